"""Exploratory and comparison reports.

All are aggregates over the observation or weekly table; every output is one
row per group, so nothing data-sized reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kharif.schema import TARGET
from kharif.session import fitted


# --------------------------------------------------------------------------- O1
def sort_for_output(df: DataFrame, keys: Sequence[str] = ("market", "crop", "date")) -> DataFrame:
    """Total sort at a sink: (market, crop, date) then the remaining columns."""
    rest = [c for c in df.columns if c not in keys]
    return df.orderBy(*keys, *rest)


# --------------------------------------------------------------------------- O3
def first_market(df: DataFrame, group_keys: Sequence[str] = ("crop",)) -> DataFrame:
    """The first market in sort order, per group (the notebook's sample series)."""
    return df.groupBy(*group_keys).agg(F.min("market").alias("sample_market"))


# --------------------------------------------------------------------------- A14
def price_by_date_for_sample(df: DataFrame, price: str = TARGET) -> DataFrame:
    """Mean price by date in each crop's sample market."""
    s = fitted(first_market(df).withColumnRenamed("crop", "__crop"))
    j = df.join(s, (df["crop"] == s["__crop"]) & (df["market"] == s["sample_market"])).drop("__crop", "sample_market")
    return j.groupBy("crop", "market", "date").agg(F.avg(price).alias("mean_price"))


def price_by_month(df: DataFrame, price: str = TARGET) -> DataFrame:
    return df.groupBy("crop", F.month("date").alias("month")).agg(F.avg(price).alias("mean_price"))


def price_by_state(df: DataFrame, price: str = TARGET) -> DataFrame:
    """Mean price per state, ranked ascending within the crop (the bar order)."""
    agg = df.groupBy("crop", "state").agg(F.avg(price).alias("mean_price"))
    w = Window.partitionBy("crop").orderBy("mean_price", "state")
    return agg.withColumn("position", F.row_number().over(w))


# --------------------------------------------------------------------------- A15
def histogram(df: DataFrame, col: str = TARGET, bins: int = 50, group_keys: Sequence[str] = ("crop",)) -> DataFrame:
    """Equal-width bins between min and max (the last bin closed), counts of
    non-empty bins; bin edges as columns."""
    rng = fitted(df.groupBy(*group_keys).agg(F.min(col).alias("__lo"), F.max(col).alias("__hi")))
    j = df.where(F.col(col).isNotNull()).join(rng, list(group_keys))
    width = F.col("__hi") - F.col("__lo")
    idx = F.when(width == 0, F.lit(bins // 2)).otherwise(
        F.least(F.floor((F.col(col) - F.col("__lo")) / width * bins), F.lit(bins - 1))
    )
    binned = j.withColumn("bin", (idx + 1).cast("int"))
    return binned.groupBy(*group_keys, "bin").agg(
        F.count(F.lit(1)).alias("count"),
        F.first("__lo").alias("__lo"),
        F.first("__hi").alias("__hi"),
    ).select(
        *group_keys,
        "bin",
        (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * (F.col("bin") - 1) / bins).alias("bin_start"),
        (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("bin") / bins).alias("bin_end"),
        "count",
    )


# --------------------------------------------------------------------------- A17
def crop_comparison(df: DataFrame, price: str = TARGET) -> DataFrame:
    """Per market and crop: mean, min, max, spread, coefficient of variation,
    and the crop's rank by mean price within the market."""
    agg = df.groupBy("market", "crop").agg(
        F.avg(price).alias("mean_price"),
        F.min(price).alias("min_price"),
        F.max(price).alias("max_price"),
        F.stddev_samp(price).alias("std_price"),
    )
    agg = agg.withColumns(
        {
            "spread": F.col("max_price") - F.col("min_price"),
            "cv": F.col("std_price") / F.col("mean_price"),
        }
    )
    return agg.withColumn("rank_in_market", F.rank().over(Window.partitionBy("market").orderBy(F.desc("mean_price"))))


# --------------------------------------------------------------------------- A18
def market_trend(df: DataFrame, price: str = TARGET, keys: Sequence[str] = ("market", "crop")) -> DataFrame:
    """Per series: slope of price per week (least squares), first and last
    price, change %, bullish when the last price is above the first.

    Varieties of the same date are averaged first, so first / last are
    well defined."""
    daily = df.groupBy(*keys, "date").agg(F.avg(price).alias("__p"))
    x = F.unix_date("date") / 7.0
    agg = daily.groupBy(*keys).agg(
        F.regr_slope(F.col("__p"), x).alias("slope_per_week"),
        F.min_by("__p", "date").alias("first_price"),
        F.max_by("__p", "date").alias("last_price"),
        F.count(F.lit(1)).alias("points"),
    )
    return agg.withColumns(
        {
            "change_pct": (F.col("last_price") - F.col("first_price")) / F.col("first_price") * 100.0,
            "trend": F.when(F.col("last_price") > F.col("first_price"), "bullish").otherwise("bearish"),
        }
    )
