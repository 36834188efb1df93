"""Roll-up of daily observations to weekly or monthly grain (A1-A3).

One hash aggregate; every measure (avg, sum, max, max_by) is partially
aggregated on the map side, so the shuffle carries at most one row per
(period, series) per input partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kharif.functions.calendar import month_end, week_ending_monday
from kharif.schema import ROLLUP_KEYS

FREQUENCIES = ("daily", "weekly", "monthly")


def _last_non_null(col: str, order: str = "date") -> Column:
    """Value of ``col`` on the latest ``order`` where it is not NULL."""
    return F.max_by(F.col(col), F.when(F.col(col).isNotNull(), F.col(order)))


def rollup_measures() -> list[Column]:
    return [
        F.avg("min_price").alias("min_price"),
        F.avg("max_price").alias("max_price"),
        F.avg("modal_price").alias("modal_price"),
        F.sum("arrival_qty").alias("arrival_qty"),
        _last_non_null("acreage_estimate").alias("acreage_estimate"),
        F.sum("rainfall_mm").alias("rainfall_mm"),
        F.avg("temp_c").alias("temp_c"),
        F.max("govt_policy_flag").alias("govt_policy_flag"),
        F.max("holiday_flag").alias("holiday_flag"),
    ]


def period_label(freq: str, date: str = "date") -> Column:
    if freq == "weekly":
        return week_ending_monday(date)
    if freq == "monthly":
        return month_end(date)
    raise ValueError(f"unknown aggregation frequency {freq!r}; use one of {FREQUENCIES}")


def rollup(df: DataFrame, freq: str = "weekly", keys: Sequence[str] = ROLLUP_KEYS) -> DataFrame:
    """A1 (weekly, W-MON labels), A2 (monthly, month-end labels), A3 (daily pass-through).

    An unknown frequency raises instead of silently returning daily rows.
    """
    if freq == "daily":
        return df
    label = period_label(freq)
    out = df.groupBy(label.alias("date"), *keys).agg(*rollup_measures())
    return out


def weekly(df: DataFrame) -> DataFrame:
    return rollup(df, "weekly")


def monthly(df: DataFrame) -> DataFrame:
    return rollup(df, "monthly")
