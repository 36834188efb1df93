"""Forecast requests: normalisation, validation, lookups, weekly forecast
rows with bands, fallback, headline and response nesting.

Requests are a table (or a stream) instead of HTTP calls.  Every request
expands to at most 12 weekly rows, so per-request windows and nesting are
bounded; the only data-sized join is the as-of lookup, done as equi-joins on
(series, week bucket) so a busy series never lands in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kharif.functions import pricing
from kharif.functions.numeric import round_half_up
from kharif.sources import dims

REQUEST_COLS = ("request_id", "market", "state", "crop", "variety", "horizon_weeks", "as_of_date")


# --------------------------------------------------------------------------- P10
def normalise_requests(df: DataFrame) -> DataFrame:
    """Trim text fields, lower-case the crop, keep the date as trimmed text."""
    return df.withColumns(
        {
            "market": F.trim("market"),
            "state": F.trim("state"),
            "crop": F.lower(F.trim("crop")),
            "variety": F.trim("variety"),
            "as_of_date": F.trim(F.col("as_of_date").cast("string")),
        }
    )


# --------------------------------------------------------------------------- P11
def validate_requests(df: DataFrame, run_date: str) -> DataFrame:
    """Apply defaults and the request rules; adds ``as_of`` (date),
    ``status`` ('accepted' / 'rejected') and ``reason``.

    Defaults: crop 'rice', variety 'PR 126', horizon 4.  Rules: market and
    state present; horizon in (1, 2, 4, 12); date 'yyyy-M-d' (unpadded month
    and day accepted, like the reference's parser); the literal 'string'
    means the run date.
    """
    horizon = F.coalesce(F.col("horizon_weeks"), F.lit(dims.DEFAULT_HORIZON))
    raw_date = F.col("as_of_date")
    parsed = F.when(raw_date == "string", F.to_date(F.lit(run_date))).otherwise(F.try_to_date(raw_date, "yyyy-M-d"))
    reason = F.concat_ws(
        ",",
        F.when(F.col("market").isNull() | (F.col("market") == ""), F.lit("missing_market")),
        F.when(F.col("state").isNull() | (F.col("state") == ""), F.lit("missing_state")),
        F.when(~horizon.isin(*dims.ALLOWED_HORIZONS), F.lit("bad_horizon")),
        F.when(parsed.isNull(), F.lit("bad_date")),
    )
    out = df.withColumns(
        {
            "crop": F.coalesce(F.col("crop"), F.lit(dims.DEFAULT_CROP)),
            "variety": F.coalesce(F.col("variety"), F.lit(dims.DEFAULT_VARIETY)),
            "horizon_weeks": horizon.cast("int"),
            "as_of": parsed,
            "reason": F.when(reason == "", F.lit(None).cast("string")).otherwise(reason),
        }
    )
    return out.withColumn("status", F.when(F.col("reason").isNull(), "accepted").otherwise("rejected"))


def accepted(df: DataFrame) -> DataFrame:
    return df.where(F.col("status") == "accepted")


def rejected(df: DataFrame) -> DataFrame:
    return df.where(F.col("status") == "rejected")


# ------------------------------------------------------------------- J4 J5 J6 P14
def with_price_anchors(df: DataFrame) -> DataFrame:
    """Rule base price (crop base x market multiplier) and serving base price
    (market base x crop multiplier), defaults for unknown keys (J4)."""
    spark = df.sparkSession
    cp = F.broadcast(dims.crop_price(spark).select(F.col("crop").alias("__c"), F.col("base_price").alias("__cb"), F.col("volatility").alias("volatility")))
    mp = F.broadcast(dims.market_price(spark).select(F.col("market").alias("__m"), F.col("multiplier").alias("__mm")))
    sm = F.broadcast(dims.serving_market_base(spark).select(F.col("market").alias("__sm"), F.col("base_price").alias("__sb")))
    sc = F.broadcast(dims.serving_crop_multiplier(spark).select(F.col("crop").alias("__sc"), F.col("multiplier").alias("__scm")))
    j = (
        df.join(cp, df["crop"] == cp["__c"], "left")
        .join(mp, df["market"] == mp["__m"], "left")
        .join(sm, df["market"] == sm["__sm"], "left")
        .join(sc, df["crop"] == sc["__sc"], "left")
    )
    return j.withColumns(
        {
            "rule_base_price": F.coalesce("__cb", F.lit(dims.DEFAULT_BASE_PRICE)) * F.coalesce("__mm", F.lit(dims.DEFAULT_MULTIPLIER)),
            "serving_base_price": F.coalesce("__sb", F.lit(dims.SERVING_DEFAULT_BASE)) * F.coalesce("__scm", F.lit(1.0)),
            "volatility": F.coalesce("volatility", F.lit(dims.DEFAULT_VOLATILITY)),
        }
    ).drop("__c", "__cb", "__m", "__mm", "__sm", "__sb", "__sc", "__scm")


def with_market_info(df: DataFrame) -> DataFrame:
    """Market dimension: state, region, major crops as text, and whether the
    requested crop is one of them (J5, J6)."""
    md = F.broadcast(
        dims.market_dim(df.sparkSession).select(
            F.col("market").alias("__m"), F.col("state").alias("market_state"), "region", "major_crops"
        )
    )
    j = df.join(md, df["market"] == md["__m"], "left").drop("__m")
    return j.withColumns(
        {
            "major_crops_text": F.array_join("major_crops", ", "),
            "is_major_crop": F.coalesce(F.array_contains("major_crops", F.col("crop")), F.lit(False)),
        }
    ).drop("major_crops")


def with_volatility_class(df: DataFrame) -> DataFrame:
    """Crop volatility (default 0.1) and its class."""
    cp = F.broadcast(dims.crop_price(df.sparkSession).select(F.col("crop").alias("__c"), F.col("volatility").alias("__v")))
    j = df.join(cp, df["crop"] == cp["__c"], "left")
    v = F.coalesce("__v", F.lit(dims.DEFAULT_VOLATILITY))
    return j.withColumns({"volatility": v, "volatility_class": pricing.volatility_class(v)}).drop("__c", "__v")


# --------------------------------------------------------------------------- J8
def last_per_date(df: DataFrame, keys: Sequence[str], date: str, cols: Sequence[str], tiebreak: Sequence[str]) -> DataFrame:
    """One row per (keys, date): the last row in ``tiebreak`` order."""
    picked = F.max_by(F.struct(*cols), F.struct(*tiebreak)).alias("__row")
    return df.groupBy(*keys, date).agg(picked).select(*keys, date, "__row.*")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_date: str,
    right_date: str,
    bucket_days: int = 7,
) -> DataFrame:
    """For every left row, the right row with the greatest ``right_date`` <=
    ``left_date`` among rows with equal keys (``right`` must be unique per
    (keys, right_date)).  Left rows without one get NULLs.

    Each right row is valid from its date until the next date of its series.
    Finite validity intervals are exploded into ``bucket_days`` buckets and
    equi-joined on (keys, bucket) with a range check; the open interval of
    each series' last row is joined on the keys alone.  No pairwise blow-up,
    and a hot series is spread over its buckets.
    """
    w = Window.partitionBy(*keys).orderBy(right_date)
    rcols = [c for c in right.columns if c not in keys]
    iv = right.select(*keys, *rcols, F.lead(right_date).over(w).alias("__to"))

    def bucket(c):
        return F.floor(F.unix_date(c) / float(bucket_days))

    r = {c: f"__r_{c}" for c in [*keys, *rcols]}
    finite = iv.where(F.col("__to").isNotNull()).select(
        *[F.col(c).alias(r[c]) for c in [*keys, *rcols]],
        F.col("__to"),
        F.explode(F.sequence(bucket(right_date), bucket(F.date_sub("__to", 1)))).alias("__b"),
    )
    tail = iv.where(F.col("__to").isNull()).select(*[F.col(c).alias(f"__t_{c}") for c in [*keys, *rcols]])

    lb = left.withColumn("__lb", bucket(left_date))
    cond = (lb["__lb"] == finite["__b"]) & (finite[r[right_date]] <= lb[left_date]) & (lb[left_date] < finite["__to"])
    for k in keys:
        cond = cond & (lb[k] == finite[r[k]])
    m1 = lb.join(finite, cond, "left")
    tcond = F.col(f"__t_{right_date}") <= F.col(left_date)
    for k in keys:
        tcond = tcond & (F.col(k) == F.col(f"__t_{k}"))
    m2 = m1.join(tail, tcond, "left")
    out = m2.select(
        *left.columns,
        *[F.coalesce(F.col(r[c]), F.col(f"__t_{c}")).alias(c if c not in left.columns else f"right_{c}") for c in rcols],
    )
    return out


def asof_features(
    requests: DataFrame,
    feature_rows: DataFrame,
    cols: Sequence[str],
    keys: Sequence[str] = ("market", "crop"),
    tiebreak: Sequence[str] = ("variety", "state", "district"),
) -> DataFrame:
    """Latest feature row at or before each request's ``as_of`` per (market, crop)."""
    right = last_per_date(feature_rows, keys, "date", cols, tiebreak).withColumnRenamed("date", "feature_date")
    return asof_join(requests, right, keys, "as_of", "feature_date")


# ------------------------------------------------------------------ F4 F5 F6
def forecast_weeks(df: DataFrame) -> DataFrame:
    """One row per request and week k = 1..horizon, date = as_of + 7k."""
    return df.withColumn("week", F.explode(F.sequence(F.lit(1), F.col("horizon_weeks")))).withColumn(
        "forecast_date", F.date_add("as_of", F.col("week") * 7)
    )


def _model_exprs(anchor: str) -> dict:
    """Weekly price from the anchor with the seasonal factor of the forecast
    month, price band and confidence interval."""
    price = pricing.seasonal_price(F.col(anchor), F.month("forecast_date"))
    lo, hi = pricing.price_band(price)
    return {
        "modal_price": price, "min_price": lo, "max_price": hi,
        "confidence_interval": pricing.confidence_interval(price, F.col("horizon_weeks")),
    }


def _rule_exprs() -> dict:
    """Rule-based forecast (needs ``rule_base_price`` and ``volatility``)."""
    modal = pricing.rule_step_price(F.col("rule_base_price"), F.col("week") - 1)
    lo, hi = pricing.rule_band(modal, F.col("volatility"))
    return {
        "modal_price": round_half_up(modal, 2), "min_price": round_half_up(lo, 2), "max_price": round_half_up(hi, 2),
        "confidence_interval": F.lit(None).cast("struct<lower:double,upper:double>"),
    }


def model_rows(df: DataFrame, anchor: str = "anchor_price") -> DataFrame:
    return df.withColumns(_model_exprs(anchor))


# --------------------------------------------------------------------------- F7
def rule_rows(df: DataFrame) -> DataFrame:
    return df.withColumns(_rule_exprs())


# -------------------------------------------------------------------------- J10
def with_fallback(df: DataFrame, anchor: str = "anchor_price") -> DataFrame:
    """Rows with a model anchor use it; the others get the rule forecast,
    flagged in ``source``.  One projection with per-row conditionals, so the
    upstream plan (requests, as-of join) runs once."""
    has = F.col(anchor).isNotNull()
    m, r = _model_exprs(anchor), _rule_exprs()
    cols = {k: F.when(has, m[k]).otherwise(r[k]) for k in m}
    cols["source"] = F.when(has, F.lit("model")).otherwise(F.lit("rule"))
    return df.withColumns(cols)


# -------------------------------------------------------------------------- W10
def with_pct_change(df: DataFrame, key: str = "request_id", order: str = "week", price: str = "modal_price") -> DataFrame:
    """Week-over-week % change within a request; the first week is 0."""
    prev = F.lag(price).over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("price_change_pct", F.coalesce((F.col(price) - prev) / prev * 100.0, F.lit(0.0)))


# -------------------------------------------------------------------------- A16
def headline(df: DataFrame, key: str = "request_id", price: str = "modal_price") -> DataFrame:
    """First, last, total % change, mean, population std, peak and trough
    week (ties go to the earliest week)."""
    p = F.col(price)
    return df.groupBy(key).agg(
        F.min_by(p, F.col("week")).alias("first_price"),
        F.max_by(p, F.col("week")).alias("last_price"),
        F.avg(p).alias("mean_price"),
        F.stddev_pop(p).alias("std_price"),
        F.min_by(F.col("week"), F.struct(-p, F.col("week"))).alias("peak_week"),
        F.min_by(F.col("week"), F.struct(p, F.col("week"))).alias("trough_week"),
    ).withColumn("total_change_pct", (F.col("last_price") - F.col("first_price")) / F.col("first_price") * 100.0)


# -------------------------------------------------------------------------- A19
def spread_stats(df: DataFrame, key: str = "request_id", price: str = "modal_price") -> DataFrame:
    """Spread of a request's forecast under honest names (0.7 sd, 0.5 sd,
    sd / mean in %, horizon-based confidence) and its class (P13)."""
    # The std is snapped to 1e-9 before scaling: summation order (partitioning,
    # engine) moves it by an ulp, which would flip the 2-decimal rounding at ties.
    sd = round_half_up(F.stddev_pop(price), 9)
    out = df.groupBy(key, "horizon_weeks").agg(
        round_half_up(sd * 0.7, 2).alias("sd_x07"),
        round_half_up(sd * 0.5, 2).alias("sd_x05"),
        round_half_up(sd / F.avg(price) * 100.0, 2).alias("cv_pct"),
    )
    conf = round_half_up(0.9 - F.col("horizon_weeks") * 0.03, 2)
    return out.withColumns({"confidence": conf, "confidence_class": pricing.confidence_class(conf * 100.0)})


# -------------------------------------------------------------------------- A20
def nest_response(df: DataFrame, key_cols: Sequence[str] = ("request_id", "market", "crop", "horizon_weeks")) -> DataFrame:
    """One row per request with its weekly rows sorted by date."""
    item = F.struct(
        F.col("week"),
        F.date_format("forecast_date", "yyyy-MM-dd").alias("date"),
        F.col("modal_price"),
        F.col("min_price"),
        F.col("max_price"),
        F.col("confidence_interval"),
    )
    return df.groupBy(*key_cols).agg(F.sort_array(F.collect_list(item)).alias("predictions"))
