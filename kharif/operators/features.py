"""Feature operators: calendar, harvest flag, lags, rolling statistics,
encoders, scaler, feature selection and summary.

Lags and rolling statistics are window functions over one shared
``WindowSpec`` (series keys, total order), emitted in a single ``select`` so
the plan has one exchange and one sort for all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kharif.functions.calendar import calendar_columns, month_cos, month_sin
from kharif.operators import series
from kharif.operators.clean import NUMERIC_TYPES, _attach
from kharif.session import cut_lineage, fitted
from kharif.schema import FEATURE_KEYS, FEATURE_ORDER, TARGET
from kharif.sources import dims

LAGS = (1, 2, 4, 12)
ROLLING_WINDOWS = (4, 12)
TIME_FEATURES = (
    "year", "month", "quarter", "week_of_year", "day_of_week",
    "is_harvest_month", "month_sin", "month_cos",
)
BASIC_FEATURES = ("arrival_qty", "acreage_estimate", "rainfall_mm", "temp_c", "govt_policy_flag", "holiday_flag")
FEATURE_PREFIXES = ("lag_", "rolling_", "arrival_")
FEATURE_INFIXES = ("encoded", "variety_")


def series_window(keys: Sequence[str] = FEATURE_KEYS, order: Sequence[str] = FEATURE_ORDER):
    return Window.partitionBy(*keys).orderBy(*order)


# ------------------------------------------------------------------ F1 F2 F3 J1
def add_harvest_flag(df: DataFrame, month_col: str = "month") -> DataFrame:
    """1 when (crop, month) is a harvest month, unknown crop -> 0."""
    cal = F.broadcast(dims.harvest_calendar(df.sparkSession).withColumn("__hv", F.lit(1)))
    cal = cal.withColumnRenamed("crop", "__hc").withColumnRenamed("month", "__hm")
    j = df.join(cal, (df["crop"] == cal["__hc"]) & (df[month_col] == cal["__hm"]), "left")
    return j.withColumn("is_harvest_month", F.coalesce(F.col("__hv"), F.lit(0))).drop("__hc", "__hm", "__hv")


def add_time_features(df: DataFrame, date: str = "date") -> DataFrame:
    """year, month, quarter, ISO week, Monday-0 weekday, harvest flag, cyclic month."""
    out = df.select("*", *calendar_columns(date))
    out = add_harvest_flag(out)
    return out.withColumns({"month_sin": month_sin("month"), "month_cos": month_cos("month")})


# ------------------------------------------------------------------ W2 - W6
def lag_columns(target: str = TARGET, lags: Sequence[int] = LAGS, window=None) -> list[Column]:
    w = window or series_window()
    cols = []
    for n in lags:
        cols.append(F.lag(target, n).over(w).alias(f"lag_{n}"))
        cols.append(F.lag("arrival_qty", n).over(w).alias(f"arrival_lag_{n}"))
    return cols


def rolling_columns(
    target: str = TARGET, windows: Sequence[int] = ROLLING_WINDOWS, window=None, exclude_current: bool = False
) -> list[Column]:
    """Rolling mean / sample std of the target and rolling mean of arrivals.

    Partial windows are allowed (min_periods=1).  By default the frame ends at
    the current row, as in the reference (the target leaks into its own
    feature); ``exclude_current=True`` ends it one row earlier.
    """
    w = window or series_window()
    cols = []
    for n in windows:
        frame = w.rowsBetween(-n, -1) if exclude_current else w.rowsBetween(-(n - 1), 0)
        cols += [
            F.avg(target).over(frame).alias(f"rolling_mean_{n}"),
            F.stddev_samp(target).over(frame).alias(f"rolling_std_{n}"),
            F.avg("arrival_qty").over(frame).alias(f"arrival_rolling_mean_{n}"),
        ]
    return cols


def add_series_features(
    df: DataFrame,
    target: str = TARGET,
    lags: Sequence[int] = LAGS,
    windows: Sequence[int] = ROLLING_WINDOWS,
    keys: Sequence[str] = FEATURE_KEYS,
    order: Sequence[str] = FEATURE_ORDER,
    exclude_current: bool = False,
    sizes_from: DataFrame | None = None,
    shard_rows: int | None = None,
) -> DataFrame:
    """All lag and rolling features in one window pass.

    Large series are windowed in time shards with a halo as long as the longest
    lag or window (``operators.series``).  ``sizes_from`` is a table with the same
    keys and no fewer rows a series, from which to tell whether there are any."""
    big = series.large_series(df if sizes_from is None else sizes_from, keys, shard_rows)
    names, parts, own = df.columns, list(keys), F.lit(True)
    if big is not None:
        df = cut_lineage(df, "periodic")
        cuts = series.shard_map(df, big, keys, order[0], shard_rows, halo=max([*lags, *windows]))
        df = series.in_shards(df, cuts, keys, order[0]).repartition(*keys, series.SHARD)
        parts, own = [*parts, series.SHARD], ~F.col(series.HALO)
    w = series_window(parts, order)
    out = df.select("*", *lag_columns(target, lags, w), *rolling_columns(target, windows, w, exclude_current))
    return out.where(own).drop(series.SHARD, series.HALO) if big is not None else out.select(*names, *out.columns[len(names):])


# ------------------------------------------------------------------ A7 J2
def fit_target_encoder(
    df: DataFrame,
    col: str,
    target: str = TARGET,
    group_keys: Sequence[str] = ("crop",),
    min_samples_leaf: int = 20,
    smoothing: float = 10.0,
) -> DataFrame:
    """Smoothed target means per category.

    prior = mean(target); w = 1 / (1 + exp(-(n - min_samples_leaf) / smoothing));
    code = prior * (1 - w) + mean * w.  One row per (group, category) plus the
    group's prior, so unseen categories can fall back to it.
    """
    # One aggregate: per (group, category) count and mean of the target; the
    # group prior is rebuilt from the same partial sums (NULL categories
    # count towards the prior only), so the fit is a single job.
    stats = df.where(F.col(target).isNotNull()).groupBy(*group_keys, col).agg(
        F.count(F.lit(1)).alias("n"), F.sum(target).alias("__sum"), F.avg(target).alias("mean")
    )
    s = fitted(stats)
    w = Window.partitionBy(*group_keys) if group_keys else Window.partitionBy(F.lit(0))
    s = s.withColumn("prior", F.sum("__sum").over(w) / F.sum("n").over(w)).where(F.col(col).isNotNull())
    weight = 1.0 / (1.0 + F.exp(-(F.col("n") - min_samples_leaf) / smoothing))
    return s.select(
        *group_keys, F.col(col).alias("category"), "n", "prior",
        (F.col("prior") * (1.0 - weight) + F.col("mean") * weight).alias("code"),
    )


def apply_target_encoder(
    df: DataFrame, col: str, encoder: DataFrame, group_keys: Sequence[str] = ("crop",), out: str | None = None
) -> DataFrame:
    """Left join the codes; unseen or NULL category -> the group prior."""
    out = out or f"{col}_encoded"
    enc = fitted(encoder)
    codes = enc.select(*[F.col(k).alias(f"__k_{k}") for k in group_keys], F.col("category").alias("__cat"), F.col("code").alias("__code"))
    priors = enc.select(*group_keys, "prior").dropDuplicates(list(group_keys)) if group_keys else enc.select("prior").limit(1)
    priors = priors.withColumnRenamed("prior", "__prior")
    cond = df[col] == codes["__cat"]
    for k in group_keys:
        cond = cond & df[k].eqNullSafe(codes[f"__k_{k}"])
    j = df.join(codes, cond, "left").drop(*[f"__k_{k}" for k in group_keys], "__cat")
    j = _attach(j, priors, group_keys)
    return j.withColumn(out, F.coalesce(F.col("__code"), F.col("__prior"))).drop("__code", "__prior")


# ------------------------------------------------------------------ A8 M1
def category_vocabulary(df: DataFrame, col: str = "variety") -> DataFrame:
    """Sorted distinct non-NULL values."""
    return df.where(F.col(col).isNotNull()).select(col).distinct().orderBy(col)


def collect_vocabulary(df: DataFrame, col: str = "variety") -> list[str]:
    """Vocabulary for wide one-hot columns, an explicit choice of the caller:
    column names must be known when the plan is built, so the distinct values
    come to the driver.  ``one_hot_vector`` has no such need."""
    return [r[0] for r in category_vocabulary(df, col).collect()]


def fit_one_hot_vector(df: DataFrame, col: str = "variety"):
    """Fitted indexer and encoder for one sparse 0/1 vector column of any
    width; values by name, unknown and NULL ones all zero.  Can be saved."""
    index = StringIndexer(inputCol=col, outputCol=f"{col}_index", handleInvalid="keep", stringOrderType="alphabetAsc")
    # "keep" files unknown values last, and dropLast leaves that place out.
    vector = OneHotEncoder(inputCol=f"{col}_index", outputCol=f"{col}_onehot", dropLast=True)
    return Pipeline(stages=[index, vector]).fit(df)


def one_hot_vector(df: DataFrame, fitted_encoder, col: str = "variety") -> DataFrame:
    return fitted_encoder.transform(df).drop(f"{col}_index")


def one_hot(df: DataFrame, col: str, vocabulary: Sequence[str], prefix: str | None = None) -> DataFrame:
    """One 0/1 double column per category, ``<col>_<value>``; unknown -> all 0."""
    prefix = prefix or f"{col}_"
    return df.withColumns(
        {f"{prefix}{v}": F.when(F.col(col) == F.lit(v), 1.0).otherwise(0.0) for v in vocabulary}
    )


# ------------------------------------------------------------------ P9
def feature_columns(df: DataFrame) -> list[str]:
    """Feature columns in frame order: the fixed lists plus prefix/infix
    matches, numeric only, each name once."""
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)}
    def wanted(c: str) -> bool:
        return (
            c in TIME_FEATURES
            or c in BASIC_FEATURES
            or c.startswith(FEATURE_PREFIXES)
            or any(s in c for s in FEATURE_INFIXES)
        )
    return [c for c in df.columns if wanted(c) and c in numeric]


def select_features(df: DataFrame, keep: Sequence[str] = (), target: str = TARGET) -> DataFrame:
    cols = feature_columns(df)
    return df.select(*keep, *cols, target)


# ------------------------------------------------------------------ A10
def feature_summary(df: DataFrame, cols: Sequence[str], target: str = TARGET) -> DataFrame:
    """Per column: mean, sample std, min, max, NULL count; target last.

    One wide aggregate, then ``stack`` to long form (column, stat columns).
    """
    names = list(cols) + [target]
    aggs = []
    for i, c in enumerate(names):
        aggs += [
            F.avg(c).alias(f"m{i}"), F.stddev_samp(c).alias(f"s{i}"),
            F.min(F.col(c).cast("double")).alias(f"lo{i}"), F.max(F.col(c).cast("double")).alias(f"hi{i}"),
            F.count_if(F.col(c).isNull()).alias(f"n{i}"),
        ]
    wide = df.agg(*aggs)
    parts = ", ".join(
        f"'{c}', {'true' if c == target else 'false'}, m{i}, s{i}, lo{i}, hi{i}, n{i}" for i, c in enumerate(names)
    )
    return wide.selectExpr(
        f"stack({len(names)}, {parts}) as (column_name, is_target, mean, std, min, max, null_count)"
    )


# ------------------------------------------------------------------ A11 M2
def fit_scaler(df: DataFrame, cols: Sequence[str], group_keys: Sequence[str] = ()) -> DataFrame:
    """Mean and population std per column (one aggregate)."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"__mean_{c}"), F.stddev_pop(c).alias(f"__sd_{c}")]
    return df.groupBy(*group_keys).agg(*aggs)


def apply_scaler(df: DataFrame, cols: Sequence[str], scaler: DataFrame, group_keys: Sequence[str] = ()) -> DataFrame:
    """(x - mean) / sd; a zero-variance column is divided by 1."""
    j = _attach(df, scaler, group_keys)
    scaled = {}
    for c in cols:
        sd = F.col(f"__sd_{c}")
        scaled[c] = (F.col(c) - F.col(f"__mean_{c}")) / F.when(sd.isNull() | (sd == 0), 1.0).otherwise(sd)
    drop = [f"__{s}_{c}" for c in cols for s in ("mean", "sd")]
    return j.withColumns(scaled).drop(*drop)


def scaler_table(scaler: DataFrame, cols: Sequence[str], group_keys: Sequence[str] = ()) -> DataFrame:
    """Long form (group..., column_name, mean, std)."""
    parts = ", ".join(f"'{c}', `__mean_{c}`, `__sd_{c}`" for c in cols)
    return scaler.selectExpr(*[f"`{k}`" for k in group_keys], f"stack({len(cols)}, {parts}) as (column_name, mean, std)")
