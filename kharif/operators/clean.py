"""Cleaning: crop filter, imputation, outlier capping, numeric preparation.

All operators are lazy ``DataFrame -> DataFrame`` functions.  Group
statistics (medians, quantiles, frequencies) are computed with one
aggregate per call and joined back: against a one-row frame by cross join
(size proven: one row) or on the group keys, where Catalyst / AQE choose the
strategy from the runtime size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kharif.functions.numeric import is_infinite
from kharif.operators import series
from kharif.operators.joins import null_safe_join
from kharif.operators.quantiles import group_medians, group_quantiles
from kharif.session import cut_lineage, fitted
from kharif.schema import (
    FEATURE_KEYS,
    FLAG_COLS,
    IMPUTE_KEYS,
    IMPUTE_ORDER,
    MEDIAN_FILL_COLS,
    PRICE_COLS,
    TARGET,
)

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in exclude]


def _attach(df: DataFrame, stats: DataFrame, group_keys: Sequence[str]) -> DataFrame:
    """Attach per-group statistics to every row.

    Without keys ``stats`` is a single row, so a broadcast cross join is
    bounded.  With keys the statistics are written once and Catalyst / AQE
    choose the join by their size.  The join is null-safe (a NULL key is its
    own group).
    """
    s = stats if stats.isStreaming else fitted(stats)
    if not group_keys:
        return df.crossJoin(F.broadcast(s))
    for k in group_keys:
        s = s.withColumnRenamed(k, f"__g_{k}")
    cond = None
    for k in group_keys:
        c = df[k].eqNullSafe(s[f"__g_{k}"])
        cond = c if cond is None else cond & c
    return df.join(s, cond, "left").drop(*[f"__g_{k}" for k in group_keys])


# --------------------------------------------------------------------------- P1
def filter_crop(df: DataFrame, crop: str) -> DataFrame:
    """Rows of one crop; the predicate reaches the scan when it can."""
    return df.where(F.col("crop") == F.lit(crop))


def require_crop(df: DataFrame, crop: str) -> DataFrame:
    """P1 with the reference's guard: raise, listing the crops, when empty."""
    out = filter_crop(df, crop)
    if not out.limit(1).count():
        names = df.select("crop").distinct()
        first = [r[0] for r in names.orderBy("crop").limit(20).collect()]
        raise ValueError(f"no rows for crop {crop!r}; there are {names.count()} crops, the first by name: {first}")
    return out


# ------------------------------------------------------------------ W1 A4 J7 P2 P3
def series_medians(df: DataFrame, cols: Sequence[str] = MEDIAN_FILL_COLS, series_keys: Sequence[str] = IMPUTE_KEYS, stored: bool = False) -> DataFrame:
    """A4: exact medians per series, as ``__med_{col}``."""
    return fitted(group_medians(df, cols, series_keys, stored), "series-medians")


def impute(
    df: DataFrame,
    series_keys: Sequence[str] = IMPUTE_KEYS,
    order: Sequence[str] = IMPUTE_ORDER,
    price_cols: Sequence[str] = PRICE_COLS,
    median_cols: Sequence[str] = MEDIAN_FILL_COLS,
    flag_cols: Sequence[str] = FLAG_COLS,
    zero_fill: bool = True,
    medians: DataFrame | None = None,
    stored: bool = False,
    shard_rows: int | None = None,
    cluster: Sequence[str] = FEATURE_KEYS,
) -> DataFrame:
    """Fill gaps per series.

    * prices: forward fill, then back fill, in series order (W1);
    * arrivals, rain, temperature, acreage: the series median (A4 + J7), of this
      frame or, if given, of the frame ``medians`` was fitted on;
    * flags: 0 (P2); any other numeric NULL: 0 (P3, numeric columns only).

    Rows with a NULL series key are not imputed (they belong to no series)
    and end with the zero fill.  ``stored`` says that ``df`` is a table; else it
    is written once, as medians and cuts read it too.  Large series are filled in
    time shards with carried values (``operators.series``); the exchange is on
    ``cluster`` keys, of which the series keys are a refinement.
    """
    names = df.columns
    df = df if stored else cut_lineage(df, "impute-input")
    keyed = F.lit(True)
    for k in series_keys:
        keyed = keyed & F.col(k).isNotNull()
    medians = series_medians(df, median_cols, series_keys, stored=True) if medians is None else medians
    big = series.large_series(df, cluster, shard_rows)
    parts, carry, rows = list(series_keys), [], df
    if big is not None:
        cuts = series.shard_map(df, big, cluster, order[0], shard_rows)
        rows = series.in_shards(df, cuts, cluster, order[0])
        known = series.carried(rows, big, series_keys, order, price_cols, cluster)
        rows = null_safe_join(rows.repartition(*cluster, series.SHARD), known, [*series_keys, series.SHARD], how="left")
        parts.append(series.SHARD)
        carry = ["__last_", "__first_"]
    else:
        rows = rows.repartition(*cluster)
    rows = null_safe_join(rows, medians, series_keys, how="left")
    ordered = Window.partitionBy(*parts).orderBy(*order)
    fwd = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # After the forward fill only rows before the series' first value are
    # still NULL, and their back fill is exactly that first value: a
    # whole-series frame (computed once per series, O(n)) replaces the
    # current..unbounded-following frame that Spark re-evaluates per row.
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    fills: dict[str, Column] = {}
    for c in price_cols:
        filled = F.coalesce(F.last(c, ignorenulls=True).over(fwd), *[F.col(x + c) for x in carry], F.first(c, ignorenulls=True).over(whole))
        fills[c] = F.when(keyed, filled).otherwise(F.col(c))
    for c in median_cols:
        fills[c] = F.when(keyed, F.coalesce(F.col(c), F.col(f"__med_{c}"))).otherwise(F.col(c))
    for c in flag_cols:
        fills[c] = F.coalesce(F.col(c), F.lit(0))
    out = rows.withColumns(fills).select(*names)
    return fill_zero(out) if zero_fill else out


def fill_flags(df: DataFrame, flag_cols: Sequence[str] = FLAG_COLS) -> DataFrame:
    """NULL flags become 0."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in flag_cols})


def fill_zero(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Remaining numeric NULLs become 0; strings and dates stay NULL."""
    cols = numeric_columns(df) if cols is None else list(cols)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType)) for c in cols})


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Long table (column, nulls): one aggregate over the frame."""
    cols = list(df.columns) if cols is None else list(cols)
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    return wide.selectExpr(f"stack({len(cols)}, {stack}) as (column_name, null_count)")


# --------------------------------------------------------------------------- P6
def outlier_bounds(
    df: DataFrame,
    cols: Sequence[str] = PRICE_COLS,
    group_keys: Sequence[str] = (),
    lower_q: float = 0.05,
    upper_q: float = 0.95,
    k: float = 1.5,
    approx: bool = False,
    accuracy: int = 100000,
    stored: bool = False,
) -> DataFrame:
    """Per column: q_lo - k*(q_hi-q_lo) and q_hi + k*(q_hi-q_lo).

    Exact interpolated quantiles by default (``group_quantiles``); ``approx=True``
    switches to ``percentile_approx``.  ``stored``: ``df`` is a table.
    """
    if approx:
        aggs = [F.percentile_approx(F.col(c), [lower_q, upper_q], accuracy).alias(f"__a_{c}") for c in cols]
        stats = df.groupBy(*group_keys).agg(*aggs).select(
            *group_keys, *[F.col(f"__a_{c}")[i].alias(f"__q{i}_{c}") for c in cols for i in (0, 1)]
        )
    else:
        stats = group_quantiles(df, cols, [lower_q, upper_q], group_keys, stored)
    out = [F.col(k_) for k_ in group_keys]
    for c in cols:
        lo, hi = F.col(f"__q0_{c}"), F.col(f"__q1_{c}")
        iqr = hi - lo
        out += [(lo - k * iqr).alias(f"{c}_lower"), (hi + k * iqr).alias(f"{c}_upper")]
    return stats.select(*out)


def _clip(c: str) -> Column:
    lo, hi = F.col(f"{c}_lower"), F.col(f"{c}_upper")
    return F.when(F.col(c) < lo, lo).when(F.col(c) > hi, hi).otherwise(F.col(c))


def winsorize(
    df: DataFrame,
    cols: Sequence[str] = PRICE_COLS,
    group_keys: Sequence[str] = (),
    bounds: DataFrame | None = None,
    **kw,
) -> DataFrame:
    """Cap each column to its bounds (np.clip semantics: NULL stays NULL)."""
    b = outlier_bounds(df, cols, group_keys, **kw) if bounds is None else bounds
    j = _attach(df, b, group_keys)
    bound_cols = [f"{c}_{s}" for c in cols for s in ("lower", "upper")]
    return j.withColumns({c: _clip(c) for c in cols}).drop(*bound_cols)


def winsorize_report(
    df: DataFrame, cols: Sequence[str] = PRICE_COLS, group_keys: Sequence[str] = (), **kw
) -> DataFrame:
    """Bounds and the number of capped rows per column (and group)."""
    b = outlier_bounds(df, cols, group_keys, **kw)
    j = _attach(df, b, group_keys)
    aggs = []
    for c in cols:
        lo, hi = F.col(f"{c}_lower"), F.col(f"{c}_upper")
        aggs += [
            F.first(lo).alias(f"{c}_lower"),
            F.first(hi).alias(f"{c}_upper"),
            F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(f"{c}_capped"),
        ]
    return j.groupBy(*group_keys).agg(*aggs)


# --------------------------------------------------------------------------- P7
def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Strings to double; values that do not parse become NULL."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in cols})


# --------------------------------------------------------------------------- P8
def column_medians(df: DataFrame, cols: Sequence[str], group_keys: Sequence[str] = ()) -> DataFrame:
    """Interpolated median of every column per group, all at once."""
    return group_medians(df, cols, group_keys)


def fill_median(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    group_keys: Sequence[str] = (),
    medians: DataFrame | None = None,
) -> DataFrame:
    """NULL -> column median (of the fit frame when ``medians`` is given)."""
    cols = numeric_columns(df, exclude=group_keys) if cols is None else list(cols)
    if medians is None:
        # Like the reference, only columns that have NULLs are filled: one
        # cheap count pass spares the median of every complete column.
        counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
        cols = [c for c in cols if counts[c] > 0]
        if not cols:
            return df
        medians = column_medians(df, cols, group_keys)
    j = _attach(df, medians, group_keys)
    # Whole-number columns stay whole: their median is cast.
    return j.withColumns({c: F.coalesce(F.col(c), F.col(f"__med_{c}").cast(df.schema[c].dataType)) for c in cols}).drop(
        *[f"__med_{c}" for c in cols]
    )


# --------------------------------------------------------------------------- P4
def replace_infinite(df: DataFrame, cols: Sequence[str] | None = None, value: float = 0.0) -> DataFrame:
    cols = [c for c in (numeric_columns(df) if cols is None else cols) if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(is_infinite(c), F.lit(value)).otherwise(F.col(c)) for c in cols})


# --------------------------------------------------------------------------- P5
def drop_null_target(df: DataFrame, target: str = TARGET) -> DataFrame:
    return df.where(F.col(target).isNotNull())


def require_rows(df: DataFrame, what: str = "valid target values") -> DataFrame:
    if not df.limit(1).count():
        raise ValueError(f"no {what} after processing")
    return df


# ------------------------------------------------------------------------- A9 J3
def frequency_table(df: DataFrame, col: str) -> DataFrame:
    """Share of non-NULL rows per value (value_counts(normalize=True))."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(col).alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(
        F.col(col).alias("value"), (F.col("n") / F.col("total")).alias("frequency")
    )


def frequency_encode(df: DataFrame, col: str, table: DataFrame | None = None, out: str | None = None) -> DataFrame:
    """Replace ``col`` by its frequency share; unseen or NULL -> 0."""
    t = frequency_table(df, col) if table is None else table
    out = out or col
    t = fitted(t.withColumnRenamed("value", "__fv").withColumnRenamed("frequency", "__freq"))
    j = df.join(t, df[col] == t["__fv"], "left")
    return j.withColumn(out, F.coalesce(F.col("__freq"), F.lit(0.0))).drop("__fv", "__freq")
