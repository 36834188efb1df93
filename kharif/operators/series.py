"""Series too large for one task: time shards, halos and carried values.

Windows over a series run in one task.  A series of more than ``SHARD_ROWS`` rows
is therefore cut into shards of consecutive dates.  Row-positional windows (lags,
rolling statistics) get a halo, copies of the last rows before the shard, and the
copies are dropped afterwards; fills get a carry table, the last value known
before each shard and the first of the whole series.  The cuts come from counts
per date, which are combined on the map side; the table of cuts has a row for
each date of the large series only.  A series without a cut is shard 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kharif.operators.joins import null_safe_join
from kharif.session import fitted

SHARD_ROWS = 250_000
SHARD, HALO = "__shard", "__halo"


def large_series(df: DataFrame, keys: Sequence[str], rows: int | None = None) -> DataFrame | None:
    """Keys of the series with more than ``rows`` rows, None if there is none."""
    rows = SHARD_ROWS if rows is None else rows
    big = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows).select(*keys)
    return fitted(big, "large-series") if big.take(1) else None


def shard_map(df: DataFrame, big: DataFrame, keys: Sequence[str], label: str = "date", rows: int | None = None, halo: int = 0) -> DataFrame:
    """(keys, label, shards): for every date of the large series the shards its
    rows belong to, its own (``__halo`` false) and those whose first ``halo``
    preceding rows reach back to it.  A date is never divided."""
    rows = SHARD_ROWS if rows is None else rows
    per = null_safe_join(df, big, keys, how="left_semi").groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    # One row per date of a series: bounded by the calendar.
    before = Window.partitionBy(*keys).orderBy(label).rowsBetween(Window.unboundedPreceding, -1)
    cuts = per.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    cuts = fitted(cuts.withColumn("own", F.floor(F.col("before") / rows).cast("int")), "series-cuts")
    starts = cuts.groupBy(*keys, F.col("own").alias("other")).agg(F.min("before").alias("start"))
    reach = null_safe_join(cuts, starts, keys, f"other > own and start < before + n + {int(halo)}") if halo else None
    own = F.array(F.struct(F.col("own").alias(SHARD), F.lit(False).alias(HALO)))
    if reach is None:
        return cuts.select(*keys, label, own.alias("shards"))
    reach = reach.groupBy(*keys, label).agg(F.collect_list(F.struct(F.col("other").alias(SHARD), F.lit(True).alias(HALO))).alias("others"))
    both = null_safe_join(cuts, reach, [*keys, label], how="left")
    return both.select(*keys, label, F.when(F.col("others").isNull(), own).otherwise(F.concat(own, "others")).alias("shards"))


def in_shards(df: DataFrame, cuts: DataFrame, keys: Sequence[str], label: str = "date") -> DataFrame:
    """``df`` with ``__shard`` and ``__halo``, copies for halos included."""
    none = F.array(F.struct(F.lit(0).alias(SHARD), F.lit(False).alias(HALO)))
    met = null_safe_join(df, cuts, [*keys, label], how="left")
    return met.withColumn("shards", F.explode(F.coalesce("shards", none))).select(*df.columns, f"shards.{SHARD}", f"shards.{HALO}")


def carried(df: DataFrame, big: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str], big_keys: Sequence[str]) -> DataFrame:
    """(keys, __shard, __last_c, __first_c): per shard of the large series the
    last value of each column before it, and the first of the series."""
    at = lambda c: F.when(F.col(c).isNotNull(), F.struct(*order))
    rows = null_safe_join(df, big, big_keys, how="left_semi")
    ends = rows.groupBy(*keys, SHARD).agg(*[x for c in cols for x in (F.max_by(c, at(c)).alias(f"e_{c}"), F.min_by(c, at(c)).alias(f"s_{c}"))])
    w = Window.partitionBy(*keys).orderBy(SHARD)  # one row per shard
    earlier, all_ = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return fitted(
        ends.select(*keys, SHARD, *[x for c in cols for x in (F.last(f"e_{c}", True).over(earlier).alias(f"__last_{c}"), F.first(f"s_{c}", True).over(all_).alias(f"__first_{c}"))]),
        "carried",
    )
