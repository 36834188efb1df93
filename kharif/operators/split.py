"""Horizon targets, sequences, row positions and train/test splits
(W7-W9, W11-W13).

Row positions in a global order are computed without a one-partition
window: the frame is range-sorted, tagged with ``monotonically_increasing_id``
(partition id in the high bits, position in the low bits), checkpointed to
the shared folder so the tags cannot change on recomputation, and turned
into dense positions by adding per-partition offsets (one row per partition).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kharif.schema import FEATURE_KEYS, FEATURE_ORDER, TARGET
from kharif.operators.clean import _attach
from kharif.session import cut_lineage, fitted

HORIZONS = (1, 2, 4, 12)
LOW_BITS = (1 << 33) - 1


# --------------------------------------------------------------------------- W11
def with_row_index(
    df: DataFrame,
    order: Sequence[str],
    group_keys: Sequence[str] = ("crop",),
    out: str = "row_index",
) -> DataFrame:
    """0-based position of each row within its group in ``order``; also
    adds ``group_rows`` (rows in the group).  ``order`` must be total."""
    sorted_ = df.orderBy(*group_keys, *order).withColumn("__mid", F.monotonically_increasing_id())
    tagged = cut_lineage(sorted_)
    pid = F.shiftright("__mid", 33)
    pos = F.col("__mid").bitwiseAND(F.lit(LOW_BITS))
    counts = tagged.groupBy(pid.alias("__pid")).agg(F.count(F.lit(1)).alias("__cnt"))
    # One row per partition: a global running sum over it is bounded.
    offsets = counts.select(
        "__pid",
        F.coalesce(
            F.sum("__cnt").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("__off"),
    )
    g = tagged.join(F.broadcast(offsets), pid == F.col("__pid")).withColumn("__gidx", F.col("__off") + pos)
    firsts = fitted(g.groupBy(*group_keys).agg(F.min("__gidx").alias("__first"), F.count(F.lit(1)).alias("group_rows")))
    cond = None
    fk = firsts
    for k in group_keys:
        fk = fk.withColumnRenamed(k, f"__fk_{k}")
        c = g[k].eqNullSafe(fk[f"__fk_{k}"])
        cond = c if cond is None else cond & c
    j = g.join(fk, cond) if cond is not None else g.crossJoin(fk)
    return j.withColumn(out, F.col("__gidx") - F.col("__first")).drop(
        "__mid", "__pid", "__off", "__gidx", "__first", *[f"__fk_{k}" for k in group_keys]
    )


def positional_split(
    df: DataFrame,
    order: Sequence[str] = ("market", *FEATURE_ORDER),
    group_keys: Sequence[str] = ("crop",),
    train_fraction: float = 0.8,
) -> DataFrame:
    """First int(0.8 n) rows of each group (in ``order``) are train, the rest test."""
    idx = with_row_index(df, order, group_keys)
    cut = F.floor(F.lit(train_fraction) * F.col("group_rows"))
    return idx.withColumn("split", F.when(F.col("row_index") < cut, "train").otherwise("test"))


# --------------------------------------------------------------------------- W12
def temporal_split(
    df: DataFrame, group_keys: Sequence[str] = ("crop",), train_fraction: float = 0.8, cutoff_date: str | None = None
) -> DataFrame:
    """Rows on or before the cutoff are train.  The cutoff is a fixed date or
    the interpolated ``train_fraction`` quantile of the day number per group."""
    day = F.unix_date("date")
    if cutoff_date is not None:
        return df.withColumn("split", F.when(F.col("date") <= F.to_date(F.lit(cutoff_date)), "train").otherwise("test"))
    cuts = df.groupBy(*group_keys).agg(F.percentile(day, train_fraction).alias("cutoff_day"))
    j = _attach(df, cuts, group_keys)
    return j.withColumn("split", F.when(day <= F.col("cutoff_day"), "train").otherwise("test"))


def horizon_split(long: DataFrame, train_fraction: float = 0.8, group_keys: Sequence[str] = ("crop",)) -> DataFrame:
    """Temporal split of a ``horizon_targets`` frame with a gap: rows up to the
    cutoff whose target lies after it are neither train nor test rows."""
    out = temporal_split(long, train_fraction=train_fraction, group_keys=group_keys)
    beyond = F.unix_date("target_date") > F.col("cutoff_day")
    return out.withColumn("split", F.when((F.col("split") == "train") & beyond, "gap").otherwise(F.col("split"))).drop("cutoff_day")


# --------------------------------------------------------------------------- W13
def fold_role(fold: Column, n_splits: int = 5) -> Column:
    """'train', 'test' or NULL of a row with ``row_index`` and ``group_rows``."""
    size = F.floor(F.col("group_rows") / (n_splits + 1))
    start = F.col("group_rows") - (F.lit(n_splits) - fold) * size
    return F.when(F.col("row_index") < start, "train").when(F.col("row_index") < start + size, "test")


def expanding_folds(indexed: DataFrame, n_splits: int = 5) -> DataFrame:
    """Expanding-window folds over a frame with ``row_index`` and
    ``group_rows``: test size n // (k + 1); fold i tests rows
    [n - (k - i) * size, n - (k - i - 1) * size) and trains on all rows
    before.  Rows outside both are omitted from that fold."""
    out = indexed.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    return out.withColumn("role", fold_role(F.col("fold"), n_splits)).where(F.col("role").isNotNull())


# --------------------------------------------------------------------------- W7
def horizon_targets(
    df: DataFrame,
    horizons: Sequence[int] = HORIZONS,
    target: str = TARGET,
    keys: Sequence[str] = FEATURE_KEYS,
    order: Sequence[str] = FEATURE_ORDER,
    min_rows: int = 100,
    count_keys: Sequence[str] = ("crop",),
) -> DataFrame:
    """Long frame: one row per input row and horizon h with the target h
    rows ahead in the same series and its date; rows without a future are dropped and
    (group, horizon) pairs with fewer than ``min_rows`` rows are skipped."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ahead = lambda c, h: F.lead(c, h).over(w)
    fields = lambda h: (F.lit(h).alias("horizon"), ahead(target, h).alias("target_future"), ahead("date", h).alias("target_date"))
    leads = df.select("*", *[F.struct(*fields(h)).alias(f"__lead_{h}") for h in horizons])
    arr = F.array(*[F.col(f"__lead_{h}") for h in horizons])
    long = leads.select(*df.columns, F.explode(arr).alias("__h")).select(*df.columns, "__h.*")
    long = long.where(F.col("target_future").isNotNull())
    counts = long.groupBy(*count_keys, "horizon").agg(F.count(F.lit(1)).alias("__n"))
    keep = fitted(counts.where(F.col("__n") >= min_rows).drop("__n"))
    return long.join(keep, [*count_keys, "horizon"], "left_semi")


# --------------------------------------------------------------------------- W8
def sequences(
    df: DataFrame,
    cols: Sequence[str],
    length: int = 12,
    target: str = TARGET,
    keys: Sequence[str] = FEATURE_KEYS,
    order: Sequence[str] = FEATURE_ORDER,
) -> DataFrame:
    """The ``length`` preceding rows' feature vectors (array of arrays,
    oldest first) paired with the current target; only full windows."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-length, -1)
    vec = F.array(*[F.col(c).cast("double") for c in cols])
    out = df.select(*keys, *order, F.collect_list(vec).over(w).alias("sequence"), F.col(target).alias("target"))
    return out.where(F.size("sequence") == length)


# --------------------------------------------------------------------------- W9
def latest_window(
    df: DataFrame,
    col: str = TARGET,
    length: int = 12,
    keys: Sequence[str] = FEATURE_KEYS,
    order: Sequence[str] = FEATURE_ORDER,
    strict: bool = False,
) -> DataFrame:
    """Per series, the last ``length`` values in order (oldest first) and a
    ``complete`` flag; ``strict=True`` raises when any series is short."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    ranked = df.select(*keys, *order, col, F.row_number().over(w).alias("__rn")).where(F.col("__rn") <= length)
    item = F.struct(*[F.col(c) for c in order], F.col(col).alias("__v"))
    out = ranked.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("__items"))
    out = out.select(
        *keys,
        F.transform("__items", lambda s: s["__v"]).alias("values"),
        F.size("__items").alias("points"),
    ).withColumn("complete", F.col("points") == length)
    if strict:
        short = out.where(~F.col("complete")).limit(1).collect()
        if short:
            raise ValueError(f"series {short[0][:len(keys)]} is shorter than the window of {length} rows")
    return out
