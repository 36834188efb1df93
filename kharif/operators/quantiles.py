"""Exact interpolated quantiles of many columns, groups and levels at once.

One algorithm for groups of any size.  First, one aggregate per group gives the
count, minimum and maximum of every column.  Then each wanted rank is narrowed:
its range of values is cut into ``BUCKETS`` buckets, one aggregate counts them
for all columns, groups and ranks together (combined on the map side, so a group
holding a third of the rows is no hot task), and the bucket that holds the rank,
with its own minimum and maximum, is the next range.  A range of at most
``FINAL_ROWS`` values, or of equal ones, is done: its values are sorted and the
rank is picked.  Nothing is sorted globally, no map of values is held and no row
reaches the driver; a round costs one pass over the needed columns.

The value at level p of n values is ``v[lo] + (h - lo) * (v[hi] - v[lo])`` with
``h = (n - 1) p``, the linear rule of ``percentile``, NumPy and DuckDB.  NULL and
NaN are left out; infinite values count as the ends of the range; a group with
no value of a column has NULL; a NULL key is a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kharif.operators.joins import null_safe_join
from kharif.session import cut_lineage, fitted

#: Buckets of a round; values of a range that are sorted at last.
BUCKETS, FINAL_ROWS = 1 << 12, 1 << 14
_MAX = 1.7976931348623157e308


def _name(c: str, i: int) -> str:
    return f"__q{i}_{c}"


def _place(v: Column, lo: Column, hi: Column, curved: bool) -> Column:
    """Bucket of a value, never falling as the value grows.  The first round
    spaces buckets by magnitude, so that far outliers do not cost rounds."""
    def flat(x: Column) -> Column:
        x = F.least(F.greatest(x, F.lit(-_MAX)), F.lit(_MAX))
        return F.signum(x) * F.log1p(F.abs(x)) if curved else x / 2

    share = (flat(v) - flat(lo)) / (flat(hi) - flat(lo))
    return F.least(F.floor(F.greatest(share, F.lit(0.0)) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")


def group_quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    group_keys: Sequence[str] = (),
    stored: bool = False,
    final_rows: int | None = None,
) -> DataFrame:
    """One row per group with ``__q{i}_{col}`` for every column and level.

    ``stored`` says that ``df`` is cheap to read again (a table); else its needed
    columns are written once."""
    final_rows = FINAL_ROWS if final_rows is None else final_rows
    keys = [f"__k{i}" for i in range(len(group_keys))]
    need = df.select(*[F.col(f"`{g}`").alias(k) for g, k in zip(group_keys, keys)], *[F.col(f"`{c}`").cast("double").alias(f"__c{i}") for i, c in enumerate(cols)])
    need = need if stored else cut_lineage(need, "quantile-input")
    value = lambda i: F.when(~F.isnan(f"__c{i}"), F.col(f"__c{i}"))

    stats = []
    for i in range(len(cols)):
        stats.append(F.struct(F.lit(i).alias("c"), F.count(value(i)).alias("n"), F.min(value(i)).alias("lo"), F.max(value(i)).alias("hi")))
    groups = need.groupBy(*keys).agg(F.array(*stats).alias("s"))
    wide_range = F.exists("s", lambda x: x["n"] > final_rows)
    if not groups.where(wide_range).take(1):
        # Nothing to narrow: every range is a whole group of a few values.
        return _picked(need.groupBy(*keys).agg(*[F.sort_array(F.collect_list(value(i))).alias(f"__all{i}") for i in range(len(cols))]), cols, probs, group_keys, keys)
    groups = fitted(groups, "quantile-groups")
    # Two ranks a level, the one below it and the next; k counts within the range that is left.
    h = lambda p: (F.col("n") - 1) * F.lit(float(p))
    part = lambda p: h(p) - F.floor(h(p))
    both = lambda j, p: [
        F.struct(F.lit(j).alias("j"), F.lit(False).alias("next"), part(p).alias("part"), F.floor(h(p)).alias("k")),
        F.struct(F.lit(j).alias("j"), F.lit(True).alias("next"), part(p).alias("part"), F.least(F.floor(h(p)) + 1, F.col("n") - 1).alias("k")),
    ]
    ranks = groups.select(*keys, F.explode("s").alias("s")).select(*keys, "s.*")
    ranks = ranks.withColumn("l", F.explode(F.array(*[x for j, p in enumerate(probs) for x in both(j, p)]))).select(*keys, "c", "n", "lo", "hi", "l.*")
    long = need.select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("c"), value(i).alias("v")) for i in range(len(cols))])).alias("x"))
    long = long.select(*keys, "x.*").where("v is not null")
    on, curved = [*keys, "c"], True
    open_ = (F.col("n") > final_rows) & (F.col("lo") < F.col("hi"))
    left = ranks.where(open_).take(1)
    while left:
        ranges = ranks.where(open_).select(*on, "lo", "hi").distinct()
        met = null_safe_join(long, ranges, on, "v >= lo and v <= hi")
        met = met.select(*on, "lo", "hi", "v", _place(F.col("v"), F.col("lo"), F.col("hi"), curved).alias("b"))
        found = met.groupBy(*on, "lo", "hi", "b").agg(F.count("*").alias("m"), F.min("v").alias("nlo"), F.max("v").alias("nhi"))
        upto = Window.partitionBy(*on, "lo", "hi").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # at most BUCKETS rows
        found = found.withColumn("before", F.coalesce(F.sum("m").over(upto), F.lit(0)))
        moved = null_safe_join(ranks, found, [*on, "lo", "hi"], "k >= before and k < before + m", "left").select(
            *on, F.coalesce("m", "n").alias("n"), F.coalesce("nlo", "lo").alias("lo"), F.coalesce("nhi", "hi").alias("hi"),
            "j", "next", "part", (F.col("k") - F.coalesce("before", F.lit(0))).alias("k"),
        )
        ranks, curved = fitted(moved, "quantile-ranks"), False
        left = ranks.where(open_).take(1)
    # What is left of each range, in order: at most FINAL_ROWS values.
    last = ranks.where("lo < hi").select(*on, "lo", "hi").distinct()
    rest = null_safe_join(long, last, on, "v >= lo and v <= hi").groupBy(*on, "lo", "hi").agg(F.sort_array(F.collect_list("v")).alias("all"))
    picked = null_safe_join(ranks, rest, [*on, "lo", "hi"], how="left")
    picked = picked.withColumn("v", F.coalesce(F.element_at("all", (F.col("k") + 1).cast("int")), "lo"))

    def told(i: int, j: int) -> list[Column]:
        own = (F.col("c") == i) & (F.col("j") == j)
        return [
            F.max(F.when(own & ~F.col("next"), F.col("v"))).alias(f"__a{j}_{i}"),
            F.max(F.when(own & F.col("next"), F.col("v"))).alias(f"__b{j}_{i}"),
            F.max(F.when(own, F.col("part"))).alias(f"__p{j}_{i}"),
        ]

    wide = picked.groupBy(*keys).agg(*[x for i in range(len(cols)) for j in range(len(probs)) for x in told(i, j)])

    def between(i: int, j: int) -> Column:
        a, b, p = (F.col(f"__{x}{j}_{i}") for x in "abp")
        # Between equal neighbours (infinite ones too) there is nothing to add.
        return F.when((a == b) | (p == 0), a).otherwise(a + p * (b - a)).alias(_name(cols[i], j))

    return wide.select(*[F.col(k).alias(g) for k, g in zip(keys, group_keys)], *[between(i, j) for i in range(len(cols)) for j in range(len(probs))])


def _picked(groups: DataFrame, cols: Sequence[str], probs: Sequence[float], group_keys: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """The levels of groups whose sorted values are at hand."""
    out = [F.col(k).alias(g) for k, g in zip(keys, group_keys)]
    for i, c in enumerate(cols):
        n = F.size(f"__all{i}")
        for j, p in enumerate(probs):
            h = (n - 1) * F.lit(float(p))
            below = F.floor(h).cast("int")
            a, b = F.get(f"__all{i}", below), F.get(f"__all{i}", F.least(below + 1, n - 1))
            out.append(F.when(n > 0, F.when((a == b) | (h == below), a).otherwise(a + (h - below) * (b - a))).alias(_name(c, j)))
    return groups.select(*out)


def group_medians(df: DataFrame, cols: Sequence[str], group_keys: Sequence[str] = (), stored: bool = False, final_rows: int | None = None) -> DataFrame:
    """Interpolated medians as ``__med_{col}`` per group."""
    q = group_quantiles(df, cols, [0.5], group_keys, stored, final_rows)
    return q.select(*group_keys, *[F.col(_name(c, 0)).alias(f"__med_{c}") for c in cols])
