"""Connected components of an edge table, wholly distributed.

Alternating large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014).  Each step is one pre-aggregated
``min`` per node and one equi-join, so a node with very many neighbours is
combined on the map side and its join partition can be split by AQE; every
round ends in a written table, so a lost executor re-reads files.  Nothing but
one row of counts per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kharif.llm.common import written


def _mirrored(edges: DataFrame) -> DataFrame:
    """(u, v) in both directions, from one scan of ``edges``."""
    both = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    return edges.select(F.explode(both).alias("e")).select("e.u", "e.v")


def _large_star(edges: DataFrame) -> DataFrame:
    both = _mirrored(edges)
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    far = both.where("v > u")
    return far.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # After the large star every edge already points down (u > v).
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    low = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).union(low).distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` (u long, v long) -> (node, component = least node reachable).

    Nodes without an edge are absent.  Loops, repeated and mirrored edges and
    rows with a NULL end are allowed and ignored.  An empty table gives an
    empty result.
    """
    edges = (
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    now = written(edges, "cc")
    seen = _fingerprint(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        after = written(_small_star(_large_star(now)), "cc")
        found = _fingerprint(after)
        now = after
        if found == seen:
            break
        seen = found
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
