"""Exact top-k search: tiled products of query blocks and shards, a partial
selection in each tile, and a tree of merges of each query's lists.

Every vector becomes whole numbers floor(256 * x) first; scores are exact
integers.  Queries are dealt in blocks and candidates in shards of a bounded
number of rows, so nothing grows with the table but the number of tiles.

Defined results: vectors that are NULL, empty or hold NULL or non-finite
components take no part; vectors of different lengths are not compared; a row
repeated with its id counts once; components beyond 64 bits are cut to the
range of a long, and so are scores; equal scores go by the smaller id; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kharif.llm.common import prepare, written
from kharif.llm.tiles import BLOCK, blocks_needed, packed, usable

K = 5
SCALE = 256
#: Lists of one query that a merge takes at once.
FAN = 32


def products(queries: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Exact integer products: in double precision while every partial sum
    stays below 2 ** 53, else in whole numbers of any size."""
    most = float(np.abs(queries.astype(float)).max(initial=0)) * float(np.abs(shard.astype(float)).max(initial=0))
    if most * shard.shape[1] < 2.0**53:
        return np.rint(queries.astype(float) @ shard.astype(float).T).astype(np.int64)
    whole = queries.astype(object) @ shard.astype(object).T
    return np.clip(whole, -(2**63), 2**63 - 1).astype(np.int64)


def select(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (score falling, id rising) of one query, without itself;
    ``ids`` rise."""
    other = np.flatnonzero(ids != own)
    if len(other) > k:
        part = scores[other]
        least = np.partition(part, len(part) - k)[len(part) - k]
        above, ties = other[part > least], other[part == least]
        other = np.concatenate([above, ties[: k - len(above)]])
    order = np.lexsort((ids[other], -scores[other].astype(object) if (scores[other] == -(2**63)).any() else -scores[other]))
    return ids[other[order]], scores[other[order]]


def _tile(k: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        size = int(group["size"].iloc[0])
        side = {int(r["side"]): r for _, r in group.iterrows()}
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(side) == 2:
            qids, ids = (np.frombuffer(side[s]["id"], np.int64) for s in (0, 1))
            q, x = (np.frombuffer(side[s]["v"], np.int64).reshape(-1, size) for s in (0, 1))
            for at in range(0, len(q), 256):
                scores = products(q[at : at + 256], x)
                for n, own in enumerate(qids[at : at + 256]):
                    best, score = select(scores[n], ids, own, k)
                    out["query_id"].append(np.full(len(best), own))
                    out["vec_id"].append(best)
                    out["score"].append(score)
        empty = [np.empty(0, np.int64)]
        made = pd.DataFrame({c: np.concatenate(v or empty) for c, v in out.items()})
        made["shard"] = int(group["shard"].iloc[0])
        return made

    return run


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = K,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = SCALE,
    block: int = BLOCK,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best others of each query."""
    prepare(vectors.sparkSession)
    v = F.col(f"`{vector_col}`")
    rows = vectors.where(usable(v)).where(F.col(f"`{id_col}`").isNotNull())
    ints = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), ints.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = written(rows.withColumn("size", F.size("v")).distinct(), "search")
    n = rows.agg(F.count("*").alias("all"), F.sum(F.col("asks").cast("long")).alias("asks")).first()
    shards, asked = blocks_needed(n["all"], block), blocks_needed(n["asks"] or 0, block)
    deal = lambda count: F.pmod(F.xxhash64("id"), F.lit(count)).alias("block")
    shard = written(packed(rows.select(deal(shards), "size", "id", "v"), {"id": "long"}), "shards")
    query = written(packed(rows.where("asks").select(deal(asked), "size", "id", "v"), {"id": "long"}), "queries")
    every = lambda count, name: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).alias(name)
    left = query.select(F.lit(0).alias("side"), "size", F.col("block").alias("asked"), "id", "v", every(shards, "shard"))
    right = shard.select(F.lit(1).alias("side"), "size", F.col("block").alias("shard"), "id", "v", every(asked, "asked"))
    told = left.unionByName(right).groupBy("size", "asked", "shard")
    best = told.applyInPandas(_tile(k), "query_id long, vec_id long, score long, shard long")
    groups = shards
    while True:  # a tree of merges; each takes FAN lists of a query
        groups = -(-groups // FAN)
        best = best.withColumn("shard", F.expr(f"shard div {FAN}"))
        order = W.partitionBy("query_id", "shard").orderBy(F.desc("score"), "vec_id")
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if groups == 1:
            return best.select("query_id", "rank", "vec_id", "score")
