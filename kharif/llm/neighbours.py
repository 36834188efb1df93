"""Embedding near-duplicates by PCA-ordered, tiled comparison.

Equal vectors collapse to one class first.  A rotation onto principal axes
(fitted on at most ``SAMPLE`` vectors; it only sets the order of dimensions,
never a result) puts the leading dimensions first.  Classes are cut along the
first axis into ranges and blocks of a bounded size; tiles whose ranges are
too far apart for the threshold are left out.  In a tile the products of the
leading dimensions are summed first; the rest is bounded by the product of the
suffix norms (Cauchy-Schwarz), and a pair whose bound is below the threshold
stops there.  Survivors get more dimensions, the last ones the exact cosine in
double precision from the unrotated vectors.

A tile gives, for each vector, the number of vectors it links to and one link
to the least member it reaches inside the tile, not every pair; components
come from those links.

Defined results: vectors that are NULL, empty, zero or hold NULL or non-finite
components link with nothing; vectors of different lengths never link; a row
repeated with its id counts once; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kharif.llm.common import by_hash, prepare, written
from kharif.llm.components import connected_components
from kharif.llm.simhash import _forest
from kharif.llm.tiles import BLOCK, blocks_needed, packed, usable

THRESHOLD = 0.95
#: Vectors that the rotation is fitted on, at most (fewer if very long).
SAMPLE = 4096
#: Pairs that are told exactly at once.
CHUNK = 100_000
SLACK = 1e-9


def principal_axes(sample: np.ndarray) -> np.ndarray:
    """Orthonormal axes in columns, by falling variance of the unit vectors."""
    _, axes = np.linalg.eigh(np.cov(sample.T) if len(sample) > 1 else np.eye(sample.shape[1]))
    return np.ascontiguousarray(axes[:, ::-1])


def scaled(x: np.ndarray) -> np.ndarray:
    """Vectors times powers of two (which changes no digit), so that squares of
    their components neither vanish nor overflow."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0, keepdims=True))[1])


def close_pairs(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float, same: bool):
    """Yields (i, j) arrays of the pairs whose cosine reaches the threshold;
    with ``same`` (one block against itself) only i < j."""
    d = a.shape[1]
    a, b = scaled(a), scaled(b)
    norm_a, norm_b = (np.sqrt(np.einsum("ij,ij->i", x, x)) for x in (a, b))
    ra, rb = (a / norm_a[:, None]) @ axes, (b / norm_b[:, None]) @ axes
    stops = [s for s in (16, 32, 64, 128, 256) if s < d] or [d]
    # suffix norms: what all dimensions from a stop on can add at most
    rest = [(np.sqrt(np.einsum("ij,ij->i", ra[:, s:], ra[:, s:])), np.sqrt(np.einsum("ij,ij->i", rb[:, s:], rb[:, s:]))) for s in stops]
    lead_a = np.column_stack([ra[:, : stops[0]], rest[0][0]])
    lead_b = np.ascontiguousarray(np.column_stack([rb[:, : stops[0]], rest[0][1]]).T)
    for start in range(0, len(a), 512):
        bound = lead_a[start : start + 512] @ lead_b
        i, j = np.nonzero(bound >= threshold - SLACK)
        i += start
        if same:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), CHUNK):
            p, q = i[at : at + CHUNK], j[at : at + CHUNK]
            sofar = np.einsum("ij,ij->i", ra[p, : stops[0]], rb[q, : stops[0]])
            for k, stop in enumerate(stops[1:], 1):
                sofar = sofar + np.einsum("ij,ij->i", ra[p, stops[k - 1] : stop], rb[q, stops[k - 1] : stop])
                alive = sofar + rest[k][0][p] * rest[k][1][q] >= threshold - SLACK
                p, q, sofar = p[alive], q[alive], sofar[alive]
            cosine = np.einsum("ij,ij->i", a[p], b[q]) / (norm_a[p] * norm_b[q])
            hit = cosine >= threshold
            if hit.any():
                yield p[hit], q[hit]


def _tile(axes: dict[int, np.ndarray], threshold: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        size = int(group["size"].iloc[0])
        group = group.sort_values("side")
        sides = []
        for _, row in group.iterrows():
            ids, copies = np.frombuffer(row["cid"], np.int64), np.frombuffer(row["copies"], np.int64)
            kind = np.float32 if len(row["v"]) == 4 * size * len(ids) else np.float64
            sides.append((ids, copies, np.frombuffer(row["v"], kind).reshape(len(ids), size).astype(np.float64)))
        same = len(sides) == 1
        (ids_a, n_a, a), (ids_b, n_b, b) = sides[0], sides[-1]
        shift = 0 if same else len(ids_a)
        ids = ids_a if same else np.concatenate([ids_a, ids_b])
        links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for p, q in close_pairs(a, b, axes[size], threshold, same):
            np.add.at(links, p, n_b[q])
            np.add.at(links, q + shift, n_a[p])
            label = _forest(label[p], label[q + shift], len(ids))[label]
        some = np.flatnonzero(links)
        return pd.DataFrame({"u": ids[some], "v": ids[label[some]], "n": links[some]})

    return run


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, block: int = BLOCK
) -> DataFrame:
    """One row a vector: id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    prepare(spark)
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v")).distinct()
    rows = written(rows, "vectors")
    good = rows.where(usable(F.col("v"))).where(F.exists("v", lambda x: x != 0))
    classes = good.groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("cid"), "v", F.size("v").alias("size"), "least", "copies"), "classes")
    sizes = {r["size"]: r["n"] for r in classes.groupBy("size").agg(F.count("*").alias("n")).collect()}  # vector lengths

    axes, parts = {}, []
    for size, count in sizes.items():
        own = classes.where(F.col("size") == size)
        most = max(2, min(SAMPLE, 2_000_000 // size))
        sample = own.where(by_hash(F.xxhash64("cid"), 1.2 * most / count)).select("v").limit(most).toPandas()["v"]
        x = np.stack([np.asarray(v, float) for v in sample]) if len(sample) else np.eye(size)
        x = scaled(x)
        x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        axes[size] = principal_axes(x)
        # ranges of the first axis, from the sample's quantiles
        ranges = max(1, min(64, blocks_needed(count, block)))
        cuts = np.unique(np.quantile(x @ axes[size][:, 0], np.arange(1, ranges) / ranges))
        lead = [float(w) for w in axes[size][:, 0]]
        largest = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
        unit = F.transform("v", lambda x: x.cast("double") / F.col("largest"))  # squares of tiny or huge components stay finite
        dot = F.aggregate(F.zip_with("unit", F.array(*map(F.lit, lead)), lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
        norm = F.sqrt(F.aggregate("unit", F.lit(0.0), lambda s, p: s + p * p))
        place = F.lit(0)
        for c in cuts:
            place = place + (F.col("lead") >= F.lit(float(c))).cast("int")
        own = own.withColumn("largest", largest).withColumn("unit", unit).withColumn("lead", dot / norm).drop("unit", "largest")
        parts.append(own.withColumn("range", place))
    if not parts:
        empty = F.lit(0).cast("long")
        return rows.select(F.col("id").alias(id_col), empty.alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    placed = parts[0]
    for p in parts[1:]:
        placed = placed.unionByName(p)
    placed = written(placed, "placed")
    spans = placed.groupBy("size", "range").agg(F.count("*").alias("n"), F.min("lead").alias("low"), F.max("lead").alias("high"))
    # One row a range (64 at most for each vector length); its blocks follow from its count.
    deals, tile_rows, at = [], [], 0
    for r in sorted(spans.collect(), key=lambda r: (r["size"], r["range"])):
        many = blocks_needed(r["n"], block)
        deals.append((r["size"], r["range"], at, many, r["low"], r["high"]))
        at += many
    gap = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6  # unit vectors further apart cannot link
    deal = spark.createDataFrame([d[:4] for d in deals], "size int, range int, first long, many long")
    for a in deals:
        for b in deals:
            if a[0] == b[0] and a[1] <= b[1] and (b[4] - a[5] <= gap):
                tile_rows.append((a[2], a[3], b[2], b[3]))
    blocked = placed.join(F.broadcast(deal), ["size", "range"])  # 64 rows at most for each vector length
    blocked = blocked.withColumn("block", F.col("first") + F.pmod(F.xxhash64("cid"), F.col("many")))
    blocks = written(packed(blocked, {"cid": "long", "copies": "long"}), "blocks")
    near = spark.createDataFrame(tile_rows, "a long, na long, b long, nb long")
    tiles = near.select(F.explode(F.expr("sequence(a, a + na - 1)")).alias("i"), "b", "nb").select("i", F.explode(F.expr("sequence(b, b + nb - 1)")).alias("j"))
    tiles = written(tiles.where("i <= j"), "tiles")
    left = blocks.join(tiles, blocks.block == tiles.i).drop("block").withColumn("side", F.lit(0))
    right = blocks.join(tiles.where("i < j"), blocks.block == tiles.j).drop("block").withColumn("side", F.lit(1))
    told = left.unionByName(right).groupBy("i", "j").applyInPandas(_tile(axes, threshold), "u long, v long, n long")
    told = written(told, "told")
    counts = told.groupBy("u").agg(F.sum("n").alias("n"))
    joined = connected_components(told.select("u", "v"))
    full = classes.join(counts, classes.cid == counts.u, "left").join(joined, classes.cid == joined.node, "left")
    full = written(
        full.select("v", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "cid").alias("root")),
        "linked",
    )
    roots = full.groupBy("root").agg(F.min("least").alias("component"))
    full = full.join(roots, "root").select(F.col("v").alias("w"), "n_links", "component")
    out = rows.join(full, rows.v == full.w, "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.cast("long").alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
