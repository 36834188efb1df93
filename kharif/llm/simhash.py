"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint bit is 1 if more than half of the shingle hashes (XXH64, seed
42) have it.  Documents with one fingerprint collapse to one row first.  The
bits are then grouped into ``m`` partitions, correlated bits together; if two
fingerprints differ in at most ``tau`` bits and the partition thresholds sum to
``tau - m + 1``, at least one partition differs by no more than its own
threshold (-1: partition not used).  A dynamic programme picks ``m`` and the
thresholds of the least estimated cost.  Every fingerprint is filed under its
own value of each used partition and probes with all values within the
threshold; the members of a bucket are compared in blocks and only a spanning
forest of the links found leaves the bucket, so a group of near copies never
turns into all its pairs.  Buckets above ``BLOCK`` members are dealt out as
tiles of blocks.

Defined results: NULL text counts as empty (fingerprint zero, linked like any
other); a NULL id is never the representative unless its group has no other;
repeated rows each get the same component; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kharif.llm.common import by_hash, fresh, prepare, written
from kharif.llm.components import connected_components

SHINGLE = 4
TAU = 4
#: Members of a bucket compared in one block; larger buckets become tiles.
BLOCK = 4096
#: Fingerprints from which correlations and candidate counts are estimated.
SAMPLE = 4096


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of one whole text as an unsigned number."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # ASCII letters, ASCII white space
    if not words:
        return 0
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return hashed(joined, 42)
    ends = [e + i for i, e in enumerate(accumulate(map(len, words)))]
    starts = [0, *(e + 1 for e in ends)]
    hashes = np.array([hashed(joined[s:e], 42) for s, e in zip(starts, ends[shingle - 1 :])], dtype="<u8")
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(0, dtype=np.int64)
    majority = (total * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(majority, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): one row a document, ``fp`` the fingerprint as a signed long."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return rows.mapInArrow(hashed, T.StructType([rows.schema["id"], T.StructField("fp", T.LongType())]))


# --- planning: partitions and thresholds from a bounded sample -----------------


@dataclass(frozen=True)
class Plan:
    bits: tuple[tuple[int, ...], ...]  # bits of each partition
    limits: tuple[int, ...]  # threshold of each partition, -1: unused


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.view(np.uint64).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """64 bits in ``parts`` groups of nearly equal size, each grown from a free
    bit by always adding the free bit most correlated with the group."""
    if len(sample) > 1:
        x = _bits(sample).astype(float)
        x -= x.mean(0)
        spread = np.sqrt((x * x).sum(0))
        corr = np.abs(x.T @ x) / np.maximum(np.outer(spread, spread), 1e-12)
    else:
        corr = np.zeros((64, 64))
    free, out = list(range(64)), []
    for k in range(parts):
        group = [free.pop(0)]
        for _ in range(len(free) // (parts - k) if k < parts - 1 else len(free)):
            if k < parts - 1 and len(group) >= (64 + parts - 1 - k) // parts:
                break
            best = max(free, key=lambda b: (corr[b, group].sum(), -b))
            free.remove(best)
            group.append(best)
        out.append(sorted(group))
    return out


def _ball(width: int, radius: int) -> int:
    out, term = 0, 1
    for d in range(radius + 1):
        out += term
        term = term * (width - d) // (d + 1)
    return out


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, tuple[int, ...]]:
    """Thresholds with the given sum and the least summed cost: a dynamic
    programme over partitions and the sum so far."""
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for cost in costs:
        after: dict[int, tuple[float, tuple[int, ...]]] = {}
        for used, (sofar, chosen) in best.items():
            for limit, c in cost.items():
                key, value = used + limit, (sofar + c, (*chosen, limit))
                if key not in after or value < after[key]:
                    after[key] = value
        best = after
    return best.get(total, (float("inf"), ()))


def plan(sample: np.ndarray, count: int, tau: int = TAU) -> Plan:
    """Partitions and thresholds of the least estimated work for ``count``
    distinct fingerprints: probe rows to shuffle plus pairs to compare."""
    best: tuple[float, Plan] | None = None
    for parts in range(1, tau + 2):
        groups = group_bits(sample, parts)
        costs = []
        for bits in groups:
            width = len(bits)
            value = _bits(sample)[:, bits].astype(np.float32) if len(sample) else np.zeros((0, width), np.float32)
            near = np.zeros(width + 1)
            for at in range(0, len(value), 512):  # distances of the sample's pairs within the partition
                block = value[at : at + 512]
                apart = block.sum(1)[:, None] + value.sum(1)[None, :] - 2 * block @ value.T
                near += np.bincount(np.rint(apart).astype(int).ravel(), minlength=width + 1)[: width + 1]
            if len(value):
                near[0] -= len(value)
            pairs = max(len(value) * (len(value) - 1), 1)
            cost = {-1: 0.0}
            for limit in range(tau - parts + 2):
                seen = near[: limit + 1].sum() / pairs
                even = _ball(width, limit) / 2.0**width
                cost[limit] = count * _ball(width, limit) + 0.02 * max(seen, even) * count * count / 2
            costs.append(cost)
        cost, limits = allocate(costs, tau - parts + 1)
        if limits and (best is None or cost < best[0]):
            best = cost, Plan(tuple(map(tuple, groups)), limits)
    return best[1]


# --- probing and verifying -------------------------------------------------------


def _mask(bits: tuple[int, ...]) -> int:
    return sum(1 << b for b in bits)


def signatures(fps: DataFrame, chosen: Plan) -> DataFrame:
    """(part, value, fp, own): the bucket of a fingerprint in each used
    partition (own) and the buckets that it probes."""
    used = [(k, b, t) for k, (b, t) in enumerate(zip(chosen.bits, chosen.limits)) if t >= 0]
    flips = []
    for k, bits, limit in used:
        masks = [sum(1 << bits[i] for i in c) for d in range(limit + 1) for c in combinations(range(len(bits)), d)]
        flips.append((k, np.uint64(_mask(bits)), np.array(masks, np.uint64)))

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                fp = whole.column(0).slice(at, 1000).to_numpy(zero_copy_only=False).view(np.uint64)
                for k, mask, flip in flips:
                    value = ((fp & mask)[:, None] ^ flip[None, :]).ravel()
                    own = np.zeros((len(fp), len(flip)), bool)
                    own[:, 0] = True
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(value), k, np.int32)),
                            pa.array(value.view(np.int64)),
                            pa.array(np.repeat(fp, len(flip)).view(np.int64)),
                            pa.array(own.ravel()),
                        ],
                        names=["part", "value", "fp", "own"],
                    )

    return fps.select("fp").mapInArrow(probed, "part int, value long, fp long, own boolean")


def _forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Least member of each of ``n`` nodes' component under the links u-v."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        after = label.copy()
        np.minimum.at(after, u, low)
        np.minimum.at(after, v, low)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def _links(fp: np.ndarray, own: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between filed (own) and probing members."""
    names, at = np.unique(fp, return_inverse=True)
    filed = np.unique(at[own])
    if len(filed) == 0 or len(names) < 2:
        return names[:0], names[:0]
    label, everyone = np.arange(len(names)), names.view(np.uint64)
    for start in range(0, len(filed), 256):
        block = filed[start : start + 256]
        apart = np.bitwise_count(everyone[block][:, None] ^ everyone[None, :])
        i, j = np.nonzero(apart <= tau)
        label = _forest(label[block[i]], label[j], len(names))[label] if len(i) else label
    moved = np.flatnonzero(label != np.arange(len(names)))
    return names[moved], names[label[moved]]


def _verified(tau: int):
    """Streams buckets (runs of equal keys in sorted rows) and yields links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple[np.ndarray, ...] | None = None

        def buckets(key: np.ndarray, fp: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
            edge = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            first = np.concatenate([[0], edge])
            last = np.concatenate([edge, [len(key)]])
            size = last - first
            out_u, out_v = [], []
            pair = first[size == 2]  # by far the most: compare them at once
            near = np.bitwise_count(fp[pair].view(np.uint64) ^ fp[pair + 1].view(np.uint64)) <= tau
            near &= (own[pair] | own[pair + 1]) & (fp[pair] != fp[pair + 1])
            out_u.append(fp[pair][near])
            out_v.append(fp[pair + 1][near])
            for k in np.flatnonzero(size > 2):
                s, e = first[k], last[k]
                if own[s:e].any():
                    u, v = _links(fp[s:e], own[s:e], tau)
                    out_u.append(u)
                    out_v.append(v)
            u, v = np.concatenate(out_u), np.concatenate(out_v)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            key = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)])
            fp = batch.column(4).to_numpy(zero_copy_only=False)
            own = batch.column(5).to_numpy(zero_copy_only=False).astype(bool)
            if rest is not None:
                key, fp, own = (np.concatenate(x) for x in zip(rest, (key, fp, own)))
            if not len(key):
                continue
            edge = np.flatnonzero((key[1:] != key[:-1]).any(1))
            cut = edge[-1] + 1 if len(edge) else 0
            if cut:
                yield from buckets(key[:cut], fp[:cut], own[:cut])
            rest = key[cut:], fp[cut:], own[cut:]
        if rest is not None and len(rest[0]):
            yield from buckets(*rest)

    return run


def links(fps: DataFrame, tau: int = TAU, block: int = BLOCK) -> DataFrame:
    """(u, v): links between distinct fingerprints ``fps.fp`` that together
    connect all that differ by at most ``tau`` bits (a spanning forest of each
    bucket, not every pair)."""
    spark = fps.sparkSession
    count = fps.count()
    if count < 2:
        return spark.createDataFrame([], "u long, v long")
    picked = fps.where(by_hash(F.xxhash64("fp"), 2.0 * SAMPLE / count)).select("fp").limit(SAMPLE).toPandas()
    chosen = plan(np.sort(picked["fp"].to_numpy(dtype=np.int64)), count, tau)
    signed = signatures(fps, chosen).withColumns({"i": F.lit(0), "j": F.lit(0)})

    masks = [(k, _mask(b)) for k, (b, t) in enumerate(zip(chosen.bits, chosen.limits)) if t >= 0]
    filed = fps.select(
        F.explode(
            F.array(*[F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("value")) for k, m in masks])
        ).alias("b")
    ).select("b.*")
    big = written(filed.groupBy("part", "value").count().where(F.col("count") > block), "simhash-big")
    if not big.isEmpty():  # a bucket too large for one task becomes tiles of its blocks
        big = big.withColumn("blocks", F.ceil(F.col("count") / block).cast("int")).drop("count")
        # A probe has one row a bucket, and a bucket is as large as those that file in it and near it.
        signed = signed.drop("i", "j").join(big, ["part", "value"], "left")
        mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        every = F.sequence(F.lit(0), F.col("blocks") - 1)
        tiles = F.when(F.col("blocks").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("own").alias("own"))))
        as_filed = F.transform(every, lambda j: F.struct(mine.alias("i"), j.alias("j"), F.lit(True).alias("own")))
        as_probe = F.transform(every, lambda i: F.struct(i.alias("i"), mine.alias("j"), F.lit(False).alias("own")))
        tiles = tiles.otherwise(F.when(F.col("own"), F.concat(as_filed, as_probe)).otherwise(as_probe))
        signed = signed.select("part", "value", "fp", F.explode(tiles).alias("t")).select("part", "value", "fp", "t.own", "t.i", "t.j")
    keys = ["part", "value", "i", "j"]
    dealt = signed.select(*keys, "fp", "own").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(_verified(tau), "u long, v long").distinct()


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def rooted(prints: DataFrame, tau: int = TAU) -> DataFrame:
    """``prints`` (id, fp) -> (fp, least, root): the least id of each distinct
    fingerprint, and one fingerprint that stands for its group."""
    distinct = written(prints.groupBy("fp").agg(F.min("id").alias("least")), "simhash-fp")
    joined = connected_components(links(distinct, tau))
    return distinct.join(joined, distinct.fp == joined.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))


def groups(prints: DataFrame, tau: int = TAU) -> DataFrame:
    """``prints`` (id, fp) -> (fp, component): the least id reachable from each
    distinct fingerprint over links of at most ``tau`` bits."""
    labelled = rooted(prints, tau)
    roots = labelled.groupBy("root").agg(F.min("least").alias("component"))
    return labelled.join(roots, "root").select("fp", "component")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, tau: int = TAU
) -> DataFrame:
    """One row a document: id, fingerprint (16 hex digits), component_id."""
    prints = written(fingerprints(docs, id_col, text_col, shingle), "simhash")
    grouped = groups(prints, tau)
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return prints.join(grouped, "fp").select(
        F.col("id").alias(id_col), digits.alias("fingerprint"), F.col("component").alias("component_id")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, tau: int = TAU) -> DataFrame:
    """``docs`` with one row of each group of near fingerprints (all columns): the
    one of the least id, rows without an id last; then of the least fingerprint
    and of the least hash of the whole row, so that a rerun keeps the same one.
    Rows that share an id but no group are each kept."""
    mark, key = fresh(docs, "fp"), fresh(docs, "key")
    tagged = written(with_fingerprint(docs, mark, text_col, shingle), "simhash-docs")
    # What orders the rows of a group, and tells unequal rows apart.
    order = F.struct(F.col(f"`{id_col}`").isNull().alias("late"), F.col(f"`{id_col}`").alias("id"), F.col(mark).alias("fp"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("h"))
    prints = written(tagged.select(order.alias("o")).select("o.*"), "simhash")
    known = written(rooted(prints.select("id", "fp"), tau).select("fp", "root"), "simhash-groups")
    least = prints.join(known, "fp").groupBy("root").agg(F.min(F.struct("late", "id", "fp", "h")).alias(key)).select(key)
    kept = tagged.withColumn(key, order).join(least, key, "left_semi")
    return kept.dropDuplicates([key]).drop(key, mark)


def with_fingerprint(docs: DataFrame, out: str, text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` and its fingerprint (signed long) in the last column ``out``."""
    prepare(docs.sparkSession)
    at = docs.columns.index(text_col)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(at).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps.view(np.int64))], names=[*batch.schema.names, out])

    return docs.mapInArrow(hashed, T.StructType([*docs.schema.fields, T.StructField(out, T.LongType())]))
