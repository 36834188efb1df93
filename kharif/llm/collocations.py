"""Phrase collocations: exact n-gram counts in counting quotient filters.

1. Each task cuts its texts into words and keeps, for a shard of about
   ``SHARD_BYTES`` of text and a language, the distinct words and the text as
   numbers of them.
2. Words that are frequent enough (no phrase is more frequent than its words)
   get dense ids in one distributed dictionary; the ids go back to the shards
   by a join on (language, word), so no task holds more than its shard's words.
3. Each shard counts its n-grams.  The packed word ids of an n-gram are permuted
   invertibly; the high bits name a range and, within it, the quotient, the rest
   is the remainder, kept in full: the counting quotient filter of a range is
   lossless, sorted by construction, and equal in size whatever words are hot.
4. Filters of a range are merged in sorted order across shards.  Beyond
   2^``FAN_BITS`` ranges that is done level by level, over bounded groups of
   filters, each merged filter being cut into finer ranges.
5. Counts of at least ``min_count`` are decoded and joined with those of their
   parts.

Defined results: a NULL or empty text has no words; a NULL language is ``und``;
repeated rows each count; ties in rank go by count, then by the phrase in byte
order; an empty table gives an empty result; columns other than the two named
are not read.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kharif.llm.common import by_bytes, prepare, written

MIN_COUNT, TOP, COVER_PERCENT, SCALE = 10, 2000, 50, 1_000_000
#: Text of one shard.
SHARD_BYTES = 24 << 20
#: N-gram occurrences that fall into one range, before merging.
RANGE_ENTRIES = 1 << 21
#: Ranges that one merge makes of one filter, as a power of two.
FAN_BITS = 10
#: Bits of a filter's key; n-grams of more bits use their first bits as a class.
KEY_BITS = 62


# ---------------------------------------------------------------- the filter
class QuotientFilter:
    """A counting quotient filter over ``width``-bit keys, lossless.

    A key's high bits (the quotient) name its home slot, the rest (the remainder)
    is stored.  Keys of one quotient form a run; runs stand in order, moved on by
    runs before them.  Three bits a slot tell which quotients occur, where runs
    end, and which slots hold digits of the count of the key before them (a count
    of one takes no digit)."""

    _HEAD = struct.Struct("<BBBQQ")

    def __init__(self, width: int, q: int, occupied: np.ndarray, ends: np.ndarray, digit: np.ndarray, slots: np.ndarray) -> None:
        self.width, self.q, self.r = width, q, width - q
        self.occupied, self.ends, self.digit, self.slots = occupied, ends, digit, slots

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray, width: int) -> QuotientFilter:
        """From ascending distinct keys (uint64) and their counts."""
        q = min(width, max(1, math.ceil(math.log2(max(len(keys), 1) * 1.1 + 1))))
        r = width - q
        size = next(b for b in (1, 2, 4, 8) if 8 * b >= r)
        home = (keys >> np.uint64(r)).astype(np.int64)
        rest, more, digits = counts.astype(np.uint64) - np.uint64(1), np.zeros(len(keys), np.int64), []
        while (left := rest != 0).any():
            more += left
            digits.append(rest & np.uint64((1 << 8 * size) - 1))
            rest = rest >> np.uint64(8 * size) if size < 8 else np.zeros_like(rest)
        taken = 1 + more
        before = np.cumsum(taken) - taken
        at = before + np.maximum.accumulate(home - before) if len(keys) else before
        n = max(1 << q, int(at[-1] + taken[-1]) if len(keys) else 0)
        occupied, ends, digit = np.zeros(1 << q, bool), np.zeros(n, bool), np.zeros(n, bool)
        slots = np.zeros(n, f"<u{size}")
        occupied[home] = True
        last = np.append(home[1:] != home[:-1], True) if len(keys) else np.zeros(0, bool)
        ends[(at + taken - 1)[last]] = True
        slots[at] = (keys & np.uint64((1 << r) - 1)).astype(slots.dtype)
        for k, d in enumerate(digits):
            has = more > k
            digit[at[has] + k + 1] = True
            slots[at[has] + k + 1] = d[has].astype(slots.dtype)
        return cls(width, q, np.flatnonzero(occupied), np.flatnonzero(ends), digit, slots)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Ascending keys and their counts."""
        if not len(self.ends):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        starts = np.maximum(self.occupied, np.append(-1, self.ends[:-1]) + 1)
        sizes = self.ends - starts + 1
        at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        home, digit = np.repeat(self.occupied, sizes), self.digit[at]
        key = ~digit
        keys = home[key].astype(np.uint64) << np.uint64(self.r) | self.slots[at[key]].astype(np.uint64)
        counts = np.ones(len(keys), np.int64)
        if digit.any():
            owner = np.cumsum(key) - 1
            place = at[digit] - at[key][owner[digit]] - 1
            bits = (8 * self.slots.itemsize * place).astype(np.uint64)
            np.add.at(counts, owner[digit], (self.slots[at[digit]].astype(np.uint64) << bits).astype(np.int64))
        return keys, counts

    def count(self, key: int) -> int:
        """The count of one key, from its run alone."""
        home, rest = key >> self.r, key & ((1 << self.r) - 1)
        k = int(np.searchsorted(self.occupied, home))
        if k == len(self.occupied) or self.occupied[k] != home:
            return 0
        at = max(home, int(self.ends[k - 1]) + 1 if k else 0)
        while at <= self.ends[k]:
            found, value, total, shift = int(self.slots[at]) == rest, at + 1, 1, 0
            while value <= self.ends[k] and self.digit[value]:
                total += int(self.slots[value]) << shift
                shift, value = shift + 8 * self.slots.itemsize, value + 1
            if found:
                return total
            at = value
        return 0

    def to_bytes(self) -> bytes:
        n = len(self.slots)
        bits = [np.zeros(1 << self.q, bool), np.zeros(n, bool), self.digit]
        bits[0][self.occupied], bits[1][self.ends] = True, True
        head = self._HEAD.pack(self.width, self.q, self.slots.itemsize, n, len(self.ends))
        return head + b"".join(np.packbits(b).tobytes() for b in bits) + self.slots.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> QuotientFilter:
        width, q, size, n, _ = cls._HEAD.unpack_from(data)
        at, bits = cls._HEAD.size, []
        for m in (1 << q, n, n):
            bits.append(np.unpackbits(np.frombuffer(data, np.uint8, -(-m // 8), at), count=m).astype(bool))
            at += -(-m // 8)
        return cls(width, q, np.flatnonzero(bits[0]), np.flatnonzero(bits[1]), bits[2], np.frombuffer(data, f"<u{size}", n, at))


def merged(filters: list[QuotientFilter]) -> tuple[np.ndarray, np.ndarray]:
    """Ascending keys of several filters of one range, counts added."""
    parts = [f.items() for f in filters]
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    return _summed(keys, counts)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")  # runs of sorted keys
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts[order], first)


# ---------------------------------------------------------------- permutation
class Packing:
    """N-grams of ``order`` word ids of ``bits`` bits as permuted keys.

    The last ``low`` bits of the packed ids are one number, bits before them (of
    very large vocabularies) a class; both are mixed with each other by steps
    that can be undone."""

    _ODD = 0x9E3779B97F4A7C15

    def __init__(self, order: int, bits: int, key_bits: int = KEY_BITS) -> None:
        if bits > 31:
            raise ValueError("more words than are built for")
        self.order, self.bits = order, bits
        self.low = min(order * bits, key_bits)
        self.high = order * bits - self.low
        self.mask = np.uint64((1 << self.low) - 1)
        self.shift = np.uint64(max(1, (self.low + 1) // 2))
        self.back = np.uint64(pow(self._ODD, -1, 1 << self.low) if self.low else 0)

    def _mix(self, x: np.ndarray, bits: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ x >> np.uint64(29)) & np.uint64((1 << bits) - 1)

    def permuted(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(class, key) of n-grams given as one array of ids a place."""
        low, high, at = np.zeros(len(ids[0]), np.uint64), np.zeros(len(ids[0]), np.uint64), 0
        for x in reversed(ids):
            x = x.astype(np.uint64)
            if at < self.low:
                low |= x << np.uint64(at) & self.mask
            if at + self.bits > self.low:
                high |= x >> np.uint64(self.low - at) if at < self.low else x << np.uint64(at - self.low)
            at += self.bits
        if self.high:
            high ^= self._mix(low, self.high)
            low ^= self._mix(high, self.low)
        with np.errstate(over="ignore"):
            for _ in range(2):
                low = low * np.uint64(self._ODD) & self.mask
                low ^= low >> self.shift
        return high, low

    def ids(self, high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
        """The n-grams of (class, key)."""
        with np.errstate(over="ignore"):
            for _ in range(2):
                low = low ^ low >> self.shift  # its own inverse: the shift is half the bits or more
                low = low * self.back & self.mask
        if self.high:
            low = low ^ self._mix(high, self.low)
            high = high ^ self._mix(low, self.high)
        out, at, one = [], 0, np.uint64((1 << self.bits) - 1)
        for _ in range(self.order):
            x = np.zeros(len(low), np.uint64)
            if at < self.low:
                x |= low >> np.uint64(at)
            if at + self.bits > self.low:
                x |= high << np.uint64(self.low - at) if at < self.low else high >> np.uint64(at - self.low)
            out.append((x & one).astype(np.int64))
            at += self.bits
        return out[::-1]


# ---------------------------------------------------------------- shards
def _lowered(texts: pa.Array) -> pa.Array:
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8).copy()
    data[(data >= 65) & (data <= 90)] += 32
    return pa.LargeStringArray.from_buffers(len(texts), texts.buffers()[1], pa.py_buffer(data), texts.buffers()[0], texts.null_count, texts.offset)


def _numbered(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct words, and all texts as numbers of them; -1 where a piece ends."""
    texts = _lowered(pc.fill_null(texts.cast(pa.large_string()), ""))
    texts = pc.replace_substring(pc.replace_substring_regex(texts, "[.,;:!?\\x0A-\\x0D]+", " \n "), "\t", " ")
    texts = pc.binary_join_element_wise(texts, pa.scalar(" \n", pa.large_string()), pa.scalar("", pa.large_string()))
    coded = pc.split_pattern(texts, " ").flatten().dictionary_encode()
    words, at = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    number = np.full(len(words), -2, np.int32)
    real = pc.and_(pc.not_equal(words, ""), pc.not_equal(words, "\n"))
    keep = real.to_numpy(zero_copy_only=False)
    number[keep] = np.arange(keep.sum())
    number[np.flatnonzero(pc.equal(words, "\n").to_numpy(zero_copy_only=False))] = -1
    at = number[at]
    return words.filter(real), at[at != -2]


def shard_texts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Rows (shard, lang, word, place, n) for each distinct word of a shard and
    language, and one row a shard with ``stream``: its text as such places."""
    prepare(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("text"))
    names = ["shard", "lang", "word", "place", "n", "stream"]

    def table(shard: int, lang: str, word: pa.Array, n: np.ndarray, stream: bytes | None) -> pa.RecordBatch:
        k = len(word) if stream is None else 1
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(k, shard)),
                pa.array([lang], pa.string()).take(pa.array(np.zeros(k, np.int32))),
                word.cast(pa.string()) if stream is None else pa.array([None], pa.string()),
                pa.array(np.arange(k, dtype=np.int32)) if stream is None else pa.array([None], pa.int32()),
                pa.array(n, pa.int64()) if stream is None else pa.array([None], pa.int64()),
                pa.nulls(k, pa.binary()) if stream is None else pa.array([stream], pa.binary()),
            ],
            names=names,
        )

    def sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def full() -> Iterator[pa.RecordBatch]:
            nonlocal number, held, size
            whole = pa.Table.from_batches(held).combine_chunks()
            langs = whole.column(0)
            for lang in pc.unique(langs).to_pylist():
                texts = whole.column(1).filter(pc.equal(langs, lang)).combine_chunks()
                words, stream = _numbered(texts)
                if len(words):
                    yield table(number, lang, words, np.bincount(stream[stream >= 0], minlength=len(words)), None)
                    yield table(number, lang, words, None, stream.astype("<i4").tobytes())
                number += 1
            held, size = [], 0

        for batch in by_bytes(batches, 1, SHARD_BYTES):
            held.append(batch)
            size += batch.column(1).nbytes
            if size >= SHARD_BYTES:
                yield from full()
        if held:
            yield from full()

    return written(rows.mapInArrow(sharded, "shard long, lang string, word string, place int, n long, stream binary"), "phrase-shards")


def word_ids(shards: DataFrame, min_count: int) -> tuple[DataFrame, DataFrame]:
    """(id, lang, word, f) of words with ``min_count`` occurrences or more, ids
    dense from 0; and (lang, n), all words of each language."""
    counts = written(shards.where("word is not null").groupBy("lang", "word").agg(F.sum("n").alias("f")), "phrase-words")
    kept = written(counts.where(F.col("f") >= min_count).withColumn("at", F.monotonically_increasing_id()), "phrase-frequent")
    # One row a partition: its first id.
    parts = kept.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("k"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = F.broadcast(parts.select("part", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("first")))
    ids = kept.join(parts, F.shiftright("at", 33) == F.col("part")).select((F.col("first") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("id"), "lang", "word", "f")
    return written(ids, "phrase-ids"), counts.groupBy("lang").agg(F.sum("f").alias("n"))


def count_phrases(shards: DataFrame, ids: DataFrame, orders: tuple[int, ...] = (2, 3), min_count: int = MIN_COUNT, key_bits: int = KEY_BITS, fan_bits: int = FAN_BITS, range_entries: int = RANGE_ENTRIES) -> DataFrame:
    """(size, w1, w2, w3, a): phrases of word ids with ``min_count`` occurrences
    or more; w3 is -1 for two words.  Languages never meet: ids are theirs."""
    told = ids.agg(F.count("*").alias("v"), F.coalesce(F.sum("f"), F.lit(0)).alias("n")).first()
    bits = max(1, int(told["v"]).bit_length())
    packs = {k: Packing(k, bits, key_bits) for k in orders}
    # Bits of the range, all orders alike; the class is their first part.
    want = max(0, math.ceil(math.log2(max(told["n"] / range_entries, 1))))
    want = min(max([want, *(p.high for p in packs.values())]), min(p.high + p.low for p in packs.values()) - 1)
    steps = [*range(fan_bits, want, fan_bits), want]

    def blocks(order: int, high: np.ndarray, low: np.ndarray, counts: np.ndarray, step: int, salt: int) -> Iterator[tuple]:
        """Filters of the ranges of ``step`` bits, from n-grams sorted by (class, key)."""
        pack = packs[order]
        part = _ranges(pack, high, low, step)
        for a, b in zip(*_runs(part)):
            yield order, int(part[a]), salt, pack.low, high[a:b], low[a:b], counts[a:b]

    def filters(made: Iterator[tuple]) -> tuple[list, ...]:
        rows = []
        for order, part, salt, width, high, low, counts in made:
            for a, b in zip(*_runs(high)):  # a class has a filter of its own
                f = QuotientFilter.of(low[a:b], counts[a:b], width).to_bytes()
                rows.append((order, part, salt, int(high[a]), f))
        return rows

    names, schema = ["size", "part", "salt", "class", "filter"], "size int, part long, salt int, class long, filter binary"

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, stream, places, its in zip(*(batch.column(k) for k in range(4))):
                at = np.frombuffer(stream.as_buffer(), "<i4")
                place, number = places.values.to_numpy(), its.values.to_numpy()
                known = np.full(max(int(at.max(initial=0)), int(place.max(initial=0))) + 2, -1, np.int64)
                known[place] = number  # the last stays -1, for pieces' ends
                at = known[at]
                for order in orders:
                    cols = [at[k : len(at) - order + 1 + k] for k in range(order)]
                    good = np.logical_and.reduce([c >= 0 for c in cols])
                    high, low = packs[order].permuted([c[good] for c in cols])
                    high, low, n = _grouped(high, low, np.ones(len(low), np.int64))
                    rows = filters(blocks(order, high, low, n, steps[0], int(shard.as_py() % 1_000_003)))
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=names)

    own = shards.where("word is not null").join(ids.select("lang", "word", "id"), ["lang", "word"])
    own = own.groupBy("shard", "lang").agg(F.collect_list(F.struct("place", "id")).alias("w"))
    own = own.select("shard", F.col("w.place").alias("places"), F.col("w.id").alias("ids"))
    rows = shards.where("stream is not null").select("shard", "stream").join(own.hint("merge"), "shard").select("shard", "stream", "places", "ids")
    found = rows.mapInArrow(counted, schema)

    def merging(then: int | None):
        def merge(group: pd.DataFrame) -> pd.DataFrame:
            order = int(group["size"].iloc[0])
            pack, rows = packs[order], []
            for high, same in group.groupby("class"):
                low, counts = merged([QuotientFilter.from_bytes(f) for f in same["filter"]])
                high = np.full(len(low), high, np.uint64)
                if then is None:
                    often = counts >= min_count
                    w = pack.ids(high[often], low[often]) + [np.full(often.sum(), -1)] * (3 - order)
                    rows.append(pd.DataFrame({"size": np.int32(order), "w1": w[0], "w2": w[1], "w3": w[2], "a": counts[often]}))
                else:
                    rows.append(pd.DataFrame(filters(blocks(order, high, low, counts, then, int(group["salt"].iloc[0]))), columns=names))
            return pd.concat(rows)

        return merge

    for step, then in zip(steps, [*steps[1:], None]):
        # Filters of a range go to as many merges as keep each within bounds.
        ways = 1 if then is None else max(1, math.ceil(told["n"] / (range_entries << step)))
        groups = found.withColumn("salt", F.pmod(F.hash("salt"), F.lit(ways)).cast("int")).groupBy("size", "part", "salt")
        found = groups.applyInPandas(merging(then), "size int, w1 long, w2 long, w3 long, a long" if then is None else schema)
    return found


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    return first, np.append(first[1:], len(values)) if len(values) else first


def _ranges(pack: Packing, high: np.ndarray, low: np.ndarray, step: int) -> np.ndarray:
    """The first ``step`` bits of (class, key)."""
    if step <= pack.high:
        return (high >> np.uint64(pack.high - step)).astype(np.int64)
    left = step - pack.high
    return (high << np.uint64(left) | low >> np.uint64(pack.low - left)).astype(np.int64)


def _grouped(high: np.ndarray, low: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (class, key) in order, counts added."""
    if not high.any():
        low = np.sort(low)
    else:
        order = np.lexsort((low, high))
        high, low, counts = high[order], low[order], counts[order]
    first = np.flatnonzero(np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1]))) if len(low) else np.zeros(0, np.int64)
    return high[first], low[first], np.add.reduceat(counts, first) if len(first) else counts


# ---------------------------------------------------------------- the report
def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT, top: int = TOP, **kw) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of
    two or three words."""
    shards = shard_texts(docs, lang_col, text_col)
    ids, totals = word_ids(shards, min_count)
    phrases = written(count_phrases(shards, ids, min_count=min_count, **kw), "phrases")
    word, total = ids.select("id", "f"), written(totals, "phrase-totals")
    two, three = phrases.where("size = 2").select("w1", "w2", "a"), phrases.where("size = 3").select("w1", "w2", "w3", "a")

    def named(df: DataFrame, key: str, out: str) -> DataFrame:
        return df.join(word.select(F.col("id").alias(key), F.col("f").alias(out)), key)

    def score(l: str, r: str):  # noqa: E741
        big = "decimal(18,0)"
        return F.expr(f"(cast(a as {big}) * cast(a as {big}) * {SCALE}) div (cast({l} as {big}) * cast({r} as {big}))")

    pairs = named(named(two, "w1", "l"), "w2", "r").withColumn("score", score("l", "r"))
    # What a longer candidate covers.
    inside = three.select("a", F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p")).groupBy("p.w1", "p.w2").agg(F.max("a").alias("longer"))
    pairs = pairs.join(inside, ["w1", "w2"], "left").where(F.coalesce(100 * F.col("longer") < COVER_PERCENT * F.col("a"), F.lit(True)))
    part = two.select(F.col("w1").alias("p1"), F.col("w2").alias("p2"), F.col("a").alias("f"))
    cut = named(named(three, "w1", "l1"), "w3", "r2")
    cut = cut.join(part.select(F.col("p1").alias("w2"), F.col("p2").alias("w3"), F.col("f").alias("r1")), ["w2", "w3"])
    cut = cut.join(part.select(F.col("p1").alias("w1"), F.col("p2").alias("w2"), F.col("f").alias("l2")), ["w1", "w2"])
    least = F.least(
        F.struct(score("l1", "r1").alias("score"), F.lit(1).alias("k"), F.col("l1").alias("l"), F.col("r1").alias("r")),
        F.struct(score("l2", "r2").alias("score"), F.lit(2).alias("k"), F.col("l2").alias("l"), F.col("r2").alias("r")),
    )
    cut = cut.withColumn("c", least).select("w1", "w2", "w3", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), F.col("c.score").alias("score"))
    all_ = pairs.select("w1", "w2", F.lit(-1).cast("long").alias("w3"), "a", "l", "r", "score").unionByName(cut.select("w1", "w2", "w3", "a", "l", "r", "score"))
    for k in (1, 2, 3):
        name = ids.select(F.col("id").alias(f"w{k}"), F.col("word").alias(f"t{k}"), *([F.col("lang")] if k == 1 else []))
        all_ = all_.join(name, f"w{k}", "left" if k == 3 else "inner")
    all_ = all_.withColumn("phrase", F.concat_ws(" ", "t1", "t2", "t3"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase")))
    best = all_.withColumn("rank", rank).where(F.col("rank") <= top)
    return best.join(F.broadcast(total), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
