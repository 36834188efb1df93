"""Spelling variants: words one edit apart, by a variable-length gram index.

A gram dictionary is built over the padded words: every gram of ``QMIN`` signs,
and a sign more where the short gram stands in many words (the dictionary is
pruned by frequency, so only long lists are cut finer).  A word is decomposed
from left to right into the longest dictionary grams that no earlier gram
covers.  One edit can change only the grams that start near it.  What it leaves
unchanged lies wholly before or behind it, so a gram's list is divided by the
text on its outer side, which both words must share.  Lists have one order, the
rarest (longest outer text) first; a word's affected-gram bound is how many of
its lists, in that order, leave one unchanged wherever an edit falls, and only
those are merged.  Candidates are verified by their edit distance.

With a word of m signs, PAD signs of padding a side and m + 2 PAD > 3 QMAX - 1 -
QMIN at least one gram survives every edit, so no near pair is lost.

Defined results: a NULL or empty text has no words; a NULL id counts as an empty
one; repeated rows each count; a word of any length is handled, its lists are
kept by 64-bit hashes (a clash only adds a candidate); an empty table gives an
empty result; columns other than the two named are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kharif.llm.common import by_bytes, prepare, written

#: One run in so many loses a sign.
EVERY = 31
MIN_CHARS, MIN_COUNT = 7, 2
#: A form is at least so many times as frequent as its variant.
RATIO = 10
QMIN, QMAX, PAD = 4, 5, 2
#: A gram gets longer if more than one in so many of all grams equal it; so at
#: most so many grams do, whatever the number of words.
GRAM_SHARE = 1 << 16
#: Nor does a gram of so few words.
GRAM_WORDS = 32
#: Longer words are verified after their lists are merged.
LONG = 64
_FRONT, _BACK = "\x01", "\x02"


# ---------------------------------------------------------------- words
def _crc_shifts(length: int, known: dict = {}) -> np.ndarray:  # noqa: B006
    """What ``length`` further bytes do to a CRC-32, as four tables of 256."""
    if length not in known:
        # Linear in the CRC: follow each single bit through that many zero bytes.
        zeros = bytes(length)
        base = zlib.crc32(zeros)
        bit = [zlib.crc32(zeros, 1 << b) ^ base for b in range(32)]
        table = np.zeros((4, 256), np.uint32)
        for k in range(4):
            for b in range(8):
                table[k, np.arange(256) >> b & 1 == 1] ^= np.uint32(bit[8 * k + b])
        known[length] = table
    return known[length]


def _lowered(texts: pa.Array) -> pa.Array:
    """A-Z in lower case, all other signs as they are."""
    texts = texts.cast(pa.large_string())
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8).copy()
    data[(data >= 65) & (data <= 90)] += 32
    return pa.LargeStringArray.from_buffers(len(texts), texts.buffers()[1], pa.py_buffer(data), texts.buffers()[0], texts.null_count, texts.offset)


def _objects(values: pa.Array) -> list:
    return values.to_numpy(zero_copy_only=False).tolist()


def _counted(ids: list[str], texts: pa.Array, min_chars: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Words of at least ``min_chars`` and their occurrences in some texts."""
    texts = pc.replace_substring_regex(_lowered(pc.fill_null(texts, "")), "[^A-Za-zÀ-ÿ]+", " ")
    lists = pc.split_pattern(texts, " ")
    coded = lists.flatten().dictionary_encode()
    words, at = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    if not len(at):
        return
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    raw = _objects(words.cast(pa.large_binary()))
    size = pc.binary_length(words.cast(pa.large_binary())).to_numpy()
    chars = pc.utf8_length(words).to_numpy()
    own = np.array([zlib.crc32(w) for w in raw], np.uint32)
    front = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
    crc = np.zeros(len(at), np.uint32)
    # crc(front + word) = shift(crc(front), bytes of word) xor crc(word)
    long = size > 64
    shifts = np.array([_crc_shifts(n) for n in range(65)])
    short = ~long[at]
    c, n = front[row[short]], size[at[short]]
    crc[short] = own[at[short]] ^ shifts[n, 0, c & 255] ^ shifts[n, 1, c >> 8 & 255] ^ shifts[n, 2, c >> 16 & 255] ^ shifts[n, 3, c >> 24]
    for i in np.flatnonzero(~short):
        crc[i] = zlib.crc32(raw[at[i]], int(front[row[i]]))
    hit = (crc % EVERY == 0) & (size[at] > 0)
    kept = np.bincount(at[~hit], minlength=len(words))
    good = (kept > 0) & (chars >= min_chars)
    yield words.filter(pa.array(good)), kept[good]
    cut = chars[at[hit]]
    pair, times = np.unique(np.stack((at[hit], crc[hit] % np.maximum(cut, 1))), axis=1, return_counts=True)
    texts_ = [(raw[w].decode(), p) for w, p in pair.T]
    made = pa.array([w[:p] + w[p + 1 :] for w, p in texts_], pa.large_string())
    good = pc.utf8_length(made).to_numpy(zero_copy_only=False) >= min_chars if len(made) else np.zeros(0, bool)
    yield made.filter(pa.array(good, pa.bool_())), times[good]


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: maximal runs of letters, A-Z in lower case.  Where ``EVERY``
    divides the CRC-32 of "id:run" the run counts without its sign number CRC
    modulo its length (planted misspellings)."""
    prepare(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.col(f"`{text_col}`").alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1):
            for words, n in _counted(_objects(batch.column(0)), batch.column(1), min_chars):
                yield pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(n, pa.int64())], names=["word", "n"])

    found = rows.mapInArrow(counted, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# ---------------------------------------------------------------- gram index
def gram_dictionary(words: DataFrame, qmin: int = QMIN, pad: int = PAD) -> frozenset[str]:
    """Short grams that are made longer: at most ``GRAM_SHARE``."""
    padded = F.concat(F.lit(_FRONT * pad), "word", F.lit(_BACK * pad))
    grams = words.select(padded.alias("p"))
    grams = grams.select(F.explode(F.expr(f"transform(sequence(1, length(p) - {qmin - 1}), i -> substring(p, i, {qmin}))")).alias("g"))
    counts = written(grams.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > GRAM_WORDS), "grams")
    total = words.agg(F.sum(F.length("word") + 2 * pad - qmin + 1)).first()[0] or 0
    return frozenset(r["g"] for r in counts.where(F.col("n") > total / GRAM_SHARE).select("g").collect())


def decompose(padded: str, frequent: frozenset[str], qmin: int = QMIN, qmax: int = QMAX) -> list[tuple[int, int]]:
    """(start, end) of the grams of a padded word that no earlier gram covers."""
    out, upto, n = [], 0, len(padded)
    for i in range(n - qmin + 1):
        end = i + qmin
        while end - i < qmax and end < n and padded[i:end] in frequent:
            end += 1
        if end > upto:
            out.append((i, end))
            upto = end
    return out


def affected(start: int, qmin: int = QMIN, qmax: int = QMAX) -> tuple[int, int]:
    """First and last place of an edit that can change the gram at ``start``:
    whether a gram stands depends on the signs from qmax - qmin before its start
    to qmax - 1 behind it."""
    return start - (qmax - qmin), start + qmax - 1


def lists_of(word: str, frequent: frozenset[str], qmin: int = QMIN, qmax: int = QMAX, pad: int = PAD) -> list[int]:
    """Hashes of the lists a word must be filed under: in the order of lists, as
    many as leave one unchanged wherever an edit falls.  Two near words keep the
    same lists unchanged, so the first of those is among both words' own."""
    padded = _FRONT * pad + word + _BACK * pad
    grams, n = decompose(padded, frequent, qmin, qmax), len(padded)
    front, back, fronts, backs = xxhash.xxh3_64(), xxhash.xxh3_64(), [], []
    back.update(b"\xff")  # a side of its own
    for sign in padded:
        front.update(sign.encode())
        fronts.append(front.intdigest())
    for sign in reversed(padded):
        back.update(sign.encode())
        backs.append(back.intdigest())
    found = [(-end, 0, fronts[end - 1], start) for start, end in grams]
    found += [(start - n, 1, backs[n - start - 1], start) for start, _ in grams]
    found.sort()  # the longest outer text, that is the rarest list, first
    # Places of an edit that no list so far survives.
    first, last, out = pad, n - pad - 1, []
    for _, side, h, start in found:
        out.append(h - (1 << 64) if h >> 63 else h)
        before, behind = affected(start, qmin, qmax)
        first, last = (max(first, before), last) if side else (first, min(last, behind))
        if first > last:
            return out
    raise AssertionError("a word without a sure gram")


def odd_signs(word: str) -> int:
    """Which signs (modulo 64) occur an odd number of times, as bits."""
    bits = 0
    for sign in word:
        bits ^= 1 << (ord(sign) & 63)
    return bits - (1 << 64) if bits >> 63 else bits


def near_pairs(words: DataFrame, min_chars: int = MIN_CHARS, qmin: int = QMIN, qmax: int = QMAX, pad: int = PAD) -> DataFrame:
    """a, na, b, nb: every pair of words that differ by exactly one inserted,
    deleted or replaced sign, once.  All words have ``min_chars`` signs or more."""
    if min_chars + 2 * pad <= 3 * qmax - 1 - qmin:
        raise ValueError("grams too long for the shortest word: pairs would be lost")
    spark = words.sparkSession
    prepare(spark)
    frequent = spark.sparkContext.broadcast(gram_dictionary(words, qmin, pad))

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words_ = _objects(batch.column(0))
            lists = [lists_of(w, frequent.value, qmin, qmax, pad) for w in words_]
            at = np.repeat(np.arange(batch.num_rows), [len(x) for x in lists])
            key = pa.array(np.fromiter((h for x in lists for h in x), np.int64, len(at)))
            odd = pa.array([odd_signs(w) for w in words_], pa.int64())
            columns = [key, batch.column(0).take(at), batch.column(1).take(at), odd.take(at)]
            yield pa.RecordBatch.from_arrays(columns, names=["list", "word", "n", "odd"])

    index = written(words.select("word", "n").mapInArrow(filed, "list long, word string, n long, odd long"), "gram-index")
    left, right = (index.select("list", F.col("word").alias(x), F.col("n").alias(f"n{x}"), F.col("odd").alias(f"o{x}")) for x in "ab")
    # One edit changes how often at most two signs occur: most candidates end here.
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("oa").bitwiseXOR(F.col("ob"))) <= 2)
    # Very long words share very many lists: those are verified below, once a pair.
    close = close & ((F.length("a") > LONG) | (F.levenshtein("a", "b", 1) == 1))
    met = left.join(right, (left["list"] == right["list"]) & close)
    # A filter on the keys themselves would go below the join.
    met = met.groupBy("a", "b").agg(F.first("a").alias("x"), F.first("b").alias("y"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return met.where(F.levenshtein("x", "y", 1) == 1).drop("x", "y")


def variants(words: DataFrame, min_chars: int = MIN_CHARS, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of ``words`` (word, n).

    The form is the most frequent near word (ties: the first in order of signs)
    if ``ratio`` times as frequent; the root is where forms lead."""
    words = written(words, "words")
    pairs = written(near_pairs(words, min_chars), "near-pairs")
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("na").alias("m")))).alias("p")).select("p.*")
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("top"))
    told = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("top.m") >= ratio * F.col("n"), F.col("top")).alias("top")
    )
    told = written(told.select("word", F.col("top.near").alias("form"), "n", "n_near", (-F.col("top.m")).alias("form_n")), "forms")
    # n grows by the ratio with every step, so a few doublings reach every root.
    most = words.agg(F.max("n")).first()[0] or 1
    steps = max(1, math.ceil(math.log(max(most, 2), ratio)))
    led = told.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        onward = led.select(F.col("word").alias("root"), F.col("root").alias("next"))
        led = written(led.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return told.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
