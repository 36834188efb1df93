"""Near-duplicate passages across documents by compact windows.

The tokens are the five-word shingles of a text.  For each of ``BANDS * 2``
hash functions the Cartesian tree over the hashed tokens groups all
subsequences of at least ``MIN_SHINGLES`` tokens that have the same minimum:
a node (centre) stands for every [i, j] with left <= i <= centre <= j <= right.
Two functions make a band; the intersections of their windows within a text
are the subsequences that share a signature of two minima.  Windows of
different texts meet on that signature; each is compared with the first text
that has it (copies of a passage never turn into all their pairs), and the
passage around the meeting point is verified on the shingles themselves:
Jaccard similarity of at least ``SIMILARITY`` over at least ``MIN_WORDS``
words.  Texts that fail against the first one of a signature meet again
without it, for ``ROUNDS`` rounds (near copies of later texts).  Everything
under a signature that failed a text is then windowed again with ``GROWTH`` times
as many functions a band, and so on until no signature fails: longer signatures part
what differs, so nothing is dropped and no group is compared pair by pair.

A passage of ``MIN_WORDS`` words or more that two texts share word for word has
its signatures, of any number of functions, in both, so every band proposes it
until it is found.

Defined results: NULL text counts as empty; shorter texts have no passage; rows
without an id take no part; repeated rows of an id are one document; repeats
within one document are not reported; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kharif.llm.common import by_bytes, filter_bit, id_filter, maybe_in, passes, prepare, slices, written

SHINGLE = 5
MIN_WORDS = 51
MIN_SHINGLES = MIN_WORDS - SHINGLE + 1
SIMILARITY = 0.8
BANDS = 2
ROUNDS = 3
#: How many times more functions a band has once a signature has failed.
GROWTH = 2
#: Bytes of text that are hashed at a time, so that its arrays stay in the cache.
PIECE = 1 << 19
#: Lower bits of a value that make room for its place in a stretch.
PLACE_BITS = 16

_GOLD, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    x = x + np.uint64((seed * int(_GOLD)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


# A word's hash is a polynomial of its code points' numbers in _BASE: a power is the product of one of each table.
_BASE, _INVERSE = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)
_BLOCK_BITS = 16
_SPACE = np.array([chr(c).isspace() for c in range(0x3002)])


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors)


_NUMBERS = _mixed(np.arange(1 << 16, dtype=np.uint64), 2)
_UP, _DOWN = (_powers(b, 1 << _BLOCK_BITS) for b in (_BASE, _INVERSE))
_UPS, _DOWNS = (pow(b, 1 << _BLOCK_BITS, 1 << 64) for b in (_BASE, _INVERSE))


def hashed_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (``lower().split()``) of all texts, one after
    the other, and the number of words of each text."""
    lowered = [(t or "").lower() for t in texts]
    codes = np.frombuffer("\n".join(["", *lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    space = _SPACE[np.minimum(codes, len(_SPACE) - 1)]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    first, end = edges[::2], edges[1::2]
    blocks = (len(codes) >> _BLOCK_BITS) + 1
    total = (_powers(_UPS, blocks)[:, None] * _UP).ravel()[: len(codes)]
    total *= _NUMBERS[codes] if codes.max() < len(_NUMBERS) else _mixed(codes.astype(np.uint64), 2)
    np.cumsum(total, out=total)
    words = total[end - 1] - total[first - 1]
    words *= _DOWN[first & ((1 << _BLOCK_BITS) - 1)] * _powers(_DOWNS, blocks)[first >> _BLOCK_BITS]
    ends = np.cumsum([len(t) + 1 for t in lowered])
    return _mixed(words, 3), np.diff(np.searchsorted(first, ends), prepend=0)


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the five-word shingles of all texts, one after the other, and
    the number of shingles of each text."""
    words, counts = hashed_words(texts)
    n = max(len(words) - SHINGLE + 1, 0)
    out = np.zeros(n, np.uint64)
    for k in range(SHINGLE if n else 0):
        out = out * _M1 + words[k : n + k]
    inside = np.arange(n) + SHINGLE <= np.repeat(np.cumsum(counts), counts)[:n]
    return _mixed(out[inside], 1), np.maximum(counts - SHINGLE + 1, 0)


def sliding_minima(value: np.ndarray, width: int) -> np.ndarray:
    """Place of the least value of every window of ``width`` (leftmost of equal
    ones), by doubling the width.  Values are compared without their lower
    ``PLACE_BITS`` bits, which hold the place in a stretch instead."""
    low = np.uint64((1 << PLACE_BITS) - 1)
    out, step_on = [np.empty(0, np.int64)], (1 << PLACE_BITS) - width + 1
    for at in range(0, len(value) - width + 1, step_on):
        least = value[at : at + (1 << PLACE_BITS)] & ~low
        least |= np.arange(len(least), dtype=np.uint64)
        span = 1
        while span < width:
            step = min(span, width - span)
            least = np.minimum(least[step:], least[:-step])
            span += step
        out.append((least & low).astype(np.int64) + at)
    return np.concatenate(out)


def tree_windows(value: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of the compact window of each centre: up to the
    nearest smaller value on either side.  That value is itself a centre
    (its window contains this one), so the Cartesian tree over the centres
    gives it, built along its right path.  The first and
    the last centre must be smaller than all between them."""
    v, n = value[centres].tolist(), len(centres)
    left, right, path = [-1] * n, [n] * n, [-1]  # path: centres without a smaller one so far, rising
    for i, x in enumerate(v):
        while (k := path[-1]) >= 0 and v[k] > x:
            right[path.pop()] = i
        left[i] = k
        path.append(i)
    first = centres[np.maximum(left, 0)] + 1
    last = centres[np.minimum(right, n - 1)] - 1
    return first, last


def windows(
    tokens: np.ndarray, sizes: np.ndarray, bands: int = BANDS, width: int = MIN_SHINGLES, functions: int = 2, wanted: np.ndarray | None = None, roots: np.ndarray | None = None
) -> tuple[np.ndarray, ...]:
    """(number of the text, signature, centre, left, right, many, parent, root) of the
    intersections of the compact windows of the ``functions`` of each band, for
    several texts at once (shingles, and their number in each); many: the text has that signature elsewhere
    too, and this is its first place.  With ``wanted``, only signatures that
    begin with one of these (parent) of ``GROWTH`` times fewer functions, and
    with one of ``roots`` of two functions; only the stretches under these are
    hashed further.  Between texts stands a
    value below all others, so no window reaches across."""
    starts = np.concatenate([[1], 1 + np.cumsum(sizes + 1)])  # one mark before and after each text
    joined = np.zeros(int(starts[-1]), np.uint64)
    mark = np.zeros(len(joined), bool)
    mark[starts - 1] = True
    joined[~mark] = tokens
    text_of = np.repeat(np.arange(len(sizes) + 1), np.concatenate([[1], sizes + 1]))

    def compact(joined: np.ndarray, mark: np.ndarray, seed: int) -> tuple[np.ndarray, ...]:
        value = _mixed(joined, seed) >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS) | np.uint64(1 << PLACE_BITS)
        value[mark] = 0
        at = sliding_minima(value, width)
        # places never fall, so equal ones are neighbours
        begins = np.concatenate([[True], at[1:] != at[:-1]])
        least = mark.copy()
        least[at[begins]] = True
        centres = np.flatnonzero(least)
        return (value, at, begins, centres, *tree_windows(value, centres))

    out: list[tuple[np.ndarray, ...]] = []
    for band in range(bands if len(joined) >= width else 0):
        (va, a, ba, ca, fa, la), (vb, b, bb, cb, fb, lb) = (compact(joined, mark, 11 + 2 * band + f) for f in (0, 1))
        edges = np.flatnonzero(ba | bb)
        runs = edges[~mark[a[edges]] & ~mark[b[edges]]]
        centre, other = a[runs], b[runs]
        i, j = np.searchsorted(ca, centre), np.searchsorted(cb, other)
        left, right = np.maximum(fa[i], fb[j]), np.minimum(la[i], lb[j])
        apart = (other.astype(np.int64) - centre).view(np.uint64)
        chain = va[centre] ^ _mixed(vb[other] + apart, 5)
        sealed = lambda: _mixed(chain, 23 + band).view(np.int64)  # noqa: B023, E731
        used = 2
        root = parent = sealed()
        if functions > used:
            # From runs of equal minima to the starts of their windows.
            lengths = np.diff(np.append(edges, len(a)))[np.isin(edges, runs, assume_unique=True)]
            lengths = np.where(np.isin(root, roots), lengths, 0)
            at = np.repeat(runs, lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            if not len(at):
                continue
            chain, centre, left, right, root = (np.repeat(x, lengths) for x in (chain, centre, left, right, root))
            # The stretches of these windows, a mark before, between and after.
            edge = np.zeros(len(joined) + 1, np.int32)
            edge[at] += 1
            edge[at + width] -= 1
            old = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
            new = np.arange(1, len(old) + 1)
            new[1:] += np.cumsum(np.diff(old) > 1)
            some, gap, back = np.zeros(new[-1] + 2, np.uint64), np.ones(new[-1] + 2, bool), np.zeros(new[-1] + 2, np.int64)
            some[new], gap[new], back[new] = joined[old], False, old
            at = new[np.searchsorted(old, at)]
            parent = sealed()
            while True:
                if used * GROWTH == functions:
                    parent = sealed()
                    kept = np.isin(parent, wanted)
                    at, chain, centre, left, right, root, parent = (x[kept] for x in (at, chain, centre, left, right, root, parent))
                if used == functions or not len(at):
                    break
                v, c, _, cc, fc, lc = compact(some, gap, 1000 * (band + 1) + used)
                c = c[at]
                i = np.searchsorted(cc, c)
                left, right = np.maximum(left, back[fc[i]]), np.minimum(right, back[lc[i]])
                chain = _mixed(chain ^ _mixed(v[c] + (back[c] - centre).view(np.uint64), 5), 6)
                used += 1
            fresh = np.ones(len(at), bool)
            fresh[1:] = (chain[1:] != chain[:-1]) | (centre[1:] != centre[:-1])
            chain, centre, left, right, root, parent = (x[fresh] for x in (chain, centre, left, right, root, parent))
        text = text_of[centre] - 1
        begin = starts[text]
        out.append((text, sealed(), centre - begin, left - begin, right - begin, parent, root))
    if not out:
        none = np.empty(0, np.int64)
        return none, none, none, none, none, np.empty(0, bool), none, none
    text, key, centre, left, right, parent, root = (np.concatenate(x) for x in zip(*out))
    # a signature once a text: its first place
    order = np.lexsort((centre, key, text))
    again = np.zeros(len(order) + 1, bool)
    again[1:-1] = (key[order][1:] == key[order][:-1]) & (text[order][1:] == text[order][:-1])
    many = again[1:] & ~again[:-1]
    order, many = order[~again[:-1]], many[~again[:-1]]
    return text[order], key[order], centre[order], left[order], right[order], many, parent[order], root[order]


def dense(match: np.ndarray, similarity: float = SIMILARITY) -> tuple[int, int]:
    """The stretch of the best sum in which a match counts 1 and a miss as
    much as it takes to fall below the similarity."""
    if not match.any():
        return 0, 0
    worth = np.where(match, 1.0, -similarity / (1 - similarity))
    total = np.concatenate([[0.0], np.cumsum(worth)])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total[1:] - low[:-1])) + 1
    start = int(np.flatnonzero(total[:end] == low[end - 1])[-1])
    return start, end


def numbered(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The shingles of two texts as numbers from 0, and how many differ."""
    both = np.concatenate([a, b]).astype(np.uint64) << np.uint64(32) | np.arange(len(a) + len(b), dtype=np.uint64)
    both.sort()
    value, place = both >> np.uint64(32), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
    number = np.empty(len(both), np.int64)
    number[place] = np.concatenate([[0], np.cumsum(value[1:] != value[:-1])])[: len(both)]
    return number[: len(a)], number[len(a) :], int(number.max(initial=-1)) + 1


def verify(a: np.ndarray, b: np.ndarray, at: int, bt: int, kinds: int, similarity: float = SIMILARITY, least: int = MIN_SHINGLES):
    """The near-duplicate passage of two texts (shingles as numbers below
    ``kinds``) that meet at ``at`` and ``bt``: (first, end) shingles in both, and their Jaccard similarity;
    None if there is none of enough length and similarity."""
    # Word for word to either side: by far the most frequent case, and cheap.
    n = min(len(a) - at, len(b) - bt)
    differs = np.flatnonzero(a[at : at + n] != b[bt : bt + n])
    ahead = int(differs[0]) if len(differs) else n
    m = min(at, bt)
    differs = np.flatnonzero(a[at - m : at][::-1] != b[bt - m : bt][::-1])
    behind = int(differs[0]) if len(differs) else m
    same = (at - behind, at + ahead), (bt - behind, bt + ahead)
    # With edits: dense stretches of common shingles around the meeting point.
    reach = 4 * max(least, behind + ahead)
    lo_a, hi_a, lo_b, hi_b = max(0, at - reach), min(len(a), at + reach), max(0, bt - reach), min(len(b), bt + reach)
    x, y = a[lo_a:hi_a], b[lo_b:hi_b]
    best, known = None, np.zeros((2, kinds), bool)
    known[1, y] = True
    # A stretch of a positive sum has more matches than that; fewer need no search.
    match, few = known[1, x], similarity * least
    s, e = dense(match, similarity) if np.count_nonzero(match) > few else (0, 0)
    if e - s >= least:
        known[0, x[s:e]] = True
        match = known[0, y]
        t, u = dense(match, similarity) if np.count_nonzero(match) > few else (0, 0)
        if u - t >= least:
            known[1] = False
            known[1, y[t:u]] = True
            jaccard = np.count_nonzero(known[0] & known[1]) / np.count_nonzero(known[0] | known[1])
            if jaccard >= similarity:
                best = (s + lo_a, e + lo_a), (t + lo_b, u + lo_b), float(jaccard)
    if behind + ahead >= least and (best is None or best[0][1] - best[0][0] < behind + ahead):
        best = *same, 1.0
    return best


def find_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each passage and document: doc_id, source_doc_id (the least
    document it was verified with; itself for the first occurrence), the words
    [start_word, end_word), similarity to the source, is_first."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").alias("text")).where("doc is not null")

    left = written(_windows_of(rows, 2).drop("root"), "passage-windows").withColumn("root", F.col("key"))
    met = written(_meetings(left), "passage-met")
    need = id_filter(met.select(F.explode(F.array("doc", "source")).alias("doc")), "doc")
    known = spark.sparkContext.broadcast(need)

    def payload(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = known.value
        for batch in by_bytes(batches, 1, PIECE):
            some = np.flatnonzero(passes(bits, batch.column(2).to_numpy(zero_copy_only=False)))
            ids, texts = batch.column(0).take(pa.array(some)), batch.column(1).take(pa.array(some)).to_pylist()
            tokens, sizes = shingles(texts)
            ends = np.cumsum(np.concatenate([[0], sizes * 4]), dtype=np.int32)
            made = (tokens >> np.uint64(32)).astype(np.uint32)
            made = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(made)])
            yield pa.RecordBatch.from_arrays([ids, made], names=["doc", "shingles"])

    texts = written(rows.select("doc", "text", filter_bit("doc").alias("bit")).mapInArrow(payload, "doc long, shingles binary"), "passage-texts")
    texts = texts.groupBy("doc").agg(F.max("shingles").alias("shingles"))

    found, functions = None, 2
    while True:
        open_keys = None
        for k in range(ROUNDS if functions == 2 else 1):
            told = written(_verified(met.where("near"), texts), "passage-told")
            good = told.where("similarity is not null").drop("key", "place", "open")
            found = good if found is None else found.unionByName(good)
            names = ["key", "doc", "place", "open"]
            failed = told.where("similarity is null").select(names).unionByName(met.where("not near").select(names))
            lost = failed.where("open").select("key", "doc") if k == 0 else lost
            if k + 1 < ROUNDS and functions == 2:
                # Near copies: signatures meet again without the source that failed them.
                again = failed.select("key", "doc", "place", F.lit(False).alias("many"), F.lit(True).alias("seeks"))
                met = written(_meetings(again), "passage-met")
        # What is under a signature that failed goes on under signatures of more
        # functions; what failed itself is what others are compared with.
        lost = written(lost.withColumn("failed", F.lit(True)), "passage-lost")
        if lost.isEmpty():
            break
        wanted = left.select("key", "doc", "root").join(lost.select("key").distinct(), "key").join(lost, ["key", "doc"], "left")
        wanted = wanted.groupBy("doc").agg(
            F.collect_set("key").alias("wanted"), F.collect_set("root").alias("roots"), F.collect_set(F.when(F.col("failed"), F.col("key"))).alias("failed")
        )
        wanted = written(wanted, "passage-wanted")
        functions *= GROWTH
        again = maybe_in(rows, wanted, "doc").join(wanted.hint("merge"), "doc")
        left = written(_windows_of(again, functions), "passage-windows")
        met = written(_meetings(left), "passage-met")
    spans = found.groupBy("doc", "source", "start", "end").agg(F.max("similarity").alias("similarity"))
    firsts = found.select(F.col("source").alias("doc"), "source", F.col("source_start").alias("start"), F.col("source_end").alias("end"), F.lit(1.0).alias("similarity")).distinct()
    words = SHINGLE - 1
    out = spans.withColumn("is_first", F.lit(False)).unionByName(firsts.withColumn("is_first", F.lit(True)))
    return out.select(
        F.col("doc").alias("doc_id"),
        F.col("source").alias("source_doc_id"),
        F.col("start").alias("start_word"),
        (F.col("end") + words).alias("end_word"),
        "similarity",
        "is_first",
    )


def _windows_of(rows: DataFrame, functions: int) -> DataFrame:
    """Signatures of the texts of (doc, text and, for more than two functions,
    wanted, roots, failed): key, doc, place, many, root; seeks: a text that
    failed under the parent."""
    names = ["doc", "text"] + ["wanted", "roots", "failed"] * (functions > 2)

    def windowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1, PIECE):
            # Any other text of the batch with a wanted signature wants it too.
            wanted, roots = (batch.column(i).flatten().to_numpy(zero_copy_only=False) if functions > 2 else None for i in (2, 3))
            tokens, sizes = shingles(batch.column(1).to_pylist())
            text, key, centre, left, right, many, parent, root = windows(tokens, sizes, functions=functions, wanted=wanted, roots=roots)
            seeks = np.ones(len(text), bool)
            if functions > 2:
                lists = batch.column(4)
                number = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.uint64)
                of = lambda keys, numbers: keys.astype(np.int64).view(np.uint64) ^ _mixed(numbers, 7)
                seeks = np.isin(of(parent, text.astype(np.uint64)), of(lists.flatten().to_numpy(zero_copy_only=False), number))
            ids = batch.column(0).to_numpy(zero_copy_only=False)[text]
            # place packed: the centre, then how far the window reaches to either side
            near, far = np.minimum(centre - left, 255), np.minimum(right - centre, 255)
            place = centre.astype(np.int64) << 16 | near << 8 | far
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, ids, place, many, root, seeks)], names=["key", "doc", "place", "many", "root", "seeks"])

    return rows.select(*names).mapInArrow(windowed, "key long, doc long, place long, many boolean, root long, seeks boolean")


def _meetings(left: DataFrame) -> DataFrame:
    """Windows of each signature with the one in its first document.  The
    interval join, near: aligned at their centres, the two windows have a
    subsequence of nearly the least length in common.  open: if the two fail,
    there are other pairs of places under the signature."""
    first = left.groupBy("key").agg(
        F.min("doc").alias("source"),
        F.max("doc").alias("high"),
        F.min_by("place", "doc").alias("source_place"),
        F.min_by("seeks", "doc").alias("source_seeks"),
        (F.bool_or("many") | (F.count("*") > 2)).alias("open"),
    )
    # A table of its own, so that a signature of very many windows can be split in the join.
    first = written(first.where("source < high").drop("high"), "passage-first")
    met = left.join(first, "key").where("doc > source and (seeks or source_seeks)")
    part = lambda c, shift: F.shiftright(c, shift).bitwiseAND(255)
    common = F.least(part("place", 8), part("source_place", 8)) + F.least(part("place", 0), part("source_place", 0)) + 1
    near = (common >= int(SIMILARITY * MIN_SHINGLES)).alias("near")
    return met.select("doc", "source", "key", "place", F.shiftright("place", 16).alias("at"), F.shiftright("source_place", 16).alias("bt"), near, "open")


def _verified(met: DataFrame, texts: DataFrame) -> DataFrame:
    """Verified passages of each pair, and a row without similarity for every
    meeting that lies in none."""
    pairs = met.groupBy("doc", "source").agg(F.collect_list(F.struct("at", "bt", "key", "place", "open")).alias("meetings"))
    rows = pairs.join(texts, "doc").join(texts.select(F.col("doc").alias("source"), F.col("shingles").alias("other")), "source")
    names = ["doc", "source", "start", "end", "source_start", "source_end", "similarity", "key", "place", "open"]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            out, lists = [], batch.column(2)
            meetings = [c.to_numpy(zero_copy_only=False) for c in lists.flatten().flatten()]
            counts = lists.value_lengths().to_numpy(zero_copy_only=False)
            order = np.lexsort([*meetings[::-1], np.repeat(np.arange(len(counts)), counts)])
            meetings = zip(*(m[order].tolist() for m in meetings))
            for doc, source, n, one, other in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), counts, *(c.to_pylist() for c in batch.columns[3:])):
                a, b, kinds = numbered(np.frombuffer(one, np.uint32), np.frombuffer(other, np.uint32))
                spans: list[tuple] = []
                for at, bt, key, place, more in islice(meetings, int(n)):
                    if any(s[0][0] <= at < s[0][1] and s[1][0] <= bt < s[1][1] for s in spans):
                        continue
                    if hit := verify(a, b, at, bt, kinds):
                        if hit not in spans:
                            spans.append(hit)
                            (s, e), (t, u), j = hit
                            out.append((doc, source, s, e, t, u, j, None, None, None))
                    else:
                        out.append((doc, source, None, None, None, None, None, key, place, more))
            types = [pa.int64()] * 6 + [pa.float64(), pa.int64(), pa.int64(), pa.bool_()]
            columns = list(zip(*out)) or [()] * 10
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types)], names=names)

    rows = rows.select("doc", "source", "meetings", "shingles", "other")
    return rows.mapInArrow(
        told, "doc long, source long, start long, end long, source_start long, source_end long, similarity double, key long, place long, open boolean"
    )
