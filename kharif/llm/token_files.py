"""Token-id output: one compressed file a shard, a wavelet matrix inside.

Texts are encoded with the tokenizers library, an end id closes every
document, and the ids of all documents in ascending id order are cut into
shards of whole documents.  A shard is one file: a document table (ids and
lengths) and a wavelet matrix of the token ids, that is one bit-plane for each
bit of an id, each stably parted by the bit before, with a rank directory.
From the file alone it answers token access, the count of an id in any range,
and the places of its occurrences; nothing but the planes asked for is
decompressed.

On Spark: one range shuffle by document id; each task encodes its sorted
documents as a stream and emits a shard whenever one is full.  Spark's own file
sink writes the shards (one a file, committed as any other output, so a lost
executor leaves nothing half written), Spark's ``binaryFile`` source reads them.

Defined results: a NULL or empty text is the end id alone; a NULL document id
comes first; rows with one id follow each other by a hash of their text, then
by the text; an empty table writes no shard and reads back empty; a document of
any length is never cut, so a shard is ``SHARD_TOKENS`` ids or one document,
whichever is longer; columns other than the two named are not written.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kharif.llm.common import by_bytes, prepare, written

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
#: Ids of a shard (some 5 MB of file).
SHARD_TOKENS = 1 << 21
#: Pieces whose ids a worker keeps, in each of two generations.
KEEP, KEEP_CHARS = 400_000, 40
#: Bits a rank directory entry stands for.
STEP = 512
#: Ids that are parted at a time (what processor caches hold).
_BLOCK = 1 << 16

_MAGIC = b"KWM1"
_HEAD = struct.Struct("<4sBQQII")
_PLANE = struct.Struct("<QII")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# ---------------------------------------------------------------- wavelet matrix
class Plane:
    """One bit-plane: its bits, packed, and the number of ones before each step."""

    def __init__(self, bits: np.ndarray, n: int, before: np.ndarray, zeros: int) -> None:
        self.bits, self.n, self.before, self.zeros = bits, n, before, zeros

    @classmethod
    def of(cls, marks: np.ndarray, zeros: int) -> Plane:
        n = len(marks)
        packed = np.zeros(-(-n // STEP) * (STEP // 8), np.uint8)
        packed[: (n + 7) // 8] = np.packbits(marks, bitorder="little")
        bits = packed.view(np.uint64)
        ones = np.bitwise_count(bits).reshape(-1, STEP // 64).sum(1, dtype=np.uint32)
        before = np.zeros(len(ones) + 1, np.uint32)
        np.cumsum(ones, out=before[1:])
        return cls(bits, n, before, zeros)

    def get(self, at: np.ndarray) -> np.ndarray:
        return self.bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each of the places ``at``."""
        at = np.asarray(at, np.int64)
        block = at // STEP
        words = (block * (STEP // 64))[:, None] + np.arange(STEP // 64)
        inside = np.clip(at[:, None] - words * 64, 0, 64)
        mask = np.where(inside >= 64, ~np.uint64(0), (np.uint64(1) << (inside & 63).astype(np.uint64)) - np.uint64(1))
        found = self.bits[np.minimum(words, max(len(self.bits) - 1, 0))] if len(self.bits) else np.zeros(words.shape, np.uint64)
        return self.before[np.minimum(block, len(self.before) - 1)].astype(np.int64) + np.bitwise_count(found & mask).sum(1, dtype=np.int64)

    def select(self, one: bool, k: np.ndarray) -> np.ndarray:
        """Place of the ``k``-th (from 0) one or zero."""
        k = np.asarray(k, np.int64)
        before = self.before.astype(np.int64)
        if not one:
            before = np.arange(len(before)) * STEP - before
        block = np.searchsorted(before, k, side="right") - 1
        left = k - before[block]
        words = self.bits.reshape(-1, STEP // 64)[block]
        marks = np.unpackbits((words if one else ~words).view(np.uint8).reshape(len(k), -1), axis=1, bitorder="little")
        return block * STEP + np.argmax(np.cumsum(marks, 1, dtype=np.int32) > left[:, None], axis=1)


class WaveletMatrix:
    """Token ids as bit-planes, highest bit first."""

    def __init__(self, n: int, levels: int, plane) -> None:
        self.n, self.levels, self._plane, self._seen = n, levels, plane, {}

    def plane(self, level: int) -> Plane:
        if level not in self._seen:
            self._seen[level] = self._plane(level)
        return self._seen[level]

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        now = np.asarray(ids)
        levels = max(int(now.max()).bit_length(), 1) if len(now) else 1
        now = now.astype(np.uint16 if levels <= 16 else np.uint32)
        planes = []
        for level in range(levels):
            marks = (now & now.dtype.type(1 << (levels - 1 - level))) != 0
            zeros = len(now) - np.count_nonzero(marks)
            planes.append(Plane.of(marks, zeros))
            made, one, zero = np.empty_like(now), zeros, 0
            for at in range(0, len(now), _BLOCK):
                ids, mark = now[at : at + _BLOCK], marks[at : at + _BLOCK]
                on, off = np.flatnonzero(mark), np.flatnonzero(~mark)
                np.take(ids, off, out=made[zero : zero + len(off)], mode="clip")
                np.take(ids, on, out=made[one : one + len(on)], mode="clip")
                zero, one = zero + len(off), one + len(on)
            now = made
        return cls(len(now), levels, planes.__getitem__)

    def ids(self) -> np.ndarray:
        """All ids, from the last plane back to the first."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for level in range(self.levels - 1, -1, -1):
            plane = self.plane(level)
            marks = np.unpackbits(plane.bits.view(np.uint8), count=self.n, bitorder="little").view(bool)
            made, bit = np.empty(self.n, kind), kind(1 << (self.levels - 1 - level))
            zero, one = 0, plane.zeros
            for at in range(0, self.n, _BLOCK):
                part, mark = made[at : at + _BLOCK], marks[at : at + _BLOCK]
                off, on = np.flatnonzero(~mark), np.flatnonzero(mark)
                part[off] = now[zero : zero + len(off)]
                part[on] = now[one : one + len(on)] | bit
                zero, one = zero + len(off), one + len(on)
            now = made
        return now

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at the places ``at``."""
        at = np.array(at, np.int64, ndmin=1)
        out = np.zeros(len(at), np.int64)
        for level in range(self.levels):
            plane = self.plane(level)
            bit, ones = plane.get(at).astype(bool), plane.rank(at)
            out = out << 1 | bit
            at = np.where(bit, plane.zeros + ones, at - ones)
        return out

    def _range(self, token: int, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where ``token`` of the places lo to hi stands after the last plane."""
        lo, hi = np.array(lo, np.int64, ndmin=1), np.array(hi, np.int64, ndmin=1)
        if token < 0 or token >> self.levels:
            return lo, lo
        for level in range(self.levels):
            plane = self.plane(level)
            a, b = plane.rank(lo), plane.rank(hi)
            one = token >> (self.levels - 1 - level) & 1
            lo, hi = (plane.zeros + a, plane.zeros + b) if one else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo=0, hi=None) -> np.ndarray:
        """Occurrences of ``token`` in each of the ranges lo to hi (exclusive)."""
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def positions(self, token: int, first: int = 0, most: int | None = None) -> np.ndarray:
        """Places of the occurrences of ``token``, ascending, from the ``first``-th on."""
        lo, hi = (int(x[0]) for x in self._range(token, 0, self.n))
        at = np.arange(lo + first, hi if most is None else min(hi, lo + first + most))
        for level in range(self.levels - 1, -1, -1):
            if not len(at):
                return at
            plane = self.plane(level)
            one = token >> (self.levels - 1 - level) & 1
            at = plane.select(bool(one), at - plane.zeros if one else at)
        return at


# ---------------------------------------------------------------- file format
def pack_shard(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """One file: head, document table, planes (bits, then ones before each step)."""
    press = zstandard.ZstdCompressor(level=1).compress
    matrix = WaveletMatrix.build(ids)
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8")
    null = np.packbits(np.array([d is None for d in doc_ids], bool), bitorder="little")
    table = press(keys.tobytes() + np.array(lengths, "<u8").tobytes() + null.tobytes())
    out = [b"", table]
    for level in range(matrix.levels):
        plane = matrix.plane(level)
        bits, before = press(plane.bits.astype("<u8").tobytes()), press(plane.before.astype("<u4").tobytes())
        out += [_PLANE.pack(plane.zeros, len(bits), len(before)), bits, before]
    body = b"".join(out)
    return _HEAD.pack(_MAGIC, matrix.levels, matrix.n, len(keys), len(table), zlib.crc32(body)) + body


class Shard:
    """A file's bytes, opened: ``doc_ids``, ``starts`` (one more than documents),
    ``tokens`` (the wavelet matrix)."""

    def __init__(self, data: bytes) -> None:
        magic, levels, n, docs, table, crc = _HEAD.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("not a token file")
        end = _HEAD.size + table
        unpack = zstandard.ZstdDecompressor().decompress
        raw = unpack(data[_HEAD.size : end])
        null = np.unpackbits(np.frombuffer(raw, np.uint8, offset=16 * docs), count=docs, bitorder="little").astype(bool)
        self.doc_ids = [None if z else int(d) for d, z in zip(np.frombuffer(raw, "<i8", docs), null)]
        self.lengths = np.frombuffer(raw, "<u8", docs, 8 * docs).astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))
        places = []
        for _ in range(levels):
            zeros, bits, before = _PLANE.unpack_from(data, end)
            places.append((zeros, end + _PLANE.size, bits, before))
            end += _PLANE.size + bits + before
        if zlib.crc32(memoryview(data)[_HEAD.size : end]) != crc:
            raise ValueError("a token file is damaged")

        def plane(level: int) -> Plane:
            zeros, at, bits, before = places[level]
            packed = np.frombuffer(unpack(data[at : at + bits]), "<u8")
            return Plane(packed, n, np.frombuffer(unpack(data[at + bits : at + bits + before]), "<u4"), zeros)

        self.tokens = WaveletMatrix(n, levels, plane)


# ---------------------------------------------------------------- encoding
class _Recent(dict):
    """Ids of texts as bytes, made when missing; when full, the older half goes."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > KEEP_CHARS:
                return value
        if len(self) >= KEEP:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def _list(values: pa.Array) -> list:
    return values.to_numpy(zero_copy_only=False).tolist()  # faster than to_pylist


class Encoder:
    """The tokenizer of one file; words met before are not encoded again.

    The byte-level split pattern puts a blank with the printable character
    after it, and a single line feed between printable characters is a piece of
    its own.  Texts of that plain kind are cut into words by Arrow, equal words
    of a batch are one, and only words not met before go to the library's model,
    without the stops and commas at their end, which are a piece too.  All else
    (other blanks, special strings, other files) is encoded whole by the
    library."""

    _LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
    _WORD = f"^[\x01\x02]?[{_LETTERS}]+$"
    _STOPS = ".,;:!?"

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        pre = str(self.library.pre_tokenizer)
        byte_level = "ByteLevel" in pre and "use_regex=True" in pre and "add_prefix_space=False" in pre and self.library.normalizer is None
        special = [re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()]
        odd = ["[\x01\x02]", rf" [^!-~{self._LETTERS}]", " $", rf"\n[^!-~{self._LETTERS}]", rf"[^!-~{self._LETTERS}]\n", "^\n", "\n$", *special]
        self.odd = "|".join(odd) if byte_level else ""
        self.model = self.library.model
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spare = iter(range(256, 512))
        self.symbols = {b: chr(b) if b in shown else chr(next(spare)) for b in range(256)}
        self.wide = self.library.get_vocab_size(with_added_tokens=True) > 1 << 16
        self.kind = np.dtype("<u4" if self.wide else "<u2")
        self.pieces, self.items = _Recent(self._piece), _Recent(self._item)

    def _bytes(self, ids: list[int]) -> bytes:
        return array("I" if self.wide else "H", ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        """A marked word of letters, or a run of stops: one piece (after a line feed)."""
        if piece[:1] == "\x01":
            return self.items["\x02\n"] + self.pieces["\x02" + piece[1:]]
        if piece.isascii():  # printable, so only the blank has a stand-in
            symbols = piece[1:] if piece[:1] == "\x02" else self.symbols[32] + piece
        else:
            piece = piece[1:] if piece[:1] == "\x02" else " " + piece
            symbols = piece.encode().decode("latin-1").translate(self.symbols)
        return self._bytes([t.id for t in self.model.tokenize(symbols)])

    def _item(self, item: str) -> bytes:
        """A marked word of any characters."""
        mark = item[:1]
        return self.whole(item[1:] if mark == "\x02" else "\n" + item[1:] if mark == "\x01" else " " + item)

    def whole(self, text: str) -> bytes:
        return self._bytes(self.library.encode(text, add_special_tokens=False).ids)

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        marked = pc.binary_join_element_wise(pa.scalar("\x02", pa.large_string()), pc.replace_substring(texts, "\n", " \x01"), pa.scalar("", pa.large_string()))
        words = pc.split_pattern(marked, " ")
        coded = words.flatten().dictionary_encode()
        items = coded.dictionary
        stems = pc.utf8_rtrim(items, self._STOPS)
        good = _list(pc.match_substring_regex(stems, self._WORD))
        known, whole = self.pieces, self.items
        made = [
            (known[s] + known["\x02" + i[len(s) :]] if len(s) < len(i) else known[s]) if g else whole[i]
            for g, s, i in zip(good, _list(stems), _list(items))
        ]
        out = pa.array(made, pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(out.buffers()[1], np.int64)[out.offset : out.offset + len(out) + 1]
        lists = words.offsets.to_numpy() - words.offsets[0].as_py()
        data = out.buffers()[2]
        ids = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(self.kind) if data is not None else np.zeros(0, self.kind)
        return ids, (ends[lists] - ends[0]) // self.kind.itemsize

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (NULL: empty), and where each text's ids begin
        and end."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, self.odd) if self.odd else pa.array([True] * len(texts), pa.bool_())
        ids, at = self._plain(texts.filter(pc.invert(odd)))
        if not (slow := np.flatnonzero(odd.to_numpy(zero_copy_only=False))).size:
            return ids, at
        parts, place = [], iter(zip(at, at[1:]))
        rare = dict(zip(slow.tolist(), texts.filter(odd).to_pylist()))
        for i in range(len(texts)):
            if i in rare:
                parts.append(np.frombuffer(self.whole(rare[i]), self.kind))
            else:
                a, b = next(place)
                parts.append(ids[a:b])
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))


_LOADED: dict[str, Encoder] = {}


def _loaded(path: str) -> Encoder:
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


# ---------------------------------------------------------------- on Spark
def write_files(
    docs: DataFrame,
    path: str,
    tokenizer: str | None = None,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_tokens: int = SHARD_TOKENS,
) -> str:
    """Write ``docs`` (a long id and a text) as token files below ``path``, a
    folder of this session's file system.  ``tokenizer`` is a file that every
    worker can read."""
    spark = docs.sparkSession
    prepare(spark)
    tokenizer = tokenizer or vocabulary_path()
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(tasks, "id", "h").sortWithinPartitions("id", "h", "text").select("id", "text")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = _loaded(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], encoder.kind)
        made, keys, parts, size = 0, [], [], 0

        def full() -> pa.RecordBatch:
            nonlocal made, keys, parts, size
            file = pack_shard(keys, [len(p) + 1 for p in parts], np.concatenate([x for p in parts for x in (p, end)]))
            name = f"s{task:07d}.{made:05d}"
            made, keys, parts, size = made + 1, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([file], pa.binary())], names=["shard", "file"])

        for batch in by_bytes(batches, 1):
            ids, at = encoder.encode(batch.column(1))
            for key, a, b in zip(batch.column(0).to_pylist(), at, at[1:]):
                if size and size + b - a + 1 > shard_tokens:
                    yield full()
                keys.append(key)
                parts.append(ids[a:b])
                size += b - a + 1
        if keys:
            yield full()

    made = rows.mapInArrow(shards, "shard string, file binary")
    # The text sink writes a row's bytes as they are, and a line feed after them.
    made.select("shard", F.col("file").cast("string").alias("file")).write.partitionBy("shard").mode("overwrite").option("compression", "none").text(path)
    return path


def open_files(spark: SparkSession, path: str) -> DataFrame:
    """shard, content: the files below ``path``; no row if none was written."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "part-*")
        .option("recursiveFileLookup", "true")
        .load(path)
        .withColumn("shard", F.regexp_extract("path", "shard=([^/]+)/", 1))
        .select("shard", "content")
    )


def _each(files: DataFrame, work, schema: str) -> DataFrame:
    """``work(shard name, opened file)`` -> columns, for each file."""
    prepare(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1)):
                yield pa.RecordBatch.from_pydict(work(name.as_py(), Shard(data.as_buffer().to_pybytes())))

    return files.mapInArrow(run, schema)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, shard, place (in the shard), at (ids of
    the shard before it), n_tokens, ids_crc32 (of its ids as little-endian
    unsigned 32-bit integers)."""

    def work(name: str, shard: Shard) -> dict:
        ids = memoryview(shard.tokens.ids().astype("<u4")).cast("B")
        ends = 4 * shard.starts
        crc = [zlib.crc32(ids[a:b]) for a, b in zip(ends, ends[1:])]
        n = len(crc)
        return {
            "doc_id": pa.array(shard.doc_ids, pa.int64()),
            "shard": pa.array([name] * n, pa.string()),
            "place": pa.array(range(n), pa.int32()),
            "at": pa.array(shard.starts[:-1], pa.int64()),
            "n_tokens": pa.array(shard.lengths, pa.int64()),
            "ids_crc32": pa.array(crc, pa.int64()),
        }

    return _each(open_files(spark, path), work, "doc_id long, shard string, place int, at long, n_tokens long, ids_crc32 long")


def with_starts(documents: DataFrame) -> DataFrame:
    """``read_documents`` with ``start``: ids of all documents before it.

    Totals a shard are summed within groups of shards that one task wrote, then
    over the groups, so no task holds more than one row a task or a task's shards."""
    totals = documents.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("task", F.substring("shard", 2, 7))
    totals = written(totals, "shard-totals")
    inner = Window.partitionBy("task").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = totals.groupBy("task").agg(F.sum("n").alias("n")).select("task", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("b"))
    base = totals.withColumn("a", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(tasks, "task").select("shard", (F.col("a") + F.col("b")).alias("base"))
    return documents.join(base, "shard").withColumn("start", F.col("base") + F.col("at")).drop("base")


def token_counts(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """shard, token, n: how often each id occurs in each file, by ranks alone."""
    tokens = [int(t) for t in tokens]

    def work(name: str, shard: Shard) -> dict:
        n = [int(shard.tokens.count(t)[0]) for t in tokens]
        return {"shard": pa.array([name] * len(n), pa.string()), "token": pa.array(tokens, pa.int32()), "n": pa.array(n, pa.int64())}

    return _each(open_files(spark, path), work, "shard string, token int, n long")


def occurrences(spark: SparkSession, path: str, token: int) -> DataFrame:
    """doc_id, shard, offset (in the document): every place of one id."""

    def work(name: str, shard: Shard) -> dict:
        at = shard.tokens.positions(token)
        doc = np.searchsorted(shard.starts, at, side="right") - 1
        return {
            "doc_id": pa.array([shard.doc_ids[d] for d in doc], pa.int64()),
            "shard": pa.array([name] * len(at), pa.string()),
            "offset": pa.array(at - shard.starts[doc], pa.int64()),
        }

    return _each(open_files(spark, path), work, "doc_id long, shard string, offset long")
