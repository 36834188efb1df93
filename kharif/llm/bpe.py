"""BPE encoding and decoding with the vocabulary of a public tokenizer file.

Each piece of text is a doubly linked list of symbols; a priority queue holds
the ranks of the merges that neighbours allow.  The lowest rank (then the
leftmost place) is merged first; entries whose symbols have changed meanwhile
are stale and skipped.  Decoding concatenates vocabulary strings as the file
prescribes (without a decoder: joined by one blank).

The file's rules that this reads: added tokens matched in the raw text; NFC,
white-space replacement and lower case; the split pattern; byte-level symbols;
the word-end suffix.  A file with other rules is refused.

Defined results: NULL or empty text (or only white space) has no token;
repeated rows are encoded each for itself; a piece of any length is merged in
n log n steps; extra columns are kept.
"""

from __future__ import annotations

import hashlib
import json
import operator
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kharif.llm.common import fresh, prepare

VOCABULARY = "word_bpe_49k.json"
#: Words whose tokens a worker keeps, in each of two generations.
KEEP = 200_000
#: Longer words are not kept.
KEEP_CHARS = 40


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte (the public byte-level alphabet)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {}, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return [out[b] for b in range(256)]


class _Recent(dict):
    """A bounded table of made values: when full, the older generation goes."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> tuple:
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


#: The number of tokens of a made value.
_SOME = operator.itemgetter(1)


def _joined(made: list[tuple[str, int, str]]) -> tuple[str, int, str]:
    if not made:
        return "", 0, ""
    ids, n, names = zip(*made)
    return " ".join(ids), sum(n), " ".join(names)


class Bpe:
    """Encoder and decoder of one tokenizer file (its JSON text)."""

    def __init__(self, definition: str) -> None:
        d = json.loads(definition)
        model, norm, pre = d["model"], d["normalizer"] or {}, d["pre_tokenizer"] or {}
        kinds = [n["type"] for n in norm.get("normalizers", [])]
        splits = pre.get("pretokenizers", [])
        if (
            model["type"] != "BPE"
            or kinds != ["NFC", "Replace", "Lowercase"]
            or norm["normalizers"][1] != {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
            or [s["type"] for s in splits] != ["Split", "ByteLevel"]
            or splits[0]["behavior"] != "Removed"
            or not splits[0]["invert"]
            or splits[1]["use_regex"]
            or splits[1]["add_prefix_space"]
            or model.get("unk_token")
            or model.get("continuing_subword_prefix")
            or d.get("post_processor")
            or d.get("decoder")
        ):
            raise ValueError("this tokenizer file has rules that are not built")
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.names = {i: s for s, i in self.vocab.items()}
        merges = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        # By left id: right id -> (rank, merged id).
        self.ranks: list[dict[int, tuple[int, int]]] = [{} for _ in range(max(self.vocab.values()) + 1)]
        for rank, (a, b) in enumerate(merges):
            self.ranks[self.vocab[a]][self.vocab[b]] = rank, self.vocab[a + b]
        symbols = _byte_symbols()
        # The id of each byte inside a piece and at its end; -1: not in the file.
        self.first = [self.vocab.get(s, -1) for s in symbols]
        self.last = [self.vocab.get(s + self.end, -1) for s in symbols]
        # No split alternative spans white space, and after NFC lower case and
        # the split work on each word alone.
        self.pieces = regex.compile(splits[0]["pattern"]["Regex"])
        self.added = {t["content"]: t["id"] for t in d["added_tokens"]}
        for t in d["added_tokens"]:
            if t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]:
                raise ValueError("this tokenizer file has rules that are not built")
            self.names[t["id"]] = t["content"]
        longest = sorted(self.added, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, longest))) if longest else None
        self.words, self.parts = _Recent(self._word), _Recent(self._part)

    def merge(self, piece: str) -> list[int]:
        """Token ids of one piece."""
        text = piece.encode("utf-8", "replace")
        ids = [i for i in map(self.first.__getitem__, text[:-1]) if i >= 0]
        if (end := self.last[text[-1]]) >= 0:
            ids.append(end)
        n, ranks = len(ids), self.ranks
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        # An entry is one number: the rank, then the place.
        bits = n.bit_length()
        place = (1 << bits) - 1
        queue = [r[0] << bits | i for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := ranks[a].get(b))]
        heapify(queue)
        while queue:
            entry = heappop(queue)
            i = entry & place
            left, j = ids[i], after[i]
            if left < 0 or j >= n or (r := ranks[left].get(ids[j])) is None or r[0] != entry >> bits:
                continue  # stale: one of the two has been merged meanwhile
            ids[i] = made = r[1]
            ids[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if r := ranks[made].get(ids[k]):
                    heappush(queue, r[0] << bits | i)
            if (h := before[i]) >= 0 and (r := ranks[ids[h]].get(made)):
                heappush(queue, r[0] << bits | h)
        return [i for i in ids if i >= 0]

    def _part(self, piece: str) -> tuple[str, int, str]:
        """Ids (decimal, joined by blanks), their number, vocabulary strings."""
        ids = self.merge(piece)
        return " ".join(map(str, ids)), len(ids), " ".join([self.names[i] for i in ids])

    def _word(self, word: str) -> tuple[str, int, str]:
        if word.isascii() and word.isalpha():
            return self.parts[word.lower()]
        pieces = self.pieces.findall(word.replace("Σ", "σ").lower())
        if len(pieces) == 1:
            return self.parts[pieces[0]]
        return _joined([p for p in map(self.parts.__getitem__, pieces) if p[1]])

    def _plain(self, text: str) -> Iterator[tuple[str, int, str]]:
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # U+001C to U+001F part words for str.split(), but are no white space here.
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f")
        split = filter(None, regex.split(r"\s+", text)) if odd else text.split()
        return filter(_SOME, map(self.words.__getitem__, split))

    def encode(self, text: str | None) -> tuple[str, int, str]:
        """(ids in decimal joined by blanks, their number, the decoded text)."""
        text, out, at = text or "", [], 0
        if self.special and "<" in text:
            for m in self.special.finditer(text):
                out += self._plain(text[at : m.start()])
                out.append((str(self.added[m.group()]), 1, m.group()))
                at = m.end()
        out += self._plain(text[at:] if at else text)
        return _joined(out)

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.names[i] for i in ids if i in self.names])


_LOADED: dict[str, Bpe] = {}


def _loaded(key: str, definition: str) -> Bpe:
    """One encoder a worker and file."""
    if key not in _LOADED:
        _LOADED[key] = Bpe(definition)
    return _LOADED[key]


def _shared(spark: SparkSession, path: str):
    with open(path, encoding="utf-8") as f:
        definition = f.read()
    Bpe(definition)  # refuses a file early
    return hashlib.sha256(definition.encode()).hexdigest(), spark.sparkContext.broadcast(definition)  # a few MB


def encode(docs: DataFrame, path: str | None = None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (all columns, or ``keep``) with token_ids array<int> and
    decoded string of each whole text."""
    return _run(docs, path, text_col, keep, digests=False)


def digests(docs: DataFrame, path: str | None = None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Like ``encode``, but n_tokens, ids_sha256 and decoded_sha256."""
    return _run(docs, path, text_col, keep, digests=True)


def _run(docs: DataFrame, path: str | None, text_col: str, keep: list[str] | None, digests: bool) -> DataFrame:
    prepare(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    key, definition = _shared(docs.sparkSession, path or vocabulary_path())
    if digests:
        made = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    else:
        made = [("token_ids", T.ArrayType(T.IntegerType())), ("decoded", T.StringType())]
    keep = [c for c in keep if c.lower() not in {m for m, _ in made}]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias(fresh(docs, "text")))
    schema = T.StructType([*(rows.schema[c] for c in keep), *(T.StructField(n, t) for n, t in made)])

    def hashed(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(key, definition.value)
        for batch in batches:
            columns = [batch.column(i) for i in range(len(keep))]
            texts = batch.column(batch.num_columns - 1)
            if digests:
                n, ids, decoded = [], [], []
                for t in texts:
                    i, k, s = bpe.encode(t.as_py())
                    n.append(k)
                    ids.append(hashed(i))
                    decoded.append(hashed(s))
                columns += [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            else:
                found = [bpe.encode(t.as_py()) for t in texts]
                ids = [list(map(int, i.split())) for i, _, _ in found]
                columns += [pa.array(ids, pa.list_(pa.int32())), pa.array([s for _, _, s in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(encoded, schema)
