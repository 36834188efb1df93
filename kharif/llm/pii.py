"""Personal data by weak supervision.

Exact patterns give the *base* spans, which always stay.  Looser patterns give
further candidates.  Four labelers vote on every candidate (1 personal, -1
not, 0 abstains): strict pattern, gazetteer, context words, shape.  Votes are
counted over all texts; expectation-maximisation over the counted vote
patterns (at most a few thousand, whatever the input) estimates how reliable
each labeler is, and the resulting probabilities train a logistic span
classifier over votes, kind and length.  A second pass adds the candidates
that the classifier accepts.

Defined results: NULL text counts as empty; repeated rows are handled each on
its own; a candidate that overlaps a base span is never added; without any
candidate nothing is added; extra columns are kept.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kharif.llm.common import fresh, slices, prepare

KINDS = ("email", "ip", "card", "phone")
#: What a redacted span turns into.
MASKS = {k: f"[{k.upper()}]" for k in KINDS}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
# No step back inside a run of digits can help a dot to match, and a run that
# fails from its first digit fails from every later one.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Looser candidates.
_AT = re.compile(r"[ ]?[(\[](?:at|AT)[)\]][ ]?")
_DOT = re.compile(r"[A-Za-z0-9-]+(?:(?:\.|[ ]?[(\[](?:dot|DOT)[)\]][ ]?)[A-Za-z0-9-]+)+")
_NATIONAL = re.compile(r"(?<![0-9A-Za-z+.])(?:\([0-9]{2,5}\)[ ]?|0[0-9]{1,4}[ /-]|[2-9][0-9]{2}[ .-])[0-9]{3,4}[ .-]?[0-9]{3,5}(?![0-9A-Za-z])")

# Fixed values of the gazetteer and context labelers.
TOP_DOMAINS = frozenset("com org net edu gov info biz io de fr es uk it nl eu ch at us ca au".split())
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49")
CARD_PREFIXES = ("34", "36", "37", "38", "4", "51", "52", "53", "54", "55", "6011", "62", "65")
CONTEXT = {
    "email": "email e-mail mail contact reach write correo courriel".split(),
    "ip": "ip host server address client node".split(),
    "card": "card visa mastercard credit amex payment karte carte tarjeta".split(),
    "phone": "phone tel telephone call mobile fax cell telefon".split(),
}
AGAINST = "order invoice version isbn id no nr ref serial token hash sku page".split()
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _only_digits(span: str) -> str:
    return "".join(c for c in span if "0" <= c <= "9")


def _local_start(text: str, at: int, floor: int) -> int:
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    return start


def _emails(text: str) -> list[tuple[int, int]]:
    """From each @ the whole run of local characters before it (not into the
    last match): what a leftmost search finds, in linear time."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = _local_start(text, at, floor)
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            floor = m.end()
        at = text.find("@", max(at + 1, floor))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Exact spans of each kind (code points, end exclusive)."""
    out = {"email": _emails(text), "ip": [], "card": [], "phone": []}
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(int(p.lstrip("0")[:4] or "0") <= 255 for p in m.group().split(".")):
                out["ip"].append(m.span())
        for m in _CARD.finditer(text):
            if 16 <= m.end() - m.start() and 16 <= len(d := _only_digits(m.group())) <= 19 and _luhn(d):
                out["card"].append(m.span())
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= len(_only_digits(m.group())) <= 15:
                    out["phone"].append(m.span())
    return out


def _loose(text: str) -> Iterator[tuple[str, int, int]]:
    if "(" in text or "[" in text:
        floor = 0
        for m in _AT.finditer(text):
            start = _local_start(text, m.start(), floor)
            if start < m.start() and (d := _DOT.match(text, m.end())):
                yield "email", start, d.end()
                floor = d.end()
    if _DIGIT.search(text):
        for m in _NATIONAL.finditer(text):
            yield "phone", *m.span()
        for m in _CARD.finditer(text):
            if 13 <= m.end() - m.start() and 13 <= len(_only_digits(m.group())) <= 19:
                yield "card", *m.span()
        for m in _IP.finditer(text):
            yield "ip", *m.span()


def _votes(text: str, kind: str, start: int, end: int, strict: bool) -> tuple[int, int, int, int]:
    span = text[start:end]
    digits = _only_digits(span)
    if strict:
        pattern = 1
    elif kind == "card":
        pattern = 0 if _luhn(digits) else -1
    elif kind == "ip":
        pattern = -1
    else:
        pattern = 0
    if kind == "email":
        gazetteer = 1 if re.split(r"[.)\] ]+", span)[-1].lower() in TOP_DOMAINS else -1
        shape = 1 if 4 <= len(span) <= 80 and not span.startswith(".") else -1
    elif kind == "ip":
        first = int(span.split(".")[0][:6])
        gazetteer = 1 if 1 <= first <= 223 and first != 127 else -1
        shape = -1 if any(len(p) > 1 and p[0] == "0" for p in span.split(".")) else 1
        if text[end : end + 1] == "." and text[end + 1 : end + 2].isdigit():
            shape = -1
    elif kind == "card":
        gazetteer = 1 if digits.startswith(CARD_PREFIXES) else -1
        shape = 1 if len(digits) == 16 and (len(span) == 16 or re.fullmatch(r"(?:[0-9]{4}[ -]){3}[0-9]{4}", span)) else -1
    else:
        gazetteer = (1 if digits.startswith(CALLING_CODES) else -1) if span[0] == "+" else 0
        shape = 1 if re.fullmatch(r"(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{2,5}\)?[ ./-]?[0-9]{3,4}[ .-]?[0-9]{3,5}", span) else -1
    if start and text[start - 1].isalnum() or text[end : end + 1].isalnum():
        shape = -1
    before = [w.lower() for w in _WORD.findall(text[max(0, start - 40) : start])][-4:]
    context = 1 if any(w in CONTEXT[kind] for w in before) else -1 if any(w in AGAINST for w in before) else 0
    return pattern, gazetteer, context, shape


def _length_class(n: int) -> int:
    return min(n // 8, 3)


def _code(kind: str, votes: tuple[int, int, int, int], n: int) -> int:
    """Feature number: kind, four votes of three values, four length classes."""
    code = KINDS.index(kind)
    for v in votes:
        code = code * 3 + v + 1
    return code * 4 + _length_class(n)


def _decode(code: int) -> tuple[int, list[int], int]:
    code, length = divmod(code, 4)
    votes = []
    for _ in range(4):
        code, v = divmod(code, 3)
        votes.append(v - 1)
    return code, votes[::-1], length


def candidates(text: str | None) -> list[tuple[str, int, int, bool, int]]:
    """(kind, start, end, base, feature number) of every candidate: the base
    spans, then the looser ones that overlap none of them nor each other."""
    text = text or ""
    base = base_spans(text)
    out = [(k, s, e, True, _code(k, _votes(text, k, s, e, True), e - s)) for k in KINDS for s, e in base[k]]
    taken = sorted((s, e) for _, s, e, _, _ in out)
    for kind, s, e in _loose(text):
        if all(e <= a or s >= b for a, b in taken):
            out.append((kind, s, e, False, _code(kind, _votes(text, kind, s, e, False), e - s)))
            taken.append((s, e))
    return out


# --- reliabilities and the span classifier -----------------------------------------


def estimate(codes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Probability of each feature number to be personal data, by
    expectation-maximisation over two classes: a prior for each kind and, for
    each class, how often each labeler votes -1, 0, 1."""
    parts = [_decode(int(c)) for c in codes]
    kind = np.array([p[0] for p in parts])
    votes = np.array([p[1] for p in parts]) + 1
    p = np.clip(0.5 + (votes - 1).sum(1) / 8.0, 0.02, 0.98)  # starts at the mean vote
    for _ in range(rounds):
        weight = np.stack([counts * (1 - p), counts * p])
        prior = np.array([(weight[1][kind == k].sum() + 1) / (counts[kind == k].sum() + 2) for k in range(len(KINDS))])
        rate = np.ones((2, 4, 3))
        for y in (0, 1):
            for lf in range(4):
                rate[y, lf] += np.bincount(votes[:, lf], weight[y], 3)
                # a labeler is taken to do no worse than chance
                rate[y, lf, 2 * y] += 2
        rate /= rate.sum(2, keepdims=True)
        like = np.stack([np.log(rate[y])[np.arange(4)[None, :], votes].sum(1) for y in (0, 1)])
        odds = like[1] - like[0] + np.log(prior[kind] / (1 - prior[kind]))
        after = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(after - p).max() < 1e-7:
            return after
        p = after
    return p


def _design(codes: np.ndarray) -> np.ndarray:
    rows = []
    for c in codes:
        kind, votes, length = _decode(int(c))
        row = np.zeros(1 + len(KINDS) + 8 + 4)
        row[0] = 1
        row[1 + kind] = 1
        for lf, v in enumerate(votes):
            row[5 + 2 * lf] = v == 1
            row[6 + 2 * lf] = v == -1
        row[13 + length] = 1
        rows.append(row)
    return np.array(rows).reshape(len(rows), 17)


def train(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Weights of the logistic span classifier on the estimated labels."""
    target, x = estimate(codes, counts), _design(codes)
    w, share = np.zeros(x.shape[1]), counts / counts.sum()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (share * (p - target)) + 1e-4 * w
        hess = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> frozenset[int]:
    """Feature numbers that the trained classifier accepts.  One pass over all
    texts; only counts by feature number leave the tasks."""
    prepare(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[int] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(c[4] for c in candidates(text))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["code", "n"])

    rows = (
        docs.select(F.col(f"`{text_col}`").alias("text"))
        .mapInArrow(counted, "code long, n long")
        .groupBy("code")
        .agg(F.sum("n").alias("n"))
        .orderBy("code")
        .collect()  # at most 4 * 3 ** 4 * 4 rows
    )
    if not rows:
        return frozenset()
    codes, counts = np.array([r["code"] for r in rows]), np.array([float(r["n"]) for r in rows])
    p = 1 / (1 + np.exp(-(_design(codes) @ train(codes, counts))))
    return frozenset(int(c) for c, ok in zip(codes, p >= threshold) if ok)


def found_spans(text: str | None, accepted: frozenset[int]) -> list[tuple[str, int, int, bool]]:
    """All spans of one text by kind as listed, then start."""
    spans = [(k, s, e, base) for k, s, e, base, code in candidates(text) if base or code in accepted]
    return sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1]))


_SPAN = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("base", T.BooleanType()),
    ]
)


def find(docs: DataFrame, accepted: frozenset[int], text_col: str = "text", keep: list[str] | None = None, out: str = "spans") -> DataFrame:
    """``docs`` (all columns, or ``keep``) with its spans as an array of structs."""
    prepare(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    text = fresh(docs, "text")
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias(text))
    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField(out, T.ArrayType(_SPAN))])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def spanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            spans = [[{"kind": k, "start": s, "end": e, "base": b} for k, s, e, b in found_spans(t, accepted)] for t in texts]
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, kind)], names=[*keep, out])

    return rows.mapInArrow(spanned, schema)


def digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redacted(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """The text with every span replaced by the mask of its kind; of spans that
    overlap, the first by start (then the longest) names the mask and the rest
    is covered with it."""
    out, at = [], 0
    for kind, s, e, _ in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], MASKS[kind]]
            at = e
        elif e > at:
            at = e
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, accepted: frozenset[int], text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with masked texts (NULL stays NULL); a column ``length_col``,
    if there, is set to the new length of texts that changed."""
    prepare(docs.sparkSession)
    at = docs.columns.index(text_col)
    length = docs.columns.index(length_col) if length_col in docs.columns else None

    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices([whole], 500):
                old = batch.column(at).to_pylist()
                spans = [found_spans(t, accepted) for t in old]
                new = [redacted(t, s) if s else t for t, s in zip(old, spans)]
                columns = list(batch.columns)
                columns[at] = pa.array(new, columns[at].type)
                if length is not None:
                    sizes = columns[length].to_pylist()
                    sizes = [len(t) if s else n for t, s, n in zip(new, spans, sizes)]
                    columns[length] = pa.array(sizes, columns[length].type)
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(masked, docs.schema)


def report(docs: DataFrame, accepted: frozenset[int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digests of the spans of each document."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias(fresh(docs, "text")))
    schema = T.StructType(
        [
            rows.schema[0],
            *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS),
            T.StructField("base_sha256", T.StringType()),
            T.StructField("spans", T.StringType()),
            T.StructField("n_added", T.LongType()),
        ]
    )

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, shas, spans, added = [[] for _ in KINDS], [], [], []
            for text in batch.column(1).to_pylist():
                found = found_spans(text, accepted)
                base = [x[:3] for x in found if x[3]]
                for k, c in zip(KINDS, counts):
                    c.append(sum(x[0] == k for x in base))
                shas.append(hashlib.sha256(digest(base).encode()).hexdigest())
                spans.append(digest([x[:3] for x in found]))
                added.append(len(found) - len(base))
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas), pa.array(spans), pa.array(added, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(told, schema)
