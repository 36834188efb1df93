"""Quality classifier: naive Bayes support vectors.

N-gram indicators (words, word pairs, word shapes and shape pairs, hashed to
``2 ** BITS`` features) are scaled by the log-count ratio of the two classes;
the ratios come from *all* labelled training rows.  A linear hinge-loss model
over the scaled, length-normalised vectors is fitted by dual coordinate
descent on at most ``fit_rows`` labelled rows (the only bounded sample, chosen
by hash); a logistic curve fitted on the same rows turns margins into scores.

Defined results: NULL or empty text has no feature and gets the score of the
intercept; rows with a NULL or unlabelled id are scored like any other; a
repeated row gets the same score each time; a label other than 0/1 or NULL is
not learnt from; without rows of both classes every score is 1.0 (nothing can
be rejected); extra columns are kept.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kharif.llm.common import by_hash, fresh, prepare, slices

BITS = 18
SIZE = 1 << BITS
#: Labelled rows that the hinge-loss fit sees at most; counts see all of them.
FIT_ROWS = 6_000
EPOCHS = 8
COST = 1.0
THRESHOLD = 0.7
#: Distinct words kept per worker before the word table starts anew.
WORDS = 200_000

_RUNS = ((re.compile(r"[^\W\d_]+"), "a"), (re.compile(r"\d+"), "0"))


def _shape(word: str) -> str:
    """Letters to one mark by case, digits to one mark, signs kept; 12 signs at most."""
    case = "A" if word.isupper() else "a"
    out = _RUNS[0][0].sub(case, word)
    return _RUNS[1][0].sub("0", out)[:12]


class Ngrams:
    """Hashed indicator features of texts; words are hashed once per worker."""

    def __init__(self) -> None:
        self.table: dict[str, int] = {}

    def _codes(self, words: list[str]) -> np.ndarray:
        table = self.table
        if len(table) > WORDS:
            table.clear()
        for w in set(words).difference(table):
            shape = _shape(w).encode()
            table[w] = zlib.crc32(w.encode("utf-8", "replace")) << 31 | zlib.crc32(shape, 7) >> 1
        return np.fromiter(map(table.__getitem__, words), np.int64, len(words))

    def of(self, text: str | None) -> np.ndarray:
        """Sorted distinct feature numbers of one text."""
        words = text.split() if text else []
        if not words:
            return np.empty(0, np.int64)
        both = self._codes(words)
        word, shape = both >> 31, both & 0x7FFFFFFF
        again = (word[1:] == word[:-1]).astype(np.int64)
        parts = [
            word * 2654435761,
            shape * 2246822519 + 1,
            word[:-1] * 3266489917 + word[1:] * 668265263 + 2,
            shape[:-1] * 374761393 + shape[1:] * 2654435789 + again * 97 + 3,
        ]
        mixed = np.concatenate(parts)
        mixed ^= mixed >> 29
        mixed *= 0x2545F4914F6CDD1D
        return np.unique((mixed >> 40) & (SIZE - 1))


@dataclass
class Vectors:
    """Scaled indicator vectors of unit length: the features of row i are
    ``at[starts[i]:starts[i + 1]]``, their values the ratios times ``unit[i]``."""

    at: np.ndarray
    starts: np.ndarray
    ratio: np.ndarray
    unit: np.ndarray

    @classmethod
    def of(cls, at: np.ndarray, starts: np.ndarray, ratio: np.ndarray) -> Vectors:
        square = np.concatenate([[0.0], np.cumsum(ratio[at].astype(float) ** 2)])
        norm = np.sqrt(np.maximum(square[starts[1:]] - square[starts[:-1]], 0))
        return cls(at, starts, ratio, np.where(norm > 1e-9, 1 / np.maximum(norm, 1e-9), 0.0))

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        at = self.at[self.starts[i] : self.starts[i + 1]]
        return at, self.ratio[at] * self.unit[i]


def dual_coordinate_descent(rows: Vectors, sign: np.ndarray, cost: np.ndarray, size: int, epochs: int, seed: int = 1) -> np.ndarray:
    """Weights (the last one the intercept) of the hinge-loss model: each step
    solves the dual of one row exactly and keeps it within [0, cost]."""
    weights, alpha = np.zeros(size + 1), np.zeros(len(sign))
    square = np.where(rows.unit > 0, 2.0, 1.0)  # a unit vector and the intercept
    order, draw = np.arange(len(sign)), np.random.default_rng(seed)
    for _ in range(epochs):
        draw.shuffle(order)
        moved = 0.0
        for i in order:
            at, values = rows.row(i)
            slope = sign[i] * (weights[at] @ values + weights[-1]) - 1.0
            now = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
            if (step := now - alpha[i]) != 0.0:
                weights[at] += step * sign[i] * values
                weights[-1] += step * sign[i]
                alpha[i] = now
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return weights


def _curve(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through margins (Newton steps on
    smoothed targets)."""
    n1, n0 = good.sum(), (~good).sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    x = np.column_stack([margin, np.ones(len(margin))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        grad = x.T @ (p - target)
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


@dataclass
class Model:
    weight: np.ndarray | None  # per feature: log-count ratio times hinge weight
    ratio: np.ndarray | None
    intercept: float = 0.0
    slope: float = 1.0
    offset: float = 0.0

    def score(self, features: np.ndarray) -> float:
        if self.weight is None:
            return 1.0
        margin = self.intercept
        if len(features):
            values = self.ratio[features]
            norm = np.sqrt(values @ values)
            if norm > 0:
                margin += float(self.weight[features] @ values) / norm
        return float(1 / (1 + np.exp(-min(max(self.slope * margin + self.offset, -30.0), 30.0))))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each class that hold a feature; one partial table a task."""
    counts, docs, grams = np.zeros((2, SIZE), np.int64), np.zeros(2, np.int64), Ngrams()
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[label][grams.of(text)] += 1
            docs[label] += 1
    some = np.flatnonzero(counts.sum(0))
    if docs.sum():
        at = np.concatenate([some, [-1]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(at), *(pa.array(np.concatenate([counts[k][some], [docs[k]]])) for k in (0, 1))],
            names=["feature", "n0", "n1"],
        )


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams = Ngrams()
    for batch in slices(batches, 500):
        found = [grams.of(t).astype(np.int32).tobytes() for t in batch.column(0).to_pylist()]
        columns = [pa.array(found, pa.binary()), batch.column(1), batch.column(2)]
        yield pa.RecordBatch.from_arrays(columns, names=["f", "label", "key"])


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> Model:
    """Fit on rows with a label of 0 or 1.  Counts cover every row; the hinge
    loss sees the ``fit_rows`` rows with the smallest hash of all columns."""
    prepare(labelled.sparkSession)
    columns = [F.col(f"`{c}`") for c, kind in labelled.dtypes if "map<" not in kind and kind != "variant"]
    rows = labelled.select(
        F.col(f"`{text_col}`").alias("text"),
        F.col(f"`{label_col}`").cast("int").alias("label"),
        F.xxhash64(*columns).alias("key"),
    ).where("label in (0, 1)")
    counts = (
        rows.select("text", "label").mapInArrow(_count, "feature long, n0 long, n1 long")
        .groupBy("feature")
        .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        .toArrow()  # at most 2 ** BITS + 1 rows
    )
    feature = counts["feature"].to_numpy()
    held, total = np.ones((2, SIZE)), [0, 0]
    for k in (0, 1):
        n = counts[f"n{k}"].to_numpy()
        total[k] = int(n[feature < 0].sum())
        held[k][feature[feature >= 0]] += n[feature >= 0]
    del counts
    if not total[0] or not total[1]:
        return Model(None, None)
    ratio = np.log(held[1] / held[1].sum()) - np.log(held[0] / held[0].sum())

    docs = sum(total)
    picked = rows
    if docs > fit_rows:  # an even share by hash, a little over it, then the exact bound
        picked = rows.where(by_hash(F.col("key"), (1.1 * fit_rows + 50) / docs))
    picked = picked.mapInArrow(_features, "f binary, label int, key long").limit(2 * fit_rows).toArrow()
    picked = picked.sort_by([("key", "ascending"), ("label", "ascending")]).slice(0, fit_rows).combine_chunks()
    label, found = picked["label"].to_numpy(), picked["f"].to_pylist()
    del picked
    starts = np.concatenate([[0], np.cumsum([len(f) // 4 for f in found])])
    ratio = ratio.astype(np.float32)
    vectors = Vectors.of(np.frombuffer(b"".join(found), np.int32), starts, ratio)
    del found
    n0, n1 = int((label == 0).sum()), int((label == 1).sum())
    if not n0 or not n1:
        return Model(None, None)
    sign = np.where(label == 1, 1.0, -1.0)
    cost = np.where(label == 1, COST, COST * min(4.0, max(1.0, n1 / n0)))  # the rarer class counts more
    w = dual_coordinate_descent(vectors, sign, cost, SIZE, EPOCHS)
    margin = np.array([w[at] @ values for at, values in map(vectors.row, range(len(sign)))]) + w[-1]
    slope, offset = _curve(margin, label == 1)
    return Model(w[:-1].astype(np.float32), ratio, float(w[-1]), slope, offset)


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, out: str = "score") -> DataFrame:
    """``docs`` (all columns, or ``keep``) with the score of each whole text."""
    prepare(docs.sparkSession)
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    shared = spark.sparkContext.broadcast(model)  # 2 ** BITS weights: a fixed size
    text = fresh(docs, "text")
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias(text))
    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField(out, T.DoubleType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, grams = shared.value, Ngrams()
        for batch in batches:
            values = [fitted.score(grams.of(t)) for t in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(values, pa.float64())], names=[*keep, out])

    return rows.mapInArrow(scored, schema)
