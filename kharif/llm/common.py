"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kharif.session import cut_lineage

#: Rows of one Arrow batch: whole texts of up to some 100 KB stay below 250 MB.
BATCH_ROWS = 2000


_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (a
    cluster that ships it otherwise is not disturbed), and bound what one Arrow
    batch of long texts holds in a worker."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), _ROOT) if x)
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: one written table in the shared checkpoint folder."""
    return cut_lineage(df, name)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not use (extra columns may clash)."""
    name, taken = f"__{stem}", {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`"), F.lit(""))


def slices(batches: Iterator, rows: int) -> Iterator:
    """The batches cut into pieces of at most ``rows`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: Bytes of text that are worked on at a time.
SLICE_BYTES = 8 << 20


def by_bytes(batches: Iterator, column: int, most: int = SLICE_BYTES) -> Iterator:
    """The batches cut so that a piece holds about ``most`` bytes of the texts
    in ``column``, or one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            yield batch.slice(at, upto - at)
            at = upto


#: Bits of an id filter (1 MB).
FILTER_BITS = 1 << 23


def id_filter(ids: DataFrame, name: str) -> np.ndarray:
    """Bits of all ids, a fixed size whatever their number, so that every task
    may have it.  It only ever lets too many rows through."""
    bit = filter_bit(name)
    words = ids.select(F.shiftright(bit, 5).alias("w"), F.pmod(bit, F.lit(32)).cast("int").alias("b"))
    words = words.groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("m")).toArrow()  # at most FILTER_BITS / 32 rows
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    out[words["w"].to_numpy()] = words["m"].to_numpy().astype(np.uint32)
    return out


def filter_bit(name: str) -> Column:
    return F.pmod(F.xxhash64(f"`{name}`"), F.lit(FILTER_BITS))


def passes(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool)


def maybe_in(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """``docs`` without most of the rows whose ``name`` (a long) is not among
    ``ids``: what a following join need not shuffle."""
    prepare(docs.sparkSession)
    known, mark = docs.sparkSession.sparkContext.broadcast(id_filter(ids, name)), fresh(docs, "bit")

    def let(batches: Iterator) -> Iterator:
        for batch in batches:
            at = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(passes(known.value, at))).select(list(range(batch.num_columns - 1)))

    return docs.withColumn(mark, filter_bit(name)).mapInArrow(let, docs.schema)


def by_hash(hashed: Column, share: float) -> Column:
    """True for about ``share`` of all values of a 64-bit hash."""
    return F.lit(True) if share >= 1 else hashed < F.lit(int(-(2**63) + min(share, 0.999) * 2**64))
