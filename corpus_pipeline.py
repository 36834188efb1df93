"""A training-data pipeline: each stage is one operator of ``kharif.llm``.

``run(spark, sf_dir)`` applies STAGES to ``documents``; each result is written
as Parquet to the shared checkpoint folder and read again as the next stage's
input, so a lost executor never goes back beyond the last written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kharif.llm import bpe, mixing, pii, quality, simhash
from kharif.llm.common import fresh, written
from kharif.llm.queries import quality_model
from kharif.sources.tables import read_table

#: Neither the fitted classifiers nor SimHash, nor BPE, have a form in SQL.
ORACLE_SQL = None

#: The mix asks for as many tokens as there are, from at most two epochs.
MIX_PERCENT, MIX_EPOCHS = 100, 2


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    score = fresh(docs, "score")
    scored = quality.score(docs, quality_model(spark, docs, sf_dir), out=score)
    return scored.where(F.col(score) >= quality.THRESHOLD).drop(score)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the one with the smallest id."""
    return simhash.keep_one(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked in their texts."""
    return pii.redact(docs, pii.fit(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at the target weights; one that a second epoch takes comes twice.
    Of the document in which a leaf's budget ends only the prefix of its words
    that the budget covers is left (``n_chars`` follows).  Columns of ``docs``
    named like the mixer's own are not touched."""
    row = fresh(docs, "row")
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), *[F.col(f"`{c}`") for c in ("doc_id", "text", "lang", "source")])
    chosen = mixing.mix(named, percent=MIX_PERCENT, max_epochs=MIX_EPOCHS, keep=[row])
    cut = F.col("take_tokens") < F.col("n_tokens")
    words = F.slice(F.regexp_extract_all(F.col(f"{row}.text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), 1, F.col("take_tokens").cast("int"))
    text = F.when(cut, F.array_join(words, "")).otherwise(F.col(f"{row}.text"))
    columns = [text.alias(c) if c == "text" else F.col(f"{row}.`{c}`") for c in docs.columns]
    out = chosen.select(*columns, cut.alias(row))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(row), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop(row)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document."""
    return bpe.digests(docs, keep=["doc_id"])


STAGES = [
    ("quality", good_quality),
    ("simhash", one_of_each),
    ("pii", without_personal_data),
    ("mixing", mixed),
    ("bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
