"""The pipeline's stages on small tables, against brute force."""

import re

from pyspark.sql import functions as F

import corpus_pipeline as cp
from kharif.llm import simhash

WORD = r"[^\x20\x09-\x0D]+"


def test_unlike_texts_under_one_id_are_both_kept(spark):
    a, b, c = ("alpha beta gamma delta epsilon " * 9, "one two three four five six " * 9, "red green blue black white " * 9)
    rows = [(1, a, "x"), (1, b, "x"), (2, c, "x"), (3, a, "y"), (3, a, "y"), (None, b, "z"), (None, "lone text of its own " * 7, "z")]
    table = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((r["doc_id"] or 99, r["text"][:5], r["fp"]) for r in simhash.keep_one(table).collect())
    assert got == [(1, a[:5], "x"), (1, b[:5], "x"), (2, c[:5], "x"), (99, "lone ", "z")]


def test_mixing_cuts_the_last_document_and_keeps_columns(spark, monkeypatch):
    monkeypatch.setattr(cp, "MIX_PERCENT", 55)
    texts = [f" w{i}\tx{i}  y{i}\nz{i} " * (i % 5 + 1) for i in range(40)] + ["", None]
    rows = [(i, t, "en" if i % 3 else "de", f"src{i % 4}", None if t is None else len(t), "own", i) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, domain string, epoch int")
    out = cp.mixed(spark, table, "")
    assert out.columns == table.columns and out.schema == table.schema or [f.name for f in out.schema] == table.columns
    got = out.collect()
    total = sum(len(re.findall(WORD, t or "")) for t in texts)
    taken = sum(len(re.findall(WORD, r["text"])) for r in got)
    assert total * 55 // 100 - 12 <= taken <= total * 55 // 100  # shares round down, leaf by leaf
    cut = [r for r in got if r["text"] != texts[r["doc_id"]]]
    assert cut and all(texts[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"]) for r in cut)
    assert all(r["domain"] == "own" and r["epoch"] == r["doc_id"] for r in got)


def test_whole_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    before = spark.read.parquet(f"{sf}/documents.parquet")
    docs, kept = before, {}
    for name, stage in cp.STAGES:
        kept[name] = docs = cp.written(stage(spark, docs, sf), f"test-{name}")
        if name != "bpe":
            assert docs.columns == before.columns, name
    n = {k: v.count() for k, v in kept.items()}
    assert before.count() >= n["quality"] >= n["simhash"] == n["pii"] and n["mixing"] == n["bpe"] > 0
    groups = simhash.near_duplicates(kept["simhash"].select("doc_id", "text"))
    assert groups.groupBy("component_id").count().where("count > 1").count() == 0
    ids = kept["simhash"].select("doc_id")
    assert kept["mixing"].join(ids, "doc_id", "left_anti").count() == 0
    assert kept["bpe"].where(F.col("n_tokens") < 0).count() == 0
