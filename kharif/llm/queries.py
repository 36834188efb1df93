"""Registered queries of the operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kharif.llm import bpe, chat, collocations, mixing, neighbours, pages, passages, pii, quality, simhash, spelling, token_files, topk
from kharif.llm.common import maybe_in, written
from kharif.session import shared_path
from kharif.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents", *columns)


def held_out(doc_id):
    """Rows whose labels are never learnt from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.Model:
    """Fitted on the labelled rows of ``docs`` that are not held out."""
    labels = read_table(spark, sf_dir, "labels", "doc_id", "quality").where("quality in (0, 1)")
    labels = labels.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # Texts of labelled rows only go through the join (like at every size: as a
    # merge), and are read twice from one written table.
    rows = maybe_in(docs.select("doc_id", "text"), labels, "doc_id").join(labels.hint("merge"), "doc_id")
    return quality.fit(written(rows, "quality-labelled"))


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok").alias("text")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said)
    return chat.read_back(*chat.format_tree(rows.unionByName(own)))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir, "doc_id", "text", "lang", "source"), keep=["doc_id", "lang", "source"])


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text")
    return pii.report(docs, pii.fit(docs))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text")
    scored = quality.score(docs, quality_model(spark, docs, sf_dir), keep=["doc_id"])
    return scored.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.find_passages(_documents(spark, sf_dir, "doc_id", "text"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_duplicates(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 50 == 0)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir, "doc_id", "text"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_documents(spark, sf_dir, "doc_id", "text"), keep=["doc_id"])


def op10_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(read_table(spark, sf_dir, "pages", "page_id", "url", "html"), keep=["page_id", "url"])


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_documents(spark, sf_dir, "lang", "text"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.count_words(_documents(spark, sf_dir, "doc_id", "text")))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.write_files(_documents(spark, sf_dir, "doc_id", "text"), shared_path(spark, "token-files"))
    read = token_files.with_starts(written(token_files.read_documents(spark, path), "token-documents"))
    return read.select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES: dict[str, Query] = {
    "op1_chat": op1_chat,
    "op2_mixing": op2_mixing,
    "op3_pii": op3_pii,
    "op4_quality": op4_quality,
    "op5_passages": op5_passages,
    "op6_neighbours": op6_neighbours,
    "op7_topk": op7_topk,
    "op8_simhash": op8_simhash,
    "op9_bpe": op9_bpe,
    "op10_pages": op10_pages,
    "op11_collocations": op11_collocations,
    "op12_spelling": op12_spelling,
    "op13_token_files": op13_token_files,
}

_MIX_SQL = """
WITH docs AS (
  SELECT doc_id, coalesce(lang, '?') AS lang, coalesce(source, '?') AS source, lang AS lang0, source AS source0,
    CASE WHEN regexp_matches(coalesce(source, '?'), '[0-9]{{1,9}}$') AND length(regexp_extract(source, '([0-9]+)$', 1)) <= 9
         THEN 'domain' || CAST(CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) % 4 AS VARCHAR) ELSE '?' END AS domain,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n
  FROM documents),
kept AS (SELECT * FROM docs WHERE n > 0),
leaf AS (SELECT domain, lang, source, sum(n)::BIGINT AS tokens FROM kept GROUP BY ALL),
d0 AS (SELECT domain, sum(tokens)::HUGEINT * {epochs} AS k, (SELECT sum(tokens) FROM leaf)::HUGEINT * {percent} // 100 AS b,
  {domain_weight} AS w FROM leaf GROUP BY domain),
d1 AS (SELECT *, b - coalesce(sum(k) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l,
  sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS r,
  row_number() OVER o AS i FROM d0 WINDOW o AS (ORDER BY k::DOUBLE / w, domain)),
d2 AS (SELECT *, min(CASE WHEN NOT (l > 0 AND k * r <= l * w) THEN i END) OVER () AS s FROM d1),
d3 AS (SELECT domain, CASE WHEN s IS NULL OR i < s THEN k ELSE least(k, greatest(max(CASE WHEN i = s THEN l END) OVER (), 0) * w
  // max(CASE WHEN i = s THEN r END) OVER ()) END AS b FROM d2),
l0 AS (SELECT domain, lang, sum(tokens)::HUGEINT * {epochs} AS k, any_value(b) AS b, {lang_weight} AS w
  FROM leaf JOIN d3 USING (domain) GROUP BY domain, lang),
l1 AS (SELECT *, b - coalesce(sum(k) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l,
  sum(w) OVER (PARTITION BY domain) - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS r,
  row_number() OVER o AS i FROM l0 WINDOW o AS (PARTITION BY domain ORDER BY k::DOUBLE / w, lang)),
l2 AS (SELECT *, min(CASE WHEN NOT (l > 0 AND k * r <= l * w) THEN i END) OVER (PARTITION BY domain) AS s FROM l1),
l3 AS (SELECT domain, lang, CASE WHEN s IS NULL OR i < s THEN k
  ELSE least(k, greatest(max(CASE WHEN i = s THEN l END) OVER (PARTITION BY domain), 0) * w
  // max(CASE WHEN i = s THEN r END) OVER (PARTITION BY domain)) END AS b FROM l2),
s0 AS (SELECT domain, lang, source, tokens::HUGEINT * {epochs} AS k, b, tokens, 1 AS w FROM leaf JOIN l3 USING (domain, lang)),
s1 AS (SELECT *, b - coalesce(sum(k) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l,
  sum(w) OVER (PARTITION BY domain, lang) - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS r,
  row_number() OVER o AS i FROM s0 WINDOW o AS (PARTITION BY domain, lang ORDER BY k::DOUBLE / w, source)),
s2 AS (SELECT *, min(CASE WHEN NOT (l > 0 AND k * r <= l * w) THEN i END) OVER (PARTITION BY domain, lang) AS s FROM s1),
s3 AS (SELECT domain, lang, source, tokens, CASE WHEN s IS NULL OR i < s THEN k
  ELSE least(k, greatest(max(CASE WHEN i = s THEN l END) OVER (PARTITION BY domain, lang), 0) * w
  // max(CASE WHEN i = s THEN r END) OVER (PARTITION BY domain, lang)) END AS alloc FROM s2),
plan AS (SELECT *, CAST(alloc // tokens AS INTEGER) AS whole, CAST(alloc % tokens AS BIGINT) AS rest FROM s3 WHERE alloc > 0),
placed AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang, source
    ORDER BY md5('{seed}:' || CAST(whole AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)), CAST(doc_id AS VARCHAR)) - n AS start
  FROM kept JOIN plan USING (domain, lang, source)),
taken AS (
  SELECT doc_id, domain, lang0 AS lang, source0 AS source, e.epoch, n AS n_tokens, n AS take_tokens
  FROM placed, (SELECT CAST(unnest(range({epochs})) AS INTEGER) AS epoch) e WHERE e.epoch < whole
  UNION ALL
  SELECT doc_id, domain, lang0, source0, whole, n, least(n, rest - start) FROM placed WHERE start < rest)
SELECT doc_id, lang, source, domain, epoch, n_tokens, CAST(take_tokens AS BIGINT) AS take_tokens FROM taken
"""

_PHRASE_SQL = r"""
WITH docs AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM docs),
lists AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM pieces),
grams AS (
  SELECT lang, 1 AS size, unnest(ws) AS phrase FROM lists
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM lists
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM lists),
f AS (SELECT lang, size, phrase, count(*)::HUGEINT AS a FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
cand AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND a >= 10),
cuts AS (
  SELECT lang, size, phrase, a, w, 1 AS k, w[1] AS lp, array_to_string(w[2:], ' ') AS rp FROM cand
  UNION ALL SELECT lang, size, phrase, a, w, 2, w[1] || ' ' || w[2], w[3] FROM cand WHERE size = 3),
scored AS (SELECT c.*, x.a AS l, y.a AS r, (1000000::HUGEINT * c.a * c.a) // (x.a * y.a) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.lp JOIN f y ON y.lang = c.lang AND y.phrase = c.rp),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, p AS phrase, max(a) AS longer FROM (
  SELECT lang, w[1] || ' ' || w[2] AS p, a FROM cand WHERE size = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM cand WHERE size = 3) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.longer IS NULL OR 100 * i.longer < 50 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
  a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""


def _case(name: str, weights: dict[str, int]) -> str:
    return "CASE " + name + "".join(f" WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END"


ORACLE_SQL = {
    "op2_mixing": _MIX_SQL.format(
        epochs=mixing.MAX_EPOCHS,
        percent=mixing.BUDGET_PERCENT,
        seed=mixing.SEED,
        domain_weight=_case("domain", mixing.DOMAIN_WEIGHTS),
        lang_weight=_case("lang", mixing.LANG_WEIGHTS),
    ),
    "op11_collocations": _PHRASE_SQL,
}
