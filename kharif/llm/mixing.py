"""Mixing sources to target weights by hierarchical budgeting (DataFrame and
SQL functions only).

The tree is domain, language, source.  A budget of tokens is dealt top-down:
at each node the children share the node's allocation by weight, none beyond
its capacity (``max_epochs`` times the tokens below it); what a child cannot
take goes to its siblings by weight.  Because a node never gets more than its
capacity, a shortage reaches an ancestor's siblings only when the siblings
cannot hold it.  Every leaf then takes whole epochs of its documents and, of
one further epoch in the order of a seeded hash, the prefix that fills the
rest.

Hot leaves: tokens are summed by (leaf, slice of the hash range), partial sums
first; only the slice in which the prefix ends is ordered document by
document.  A slice holds about ``SLICE_ROWS`` documents of its leaf.

Defined results: NULL text has no tokens and a document without tokens is
never chosen; a NULL language or source is a leaf of its own (``'?'``);
unknown names have weight 1; a weight of 0 takes nothing; repeated rows take
part each for itself; an empty table gives no rows; all amounts are whole
tokens, rounded down; extra columns are kept, but those named like the result
columns (domain, epoch, n_tokens, take_tokens) are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kharif.llm.common import written

#: Production weights; names that are not listed have weight 1.
DOMAIN_WEIGHTS = {"domain0": 40, "domain1": 30, "domain2": 20, "domain3": 10}
LANG_WEIGHTS = {"en": 50, "de": 20, "fr": 20, "es": 10}
SOURCE_WEIGHTS: dict[str, int] = {}
#: Share of all tokens that the mix asks for, in percent, and epochs at most.
BUDGET_PERCENT = 60
MAX_EPOCHS = 2
SEED = 17
SLICE_ROWS = 4096

WORD = "[^ \\t-\\r]+"


def token_count(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def domain_of(source: Column) -> Column:
    """Sources are numbered; the number modulo 4 names the domain."""
    number = F.regexp_extract(source, "([0-9]+)$", 1)
    return F.when(number.rlike("^[0-9]{1,9}$"), F.concat(F.lit("domain"), (number.cast("long") % 4).cast("string"))).otherwise(F.lit("?"))


def seeded_order(seed: int, epoch: Column, doc: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc.cast("string"), F.lit("?"))))


def _weight(name: Column, weights: Mapping[str, int]) -> Column:
    out = F.lit(1)
    for k, v in weights.items():
        out = F.when(name == F.lit(k), F.lit(int(v))).otherwise(out)
    return out.cast("long")


def water_fill(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``children`` (parent keys, name, weight, capacity, budget of the parent)
    with ``alloc``: shares by weight, none above its capacity.

    By rising capacity per weight, a child is full if its capacity is at most
    its share of what the fuller ones before it leave; after the last full
    child the rest is shared by weight."""
    rows = children.where("weight > 0 and capacity > 0")
    order = W.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"), F.col(name))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*parent)
    rows = rows.withColumns(
        {
            "left": F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0)),
            "open": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    # decimals: capacity times weight may pass 2 ** 63
    big = lambda c: F.col(c).cast("decimal(38,0)")
    rows = rows.withColumn("full", (F.col("left") > 0) & (big("capacity") * big("open") <= big("left") * big("weight")))
    rows = rows.withColumn("rank", F.row_number().over(order))
    rows = rows.withColumn("stop", F.min(F.when(~F.col("full"), F.struct(F.col("rank").alias("at"), "left", "open"))).over(whole))
    share = F.floor(F.greatest(F.col("stop.left"), F.lit(0)).cast("decimal(38,0)") * big("weight") / F.col("stop.open"))
    alloc = F.when(F.col("stop").isNull() | (F.col("rank") < F.col("stop.at")), F.col("capacity")).otherwise(
        F.least(share.cast("long"), F.col("capacity"))
    )
    return rows.withColumn("alloc", alloc.cast("long")).drop("left", "open", "full", "rank", "stop")


def budgets(
    leaves: DataFrame,
    budget: int | None,
    percent: int = BUDGET_PERCENT,
    max_epochs: int = MAX_EPOCHS,
    weights: tuple[Mapping[str, int], Mapping[str, int], Mapping[str, int]] = (DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS),
) -> DataFrame:
    """``leaves`` (domain, lang, source, tokens, ...) with ``alloc`` tokens of
    each leaf.  ``budget`` None: ``percent`` of all tokens."""
    levels = ["domain", "lang", "source"]
    if budget is None:
        budget = (leaves.agg(F.sum("tokens").alias("n")).first()["n"] or 0) * percent // 100
    above = None
    for k, level in enumerate(levels):
        nodes = leaves.where("tokens > 0").groupBy(*levels[: k + 1]).agg((F.sum("tokens") * max_epochs).alias("capacity"))
        nodes = nodes.withColumn("weight", _weight(F.col(level), weights[k]))
        if above is None:
            nodes = nodes.withColumns({"budget": F.lit(budget).cast("long"), "root": F.lit(0)})
            parent = ["root"]
        else:
            parent = levels[:k]
            nodes = nodes.join(above.select(*parent, F.col("alloc").alias("budget")), parent)
        above = water_fill(nodes, parent, level).drop("budget", "root")
    return leaves.join(above.select(*levels, "alloc"), levels)


def numbered(rows: DataFrame, key: str, out: str) -> DataFrame:
    """``rows`` written once, each with a number from 0 among the rows of its key;
    counted by part of the table, so that no task needs all rows of a key."""
    rows = written(rows.withColumn("at", F.monotonically_increasing_id()), "mix-ends").withColumn("piece", F.shiftright("at", 33))
    counts = rows.groupBy(key, "piece").agg(F.count("*").alias("k"))
    before = W.partitionBy(key).orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(key, "piece", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("first"))
    own = F.row_number().over(W.partitionBy(key, "piece").orderBy("at"))
    return rows.withColumn(out, own).join(counts, [key, "piece"]).withColumn(out, F.col(out) - 1 + F.col("first")).drop("at", "piece", "first")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    budget: int | None = None,
    percent: int = BUDGET_PERCENT,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    slice_rows: int = SLICE_ROWS,
    weights: tuple[Mapping[str, int], Mapping[str, int], Mapping[str, int]] = (DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS),
    keep: list[str] | None = None,
) -> DataFrame:
    """The chosen documents, a row for each epoch that takes one: kept columns,
    domain, epoch (from 0), n_tokens and take_tokens (those of the prefix; less
    than n_tokens only for the last document of a leaf)."""
    made = ["domain", "epoch", "n_tokens", "take_tokens"]
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in made]
    col = lambda c: F.col(f"`{c}`")
    lang, source = (F.coalesce(col(c).cast("string"), F.lit("?")) for c in (lang_col, source_col))
    key = F.struct(domain_of(source).alias("domain"), lang.alias("lang"), source.alias("source"))
    # The texts are read once: all that follows reads this table.
    row = F.struct(*[col(c) for c in keep]) if keep else F.lit(None).cast("int")
    light = docs.select(row.alias("row"), F.coalesce(col(id_col).cast("string"), F.lit("?")).alias("id"), key.alias("leaf"), token_count(col(text_col)).alias("n"), F.xxhash64(col(text_col)).alias("tie"))
    light = written(light.where("n > 0"), "mix-docs")
    leaves = light.groupBy("leaf").agg(F.sum("n").alias("tokens"), F.count("*").alias("docs")).select("leaf.*", "tokens", "docs")
    leaves = written(budgets(leaves, budget, percent, max_epochs, weights), "mix-leaves")
    leaves = leaves.where("alloc > 0").withColumns(
        {
            "full": F.expr("alloc div tokens").cast("int"),
            "rest": F.expr("alloc % tokens").cast("long"),
            "slices": F.greatest(F.lit(1), F.ceil(F.col("docs") / slice_rows)).cast("long"),
        }
    )
    leaves = leaves.select(F.struct("domain", "lang", "source").alias("leaf"), "full", "rest", "slices")

    # The prefix of the last, partial epoch: sums by slice, then documents of one slice.
    part = light.drop("row").join(leaves.where("rest > 0"), "leaf").withColumn("h", seeded_order(seed, F.col("full"), F.col("id")))
    at = F.conv(F.substring("h", 1, 12), 16, 10).cast("decimal(38,0)") * F.col("slices") / F.lit(16**12)
    part = part.withColumn("slice", F.floor(at).cast("long"))
    sliced = part.groupBy("leaf", "slice", "rest").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(W.partitionBy("leaf").orderBy("slice").rowsBetween(W.unboundedPreceding, -1))
    sliced = sliced.withColumn("before", F.coalesce(upto, F.lit(0)))
    ends = sliced.where("before < rest and before + n >= rest").select("leaf", F.col("slice").alias("end_slice"), "before")
    ends = written(ends, "mix-ends")
    bounds = leaves.join(ends, "leaf", "left")
    inside = part.drop("full", "slices").join(ends.withColumnRenamed("end_slice", "slice"), ["leaf", "slice"])
    # Repeated rows are one point of the order; the prefix ends inside a point.
    points = inside.groupBy("leaf", "slice", "rest", "before", "h", "id", "tie").agg(F.sum("n").alias("n"))
    order = W.partitionBy("leaf", "slice").orderBy("h", "id", "tie").rowsBetween(W.unboundedPreceding, -1)
    points = points.withColumn("start", F.col("before") + F.coalesce(F.sum("n").over(order), F.lit(0)))
    last = points.where("start < rest").groupBy("leaf").agg(F.max(F.struct("h", "id", "tie", "start")).alias("end"))
    bounds = written(bounds.join(last, "leaf", "left").drop("before", "end_slice", "slices"), "mix-bounds")

    # Documents against the bounds of their leaf (a row a leaf).
    point = F.struct(seeded_order(seed, F.col("full"), F.col("id")).alias("h"), "id", "tie")
    stop = F.struct("end.h", "end.id", "end.tie")
    rows = light.join(bounds, "leaf").withColumn("side", F.when(F.col("end").isNull() | (point > stop), 1).when(point < stop, -1).otherwise(0))
    none = F.expr("cast(array() as array<struct<epoch:int,take:bigint>>)")
    whole = F.transform(F.sequence(F.lit(1), F.col("full")), lambda e: F.struct((e - 1).cast("int").alias("epoch"), F.col("n").alias("take")))
    whole = F.when(F.col("full") > 0, whole).otherwise(none)
    part = F.array(F.struct(F.col("full").alias("epoch"), F.col("part").alias("take")))
    taken = F.explode(F.concat(whole, F.when(F.col("part") > 0, part).otherwise(none))).alias("taken")
    plain = rows.where("side <> 0").withColumn("part", F.when(F.col("side") < 0, F.col("n")).otherwise(F.lit(0).cast("long")))
    # The rows of the last point share what is left: each as much as those before it leave.
    ends = numbered(rows.where("side = 0"), "leaf", "number")
    left = F.col("rest") - F.col("end.start") - F.col("number") * F.col("n")
    ends = ends.withColumn("part", F.greatest(F.lit(0), F.least(F.col("n"), left)).cast("long"))
    rows = plain.select("row", "leaf", "n", taken).unionByName(ends.select("row", "leaf", "n", taken))
    return rows.select(
        *([F.col("row.*")] if keep else []),
        F.col("leaf.domain").alias("domain"),
        F.col("taken.epoch").alias("epoch"),
        F.col("n").alias("n_tokens"),
        F.col("taken.take").alias("take_tokens"),
    )
