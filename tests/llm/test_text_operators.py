"""Quality, PII, SimHash, BPE, mixing: brute force and edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kharif.llm import bpe, mixing, pii, quality, simhash
from kharif.llm.queries import held_out

DOCS = "doc_id long, text string, lang string, source string, score int, spans string, epoch int, text_ string"
LONG = " ".join(f"w{i}" for i in range(30_000))


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "src0", 1, "s", 2, "x") for i, t in zip(ids, texts)], DOCS)


ODD = [None, "", "   \n", "a", "same words here again", "same words here again", LONG, "Ünïcödé \x1c\u2003 x", "x" * 5000]


# --- PII --------------------------------------------------------------------------


def brute_base(text):
    luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = {"email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]}
    out["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    out["card"] = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    out["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m.group())) <= 15]
    return out


def test_base_spans_equal_brute_force():
    draw = random.Random(5)
    for _ in range(4000):
        text = "".join(draw.choice("aB9.0@+- (x)1%\n2é5") for _ in range(draw.randint(0, 60)))
        assert pii.base_spans(text) == brute_base(text), text
    text = "a@b.c@d.e 1.2.3.4.5.6.7.8 4111 1111-1111 1111 +49 (30) 123-4567. 0001.02.3.256 ١٢٣"
    assert pii.base_spans(text) == brute_base(text)


def test_pii_edges_and_redaction(spark):
    texts = [*ODD, "mail bob@example.com or call 030 1234567 now", "phone: 020 7946 0018 end"] + [f"phone 030 12345{i} {i}" for i in range(9)]
    table = docs(spark, texts)
    accepted = pii.fit(table)
    rows = {r["doc_id"]: r for r in pii.report(table, accepted).collect()}
    assert len(rows) == len(texts) and rows[0]["spans"] == "" and rows[9]["n_email"] == 1
    assert rows[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert rows[9]["spans"].startswith("email:5:20")
    clean = pii.redact(table, accepted)
    assert clean.columns == table.columns
    got = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert got[0] is None and got[9].startswith("mail [EMAIL] or call") and got[6] == LONG
    assert pii.fit(table.limit(0)) == frozenset() and pii.report(table.limit(0), frozenset()).count() == 0


def test_reliabilities_come_from_votes():
    codes = np.array([pii._code("phone", v, 12) for v in ((1, 1, 1, 1), (0, 1, 1, 1), (-1, -1, -1, -1), (-1, -1, 0, -1), (0, 1, 0, 1))])
    p = pii.estimate(codes, np.array([50.0, 40, 60, 50, 5]))
    assert p[0] > 0.9 and p[1] > 0.9 and p[2] < 0.1 and p[3] < 0.1


# --- SimHash ----------------------------------------------------------------------


def components(names, near):
    root = {n: n for n in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in names:
        for b in names:
            if a < b and near(a, b) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in names}


@pytest.mark.parametrize("block", [4096, 8])
def test_links_reach_every_fingerprint_within_tau(spark, block):
    draw = np.random.default_rng(3)
    base = draw.integers(0, 2**63, 60, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base[:12]:  # chains and dense groups
        for _ in range(12):
            b = b ^ np.bitwise_or.reduce(np.uint64(1) << draw.integers(0, 64, draw.integers(1, 5), dtype=np.uint64))
            fps.add(int(b))
    want = components(sorted(simhash._signed(f) for f in fps), lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 4)
    table = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    from kharif.llm.components import connected_components

    got = {r["node"]: r["component"] for r in connected_components(simhash.links(table, 4, block)).collect()}
    assert {f: got.get(f, f) for f in want} == want


def test_thresholds_sum_as_the_pigeonhole_needs():
    for parts in range(1, 6):
        cost = [{-1: 0.0, 0: 1.0, 1: 3.0, 2: 9.0, 3: 27.0, 4: 81.0} for _ in range(parts)]
        _, limits = simhash.allocate(cost, 4 - parts + 1)
        assert sum(limits) == 4 - parts + 1 and len(limits) == parts
    chosen = simhash.plan(np.arange(50, dtype=np.int64) * 7919, 10_000)
    assert sorted(b for bits in chosen.bits for b in bits) == list(range(64))


def test_simhash_edges(spark):
    table = docs(spark, [*ODD, "same words here again"], [0, 1, 2, 3, 4, 5, 6, 7, 8, None])
    rows = simhash.near_duplicates(table).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == 10 and by[0]["fingerprint"] == "0" * 16
    assert by[0]["component_id"] == by[1]["component_id"] == by[2]["component_id"] == 0
    assert by[5]["component_id"] == by[None]["component_id"] == 4
    kept = simhash.keep_one(table)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 3, 4, 6, 7, 8] and kept.columns == table.columns
    orphans = docs(spark, ["only here now ok", "only here now ok"], [None, None])
    assert simhash.keep_one(orphans).count() == 1
    assert simhash.near_duplicates(table.limit(0)).count() == 0 and simhash.keep_one(table.limit(0)).count() == 0


# --- BPE --------------------------------------------------------------------------


def test_bpe_equals_the_public_library():
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    library, own = Tokenizer.from_file(path), bpe.Bpe(open(path, encoding="utf-8").read())
    draw = random.Random(11)
    marks = ["<|endoftext|>", "<|startoftext|>", "'s", "'LL", "Σ", "İ", "e\u0301", "\u00a0", "\x1c", "\u2028", "½", "１２", "東京", "🙂", "\ufb01", "ß", "<|", " \n", "THE", "hello"]
    texts = ["".join(draw.choice(marks + list("abcdefg .,'12ÀÉ")) for _ in range(draw.randint(0, 40))) for _ in range(3000)]
    for text in [*texts, *(t or "" for t in ODD)]:
        want = library.encode(text, add_special_tokens=False).ids
        ids, n, decoded = own.encode(text)
        assert ids == " ".join(map(str, want)) and n == len(want), text
        assert decoded == library.decode(want, skip_special_tokens=False) == own.decode(want), text


def test_bpe_edges(spark):
    table = docs(spark, ODD).withColumn("n_tokens", F.lit(99))
    rows = {r["doc_id"]: r for r in bpe.digests(table, keep=["doc_id", "n_tokens", "score"]).collect()}
    assert rows[0]["n_tokens"] == rows[1]["n_tokens"] == rows[2]["n_tokens"] == 0 and rows[0]["score"] == 1
    assert rows[4]["ids_sha256"] == rows[5]["ids_sha256"] and rows[6]["n_tokens"] > 30_000
    whole = {r["doc_id"]: r for r in bpe.encode(table.drop("n_tokens"), keep=["doc_id"]).collect()}
    assert len(whole[6]["token_ids"]) == rows[6]["n_tokens"]
    assert bpe.digests(table.limit(0), keep=["doc_id"]).count() == 0


# --- quality ----------------------------------------------------------------------


def labelled(spark, n=240):
    draw = random.Random(2)
    words = "the of and river stone light quiet morning garden road paper glass".split()
    good = [" ".join(draw.choices(words, k=30)) for _ in range(n)]
    bad = [" ".join(w.upper() + "!!" for w in draw.choices(words, k=10)) for _ in range(n // 4)]
    rows = [(i, t, 1) for i, t in enumerate(good)] + [(n + i, t, 0) for i, t in enumerate(bad)]
    return spark.createDataFrame(rows, "doc_id long, text string, quality int")


def test_quality_separates_and_scores_odd_texts(spark):
    rows = labelled(spark)
    model = quality.fit(rows, fit_rows=150)
    scored = quality.score(rows, model, keep=["quality"]).collect()
    assert np.mean([(r["score"] >= quality.THRESHOLD) == (r["quality"] == 1) for r in scored]) > 0.97
    odd = quality.score(docs(spark, ODD).drop("score"), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd) and odd[0]["score"] == odd[1]["score"]
    again = quality.fit(rows, fit_rows=150)
    assert np.array_equal(model.weight, again.weight)


def test_quality_without_both_classes_rejects_nothing(spark):
    model = quality.fit(labelled(spark).where("quality = 1"))
    assert [r["score"] for r in quality.score(docs(spark, ["x"]).drop("score"), model).collect()] == [1.0]
    assert quality.fit(labelled(spark).limit(0)).weight is None


def test_held_out_rows_follow_crc32(spark):
    import zlib

    rows = spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in rows)


# --- mixing -----------------------------------------------------------------------


def water(children, budget):
    """Share by weight; whoever is full drops out and the rest shares again."""
    alloc, open_ = {}, dict(children)
    left = budget
    while open_:
        total = sum(w for w, _ in open_.values())
        full = [n for n, (w, k) in open_.items() if k * total <= left * w]
        if not full:
            return alloc | {n: left * w // total for n, (w, _) in open_.items()}
        for n in full:
            alloc[n] = open_.pop(n)[1]
        left = budget - sum(alloc.values())
    return alloc


def test_water_fill_equals_repeated_sharing(spark):
    draw = random.Random(8)
    for _ in range(6):
        children = {f"c{i}": (draw.randint(1, 9), draw.randint(1, 400)) for i in range(draw.randint(1, 9))}
        budget = draw.randint(0, sum(k for _, k in children.values()))
        rows = spark.createDataFrame([(0, n, w, k, budget) for n, (w, k) in children.items()], "p int, n string, weight long, capacity long, budget long")
        got = {r["n"]: r["alloc"] for r in mixing.water_fill(rows, ["p"], "n").collect()}
        assert got == water(children, budget), (children, budget)


@pytest.mark.parametrize("slice_rows", [3, 4096])
def test_mix_takes_the_prefix_of_a_seeded_epoch(spark, slice_rows):
    texts = [" ".join(["w"] * (1 + i % 7)) for i in range(60)]
    rows = spark.createDataFrame([(i, t, "en", "src0", "keep", 5) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, rest string, end int")
    got = mixing.mix(rows, budget=300, max_epochs=2, slice_rows=slice_rows).collect()
    tokens = {i: 1 + i % 7 for i in range(60)}
    total = sum(tokens.values())
    assert sum(r["take_tokens"] for r in got) == 300 and {r["rest"] for r in got} == {"keep"}
    assert sorted(r["doc_id"] for r in got if r["epoch"] == 0) == list(range(60))
    order = sorted(range(60), key=lambda i: hashlib.md5(f"{mixing.SEED}:1:{i}".encode()).hexdigest())
    want, left = {}, 300 - total
    for i in order:
        if left <= 0:
            break
        want[i] = min(tokens[i], left)
        left -= want[i]
    assert {r["doc_id"]: r["take_tokens"] for r in got if r["epoch"] == 1} == want


def test_mix_edges(spark):
    table = docs(spark, ODD).withColumn("lang", F.when(F.col("doc_id") == 3, None).otherwise(F.col("lang")))
    rows = mixing.mix(table, percent=100).collect()
    assert {r["doc_id"] for r in rows} >= {3, 4, 5, 6, 7, 8} and not {r["doc_id"] for r in rows} & {0, 1, 2}
    assert mixing.mix(table.limit(0)).count() == 0


@pytest.mark.parametrize("copies,budget,want", [(2, 15, [5, 10]), (5, 32, [2, 10, 10, 10]), (3, 30, [10, 10, 10])])
def test_mixing_shares_the_end_among_repeated_rows(spark, copies, budget, want):
    rows = docs(spark, ["a b c d e f g h i j"] * copies, [7] * copies)
    got = mixing.mix(rows, budget=budget, max_epochs=1).collect()
    assert sorted(r["take_tokens"] for r in got) == want


def test_hinge_weights_equal_a_slow_solver():
    """The dual optimum by projected gradient steps over the full matrix: equal
    objectives, a small duality gap and the optimum's conditions row by row."""
    draw = np.random.default_rng(3)
    n, size = 120, 40
    found = [np.unique(draw.integers(0, size, draw.integers(0, 12))) for _ in range(n)]
    ratio = draw.normal(size=size).astype(np.float32)
    starts = np.concatenate([[0], np.cumsum([len(f) for f in found])])
    rows = quality.Vectors.of(np.concatenate(found).astype(np.int32), starts, ratio)
    sign, cost = np.where(draw.random(n) < 0.6, 1.0, -1.0), np.where(draw.random(n) < 0.5, 1.0, 2.0)
    weights = quality.dual_coordinate_descent(rows, sign, cost, size, epochs=3000)

    dense = np.zeros((n, size + 1))
    dense[:, -1] = 1.0
    for i in range(n):
        dense[i, found[i]] = rows.row(i)[1]
    signed = dense * sign[:, None]
    gram, alpha = signed @ signed.T, np.zeros(n)
    step = 1 / np.linalg.eigvalsh(gram)[-1]
    for _ in range(60_000):
        alpha = np.clip(alpha - step * (gram @ alpha - 1), 0, cost)
    primal = lambda w: 0.5 * w @ w + cost @ np.maximum(0, 1 - signed @ w)
    dual = alpha.sum() - 0.5 * alpha @ gram @ alpha
    assert 0 <= primal(weights) - dual < 2e-2 * dual
    # rows well inside the margin carry no weight, rows well beyond it their cost
    margin = signed @ (signed.T @ alpha)
    assert (alpha[margin > 1 + 1e-3] < 1e-3).all() and (cost - alpha)[margin < 1 - 1e-3].max(initial=0) < 1e-3
    assert np.abs(weights - signed.T @ alpha).max() < 5e-2


def test_scores_equal_a_version_with_plain_dictionaries(spark):
    rows = labelled(spark)
    model = quality.fit(rows, fit_rows=150)
    held = {0: {}, 1: {}}
    for r in rows.collect():
        for f in set(quality.Ngrams().of(r["text"]).tolist()):
            held[r["quality"]][f] = held[r["quality"]].get(f, 0) + 1
    total = {k: sum(v.values()) + quality.SIZE for k, v in held.items()}
    log = lambda k, f: np.log((held[k].get(f, 0) + 1) / total[k])
    for r in quality.score(rows, model).limit(40).collect():
        values = {int(f): log(1, f) - log(0, f) for f in quality.Ngrams().of(r["text"])}
        norm = sum(v * v for v in values.values()) ** 0.5
        margin = model.intercept + (sum(float(model.weight[f]) * v for f, v in values.items()) / norm if norm else 0.0)
        assert abs(r["score"] - 1 / (1 + np.exp(-(model.slope * margin + model.offset)))) < 1e-4
