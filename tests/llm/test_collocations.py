"""Phrase collocations: filters, permutation, and the report against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from kharif.llm import collocations as co

DOCS = "lang string, text string, word string, n int, part long, id long"


@pytest.mark.parametrize("width", [1, 3, 8, 20, 40, 62])
def test_filter_is_lossless_and_answers_single_keys(width):
    draw = np.random.default_rng(width)
    for n in (0, 1, 5, 1000):
        near = np.arange(min(n, 1 << width), dtype=np.uint64)[:40]  # one long run, and one at the end
        keys = np.unique(np.concatenate([draw.integers(0, 1 << width, n).astype(np.uint64), near, np.uint64((1 << width) - 1) - near]))
        counts = np.where(draw.random(len(keys)) < 0.3, draw.integers(1, 1 << 40, len(keys)), 1)
        f = co.QuotientFilter.from_bytes(co.QuotientFilter.of(keys, counts, width).to_bytes())
        got = f.items()
        assert (got[0] == keys).all() and (got[1] == counts).all()
        known = dict(zip(keys.tolist(), counts.tolist()))
        assert all(f.count(k) == known.get(k, 0) for k in [*list(known)[:30], *range(min(1 << width, 30))])


def test_merged_filters_add_counts():
    draw, parts, want = np.random.default_rng(0), [], Counter()
    for _ in range(5):
        keys = np.unique(draw.integers(0, 500, 300).astype(np.uint64))
        counts = draw.integers(1, 400, len(keys))
        parts.append(co.QuotientFilter.of(keys, counts, 20))
        want.update(dict(zip(keys.tolist(), counts.tolist())))
    keys, counts = co.merged(parts)
    assert dict(zip(keys.tolist(), counts.tolist())) == want and (np.diff(keys.astype(np.int64)) > 0).all()


@pytest.mark.parametrize("order,bits,key_bits", [(2, 1, 62), (2, 20, 62), (3, 20, 62), (3, 21, 62), (3, 31, 62), (2, 5, 4), (3, 10, 7)])
def test_packing_can_be_undone(order, bits, key_bits):
    draw = np.random.default_rng(bits)
    pack = co.Packing(order, bits, key_bits)
    ids = [draw.integers(0, 1 << bits, 500) for _ in range(order)]
    high, low = pack.permuted(ids)
    assert (low <= pack.mask).all() and (high.astype(np.int64) < 1 << pack.high).all()
    assert all((a == b).all() for a, b in zip(ids, pack.ids(high, low)))


def brute(rows, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3):
                f[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= 10}
        rows = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                continue
            cuts = [(1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), lang, " ".join(p), a, counts[p[:k]], counts[p[k:]], n[lang], score))
        out += [(r[3], i + 1, *r[4:]) for i, r in enumerate(sorted(rows)[:top])]
    return sorted(out)


def texts():
    draw = random.Random(2)
    vocabulary = ["The", "old", "Ünder", "x\x1fy", "sea", "cat", "naïve", "b", "(q)", "the"]
    rows = []
    for _ in range(150):
        words = [vocabulary[int(10 * draw.random() ** 2)] for _ in range(draw.randint(0, 60))]
        if draw.random() < 0.4:
            words[3:3] = ["New", "York", "City"]
        rows.append((draw.choice(["en", "de", None]), "".join(w + draw.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\x0b"]) for w in words)))
    return rows + [("en", None), ("en", ""), ("fr", " \t\n;"), ("de", "long " * 20_000), rows[3], rows[3]]


@pytest.mark.parametrize("kw", [{}, {"fan_bits": 2, "range_entries": 9000}, {"key_bits": 8, "range_entries": 20000}])
def test_report_equals_brute_force(spark, kw):
    rows = texts()
    docs = spark.createDataFrame([(lang, t, "w", 1, 2, 3) for lang, t in rows], DOCS)
    got = co.collocations(docs, top=60, **kw)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, 60)


def test_empty_table_and_scores_beyond_64_bits(spark):
    assert co.collocations(spark.createDataFrame([], DOCS)).collect() == []
    big = spark.sql("select 3000000000000L a, 4000000000001L l, 5000000000003L r")
    expr = "(cast(a as decimal(18,0)) * cast(a as decimal(18,0)) * 1000000) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"
    assert big.selectExpr(expr).first()[0] == 1000000 * 3000000000000**2 // (4000000000001 * 5000000000003)
