"""Spelling variants: words, bounds, pairs and forms against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from kharif.llm import spelling as sp

DOCS = "doc_id long, text string, word string, n int, list string"


def brute_words(rows, min_chars=7, min_count=2):
    found = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                cut = h % len(run)
                run = run[:cut] + run[cut + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= min_chars and n >= min_count}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(words):
    sizes = {}
    for w in words:
        sizes.setdefault(len(w), []).append(w)
    near = {w: [x for d in (-1, 0, 1) for x in sizes.get(len(w) + d, ()) if one_edit(w, x)] for w in words}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-words[x], x)) if xs else None
        form[w] = best if best and words[best] >= 10 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def texts(seed=1):
    draw = random.Random(seed)
    stems = ["".join(draw.choice("abcdeéÿÀ") for _ in range(draw.randint(6, 12))) for _ in range(25)] + ["commonwordtion", "commonxordtion"]
    rows = []
    for i in range(80):
        said = []
        for _ in range(30):
            w = stems[int(len(stems) * draw.random() ** 3)]
            if draw.random() < 0.15:
                at = draw.randrange(len(w))
                w = draw.choice([w[:at] + w[at + 1 :], w[:at] + draw.choice("abcé") + w[at:], w[:at] + "x" + w[at + 1 :]])
            said.append(w.upper() if draw.random() < 0.1 else w)
        rows.append((i, draw.choice([" ", ", ", "\n", "9"]).join(said)))
    return rows + [(None, "wordwithoutid " * 3), (900, None), (901, ""), (902, "×÷ Ā 1"), (903, "q" * 3000 + " " + "q" * 3000 + " " + "q" * 2999 + "z " + "q" * 2999 + "z"), (5, rows[5][1])]


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], DOCS)
    words = {r["word"]: r["n"] for r in sp.count_words(docs).collect()}
    assert words == brute_words(rows)
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in sp.variants(sp.count_words(docs)).collect()}
    assert got == brute_variants(words)
    return got


def test_variants_equal_brute_force(spark):
    got = check(spark, texts())
    assert sum(v[0] is not None for v in got.values()) > 5


def test_cut_dictionary_changes_no_result(spark, monkeypatch):
    """Longer grams for every list of more than one word."""
    monkeypatch.setattr(sp, "GRAM_WORDS", 1)
    check(spark, texts(2))


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert sp.variants(sp.count_words(docs)).collect() == []


def test_lists_of_near_words_meet():
    """Whatever grams the dictionary makes longer, wherever the edit falls."""
    draw = random.Random(4)
    for _ in range(6000):
        w = "".join(draw.choice("abc") for _ in range(draw.randint(7, 14)))
        at = draw.randrange(len(w) + 1)
        x = draw.choice([w[:at] + w[at + 1 :], w[:at] + "b" + w[at:], w[:at] + "c" + w[at + 1 :]])
        if x == w or len(x) < 7:
            continue
        grams = {p[i : i + 4] for p in ("\x01\x01" + w + "\x02\x02", "\x01\x01" + x + "\x02\x02") for i in range(len(p) - 3)}
        frequent = frozenset(g for g in sorted(grams) if draw.random() < 0.5)
        assert set(sp.lists_of(w, frequent)) & set(sp.lists_of(x, frequent)), (w, x)
        assert sp.odd_signs(w) ^ sp.odd_signs(x) == 0 or bin((sp.odd_signs(w) ^ sp.odd_signs(x)) & (1 << 64) - 1).count("1") <= 2


def test_grams_too_long_are_refused(spark):
    words = spark.createDataFrame([("abcd", 3)], "word string, n long")
    with pytest.raises(ValueError):
        sp.near_pairs(words, min_chars=4)
