"""Words of many texts are hashed at once, and numbered shingles verify as the shingles do."""

import random

import numpy as np

from kharif.llm import passages


def test_words_of_many_texts_have_equal_hashes_if_they_are_equal():
    draw = random.Random(8)
    odd = ["", None, "　a\x1cb \x85ΑΣ Σ İx ", "\U0001f600 ab \U0001f600", "x" * 70_000 + " ab"]
    texts = odd + [" ".join(draw.choice("abABäЖ") * draw.randint(1, 3) + draw.choice("ab") for _ in range(draw.randint(0, 60))) for _ in range(200)]
    hashes, counts = passages.hashed_words(texts)
    words = [(t or "").lower().split() for t in texts]
    assert counts.tolist() == [len(w) for w in words]
    flat = [w for one in words for w in one]
    assert len(set(flat)) == len(set(hashes.tolist())) == len(set(zip(flat, hashes.tolist())))
    assert passages.hashed_words([])[0].size == 0 and passages.hashed_words([None])[1].tolist() == [0]
    tokens, sizes = passages.shingles(texts)
    runs = [tuple(w[i : i + 5]) for w in words for i in range(len(w) - 4)]
    assert sizes.tolist() == [max(len(w) - 4, 0) for w in words]
    assert len(runs) == len(tokens) and len(set(runs)) == len(set(tokens.tolist())) == len(set(zip(runs, tokens.tolist())))


def test_minima_hold_across_stretches():
    value = np.random.default_rng(3).integers(1, 2**63, 150_000).astype(np.uint64)
    value[70_000:70_100] = value[70_000]
    at = passages.sliding_minima(value, 47)
    whole = np.lib.stride_tricks.sliding_window_view(value >> np.uint64(passages.PLACE_BITS), 47)
    assert (at == whole.argmin(axis=1) + np.arange(len(whole))).all()


def _plain(a, b, at, bt, similarity=0.8, least=47):
    """The passage as ``verify`` finds it, by set operations on the shingles."""
    n, m = min(len(a) - at, len(b) - bt), min(at, bt)
    ahead = next((k for k in range(n) if a[at + k] != b[bt + k]), n)
    behind = next((k for k in range(m) if a[at - 1 - k] != b[bt - 1 - k]), m)
    reach, best = 4 * max(least, behind + ahead), None
    p, q = max(0, at - reach), max(0, bt - reach)
    x, y = a[p : at + reach], b[q : bt + reach]
    s, e = passages.dense(np.isin(x, y), similarity)
    t, u = passages.dense(np.isin(y, x[s:e]), similarity) if e > s else (0, 0)
    if e - s >= least and u - t >= least:
        one, other = set(x[s:e].tolist()), set(y[t:u].tolist())
        if len(one & other) / len(one | other) >= similarity:
            best = (s + p, e + p), (t + q, u + q), len(one & other) / len(one | other)
    if behind + ahead >= least and (best is None or best[0][1] - best[0][0] < behind + ahead):
        best = (at - behind, at + ahead), (bt - behind, bt + ahead), 1.0
    return best


def test_numbered_shingles_verify_as_the_shingles_do():
    draw, found = np.random.default_rng(4), 0
    for edits in range(300):
        a = draw.integers(0, 2**32, draw.integers(60, 400)).astype(np.uint32)
        b = np.concatenate([draw.integers(0, 2**32, draw.integers(0, 60)).astype(np.uint32), a[draw.integers(0, 30) :]])
        b[draw.integers(0, len(b), edits // 6)] = draw.integers(0, 2**32, edits // 6)
        same = [(i, int(j[0])) for i in range(len(a)) if len(j := np.flatnonzero(b == a[i]))]
        for at, bt in same[:: max(1, len(same) // 3)]:
            got = passages.verify(*(n := passages.numbered(a, b))[:2], at, bt, n[2])
            assert got == _plain(a, b, at, bt)
            found += got is not None
    assert found > 200
