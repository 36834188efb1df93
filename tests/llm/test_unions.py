"""Links found in several chunks or blocks stay in the components."""

import numpy as np
import pandas as pd
import pytest

from kharif.llm.neighbours import THRESHOLD, _tile
from kharif.llm.simhash import TAU, _links


def _components(n, pairs):
    """Least member of each node's component, by a plain union-find."""
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(int(a)), root(int(b))))
        up[b] = a
    return np.array([root(x) for x in range(n)])


def _arcs(groups, steps, size=64, degrees=17.0):
    """Vectors in chains: each is near only the one before and after it."""
    draw, out = np.random.default_rng(3), []
    turn = np.radians(degrees) * np.arange(steps)
    for _ in range(groups):
        e, _ = np.linalg.qr(draw.normal(size=(size, 2)))
        out.append(np.cos(turn)[:, None] * e[:, 0] + np.sin(turn)[:, None] * e[:, 1])
    return draw.permutation(np.concatenate(out))


@pytest.mark.parametrize("sides", [1, 2])
def test_tile_of_several_chunks_keeps_every_link_of_a_chain(sides):
    x = _arcs(160, 10)
    n = len(x)
    near = x @ x.T >= THRESHOLD
    half = n if sides == 1 else n // 2 + 100  # 900 rows against 700: two chunks
    side = np.arange(n) >= half
    if sides == 2:
        near &= side[:, None] != side[None, :]
    p, q = np.nonzero(np.triu(near, 1))
    group = pd.DataFrame(
        [
            {"size": 64, "side": s, "cid": ids.astype(np.int64).tobytes(), "copies": np.ones(len(ids), np.int64).tobytes(), "v": x[ids].tobytes()}
            for s in range(sides)
            for ids in [np.flatnonzero(side == bool(s))]
        ]
    )
    told = _tile({64: np.eye(64)}, THRESHOLD)(group)
    links = np.zeros(n, np.int64)
    links[told["u"]] = told["n"]
    assert (links == near.sum(1) - (sides == 1)).all()
    assert (_components(n, zip(told["u"], told["v"])) == _components(n, zip(p, q))).all()


def test_bucket_of_several_blocks_keeps_every_link_of_a_chain():
    draw, out = np.random.default_rng(5), []
    for _ in range(10):
        at = draw.integers(0, 1 << 63, dtype=np.uint64)
        for _ in range(200):  # each is four bits from the one before it
            out.append(at)
            at = at ^ np.bitwise_or.reduce(np.uint64(1) << draw.choice(64, 4, replace=False).astype(np.uint64))
    fp = draw.permutation(np.array(out, np.uint64)).view(np.int64)
    names = np.unique(fp)
    bare = names.view(np.uint64)
    p, q = np.nonzero(np.bitwise_count(bare[:, None] ^ bare[None, :]) <= TAU)
    u, v = _links(fp, np.ones(len(fp), bool), TAU)
    found = _components(len(names), zip(np.searchsorted(names, u), np.searchsorted(names, v)))
    told = _components(len(names), zip(p, q))
    assert len(np.unique(told)) == 10
    assert (found == told).all(), len(np.unique(found))


def test_tiny_and_huge_components(spark):
    """Finite vectors whose squares vanish or overflow have a direction too."""
    from kharif.llm.neighbours import near_duplicates

    rows = [(1, [1e-170, 0.0]), (2, [3e-170, 0.0]), (3, [1e200, 0.0]), (4, [0.0, 1e-320]), (5, [0.0, 2.0]), (6, [1.7e308, 1.7e308]), (7, [0.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_duplicates(table).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4), 6: (0, 6), 7: (0, 7)}
