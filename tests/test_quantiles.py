"""Exact quantiles by narrowing: equal to the interpolated percentile whatever
the group's size, the number of rounds, ties, outliers or NULL keys."""

import math
import random

import numpy as np
import pytest

from kharif.operators.quantiles import group_medians, group_quantiles

PROBS = [0.0, 0.05, 0.5, 0.95, 1.0]


def rows():
    draw = random.Random(1)
    out = []
    for i in range(3000):
        g = draw.choice(["a", "a", "a", "b", None])
        x = draw.choice([draw.gauss(0, 1), 7.0, draw.expovariate(1) * 1e12, -1e300 * draw.random(), 1e-300])
        out.append((g, x, None if g == "b" or i % 3 else draw.gauss(5, 2), float(draw.randint(0, 3))))
    return out + [("one", 4.5, None, 1.0), ("none", None, None, None), ("nan", math.nan, 2.0, None)]


@pytest.mark.parametrize("final_rows", [20, 100_000])
def test_equal_to_numpy(spark, final_rows):
    df = spark.createDataFrame(rows(), "g string, x double, y double, z double")
    got = {r["g"]: r for r in group_quantiles(df, ["x", "y", "z"], PROBS, ["g"], final_rows=final_rows).collect()}
    assert set(got) == {"a", "b", None, "one", "none", "nan"}
    for g, r in got.items():
        for k, c in enumerate("xyz", start=1):
            v = [t[k] for t in rows() if t[0] == g and t[k] is not None and not math.isnan(t[k])]
            for j, p in enumerate(PROBS):
                q = r[f"__q{j}_{c}"]
                if not v:
                    assert q is None
                else:
                    v.sort()
                    h = (len(v) - 1) * p
                    a, b = v[math.floor(h)], v[min(math.floor(h) + 1, len(v) - 1)]
                    assert q == (a if a == b else a + (h - math.floor(h)) * (b - a)), (g, c, p)


def test_without_groups_and_infinite_values(spark):
    v = np.array([math.inf, -math.inf, 1.0, 2.0, 3.0] + [5.0] * 50)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    assert group_medians(df, ["v"], final_rows=3).first()["__med_v"] == 5.0
    low = group_quantiles(df, ["v"], [0.0, 1.0, 2 / 54], final_rows=3).first()
    assert low["__q0_v"] == -math.inf and low["__q1_v"] == math.inf and low["__q2_v"] == 2.0
    assert group_medians(df.limit(0), ["v"]).collect()[0]["__med_v"] is None
