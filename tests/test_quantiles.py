"""Exact quantiles against numpy, on values that defeat ranges of a fixed scale."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from opinara.operators import quantiles as Q

SHARES = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.99, "e": 1.0}


def check(spark, rows, got_keys=None):
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r for r in Q.exact_quantiles(df, ["k"], "v", SHARES).collect()}
    values = {}
    for k, v in rows:
        if v is not None:
            values.setdefault(k, []).append(v)
    assert set(got) == set(values)
    for k, vs in values.items():
        for name, q in SHARES.items():
            assert math.isclose(got[k][name], np.quantile(vs, q), rel_tol=1e-9), (k, name)


RND = random.Random(5)
SHAPES = {
    "copies": [float(RND.choice([1, 1, 1, 2, RND.randint(3, 10**6)])) for _ in range(2000)],
    "close values and one huge": [1e6 + RND.randint(0, 10**5) for _ in range(2000)] + [1e15],
    "orders of magnitude": [RND.choice([-1, 1]) * 10.0 ** RND.uniform(-300, 300) for _ in range(2000)],
    "around a value": [5.0 + RND.choice([-1, 1]) * 2.0 ** -RND.randint(0, 50) * RND.random() for _ in range(2000)],
    "extremes": [0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308] + [RND.gauss(0, 1) for _ in range(500)],
    "one": [7.0],
}


@pytest.mark.parametrize("most", [16, Q.SORTED])
def test_against_numpy(spark, monkeypatch, most):
    """Small limits make even these columns take many rounds."""
    monkeypatch.setattr(Q, "SORTED", most)
    monkeypatch.setattr(Q, "CELLS", 64 if most == 16 else 1024)
    rows = [(name, v) for name, vs in SHAPES.items() for v in vs] + [(None, 1.0), (None, 3.0), ("nothing", None)]
    check(spark, rows)


def test_no_range_stays_large(spark, monkeypatch):
    """100,001 close values beside one far away: after each round the largest range left is smaller, and none that is sorted is large."""
    monkeypatch.setattr(Q, "SORTED", 10_000)
    seen, real = [], Q._largest
    monkeypatch.setattr(Q, "_largest", lambda rows: seen.append(real(rows)) or seen[-1])
    df = spark.range(100_001).selectExpr("1e6 + id AS v").unionByName(spark.createDataFrame([(1e15,)], "v double"))
    got = Q.overall_quantiles(df, "v", {"low": 0.01, "mid": 0.5, "top": 1.0})
    assert got == {"low": 1e6 + 0.01 * 100_001, "mid": 1e6 + 50_000.5, "top": 1e15}
    assert seen[0] == 100_002 and sorted(seen, reverse=True) == seen and seen[-1] <= Q.SORTED and len(seen) <= 4


def test_infinities_and_nan(spark, monkeypatch):
    monkeypatch.setattr(Q, "SORTED", 4)
    df = spark.createDataFrame([(float(i),) for i in range(40)] + [(float("inf"),), (float("-inf"),), (float("nan"),), (None,)], "v double")
    got = Q.overall_quantiles(df, "v", {"a": 0.0, "b": 0.5, "c": 41 / 42, "d": 1.0})
    assert got["a"] == float("-inf") and got["b"] == 20.0 and got["c"] == float("inf") and math.isnan(got["d"])
    assert Q.overall_quantiles(df.limit(0), "v", {"a": 0.5}) == {"a": None}
