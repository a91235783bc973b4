"""Candidates of the greedy evidence selection."""

from __future__ import annotations

import random

from opinara.operators import evidence as EV


def items_of(spark, n: int, products: int):
    rng = random.Random(n)
    rows = [(
        None if rng.random() < 0.05 else str(rng.randrange(products)), rng.choice(["positive", "negative", "neutral"]), rng.choice(["PRICE#GENERAL", "PRODUCT#QUALITY"]),
        rng.choice([None, "", *map(str, range(12))]), rng.randrange(5) / 4, i, f"this is sentence number {rng.randrange(25)} about a thing",
    ) for i in range(n)]
    return spark.createDataFrame(rows, "product_id string, sentiment string, aspect string, review_id string, confidence double, item_id long, sentence string")


def test_candidates_only_of_what_is_asked_for(spark):
    """Without other sentiments and filling, their items are neither judged nor moved; texts move twice, not once per cut."""
    out = EV.diverse_evidence(items_of(spark, 50, 3), ["negative"], limit=6, fill=False)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2


def test_spread_of_a_product_changes_no_pick(spark, monkeypatch):
    items = items_of(spark, 3000, 3).cache()
    rows = lambda df: sorted(map(repr, df.collect()))
    want = {}
    for spread in (1, 64):
        monkeypatch.setattr(EV, "SPREAD", spread)
        for sentiments, fill in ((None, True), (["negative"], False)):
            got = rows(EV.diverse_evidence(items, sentiments, limit=3, fill=fill))
            assert want.setdefault(fill, got) == got
    # the cuts hold every pick: nothing changes if nothing is cut
    monkeypatch.setattr(EV, "_cut", lambda rows, *a: rows)
    assert rows(EV.diverse_evidence(items, None, limit=3)) == want[True]
