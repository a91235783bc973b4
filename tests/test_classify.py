"""All classifiers in one pass: gradients, minima, agreement with separate fits, and labels better than the majority."""

from __future__ import annotations

import random

import numpy as np

from opinara import constants as K
from opinara.operators import classify as CL

N = len(K.CATEGORIES)
CUES = {1: "good fine nice", 2: "okay plain", 3: "bad poor broken"}


def reviews(spark, n, seed=1):
    """Texts that name some of four aspects, each beside a word of its polarity; the rest is noise."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        labels, words = [0] * N, []
        for c, kinds in ((0, (1, 2, 3)), (1, (1, 3)), (2, (2,)), (3, (1, 2, 3))):
            if rng.random() < (0.4, 0.5, 0.3, 0.02)[c]:
                labels[c] = rng.choice(kinds)
                words.append(f"aspect{c} aspect{c}{rng.choice(CUES[labels[c]].split())}")
        words += rng.choices("the of a and to in it is was".split(), k=rng.randint(0, 8))
        rng.shuffle(words)
        rows.append((str(i), " ".join(words), labels))
    rows += [("empty", "", [0] * N), ("null", None, [0] * N)]
    return spark.createDataFrame(rows, "review_id string, text string, labels array<int>")


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(0)
    sizes, size, models = np.array([3, 0, 5, 1]), 6, 2
    idx, data = rng.integers(0, size, sizes.sum()), rng.normal(size=sizes.sum())
    y, cost, at = np.where(rng.random((4, models)) > 0.5, 1.0, -1.0), rng.random((4, models)), rng.normal(size=(size + 1, models))
    gradient = np.zeros_like(at)
    CL._loss(sizes, idx, data, y, cost, at, gradient)
    for f in range(size + 1):
        for m in range(models):
            step = np.zeros_like(at)
            step[f, m] = 1e-6
            up, down = (CL._loss(sizes, idx, data, y, cost, x, np.zeros_like(at))[m] for x in (at + step, at - step))
            assert abs((up - down) / 2e-6 - gradient[f, m]) < 1e-4


def test_minima_of_columns_that_differ_in_scale():
    scales, centre = np.logspace(-2, 4, 7), np.random.default_rng(1).normal(size=(30, 7))
    calls = []

    def evaluate(x):
        calls.append(1)
        weights = scales * np.linspace(1, 50, 30)[:, None]
        return (weights * (x - centre) ** 2).sum(axis=0), 2 * weights * (x - centre)

    got = CL.minimise(evaluate, centre.shape, 200, tolerance=1e-9)
    assert np.abs(got - centre).max() < 1e-3 and len(calls) <= 201


def test_labels_of_new_texts(spark):
    model = CL.fit(reviews(spark, 400), max_iter=30)
    asked = {(q.category, q.label) for q in model.questions}
    assert {(0, None), (1, None), (2, None), (0, 1), (0, 2), (0, 3), (1, 3)} <= asked and (1, 1) not in asked and model.fixed == {2: 2}
    new = reviews(spark, 200, seed=2)
    truth = {r.review_id: r.labels for r in new.collect()}
    got = {r.review_id: list(r.y_pred) for r in CL.predict(model, new).collect()}
    assert set(got) == set(truth)
    for c in (0, 1, 2):
        right = np.mean([got[i][c] == truth[i][c] for i in truth])
        majority = max(np.mean([t[c] == v for t in truth.values()]) for v in range(4))
        assert right > 0.95 > majority
        for v in {t[c] for t in truth.values()}:  # every class, not the frequent ones alone
            assert np.mean([got[i][c] == v for i in truth if truth[i][c] == v]) > 0.9


def test_fitted_together_or_apart_is_the_same(spark):
    train = reviews(spark, 300)
    one = CL.fit(train, max_iter=200)
    only = CL.F.transform("labels", lambda v, i: CL.F.when(i == 1, v).otherwise(0))
    alone = CL.fit(train.withColumn("labels", only), max_iter=200)
    at = [j for j, q in enumerate(one.questions) if q.category == 1]
    assert len(alone.questions) == len(at) == 2
    assert np.abs(one.coefficients[:, at] - alone.coefficients).max() < 1e-2


def test_a_fixed_number_of_jobs(spark, monkeypatch):
    """An evaluation serves all models, however many there are."""
    calls, real = [], CL._objective
    monkeypatch.setattr(CL, "_objective", lambda *a: (lambda f: lambda x: calls.append(x.shape) or f(x))(real(*a)))
    model = CL.fit(reviews(spark, 200), max_iter=8)
    assert len(calls) <= 9 and {s[1] for s in calls} == {len(model.questions)}


def test_nothing_to_learn(spark):
    none = reviews(spark, 0)
    model = CL.fit(none, max_iter=3)
    assert model.questions == [] and {tuple(r.y_pred) for r in CL.predict(model, none).collect()} == {(0,) * N}


def test_ngrams_are_counted_where_their_text_is(spark):
    """Texts are moved, by key; n-grams, many times their size, are not. Rows of one key count together, null keys too."""
    from opinara.operators.classify import term_counts

    rows = [(1, "a b a b"), (1, "a b"), (None, "c"), (None, "c"), (2, None), (3, "")]
    counts = term_counts(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    got = sorted(map(tuple, counts.collect()), key=repr)
    want = [(1, "a", 3), (1, "b", 3), (1, "a b", 3), (1, "b a", 1), (1, "a b a", 1), (1, "b a b", 1), (None, "c", 2)]
    assert got == sorted(want, key=repr)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("Exchange hashpartitioning") == 1
