"""TF-IDF by blocks of documents: against brute force, and what is moved for it."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np

from opinara.operators import ngram_blocks as NB
from opinara.operators.classify import weights_table


def corpus():
    """Repeated and missing keys, missing and blank texts, words that go on with a character below the blank, and other scripts."""
    rng = random.Random(3)
    words = ["a", "A", "a\x01", "a\x01b", "ab", "b", "é", "日本", "z" * 40, "a\x1cb", "x y"]
    rows = [(rng.choice([None, *range(40)]), " ".join(rng.choices(words, k=rng.randint(0, 30)))) for _ in range(120)]
    return [*rows, (100, None), (101, ""), (102, " \t\n"), (103, "only here"), (104, "only")]


def brute(rows, min_df=2):
    docs = defaultdict(Counter)
    for key, text in rows:
        w = (text or "").lower().split()
        docs[key].update(" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))
    df = Counter(t for d in docs.values() for t in d)
    idx = {t: i for i, t in enumerate(sorted((t for t in df if df[t] >= min_df), key=lambda t: t.encode()))}
    out = {}
    for key, d in docs.items():
        w = {t: (1 + math.log(n)) * (math.log((1 + len(rows)) / (1 + df[t])) + 1) for t, n in d.items() if t in idx}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out |= {(key, t, idx[t]): x / norm for t, x in w.items() if key is not None}
    return out


def test_weights_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(NB, "SMALL_BYTES", 500)
    rows = corpus()
    got = {(r.id, r.term, r.idx): r.weight for r in NB.weights(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()}
    want = brute(rows)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_no_texts(spark):
    assert weights_table(spark.createDataFrame([], "id string, text string"), "id", "text").collect() == []
    assert weights_table(spark.createDataFrame([("a", None)], "id string, text string"), "id", "text").collect() == []


def test_numbers_are_sorted_as_texts(monkeypatch):
    words = [w.lower().encode() for w in ("a", "a\x01", "a\x01b", "ab", "b", "é")]
    triples = [(i, j, k) for i in range(6) for j in range(-1, 6) for k in range(-1 if j < 0 else -1, 0 if j < 0 else 6)]
    for most in (NB.MOST, 0):
        monkeypatch.setattr(NB, "MOST", most)
        grams = NB.Grams(words)
        codes = grams.codes(*np.array(triples).T)
        texts = [b" ".join(words[i] for i in t if i >= 0) for t in triples]
        assert [grams.text(c) for c in codes] == texts and [t.encode() for t in grams.texts(codes).to_pylist()] == texts
        assert [texts[i] for i in np.argsort(codes)] == sorted(texts)


def test_ngrams_are_not_moved(spark):
    """Rows of an n-gram each, moved for their document frequency, numbers and norms, took 39 times the input of disk."""
    docs = spark.createDataFrame(corpus(), "id long, text string")
    plan = weights_table(docs, "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "hashpartitioning(term" not in plan and "rangepartitioning(term" not in plan


def test_shuffled_files_go_when_they_are_read(spark):
    from opinara.session import CLEANUP, materialise

    materialise(spark.range(10).repartition(3), "x", done=True)
    assert spark.conf.get(CLEANUP, None) in (None, "false")


def test_features_of_the_most_frequent(spark, monkeypatch):
    """The classifiers' n-grams: counted in blocks, and weighed at the documents with the few that are asked for."""
    monkeypatch.setattr(NB, "SMALL_BYTES", 500)
    rows = corpus()
    docs = spark.createDataFrame(rows, "id long, text string")
    total, df = Counter(), Counter()
    for key in {k for k, _ in rows}:
        own = Counter(t for k, text in rows if k == key for w in [(text or "").lower().split()] for n in (1, 2, 3) for t in (" ".join(w[i : i + n]) for i in range(len(w) - n + 1)))
        total.update(own)
        df.update(set(own))
    order = sorted((t for t in df if df[t] >= 2), key=lambda t: (-total[t], t.encode()))
    for most in (25, None):
        top = NB.vocabulary(docs, "id", "text", most=most)
        assert sorted(map(tuple, top.collect())) == sorted((t, df[t], total[t]) for t in order[:most])
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "hashpartitioning(term" not in plan
    few = sorted(order[:25], key=lambda t: t.encode())
    vocab = spark.createDataFrame([(t, df[t], i) for i, t in enumerate(few)], "term string, df long, idx int").toArrow()
    for big in (NB.MOST, 0):
        monkeypatch.setattr(NB, "MOST", big)
        got = {r.id: dict(zip(r.idx, r.weight, strict=True)) for r in NB.features(docs, "id", "text", vocab, len(rows)).collect()}
        raw = defaultdict(dict)
        for (key, t, _), _w in brute(rows).items():
            if t in few:
                n = sum(1 for k, text in rows if k == key for w in [(text or "").lower().split()] for m in (1, 2, 3) for i in range(len(w) - m + 1) if " ".join(w[i : i + m]) == t)
                raw[key][few.index(t)] = (1 + math.log(n)) * (math.log((1 + len(rows)) / (1 + df[t])) + 1)
        norm = {k: math.sqrt(sum(x * x for x in v.values())) for k, v in raw.items()}
        assert got.keys() == raw.keys()
        assert all(got[k].keys() == raw[k].keys() and list(got[k]) == sorted(got[k]) and abs(got[k][i] - raw[k][i] / norm[k]) < 1e-9 for k in raw for i in raw[k])
