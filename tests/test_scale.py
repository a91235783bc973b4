"""Hot keys, brute-force comparisons and results that do not depend on partitions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinara import constants as K
from opinara.operators import aspects as A
from opinara.operators import classify as CL
from opinara.operators import evidence as EV
from opinara.operators import metrics as M
from opinara.operators import retrieval as RT
from opinara.operators.ranking import rank_in_group, top_rows
from opinara.sources import fixtures as V
from tests.parity import DATA

SF_DIR = f"{DATA}/sf0.001"


def test_rank_in_group_with_a_hot_key(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("k"), F.xxhash64("id").alias("h"), "id"
    )
    out = rank_in_group(df, ["k"], "h", ["id"], "n", total="of").toPandas()
    for _, group in out.groupby("k"):
        ordered = group.sort_values(["h", "id"])
        assert list(ordered["n"]) == list(range(1, len(group) + 1))
        assert set(group["of"]) == {len(group)}


def test_top_rows_cuts_before_the_shuffle(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 3)
    plan = top_rows(df, ["k"], ["id"], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def _greedy(rows, order, limit, fill):
    """Plain greedy selection over one product's rows."""
    picked, aspects, texts, reviews = [], set(), set(), set()
    good = lambda r: r["aspect"] in K.ASPECT_LABELS and len(r["text"]) >= 28
    key = lambda r: r["text"].lower()
    by_conf = sorted(rows, key=lambda r: (-r["confidence"], r["item_id"], r["text"]))
    for s in order:
        for r in by_conf:
            if r["sentiment"] != s or not good(r) or r["aspect"] in aspects or key(r) in texts or r["review_id"] in reviews:
                continue
            picked.append(r), aspects.add(r["aspect"]), texts.add(key(r)), reviews.add(r["review_id"])
            if len(picked) >= limit:
                return picked
    if fill:
        for r in by_conf[:limit]:
            if good(r) and key(r) not in texts and r["review_id"] not in reviews:
                picked.append(r), texts.add(key(r)), reviews.add(r["review_id"])
            if len(picked) >= limit:
                break
    return picked


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_diverse_evidence_against_plain_greedy(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(900):
        rows.append({
            "product_id": rnd.choice(["hot", "hot", "hot", "p2"]), "aspect": rnd.choice(K.CATEGORIES[:4]),
            # few reviews and texts, so that earlier picks block most rows
            "review_id": f"r{rnd.randint(0, 7)}", "sentiment": rnd.choice(K.SENTIMENTS), "confidence": rnd.randint(1, 5) / 5,
            "item_id": i, "text": f"the same long words repeated {rnd.randint(0, 9)} times here",
        })
    df = spark.createDataFrame([{**r, "sentence": r["text"]} for r in rows]).drop("text")
    got = {}
    for r in EV.diverse_evidence(df, limit=6).orderBy("product_id", "rank").collect():
        got.setdefault(r["product_id"], []).append((r["review_id"], r["aspect_code"], r["sentiment"], r["confidence"], r["text"]))
    for product in ("hot", "p2"):
        want = _greedy([r for r in rows if r["product_id"] == product], EV.SENTIMENT_ORDER, 6, True)
        assert got[product] == [(r["review_id"], r["aspect"], r["sentiment"], r["confidence"], r["text"]) for r in want]


@pytest.mark.parametrize("parts", ["1", "7", "64"])
def test_results_do_not_depend_on_partitions(spark, parts):
    def run():
        items = V.aspect_items(spark, SF_DIR, with_sentence=True)
        tables = [A.aspect_table(items), A.opinion_table(items), A.strengths(A.aspect_table(items))]
        return [sorted(map(tuple, t.select(sorted(t.columns)).collect())) for t in tables]

    before = run()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert run() == before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_a_label_set_agrees_with_itself(spark):
    q = V.quads(spark, SF_DIR)
    row = M.quad_f1(M.quad_matches(M.both_sides(q, q, ["pos"]), "full"), "full").first()
    assert row["f1"] == row["exact_match"] == 1.0
    for r in M.cohen_kappa(*[f(M.distinct_sides(M.both_sides(q, q, ["pos"]))) for f in (M.category_counts, M.sentiment_pairs)]).collect():
        assert r["kappa"] is None or -1 <= r["kappa"] <= 1


def test_counts_add_up(spark):
    table = A.aspect_table(V.aspect_items(spark, SF_DIR))
    assert table.filter(F.col("positive") + F.col("neutral") + F.col("negative") != F.col("mentions")).count() == 0


@pytest.mark.parametrize("sizes", [(2048, 512), (16, 4)])
def test_vector_search_against_numpy(spark, sizes):
    """A hot product over many blocks, filters, repeated vectors, missing ones, and products of one side only."""
    rnd, plain = np.random.default_rng(3), random.Random(3)
    unit = lambda n: [v / np.linalg.norm(v) for v in rnd.normal(size=(n, 8))]
    vectors = unit(200)
    vectors[50:90] = [vectors[0]] * 40  # a very common vector: ties go by id
    chunks = [(i, plain.choice(["hot", "hot", "hot", "p"]), plain.choice(["A", "B", None]), plain.choice(["positive", "negative"]), [float(x) for x in v]) for i, v in enumerate(vectors)]
    chunks += [(900, "lone", "A", "positive", [1.0] + [0.0] * 7), (901, "hot", "A", "positive", None)]
    queries = [(f"q{i}", plain.choice(["hot", "p", "empty"]), [float(x) for x in v], plain.choice([None, [], ["negative"], ["negative", "positive"]]), plain.choice([None, [], ["A"], ["Z"]])) for i, v in enumerate([vectors[0], *unit(20)])]
    queries += [("q99", "hot", None, None, None)]
    made = (
        spark.createDataFrame(queries, "query_id string, product_id string, q_vector array<double>, sentiments array<string>, aspects array<string>"),
        spark.createDataFrame(chunks, "chunk_id long, product_id string, aspect string, sentiment string, vector array<double>"),
    )
    got = {}
    for r in RT.vector_search(*made, 5, *sizes).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["chunk_id"], r["semantic_score"], r["aspect"], r["sentiment"]))
    want = {}
    for q, product, vector, sentiments, aspects in queries:
        hits = [(-round(float(np.dot(vector, c[4])) + 1e-9, 6), *c[:4]) for c in chunks if vector and c[4] and c[1] == product and (not sentiments or c[3] in sentiments) and (not aspects or c[2] in aspects)]
        if hits:
            want[q] = [(n + 1, i, -score, aspect, sentiment) for n, (score, i, _, aspect, sentiment) in enumerate(sorted(hits, key=lambda h: h[:2])[:5])]
    assert got == want


def test_questions_and_chunks_meet_as_blocks(spark):
    queries = spark.range(40).selectExpr("id AS query_id", "'hot' AS product_id", "array(1D, 0D) AS q_vector")
    chunks = spark.range(3000).selectExpr("id AS chunk_id", "IF(id < 2990, 'hot', CAST(id AS STRING)) AS product_id", "array(0D, 1D) AS vector")
    blocks = [RT._blocks(df, c, "rows", n).collect() for df, c, n in ((queries, "query_id", 10), (chunks, "chunk_id", 100))]
    sizes = [[len(r["rows"]) for r in b if r["product_id"] == "hot"] for b in blocks]
    assert sum(sizes[0]) == 40 and max(sizes[0]) <= 10 and sum(sizes[1]) == 2990 and max(sizes[1]) <= 100 and len(sizes[1]) <= 30 + 8
    assert sorted(x["chunk_id"] for r in blocks[1] for x in r["rows"]) == list(range(3000))
    assert all([x["chunk_id"] for x in r["rows"]] == sorted(x["chunk_id"] for x in r["rows"]) for r in blocks[1])


def test_ngrams(spark):
    df = spark.createDataFrame([("A b c",), ("x",), ("",)], "t string")
    got = [r["g"] for r in df.select(CL.ngrams("t").alias("g")).collect()]
    assert got == [["a", "b", "c", "a b", "b c", "a b c"], ["x"], []]
