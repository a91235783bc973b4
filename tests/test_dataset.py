"""Changed copies of texts."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from opinara.operators import dataset as DS


def plain_swap(words: list[str], draws: list[float]) -> str:
    for x in draws:
        p = int(x * (len(words) - 1))
        words[p], words[p + 1] = words[p + 1], words[p]
    return " ".join(words)


def test_word_swap_in_order_of_rounds(spark):
    """Neighbouring and repeated places, both ends, short and missing texts."""
    sizes = [0, 1, 3, 4, 5, 19, 40, 41, 200, 1000]
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(n))) for i, n in enumerate(sizes)] + [(99, None)], "id long, text string")
    # draws that lie close together: most pairs share words with others
    close = lambda seed, key, r: F.pmod(F.xxhash64(key, r), F.lit(40)) / F.lit(40.0) * F.when(F.col("id") % 2 == 0, 1).otherwise(0.05)
    rows = docs.select("text", DS.word_swap(F.col("text"), 1, F.col("id"), close).alias("got"),
                       F.transform(F.sequence(F.lit(1), F.lit(60)), lambda r: close(1, F.col("id"), r)).alias("draws")).collect()
    for r in rows:
        words = (r.text or "").split()
        want = r.text if len(words) < 4 else plain_swap(words, r.draws[: max(1, len(words) // 20)])
        assert r.got == want


def test_word_swap_of_a_long_text_is_not_quadratic(spark):
    docs = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda i: i.cast("string")), " ").alias("text"))
    start = time.time()
    got = docs.select(DS.word_swap(F.col("text"), 1, F.lit("k")).alias("t")).first().t.split(" ")
    assert sorted(map(int, got)) == list(range(1, 60_001))
    assert time.time() - start < 15  # 3,000 rounds over 60,000 words took far longer


def test_repeated_terms_are_tagged_once_and_split_once(spark):
    """A term that comes again finds its place taken, whatever its sentiment; it is not split and looked for again."""
    from opinara.functions import arrays as R

    quads = [("good", "x"), ("b c", "negative"), (" a ", None), ("a", "negative"), ("b c", "neutral"), ("", "positive"), ("c", "neutral"), ("c d", "positive"), (None, "neutral"), ("zz", "neutral"), ("B!", "neutral"), ("d", "NEGATIVE ")]
    row = [("a b c a d b !", [(t, "C", "o", s) for t, s in quads]), (None, []), ("a", None)]
    kind = "text string, quadruples array<struct<aspect_term:string,aspect_category:string,opinion_term:string,sentiment:string>>"
    docs = spark.createDataFrame(row, kind)
    from opinara.functions import text as X

    tags = docs.select(R.bio_tags(X.tokens("text"), F.col("quadruples")).alias("t"))
    got = [r.t for r in tags.collect()]
    assert got == [["B-positive", "B-negative", "I-negative", "O", "B-negative", "B-neutral", "I-neutral"], ["O"], ["O"]]
    plan = tags._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct" in plan


def test_samples_are_made_once(spark, monkeypatch):
    """The split reads its samples several times, so they are written first."""
    from opinara.plans import jobs

    tags, real = [], jobs.materialise
    monkeypatch.setattr(jobs, "materialise", lambda df, tag, *a, **k: tags.append(tag) or real(df, tag, *a, **k))
    rows = [(str(i), f"text a {i}", [("a", "PRODUCT#QUALITY", "o", "negative")], False) for i in range(20)]
    kind = "review_id string, text string, quadruples array<struct<aspect_term:string,aspect_category:string,opinion_term:string,sentiment:string>>, conflict boolean"
    out = jobs.build_dataset(spark.createDataFrame(rows, kind))
    assert tags[:2] == ["samples", "split"] and {r["split"] for r in out["report"].select("split").distinct().collect()} == {"train", "val", "test"}
