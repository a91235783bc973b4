"""Sentences, opinion items and the scores built from their weights."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara import constants as K
from opinara.functions import text as X
from opinara.functions.casts import lookup
from opinara.functions.keywords import keyword_counts
from opinara.functions.numbers import clamp01, count_if, dec, round_up, share

ITEM_SCHEMA = "sentence string, aspect string, sentiment string, confidence double"


def explode_sentences(reviews: DataFrame, text: str, least: int = K.SENTENCE_LENGTH, most: int | None = None) -> DataFrame:
    """One row per sentence of at least ``least`` characters, and of at most ``most`` if given, numbered from 0."""
    keep = [c for c in reviews.columns if c != text]
    # the outer form keeps the split from being evaluated again in an inferred filter
    out = reviews.select(*keep, F.posexplode_outer(X.sentences(text)).alias("sentence_no", "sentence"))
    out = out.filter(F.length("sentence") >= least)
    return out if most is None else out.filter(F.length("sentence") <= most)


def item_weight(rating: Column, helpful: Column, confidence: Column) -> Column:
    """rating/5 · (1 + helpful/10) · confidence, exact for decimal input."""
    return rating * (10 + helpful) * confidence * dec("0.02")


def sentiment_score(sentiment: Column) -> Column:
    return F.coalesce(lookup(sentiment, K.SENTIMENT_SCORE), F.lit(0))


def weigh_items(items: DataFrame) -> DataFrame:
    """Add sentiment_score and weight."""
    return items.withColumns({
        "sentiment_score": sentiment_score(F.col("sentiment")),
        "weight": item_weight(F.col("rating"), F.col("helpful_count"), F.col("confidence")),
    })


def weighted_mean(score: str = "sentiment_score", weight: str = "weight") -> Column:
    """Σ score·w / Σ w, the plain mean when no weight is left."""
    w = F.sum(weight).cast("double")
    return F.when(w > 0, F.sum(F.col(score) * F.col(weight)).cast("double") / F.nullif(w, F.lit(0.0))).otherwise(
        F.sum(score).cast("double") / F.count(F.lit(1))
    )


def score_label(score: Column) -> Column:
    return F.when(score > 0.15, "positive").when(score < -0.15, "negative").otherwise("neutral")


def review_scores(items: DataFrame) -> DataFrame:
    """Weighted score, label and highest confidence of each review."""
    out = items.groupBy("product_id", "review_id").agg(
        weighted_mean().alias("score"), F.max("confidence").cast("double").alias("confidence")
    )
    return out.withColumn("label", score_label(F.col("score")))


def sentiment_distribution(scores: DataFrame) -> DataFrame:
    """Review labels per product, as counts and ratios."""
    out = scores.groupBy("product_id").agg(*[count_if(F.col("label") == s).alias(s) for s in K.SENTIMENTS])
    total = F.greatest(F.col("positive") + F.col("neutral") + F.col("negative"), F.lit(1))
    return out.select(
        "product_id", *K.SENTIMENTS, *[share(F.col(s), total).alias(f"{s}_ratio") for s in K.SENTIMENTS]
    )


def product_score(items: DataFrame) -> DataFrame:
    """Score in [0, 1], number of aspects and reviews of each product."""
    parts = items.groupBy("product_id", "aspect").agg(
        F.sum(F.col("sentiment_score") * F.col("weight")).alias("ws"), F.sum("weight").alias("w"),
        F.sum("sentiment_score").alias("s"), F.count("*").alias("n"),
    )
    w, ws = F.sum("w").cast("double"), F.sum("ws").cast("double")
    plain = F.sum("s").cast("double") / F.sum("n")
    out = parts.groupBy("product_id").agg(
        F.when(w > 0, ws / F.nullif(w, F.lit(0.0))).otherwise(plain).alias("mean"), F.count("*").alias("num_aspects")
    )
    used = items.groupBy("product_id", "review_id").agg(F.lit(1).alias("one"))
    used = used.groupBy("product_id").agg(F.count("*").alias("reviews_used"))
    return out.join(used, "product_id").select(
        "product_id",
        round_up(clamp01((F.col("mean") + 1) / 2)).alias("absa_score"),
        "num_aspects",
        "reviews_used",
    )


def cap_reviews(reviews: DataFrame, order: list, k: int) -> DataFrame:
    """The first ``k`` reviews of each product: a limit of the analysis itself."""
    rank = F.row_number().over(Window.partitionBy("product_id").orderBy(*order))
    return reviews.withColumn("__n", rank).filter(F.col("__n") <= k).drop("__n")


def cap_item_reviews(items: DataFrame, k: int) -> DataFrame:
    """Items of the first ``k`` reviews of each product."""
    rank = F.dense_rank().over(Window.partitionBy("product_id").orderBy("review_id"))
    return items.withColumn("__n", rank).filter(F.col("__n") <= k).drop("__n")


def rule_items(df: DataFrame, sentence: str = "sentence", limit: int | None = None) -> DataFrame:
    """Rule scorer: keyword sentiment, and the matching aspects, all or the first ``limit``."""
    required, forbidden = list(K.REQUIRED_KEYWORDS), list(K.FORBIDDEN_KEYWORDS)
    lists = [K.POSITIVE_WORDS, K.NEGATIVE_WORDS, *K.REQUIRED_KEYWORDS.values(), *K.FORBIDDEN_KEYWORDS.values()]
    df = df.withColumn("__hits", keyword_counts(F.lower(F.col(sentence)), lists))
    number = lambda i: F.get("__hits", F.lit(i))
    diff = number(0) - number(1)
    aspects = []
    for i, code in enumerate(required):
        ok = number(2 + i) > 0
        if code in forbidden:
            ok = ok & (number(2 + len(required) + forbidden.index(code)) == 0)
        aspects.append(F.when(ok, F.lit(code)))
    found = F.array_compact(F.array(*aspects))
    found = F.slice(found, 1, limit) if limit else found
    return (
        df.withColumn("__diff", diff)
        .withColumns({
            "sentiment": F.when(F.col("__diff") > 0, "positive").when(F.col("__diff") < 0, "negative")
            .otherwise("neutral"),
            "rule_score": F.signum("__diff") * 0.7,
            "confidence": round_up(F.least(F.lit(0.8), 0.5 + F.abs("__diff") / 10)),
            "aspect": F.explode_outer(found),
        })
        .filter(F.col("aspect").isNotNull())
        .drop("__diff", "__hits")
    )


def score_distinct(sentences: DataFrame, scorer: Callable[[list[str]], list[list[tuple[str, str, float]]]],
                   batch: int = 32, min_length: int = 10) -> DataFrame:
    """Run an external batch scorer once per distinct sentence.

    ``scorer`` takes a list of sentences and gives, for each, a list of
    (aspect, sentiment, confidence). It runs in Arrow batches on the executors.
    """
    todo = sentences.select(X.strip_ws("sentence").alias("sentence")).filter(F.length("sentence") >= min_length)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["sentence"].tolist()
            rows = []
            for start in range(0, len(texts), batch):
                part = texts[start:start + batch]
                for sentence, found in zip(part, scorer(part)):
                    rows += [(sentence, a, s, float(c)) for a, s, c in found]
            yield pd.DataFrame(rows, columns=["sentence", "aspect", "sentiment", "confidence"])

    scored = todo.distinct().mapInPandas(run, ITEM_SCHEMA)
    keyed = sentences.withColumn("sentence", X.strip_ws("sentence"))
    return keyed.join(scored, "sentence")
