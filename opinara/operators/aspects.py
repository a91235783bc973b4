"""Aspect tables, rankings and opinion tables, for all products at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara import constants as K
from opinara.functions import labels as L
from opinara.functions import text as X
from opinara.functions.casts import zero_as_missing
from opinara.functions.numbers import count_if, mean, round_up, share
from opinara.operators.items import weighted_mean
from opinara.operators.ranking import top_rows


def _counts(sentiment: str = "sentiment") -> list[Column]:
    return [count_if(F.col(sentiment) == s).alias(s) for s in K.SENTIMENTS]


def aspect_table(items: DataFrame) -> DataFrame:
    """Counts and weighted score of every aspect of every product."""
    out = items.groupBy("product_id", "aspect").agg(
        *_counts(), round_up((weighted_mean() + 1) / 2).alias("avg_score_0_1")
    )
    mentions = F.col("positive") + F.col("neutral") + F.col("negative")
    return out.select(
        "product_id", "aspect", L.table_label(F.col("aspect")).alias("display_name"), *K.SENTIMENTS,
        mentions.alias("mentions"), "avg_score_0_1",
    )


def aspect_measures(items: DataFrame) -> DataFrame:
    """What each item adds to the aspect table of its product; other columns are kept."""
    one = {s: (F.col("sentiment") == s).cast("long") for s in K.SENTIMENTS}
    wide = lambda c: c.cast("decimal(38,6)")
    return items.withColumns({
        **{s: F.coalesce(c, F.lit(0)) for s, c in one.items()}, "items": F.lit(1).cast("long"),
        "scores": wide(F.col("sentiment_score")), "weights": wide(F.col("weight")), "weighted": wide(F.col("sentiment_score") * F.col("weight")),
    })


MEASURES = [*K.SENTIMENTS, "items", "scores", "weights", "weighted"]


def aspect_table_of_sums(sums: DataFrame) -> DataFrame:
    """The aspect table from the sums of ``aspect_measures`` by product and aspect."""
    w = F.col("weights").cast("double")
    plain = F.col("scores").cast("double") / F.col("items")
    score = F.when(w > 0, F.col("weighted").cast("double") / F.nullif(w, F.lit(0.0))).otherwise(plain)
    mentions = F.col("positive") + F.col("neutral") + F.col("negative")
    return sums.select(
        "product_id", "aspect", L.table_label(F.col("aspect")).alias("display_name"), *K.SENTIMENTS, mentions.alias("mentions"),
        round_up((score + 1) / 2).alias("avg_score_0_1"),
    )


def ranked_aspect_table(table: DataFrame, limit: int | None = None) -> DataFrame:
    return top_rows(table, ["product_id"], [F.desc("mentions"), "aspect"], limit, rank="rank")


def radar(table: DataFrame) -> DataFrame:
    """Chart series: scored aspects that were mentioned at all."""
    return table.filter((F.col("avg_score_0_1") > 0) & (F.col("mentions") > 0)).select(
        "product_id", "aspect", F.col("avg_score_0_1").alias("score")
    )


def strengths(table: DataFrame, limit: int = 4) -> DataFrame:
    pos, n = F.col("positive"), F.greatest(F.col("mentions"), F.lit(1))
    pool = table.filter((pos > F.col("negative")) & (pos / n >= 0.3))
    order = [F.desc("mentions"), F.desc("avg_score_0_1"), "aspect"]
    return top_rows(pool, ["product_id"], order, limit, rank="rank")


def weaknesses(table: DataFrame, limit: int = 4) -> DataFrame:
    neg, n = F.col("negative"), F.greatest(F.col("mentions"), F.lit(1))
    pool = table.filter((neg > 0) & ((neg >= F.col("positive")) | (neg / n >= 0.3)))
    order = [F.desc("negative"), F.desc("mentions"), "aspect"]
    return top_rows(pool, ["product_id"], order, limit, rank="rank")


def opinion_table(items: DataFrame, limit: int | None = None) -> DataFrame:
    """Count, mean confidence and an example sentence per aspect and sentiment.

    The example is the first keyword-valid sentence, where the original draws
    one at random from the first ten.
    """
    valid = X.keyword_match(F.col("aspect"), F.col("__low"), K.REQUIRED_KEYWORDS, K.FORBIDDEN_KEYWORDS)
    pool = items.filter(F.col("sentiment") != "none")
    keys = ["product_id", "aspect", "sentiment"]
    counted = pool.groupBy(*keys).agg(F.count("*").alias("count"), round_up(mean("confidence"), 3).alias("confidence"))
    examples = top_rows(pool.withColumn("__low", F.lower("sentence")).filter(valid), keys, ["item_id", "sentence"], 1).select(
        *keys, F.col("sentence").alias("example")
    )
    top = top_rows(counted, ["product_id"], [F.desc("count"), "aspect", "sentiment"], limit, rank="rank")
    return top.join(examples, keys, "left").select(
        *keys, L.table_label(F.col("aspect")).alias("display_name"), "count", "confidence",
        F.coalesce("example", F.lit("")).alias("example"), "rank",
    )


def aspect_stats(items: DataFrame) -> DataFrame:
    """Counts and ratios per aspect; unknown sentiments count as neutral.

    avg_confidence is the highest of the per-sentiment means, as in the
    original; mean_confidence is the plain mean.
    """
    by_sentiment = items.groupBy("product_id", "aspect", F.col("sentiment").alias("raw")).agg(
        F.count("*").alias("n"),
        F.coalesce(mean("confidence"), F.lit(0.0)).alias("avg"),
        F.sum("confidence").alias("conf_sum"),
    )
    sentiment = F.when(F.col("raw").isin(K.SENTIMENTS), F.col("raw")).otherwise("neutral")
    out = by_sentiment.withColumn("s", sentiment).groupBy("product_id", "aspect").agg(
        *[F.coalesce(F.sum(F.when(F.col("s") == s, F.col("n"))), F.lit(0)).alias(s) for s in K.SENTIMENTS],
        F.sum("n").alias("total"),
        round_up(F.max("avg")).alias("avg_confidence"),
        round_up(F.sum("conf_sum").cast("double") / F.sum("n")).alias("mean_confidence"),
    )
    return out.select(
        "product_id", "aspect", *K.SENTIMENTS, "total",
        share(F.col("positive"), F.col("total")).alias("positive_ratio"),
        share(F.col("negative"), F.col("total")).alias("negative_ratio"),
        "avg_confidence", "mean_confidence",
    )


def rank_stats(stats: DataFrame, by: list[str], limit: int | None, rank: str = "rank") -> DataFrame:
    """Per product, the aspects ordered by the given columns, highest first."""
    return top_rows(stats, ["product_id"], [*[F.desc(c) for c in by], "aspect"], limit, rank=rank)


def top_by_sentiment(items: DataFrame, sentiment: str, limit: int = 6) -> DataFrame:
    """Aspects by number of opinions of one sentiment."""
    out = items.filter(F.col("sentiment") == sentiment).groupBy("product_id", "aspect").agg(
        F.count("*").alias("total"), round_up(mean("confidence")).alias("avg_confidence")
    )
    out = top_rows(out, ["product_id"], [F.desc("total"), "aspect"], limit, rank="rank")
    return out.withColumn("sentiment", F.lit(sentiment))


def negative_ratio_by_aspect(stats: DataFrame, limit: int = 8) -> DataFrame:
    return rank_stats(stats, ["negative_ratio", "negative", "total"], limit)


def positive_ratio_by_aspect(stats: DataFrame, limit: int = 8) -> DataFrame:
    return rank_stats(stats, ["positive_ratio", "positive", "total"], limit)


def aspect_distribution(stats: DataFrame, limit: int | None = 8) -> DataFrame:
    return rank_stats(stats, ["total"], limit)


def two_rankings(stats: DataFrame) -> DataFrame:
    """Negative and positive rank of each aspect, and the records per product."""
    per = Window.partitionBy("product_id")  # at most one row per aspect and product
    negative = per.orderBy(F.desc("negative"), F.desc("negative_ratio"), F.desc("total"), "aspect")
    positive = per.orderBy(F.desc("positive"), F.desc("positive_ratio"), F.desc("total"), "aspect")
    return stats.select(
        "*",
        F.row_number().over(negative).alias("negative_rank"),
        F.row_number().over(positive).alias("positive_rank"),
        F.sum("total").over(per).alias("total_aspect_records"),
    )


def review_statistics(reviews: DataFrame, items: DataFrame) -> DataFrame:
    """Stored reviews, aspect records and mean non-null rating per product."""
    left = reviews.groupBy("product_id").agg(
        F.count("*").alias("stored_review_count"), round_up(mean("rating")).alias("avg_review_rating")
    )
    right = items.groupBy("product_id").agg(F.count("*").alias("aspect_record_count"))
    return left.join(right, "product_id", "full_outer").select(
        "product_id",
        F.coalesce("stored_review_count", F.lit(0)).alias("stored_review_count"),
        F.coalesce("aspect_record_count", F.lit(0)).alias("aspect_record_count"),
        "avg_review_rating",
    )


def plain_aspect_statistics(items: DataFrame) -> DataFrame:
    """Counts per named aspect, ratio to 3 digits, and both orders."""
    sentiment = F.when(F.col("sentiment").isin(K.SENTIMENTS), F.col("sentiment")).otherwise("neutral")
    named = items.filter(F.coalesce(F.col("aspect"), F.lit("")) != "").withColumn("s", sentiment)
    out = named.groupBy("product_id", "aspect").agg(*_counts("s"), F.count("*").alias("total"))
    out = out.withColumn("negative_ratio", share(F.col("negative"), F.col("total"), 3))
    per = Window.partitionBy("product_id")  # at most one row per aspect and product
    return out.select(
        "*",
        F.row_number().over(per.orderBy(F.desc("negative"), F.desc("total"), "aspect")).alias("negative_rank"),
        F.row_number().over(per.orderBy(F.desc("positive"), F.desc("total"), "aspect")).alias("positive_rank"),
    )


def aspect_summary(items: DataFrame) -> DataFrame:
    """Aspect by sentiment counts of each product."""
    return items.groupBy("product_id", "aspect").agg(*_counts())


def opinion_union(opinions: DataFrame, strong: DataFrame, weak: DataFrame) -> DataFrame:
    """Opinion rows with strengths and weaknesses appended at confidence 0.8."""
    def rows(df: DataFrame, sentiment: str, origin: str) -> DataFrame:
        return df.select(
            "product_id", "aspect", F.lit(sentiment).alias("sentiment"), F.lit(0.8).alias("confidence"),
            F.lit(origin).alias("origin"),
        )

    base = opinions.select("product_id", "aspect", "sentiment", "confidence", F.lit("opinion").alias("origin"))
    return base.unionByName(rows(strong, "positive", "strength")).unionByName(rows(weak, "negative", "weakness"))


def opinion_percent(opinions: DataFrame) -> DataFrame:
    """Share of each sentiment over opinion rows weighted by their count, in percent."""
    n = zero_as_missing(F.col("count"), F.lit(1))
    kind = F.when(F.col("sentiment").isin("positive", "negative"), F.col("sentiment")).otherwise("neutral")
    out = opinions.withColumn("s", kind).groupBy("product_id").agg(
        *[F.coalesce(F.sum(F.when(F.col("s") == s, n)), F.lit(0)).alias(s) for s in K.SENTIMENTS]
    )
    total = F.greatest(F.col("positive") + F.col("neutral") + F.col("negative"), F.lit(1))
    return out.select(
        "product_id",
        *[round_up(F.col(s).cast("double") * 100 / total, 1).alias(f"{s}_percent") for s in K.SENTIMENTS],
    )


def merge_ranked(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row per aspect: the first list wins over the second."""
    both = first.withColumn("__list", F.lit(0)).unionByName(second.withColumn("__list", F.lit(1)))
    return top_rows(both, ["product_id", "aspect"], ["__list", "rank"], 1).drop("__list")


def friendly_stats(ranked: DataFrame, limit: int = 4) -> DataFrame:
    """Display rows: aspect name, counts and whole percents."""
    return ranked.filter(F.col("rank") <= limit).select(
        "product_id", L.aspect_label(F.col("aspect")).alias("aspect_label"), "aspect", "negative", "positive", "total",
        "avg_confidence",
        L.percent_text(F.col("negative_ratio")).alias("negative_percent"),
        L.percent_text(F.col("positive_ratio")).alias("positive_percent"),
        "rank",
    )


def friendly_risks(risks: DataFrame) -> DataFrame:
    return risks.select(
        "product_id", L.risk_label(F.col("risk_type")).alias("risk"), "severity", "confidence",
        X.summarize_opinion("evidence").alias("evidence"),
    )
