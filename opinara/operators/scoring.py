"""Purchase score, fit level and answer confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara import constants as K
from opinara.functions.casts import lookup, zero_as_missing
from opinara.functions.labels import confidence_band
from opinara.functions.numbers import clamp01, dec, round_up
from opinara.operators.items import sentiment_score


def purchase_score(items: DataFrame, review_counts: DataFrame | None = None) -> DataFrame:
    """Aspect-weighted score, evidence confidence and buy label per product."""
    aspect_weight = F.coalesce(lookup(F.col("aspect"), {k: _d(v) for k, v in K.ASPECT_WEIGHTS.items()}), dec("1.0"))
    weight = F.greatest(zero_as_missing(F.col("confidence"), dec("0.5")), dec("0.05")) * aspect_weight
    out = items.withColumns({"__w": weight, "__s": sentiment_score(F.coalesce("sentiment", F.lit("neutral")))})
    out = out.groupBy("product_id").agg(
        F.sum(F.col("__w") * F.col("__s")).cast("double").alias("ws"),
        F.sum("__w").cast("double").alias("w"),
        F.count("*").alias("items"),
    )
    seen = F.col("items")
    if review_counts is not None:
        out = out.join(review_counts, "product_id", "left")
        seen = F.greatest(F.col("items"), F.coalesce("review_count", F.lit(0)))
    score = F.when(F.col("w") > 0, clamp01((F.col("ws") / F.nullif(F.col("w"), F.lit(0.0)) + 1) / 2)).otherwise(0.5)
    out = out.withColumns({"raw": score, "evidence": F.least(F.lit(1.0), seen / F.lit(30.0))})
    label = (
        F.when((F.col("raw") >= 0.68) & (F.col("evidence") >= 0.35), K.PURCHASE_LABELS["buy"])
        .when(F.col("raw") < 0.42, K.PURCHASE_LABELS["avoid"])
        .otherwise(K.PURCHASE_LABELS["consider"])
    )
    return out.select(
        "product_id", label.alias("label"), round_up(F.col("raw")).alias("score"),
        round_up(F.col("evidence")).alias("confidence"),
    )


def _d(text: str):
    from decimal import Decimal

    return Decimal(text)


def fit_level(scores: DataFrame) -> DataFrame:
    """Fit follows the buy label unless there is too little evidence."""
    level = (
        F.when(F.col("confidence") < 0.25, "insufficient_data")
        .when(F.col("label") == K.PURCHASE_LABELS["buy"], "fit")
        .otherwise("consider")
    )
    return scores.select("product_id", "label", "confidence", level.alias("fit_level"))


def answer_confidence(stats: DataFrame, evidence_counts: DataFrame, keys: list[str]) -> DataFrame:
    """Confidence band of an answer from its statistics and evidence count.

    ``stats`` has one row per key and aspect: total, negative, avg_confidence
    and total_aspect_records.
    """
    out = stats.groupBy(*keys).agg(
        F.max("total_aspect_records").alias("records"),
        F.sum("negative").alias("negative"),
        F.sum("total").alias("total"),
        (F.sum("avg_confidence") / F.count("avg_confidence")).alias("mean_confidence"),
    )
    out = out.join(evidence_counts, keys, "full_outer")
    ratio = F.when(F.col("total") > 0, F.col("negative") / F.nullif(F.col("total"), F.lit(0))).otherwise(0.0)
    conf = F.when(F.col("mean_confidence") > 0, F.col("mean_confidence")).otherwise(0.6)
    value = (
        F.least(F.lit(1.0), F.coalesce("records", F.lit(0)) / F.lit(12.0)) * 0.45
        + F.least(F.lit(1.0), F.coalesce("evidence", F.lit(0)) / F.lit(4.0)) * 0.3
        + conf * 0.25
        - F.when(ratio.between(0.25, 0.55) & (F.col("total") >= 4), 0.2).otherwise(0.0)
    )
    value = round_up(value, 6)
    return out.select(*keys, value.alias("confidence_score"), confidence_band(value).alias("confidence"))
