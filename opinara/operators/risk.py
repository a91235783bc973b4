"""Risk flags from negative opinions of risk aspects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opinara import constants as K
from opinara.functions import text as X
from opinara.functions.casts import lookup, zero_as_missing
from opinara.functions.numbers import dec, round_up


def detect_risks(items: DataFrame, fold_accents: bool = False) -> DataFrame:
    """Severity, confidence and best evidence of each risk of each product.

    The trigger words carry no accents while sentences may; ``fold_accents``
    compares without accents instead.
    """
    kind = lookup(F.col("aspect"), {a: name for a, (name, _) in K.RISK_ASPECTS.items()})
    base = lookup(F.col("aspect"), {a: weight for a, (_, weight) in K.RISK_ASPECTS.items()})
    found = items.filter((F.col("sentiment") == "negative") & F.col("aspect").isin(list(K.RISK_ASPECTS)))
    found = found.withColumn("risk_type", kind)
    found = found.withColumn("__low", X.fold_accents("sentence") if fold_accents else F.lower("sentence"))
    low = F.col("__low")
    boost = F.lit(0)
    for name, words in K.RISK_KEYWORDS.items():
        boost = F.when(F.col("risk_type") == name, X.contains_any(low, words).cast("int")).otherwise(boost)
    confidence = zero_as_missing(F.col("confidence"), dec("0.5"))
    out = found.groupBy("product_id", "risk_type").agg(
        F.sum(confidence * (base + boost)).cast("double").alias("total"),
        F.count("*").alias("n"),
        F.max_by(
            F.struct(F.col("sentence").alias("evidence"), "review_id"),
            F.struct(F.coalesce("confidence", dec("0")), -F.col("item_id")),
        ).alias("best"),
    )
    severity = (
        F.when((F.col("total") >= 5) | (F.col("n") >= 4), "high")
        .when((F.col("total") >= 2.5) | (F.col("n") >= 2), "medium")
        .otherwise("low")
    )
    out = out.select(
        "product_id", "risk_type", severity.alias("severity"),
        round_up(F.least(F.lit(1.0), F.col("total") / 8)).alias("confidence"),
        F.col("best.evidence").alias("evidence"), F.col("best.review_id").alias("review_id"),
        F.lit(K.RISK_SOURCE).alias("source"),
    )
    # at most seven rows per product
    order = [F.desc(lookup(F.col("severity"), K.SEVERITY_RANK)), F.desc("confidence"), "risk_type"]
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("product_id").orderBy(*order)))
