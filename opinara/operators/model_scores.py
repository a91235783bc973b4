"""Predictions from class scores of an external model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara import constants as K
from opinara.functions import arrays as R
from opinara.functions.numbers import round_up


def gate_predictions(rows: DataFrame, logits: str, threshold: float = K.CONFIDENCE_THRESHOLD) -> DataFrame:
    """One row per category whose best class is not 'none' and confident enough.

    ``logits`` holds one array of four class scores per category.
    """
    keep = [c for c in rows.columns if c != logits]
    out = rows.select(*keep, F.posexplode(logits).alias("idx", "z")).withColumn("p", R.softmax(F.col("z")))
    out = out.withColumns({"best": R.argmax(F.col("p")), "conf": F.array_max("p")})
    names = F.array(*[F.lit(c) for c in K.CATEGORIES])
    kinds = F.array(*[F.lit(s) for s in K.LABEL_NAMES])
    return out.filter((F.col("best") != 0) & (F.col("conf") >= threshold)).select(
        *keep, "idx", F.element_at(names, F.col("idx") + 1).alias("aspect"),
        F.element_at(kinds, F.col("best") + 1).alias("sentiment"), round_up(F.col("conf"), 6).alias("confidence"),
    )
