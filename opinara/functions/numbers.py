"""Small numeric expressions shared by the operators."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dec(text: str) -> Column:
    """Exact decimal literal, so that sums do not depend on row order."""
    return F.lit(Decimal(text))


def round_up(c: Column, digits: int = 4) -> Column:
    """Round with ties up, whatever the last binary digit of the value is."""
    return F.round(c.cast("double") + F.lit(1e-9), digits)


def mean(c: Column | str) -> Column:
    """Mean from the exact sum; a plain decimal ``avg`` would be cut to 4 more digits."""
    return F.sum(col(c)).cast("double") / F.count(col(c))


def share(part: Column, whole: Column, digits: int = 4) -> Column:
    """part/whole, 0 when whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(
        round_up(part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)), digits)
    )


def safe_div(part: Column, whole: Column) -> Column:
    """part/whole as double, 0 when whole is 0."""
    part, whole = part.cast("double"), whole.cast("double")
    return F.when(whole > 0, part / F.nullif(whole, F.lit(0.0))).otherwise(F.lit(0.0))


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def f1_of(precision: Column, recall: Column) -> Column:
    total = precision + recall
    return F.when(total > 0, 2 * precision * recall / F.nullif(total, F.lit(0.0))).otherwise(F.lit(0.0))


def prf(tp: Column, fp: Column, fn: Column, digits: int = 4) -> dict[str, Column]:
    """Rounded precision, recall and F1 from counts."""
    p, r = safe_div(tp, tp + fp), safe_div(tp, tp + fn)
    return {
        "precision": round_up(p, digits),
        "recall": round_up(r, digits),
        "f1": round_up(f1_of(p, r), digits),
    }
