"""Display names of aspects and risks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opinara import constants as K
from opinara.functions.casts import lookup


def table_label(aspect: Column) -> Column:
    bare = F.replace(F.replace(aspect, F.lit("PRODUCT#"), F.lit("")), F.lit("DELIVERY#"), F.lit(""))
    return F.coalesce(lookup(aspect, K.TABLE_LABELS), bare)


def aspect_label(aspect: Column) -> Column:
    """Public name; unknown codes share one label, other text stays itself."""
    named = F.coalesce(lookup(aspect, K.ASPECT_LABELS), lookup(aspect, K.LABEL_ALIASES))
    code = F.contains(aspect, F.lit("#")) | F.contains(aspect, F.lit("_"))
    unknown = F.lit(K.UNKNOWN_ASPECT_LABEL)
    return F.coalesce(named, F.when(code | aspect.isNull() | (aspect == ""), unknown).otherwise(aspect))


def chunk_label(aspect: Column) -> Column:
    return F.coalesce(lookup(aspect, K.ASPECT_LABELS), aspect)


def risk_label(risk: Column) -> Column:
    return F.coalesce(lookup(risk, K.RISK_LABELS), F.nullif(risk, F.lit("")), F.lit(K.UNKNOWN_RISK_LABEL))


def risk_for_aspect(aspect: Column) -> Column:
    return lookup(aspect, {code: name for code, (name, _) in K.RISK_ASPECTS.items()})


def percent_text(ratio: Column) -> Column:
    return F.when(ratio.isNull(), F.lit("")).otherwise(F.format_string("%.0f%%", ratio.cast("double") * 100))


def band(value: Column, bands: list[tuple[float, str]], lowest: str) -> Column:
    """Name of the first band whose floor the value reaches."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for floor, name in bands:
        out = out.when(value >= floor, F.lit(name))
    return out.otherwise(F.lit(lowest))


def interpret_kappa(kappa: Column) -> Column:
    return F.when(kappa.isNull(), F.lit("N/A")).otherwise(band(kappa, K.KAPPA_BANDS, K.KAPPA_LOWEST))


def interpret_f1(f1: Column) -> Column:
    return band(f1, K.F1_BANDS, K.F1_LOWEST)


def confidence_band(value: Column) -> Column:
    return band(value, [(0.67, "high"), (0.34, "medium")], "low")
