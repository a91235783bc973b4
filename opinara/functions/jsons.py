"""Parsing of model output held in text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opinara import constants as K
from opinara.functions import text as X
from opinara.functions.labels import aspect_label
from opinara.functions.casts import lookup

QUADS = "array<struct<aspect_term:string,aspect_category:string,opinion_term:string,sentiment:string>>"


def repair_json(c: Column | str) -> Column:
    """Drop a code fence and close open braces."""
    t = X.strip_ws(c)
    opened = F.regexp_replace(t, r"^```[a-z]*\n?", "")
    fenced = F.regexp_replace(X.strip_ws(opened), r"\n?```$", "")
    t = F.when(F.startswith(t, F.lit("```")), fenced).otherwise(t)
    count = lambda ch: F.length(t) - F.length(F.replace(t, F.lit(ch), F.lit("")))
    missing = count("{") - count("}")
    return F.when(missing > 0, F.concat(t, F.repeat(F.lit("}"), missing))).otherwise(t)


def strip_thinking(c: Column | str) -> Column:
    """Remove think blocks: closed ones, then everything after an open one."""
    t = F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"(?is)<think>.*?</think>", "")
    t = F.regexp_replace(t, r"(?is)<think>.*$", "")
    return X.strip_ws(F.regexp_replace(t, r"(?i)</?think>", ""))


def first_json_object(c: Column | str) -> Column:
    """A fenced object, else the text from the first '{' to the last '}'."""
    t = X.strip_ws(c)
    fenced = F.nullif(F.regexp_extract(t, r"(?is)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    spanned = F.nullif(F.regexp_extract(t, r"(?s)(\{.*\})", 1), F.lit(""))
    return F.coalesce(fenced, spanned, t)


def _text_of(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _strings(v: Column, path: str) -> Column:
    items = F.try_variant_get(v, path, "array<variant>")
    return F.array_compact(F.transform(F.coalesce(items, F.array().cast("array<variant>")), lambda x: _text_of(x, "$")))


def question_analysis(c: Column | str) -> Column:
    """Whitelisted intent, aspects, constraints and confidence of a model's answer.

    NULL when the text holds no JSON object.
    """
    v = F.try_parse_json(first_json_object(strip_thinking(c)))
    intent = F.upper(F.trim(F.coalesce(_text_of(v, "$.intent"), F.lit("UNKNOWN"))))
    intent = F.when(intent.isin(K.ALLOWED_INTENTS), intent).otherwise("UNKNOWN")
    allowed = F.array(*[F.lit(a) for a in K.ALLOWED_ASPECTS])
    aspects = F.array_distinct(F.filter(_strings(v, "$.target_aspects"), lambda a: F.array_contains(allowed, a)))
    pairs = F.map_entries(F.try_variant_get(v, "$.constraints", "map<string,string>"))
    named = F.transform(
        F.filter(pairs, lambda e: F.coalesce(e["value"], F.lit("")) != ""),
        lambda e: F.concat_ws(":", e["key"], e["value"]),
    )
    listed = F.filter(_strings(v, "$.constraints"), lambda s: s != "")
    constraints = F.array_distinct(F.coalesce(named, listed))
    confidence = F.coalesce(_text_of(v, "$.confidence").try_cast("double"), F.lit(0.0))
    result = F.struct(
        intent.alias("intent"), aspects.alias("target_aspects"), constraints.alias("constraints"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)).alias("confidence"), F.lit("llm").alias("source"),
    )
    return F.when(v.isNotNull(), result)


def _word_count(t: Column) -> Column:
    return F.size(X.words(t))


def sanitize_answer(answer: Column, evidence: Column) -> Column:
    """Length caps, defaults and citations of a structured answer.

    ``answer``: struct<summary, pros[], cons[], recommendation, confidence,
    confidence_reasons[], citations[{aspect, evidence}]>; ``evidence``:
    array<struct<aspect, evidence>> used when there are no citations.
    """
    def texts(field: Column, limit: int) -> Column:
        kept = F.filter(F.coalesce(field, F.array().cast("array<string>")), lambda s: F.coalesce(s, F.lit("")) != "")
        return F.transform(kept, lambda s: F.substring(X.public_text(s), 1, limit))

    confidence = F.lower(F.coalesce(F.nullif(answer["confidence"], F.lit("")), F.lit("medium")))
    given = F.when(F.size(F.coalesce(answer["citations"], F.array().cast("array<struct<aspect:string,evidence:string>>"))) > 0,
                   answer["citations"]).otherwise(evidence)
    known = lambda a: lookup(a, K.ASPECT_LABELS).isNotNull()
    cites = F.transform(
        given,
        lambda c: F.struct(
            F.substring(
                F.when(known(F.coalesce(c["aspect"], F.lit("Bang chung"))), aspect_label(c["aspect"]))
                .otherwise(X.public_text(F.coalesce(c["aspect"], F.lit("Bang chung")))), 1, 80
            ).alias("aspect"),
            F.substring(X.summarize_opinion(F.coalesce(c["evidence"], F.lit(""))), 1, 180).alias("evidence"),
        ),
    )
    cites = F.filter(cites, lambda c: c["evidence"] != "")
    advice = F.substring(X.public_text(answer["recommendation"]), 1, 300)
    plain = F.btrim(F.lower(advice), F.lit(" ."))
    first = F.get(cites, 0)
    before, after = K.CITATION_RECOMMENDATION
    cited = F.when(F.size(cites) == 0, K.NO_DATA_RECOMMENDATION).otherwise(
        F.concat(F.lit(before), F.lower(first["aspect"]), F.lit(after), first["evidence"])
    )
    advice = F.when((plain == "") | plain.isin(K.GENERIC_RECOMMENDATIONS), cited).otherwise(advice)
    summary = F.substring(X.public_text(answer["summary"]), 1, 600)
    summary = F.when(_word_count(summary) < 5, K.NO_DATA_SUMMARY).otherwise(summary)
    reasons = texts(answer["confidence_reasons"], 180)
    return F.struct(
        summary.alias("summary"),
        texts(answer["pros"], 220).alias("pros"),
        texts(answer["cons"], 220).alias("cons"),
        advice.alias("recommendation"),
        F.when(confidence.isin("low", "medium", "high"), confidence).otherwise("medium").alias("confidence"),
        F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit(K.NO_DATA_REASON))).alias("confidence_reasons"),
        cites.alias("citations"),
    )
