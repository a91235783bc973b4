"""Question analysis and the facts that answer a question."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara import constants as K
from opinara.functions import text as X
from opinara.functions.labels import aspect_label, percent_text, risk_for_aspect, risk_label
from opinara.operators.ranking import top_rows
from opinara.operators.scoring import answer_confidence


def _has_phrase(text: Column, phrase: str) -> Column:
    return text.rlike(f"(?<![a-z0-9]){phrase}(?![a-z0-9])")


def detect_intent(text: Column, word_bounds: bool = False) -> Column:
    """First intent with a trigger in the text; plain substrings by default."""
    out = None
    for intent, words in K.INTENT_RULES:
        hit = text.rlike(r"(?<![a-z0-9])(?:" + "|".join(words) + r")(?![a-z0-9])") if word_bounds else X.contains_any(text, words)
        out = F.when(hit, intent) if out is None else out.when(hit, intent)
    return out.when(text != "", "PRODUCT_QA").otherwise("UNKNOWN")


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def analyze_by_rule(questions: DataFrame, word_bounds: bool = False) -> DataFrame:
    """Intent, target aspects, constraints and confidence of each question."""
    out = questions.withColumn("folded", X.fold_accents(F.coalesce("question", F.lit(""))))
    text = F.col("folded")
    none = F.array().cast("array<string>")
    found = lambda column: F.array_distinct(F.flatten(F.array(*column)))
    aspects = found([
        F.when(_has_phrase(text, p), _strings([a for a in codes if a in K.ALLOWED_ASPECTS])).otherwise(none)
        for p, codes, _ in K.PHRASE_MAP
    ])
    constraints = found([F.when(_has_phrase(text, p), _strings(c)).otherwise(none) for p, _, c in K.PHRASE_MAP])
    out = out.withColumns({
        "i0": detect_intent(text, word_bounds), "a0": aspects, "constraints": constraints,
        "asks": X.contains_any(text, K.ASPECT_QUESTION_PHRASES),
    })
    named = F.size("a0") > 0
    out = out.withColumn("i1", F.when((F.col("i0") != "PRODUCT_FIT") & named & F.col("asks"), "ASPECT_QA").otherwise(F.col("i0")))
    merged = F.col("a0")
    for intent in ("PRICE_VALUE", "DELIVERY_SERVICE", "RISK_CHECK"):
        merged = F.when(F.col("i1") == intent, F.array_union("a0", _strings(K.DEFAULT_ASPECTS[intent]))).otherwise(merged)
    merged = F.when((F.col("i1") == "PRODUCT_FIT") & ~named, _strings(K.DEFAULT_ASPECTS["PRODUCT_FIT"])).otherwise(merged)
    intent = F.when(F.col("i1").isin("PRODUCT_QA", "COMPLAINT_SUMMARY") & named, "ASPECT_QA").otherwise(F.col("i1"))
    out = out.withColumns({"intent": intent, "target_aspects": merged})
    confidence = (
        F.lit(0.35) + F.when(F.col("intent") != "UNKNOWN", 0.25).otherwise(0.0)
        + F.when(F.size("target_aspects") > 0, 0.25).otherwise(0.0) + F.when(F.size("constraints") > 0, 0.1).otherwise(0.0)
    )
    confidence = F.round(F.least(confidence, F.lit(0.95)), 4)
    return out.select(
        *questions.columns, "intent", "target_aspects", "constraints", confidence.alias("confidence"), F.lit("rule").alias("source")
    )


def accept_analysis(rules: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """The rule result where it is sure enough, else an external one of 0.5 or more.

    ``external``: question_id and a struct ``analysis`` with the same fields.
    """
    if external is None:
        return rules
    sure = (F.col("confidence") >= 0.65) | (
        F.col("intent").isin("SUMMARY", "COMPLAINT_SUMMARY", "RECOMMENDATION") & (F.col("confidence") >= 0.55)
    )
    joined = rules.join(external.select("question_id", "analysis"), "question_id", "left")
    use = ~sure & F.coalesce(F.col("analysis.confidence") >= 0.5, F.lit(False))
    fields = ["intent", "target_aspects", "constraints", "confidence", "source"]
    keep = [c for c in rules.columns if c not in fields]
    return joined.select(*keep, *[F.when(use, F.col(f"analysis.{c}")).otherwise(F.col(c)).alias(c) for c in fields])


def scope_stats(questions: DataFrame, stats: DataFrame, records: DataFrame) -> DataFrame:
    """Statistics rows that bear on each question.

    ``stats`` holds the leading aspects of a product (aspect_stats, ranked),
    ``records`` its number of items. Four intents narrow them to the target
    aspects; a row then counts as positive or negative only if it has such
    opinions.
    """
    scoped = F.col("intent").isin(K.SCOPED_INTENTS) & (F.size("target_aspects") > 0)
    rows = questions.withColumn("scoped", scoped).join(stats, "product_id")
    inside = ~F.col("scoped") | F.array_contains("target_aspects", F.col("aspect"))
    rows = rows.withColumns({
        "in_positive": inside & (~F.col("scoped") | (F.col("positive") > 0)),
        "in_negative": inside & (~F.col("scoped") | (F.col("negative") > 0)),
    }).filter(F.col("in_positive") | F.col("in_negative"))
    sums = rows.groupBy("question_id").agg(F.sum("total").alias("scoped_total"))
    out = rows.join(sums, "question_id").join(records, "product_id", "left")
    total = F.when(F.col("scoped"), F.col("scoped_total")).otherwise(F.coalesce("records", F.lit(0)))
    return out.select(
        "question_id", "product_id", "intent", "aspect", "positive", "neutral", "negative", "total", "positive_ratio",
        "negative_ratio", "avg_confidence", "in_positive", "in_negative", total.alias("total_aspect_records"),
    )


def scope_rankings(questions: DataFrame, rankings: dict[str, DataFrame]) -> DataFrame:
    """Rows of each ranking of a product's aspects that bear on each question.

    Four intents keep only the target aspects. Ranks stay those of the product;
    columns a ranking lacks are NULL.
    """
    shape = {"sentiment": "string", "positive": "bigint", "negative": "bigint", "total": "bigint", "avg_confidence": "double", "positive_ratio": "double", "negative_ratio": "double"}
    parts = [
        df.select("product_id", F.lit(name).alias("ranking"), "rank", "aspect", *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in shape.items()])
        for name, df in rankings.items()
    ]
    rows = reduce(DataFrame.unionByName, parts)
    scoped = F.col("intent").isin(K.SCOPED_INTENTS) & (F.size("target_aspects") > 0)
    asked = questions.select("question_id", "product_id", "intent", "target_aspects")
    return asked.join(rows, "product_id").filter(~scoped | F.array_contains("target_aspects", F.col("aspect"))).drop("target_aspects")


def compact_rankings(rows: DataFrame, limit: int = 5) -> DataFrame:
    """Display rows: the first of each ranking of a question, with names, counts and whole percents."""
    by_sentiment = lambda s: F.coalesce(F.col(s), F.when(F.col("sentiment") == s, F.col("total")), F.lit(0)).alias(s)
    top = top_rows(rows.drop("product_id", "intent"), ["question_id", "ranking"], ["rank"], limit, rank="place")
    return top.select(
        "question_id", "ranking", "place", aspect_label(F.col("aspect")).alias("aspect"), F.coalesce("sentiment", F.lit("")).alias("sentiment"),
        by_sentiment("negative"), by_sentiment("positive"), "total", F.coalesce("avg_confidence", F.lit(0.0)).alias("avg_confidence"),
        percent_text(F.col("negative_ratio")).alias("negative_percent"), percent_text(F.col("positive_ratio")).alias("positive_percent"),
    )


def compact_questions(questions: DataFrame, products: DataFrame) -> DataFrame:
    """What an answer shows of its question and product; an unknown product leaves NULLs."""
    facts = products.select("product_id", "name", "price", "rating_average", "review_count", "brand", "seller")
    return questions.join(facts, "product_id", "left").select(
        "question_id", "name", "price", "rating_average", "review_count", "brand", "seller",
        F.transform("target_aspects", aspect_label).alias("target_aspects"), "constraints", "confidence", "source",
    )


def scope_risks(questions: DataFrame, risks: DataFrame) -> DataFrame:
    """Risks that bear on each question; each product has seven at most."""
    rows = questions.join(risks.drop("source", "confidence"), "product_id")
    wanted = F.transform("target_aspects", risk_for_aspect)
    keep = (
        F.when(F.col("intent") == "PRODUCT_FIT", F.col("risk_type").isin(K.FIT_RISKS))
        .when(F.col("intent") == "ASPECT_QA", F.coalesce(F.array_contains(F.array_compact(wanted), F.col("risk_type")), F.lit(False)))
        .otherwise(True)
    )
    return rows.filter(keep).select("question_id", "product_id", "intent", "risk_type", "severity", "rank")


def citations(evidence: Column, limit: int | None = None) -> Column:
    kept = evidence if limit is None else F.slice(evidence, 1, limit)
    cited = F.filter(kept, lambda e: F.coalesce(e["text"], F.lit("")) != "")
    return F.transform(
        cited, lambda e: F.struct(e["aspect"].alias("aspect"), X.summarize_opinion(e["text"]).alias("evidence"))
    )


def _leading(rows: DataFrame, flag: str, by: list[str], name: str, k: int = 2) -> DataFrame:
    """First k aspects of each question; a question has few statistics rows."""
    order = F.struct(*[(-F.col(c)).alias(f"k{i}") for i, c in enumerate(by)], "aspect")
    lists = rows.filter(flag).groupBy("question_id").agg(F.sort_array(F.collect_list(order)).alias("r"))
    return lists.select("question_id", F.transform(F.slice("r", 1, k), lambda r: r["aspect"]).alias(name))


def answer_facts(analyzed: DataFrame, with_evidence: DataFrame, stats: DataFrame, risks: DataFrame) -> DataFrame:
    """The facts of an answer: leading aspects, risks, evidence, citations, confidence.

    For fit questions, aspects and risks that do not bear on fit are listed as
    operational notes.
    """
    base = with_evidence.select("question_id", "product_id", "intent", "evidence")
    positive = _leading(stats, "in_positive", ["positive", "positive_ratio", "total"], "top_positive")
    negative = _leading(stats, "in_negative", ["negative", "negative_ratio", "total"], "top_negative")
    ranked = risks.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("rank", "risk_type"))).alias("r"))
    ranked = ranked.select("question_id", F.transform("r", lambda r: r["risk_type"]).alias("risks"))
    counts = base.select("question_id", F.size("evidence").alias("evidence"))
    sure = answer_confidence(stats, counts, ["question_id"])
    out = base
    for side in (positive, negative, ranked, sure):
        out = out.join(side, "question_id", "left")
    none = F.array().cast("array<string>")
    fit_codes, fit_risks = _strings(K.FIT_ASPECTS), _strings(K.FIT_RISKS)
    tops = F.coalesce("top_negative", none)
    all_risks = F.coalesce("risks", none)
    notes = F.array_distinct(F.concat(
        F.transform(F.filter(all_risks, lambda r: ~F.array_contains(fit_risks, r)), risk_label),
        F.transform(F.filter(tops, lambda a: ~F.array_contains(fit_codes, a)), aspect_label),
    ))
    is_fit = F.col("intent") == "PRODUCT_FIT"
    texts = lambda s: F.slice(F.transform(F.filter("evidence", lambda e: e["sentiment"] == s), lambda e: e["text"]), 1, 2)
    return out.select(
        "question_id", "product_id", "intent",
        F.transform(F.coalesce("top_positive", none), aspect_label).alias("top_positive"),
        F.transform(F.when(is_fit, F.filter(tops, lambda a: F.array_contains(fit_codes, a))).otherwise(tops), aspect_label).alias("top_negative"),
        F.transform(F.slice(all_risks, 1, 2), risk_label).alias("top_risks"),
        F.when(is_fit, notes).otherwise(none).alias("operational_notes"),
        texts("positive").alias("positive_evidence"), texts("negative").alias("negative_evidence"),
        citations(F.col("evidence")).alias("citations"), "confidence_score", "confidence",
    )
