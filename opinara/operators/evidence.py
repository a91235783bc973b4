"""Evidence selection: best, diverse, deduplicated, quotes.

The greedy selection looks at an item only if no earlier pick shares its
aspect, text or review. A product may hold any number of items, so each
product is first cut to a candidate set that provably contains every pick.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara import constants as K
from opinara.functions import text as X
from opinara.functions.labels import aspect_label, risk_label
from opinara.operators.ranking import compute_once, top_rows

EVIDENCE_LIMIT = 6
#: Parts that the rows of a product are dealt to before they meet.
SPREAD = 64
SENTIMENT_ORDER = ["negative", "positive", "neutral"]
PICK = "struct<review_id:string,aspect_code:string,aspect:string,sentiment:string,confidence:double,text:string>"


def select_evidence(items: DataFrame, sentiment: str | None = None, limit: int = 4) -> DataFrame:
    """Most confident non-empty sentences of each product."""
    pool = items.filter(F.length(F.trim("sentence")) > 0)
    if sentiment:
        pool = pool.filter(F.col("sentiment") == sentiment)
    top = top_rows(pool, ["product_id"], [F.desc("confidence"), "item_id", "sentence"], limit, rank="rank")
    return top.select(
        "product_id", "review_id", "aspect", "sentiment", F.col("confidence").cast("double").alias("confidence"),
        F.trim("sentence").alias("text"), "rank",
    )


def is_quality(aspect: Column, sentiment: Column, summary: Column) -> Column:
    """Known aspect, valid sentiment, and a summary that says something."""
    def says_something(plain: Column) -> Column:
        return (F.size(X.words(plain)) >= 5) & ~plain.isin(K.WEAK_PHRASES)

    return (
        (F.coalesce(aspect, F.lit("")) != "")
        & (aspect_label(aspect) != K.UNKNOWN_ASPECT_LABEL)
        & sentiment.isin(K.SENTIMENTS)
        & (F.length(summary) >= 28)
        & X.let(F.btrim(F.lower(summary), F.lit(" .,!?:;")), says_something)
    )


def evidence_candidates(items: DataFrame, limit: int = EVIDENCE_LIMIT, sentiments: list[str] | None = None, fill: str | None = "aspect") -> DataFrame:
    """A bounded set of items per product that holds every greedy pick.

    Take a sentiment and aspect of a product. When its pick is made, at most
    ``limit - 1`` texts and as many reviews are blocked. So it is enough to
    keep, in order: the best row of each text and review; the first ``limit``
    rows of each text; the first ``limit`` rows of each review; and of what is
    left the first ``2 * limit * (limit - 1) + 1``, as a blocked text or review
    accounts for at most ``limit`` rows before the pick.

    That holds for the pick among any part of the rows too. So rows are cut in
    ``SPREAD`` parts of a product first, and what is left, a bounded number of
    rows however hot the product is, is cut again where the product's rows are.

    ``sentiments`` are those to be picked from, all by default. The filling
    pass reads the first ``limit`` items of the pool whatever they are: those of
    each aspect are kept for it, where it may be asked for some aspects only,
    those of the product (``fill="product"``), or none.
    """
    order = [F.desc("confidence"), "item_id", "text"]
    pool = items.withColumn("text", F.trim("sentence")).filter(F.length("text") > 0)
    pool = pool.select("product_id", "sentiment", "aspect", "review_id", "confidence", "item_id", "text")
    wanted = pool if sentiments is None else pool.filter(F.col("sentiment").isin(sentiments))
    part = F.pmod(F.xxhash64("item_id", "review_id", "text"), F.lit(SPREAD)).cast("int")
    picks = _judge(wanted).filter("quality").withColumns({"phase": F.lit(0), "__part": part})
    out = _cut(picks.repartition("product_id", "__part"), ["product_id", "__part"], order, limit).drop("__part")
    if fill:
        head = top_rows(pool, ["product_id", "aspect"] if fill == "aspect" else ["product_id"], order, limit)
        out = out.unionByName(_judge(head).withColumn("phase", F.lit(1)))
    return _cut(out.repartition("product_id"), ["product_id"], order, limit)


def _cut(rows: DataFrame, where: list[str], order: list, limit: int) -> DataFrame:
    """Rows of the picking pass cut as ``evidence_candidates`` says, in each of the places that rows lie by; the others stay."""
    # rows without a review id block no review, so each counts as its own
    rows = rows.withColumn("who", F.when(F.coalesce("review_id", F.lit("")) == "", F.col("key")).otherwise(F.col("review_id")))
    group = [*where, "phase", "sentiment", "aspect"]
    for keys, k in ((["key", "who"], 1), (["key"], limit), (["who"], limit), ([], 2 * limit * (limit - 1) + 1)):
        rows = top_rows(rows, [*group, *keys], order, None, rank="__n").filter((F.col("phase") == 1) | (F.col("__n") <= k)).drop("__n")
    return rows.drop("who")


def _judge(rows: DataFrame) -> DataFrame:
    """Add the text key and the quality flag."""
    judged = F.struct(
        X.evidence_key("text").alias("key"),
        X.let(X.summarize_opinion("text", 180), lambda s: is_quality(F.col("aspect"), F.col("sentiment"), s)).alias("quality"),
    )
    return compute_once(rows, "judged", judged).select("*", "judged.key", "judged.quality").drop("judged")


def _row(sentiment_rank: Column) -> Column:
    return F.struct(
        "phase", sentiment_rank.alias("s_rank"), (-F.col("confidence").cast("double")).alias("neg_conf"), "item_id", "text",
        "aspect", "sentiment", "review_id", "key", "quality",
    )


def candidate_lists(candidates: DataFrame) -> DataFrame:
    """Candidates of each product and the aspects it has, as bounded arrays."""
    rank = F.when(F.col("sentiment") == "negative", 0).when(F.col("sentiment") == "positive", 1).otherwise(2)
    return candidates.groupBy("product_id").agg(
        F.sort_array(F.collect_list(_row(rank))).alias("rows"), F.collect_set("aspect").alias("aspects_seen")
    )


def greedy(rows: Column, limit: int, fill: bool = True) -> Column:
    """Greedy picks from sorted candidate rows."""
    queue = F.filter(rows, lambda r: r["phase"] == 0)
    if fill:
        later = F.slice(
            F.array_sort(
                F.filter(rows, lambda r: r["phase"] == 1),
                lambda a, b: F.when(a["neg_conf"] < b["neg_conf"], -1).when(a["neg_conf"] > b["neg_conf"], 1)
                .when(a["item_id"] < b["item_id"], -1).when(a["item_id"] > b["item_id"], 1)
                .when(a["text"] < b["text"], -1).when(a["text"] > b["text"], 1).otherwise(0),
            ),
            1, limit,
        )
        queue = F.concat(queue, later)
    names = F.array().cast("array<string>")
    start = F.struct(
        F.slice(rows, 1, 0).alias("picked"), names.alias("aspects"), names.alias("texts"), names.alias("reviews")
    )

    def step(acc: Column, r: Column) -> Column:
        free = (
            (F.size(acc["picked"]) < limit)
            & r["quality"]
            & ((r["phase"] == 1) | ~F.array_contains(acc["aspects"], r["aspect"]))
            & ~F.array_contains(acc["texts"], r["key"])
            & ((F.coalesce(r["review_id"], F.lit("")) == "") | ~F.array_contains(acc["reviews"], r["review_id"]))
        )
        taken = F.struct(
            F.array_append(acc["picked"], r).alias("picked"),
            F.array_append(acc["aspects"], r["aspect"]).alias("aspects"),
            F.array_append(acc["texts"], r["key"]).alias("texts"),
            F.array_append(acc["reviews"], r["review_id"]).alias("reviews"),
        )
        return F.when(free, taken).otherwise(acc)

    return F.aggregate(queue, start, step, lambda acc: acc["picked"])


def as_evidence(picked: Column) -> Column:
    """Picked rows as evidence with a public label and a short text."""
    return F.transform(
        picked,
        lambda r: F.struct(
            r["review_id"].alias("review_id"), r["aspect"].alias("aspect_code"), aspect_label(r["aspect"]).alias("aspect"),
            r["sentiment"].alias("sentiment"), (-r["neg_conf"]).alias("confidence"),
            X.summarize_opinion(r["text"]).alias("text"),
        ),
    )


def _of(rows: Column, sentiments: list[str]) -> Column:
    """Candidates of the picking pass for some sentiments, and all for filling."""
    return F.filter(rows, lambda r: (r["phase"] == 1) | r["sentiment"].isin(sentiments))


def diverse_evidence(items: DataFrame, sentiments: list[str] | None = None, limit: int = 5, fill: bool = True) -> DataFrame:
    """Evidence rows of different aspects, texts and reviews, per product."""
    wanted = sentiments or SENTIMENT_ORDER
    lists = candidate_lists(evidence_candidates(items, limit, wanted, "product" if fill else None))
    picked = greedy(_of(F.col("rows"), wanted), limit, fill)
    return explode_evidence(lists.select("product_id", as_evidence(picked).alias("evidence")), "evidence")


def explode_evidence(df: DataFrame, column: str) -> DataFrame:
    keep = [c for c in df.columns if c != column]
    return df.select(*keep, F.posexplode(column).alias("pos", "e")).select(*keep, (F.col("pos") + 1).alias("rank"), "e.*")


def dedupe(evidence: Column, limit: int = EVIDENCE_LIMIT) -> Column:
    """Quality evidence with distinct reviews and texts, first come first kept."""
    rows = F.transform(
        evidence,
        lambda e: F.struct(
            e["review_id"].alias("review_id"), e["aspect"].alias("aspect_code"), aspect_label(e["aspect"]).alias("aspect"),
            e["sentiment"].alias("sentiment"), e["confidence"].alias("confidence"),
            X.summarize_opinion(F.trim(e["text"])).alias("text"), X.evidence_key(F.trim(e["text"])).alias("key"),
            is_quality(e["aspect"], e["sentiment"], X.summarize_opinion(F.trim(e["text"]), 180)).alias("quality"),
        ),
    )
    names = F.array().cast("array<string>")
    start = F.struct(F.slice(rows, 1, 0).alias("out"), names.alias("texts"), names.alias("reviews"))

    def step(acc: Column, r: Column) -> Column:
        free = (
            (F.size(acc["out"]) < limit) & r["quality"] & ~F.array_contains(acc["texts"], r["key"])
            & ((F.coalesce(r["review_id"], F.lit("")) == "") | ~F.array_contains(acc["reviews"], r["review_id"]))
        )
        taken = F.struct(
            F.array_append(acc["out"], r).alias("out"), F.array_append(acc["texts"], r["key"]).alias("texts"),
            F.array_append(acc["reviews"], r["review_id"]).alias("reviews"),
        )
        return F.when(free, taken).otherwise(acc)

    kept = F.aggregate(rows, start, step, lambda acc: acc["out"])
    return F.transform(kept, lambda r: F.struct(*[r[c].alias(c) for c in ("review_id", "aspect_code", "aspect", "sentiment", "confidence", "text")]))


def risk_evidence(risks: DataFrame, limit: int = 3) -> DataFrame:
    """The first risks of each product as evidence rows, in an array."""
    row = F.struct(
        "rank", F.coalesce("review_id", F.lit("")).alias("review_id"), risk_label(F.col("risk_type")).alias("aspect"),
        F.lit("negative").alias("sentiment"), "confidence", X.summarize_opinion("evidence").alias("text"),
    )
    # seven risk types at most, so the list is short
    top = risks.filter((F.col("rank") <= limit) & (F.coalesce("evidence", F.lit("")) != ""))
    rows = top.groupBy("product_id").agg(F.sort_array(F.collect_list(row)).alias("r"))
    out = F.transform("r", lambda r: F.struct(
        r["review_id"].alias("review_id"), r["aspect"].alias("aspect_code"), r["aspect"].alias("aspect"),
        r["sentiment"].alias("sentiment"), r["confidence"].alias("confidence"), r["text"].alias("text"),
    ))
    return rows.select("product_id", out.alias("risk_rows"))


def evidence_for_questions(requests: DataFrame, items: DataFrame, risks: DataFrame, limit: int = EVIDENCE_LIMIT) -> DataFrame:
    """Evidence per question, chosen by its intent and target aspects.

    ``requests``: question_id, product_id, intent, target_aspects. Questions
    with the same product, intent and targets share one selection, so a
    popular product costs no more than its different requests.
    """
    what = ["product_id", "intent", "target_aspects"]
    distinct = requests.select(*what).distinct()
    asked = requests.select("product_id").distinct()
    lists = candidate_lists(evidence_candidates(items.join(asked, "product_id", "left_semi"), limit))
    joined = distinct.join(lists, "product_id", "left").join(risk_evidence(risks), "product_id", "left")
    targets = F.col("target_aspects")
    any_target = F.size(targets) > 0
    chosen = F.filter("rows", lambda r: F.array_contains(targets, r["aspect"]))
    strict = F.when(any_target, chosen).otherwise(F.col("rows"))
    soft = F.when(any_target & F.arrays_overlap(targets, "aspects_seen"), chosen).otherwise(F.col("rows"))
    hard_intents = ["RISK_CHECK", *K.SCOPED_INTENTS]
    rows = F.when(F.col("intent").isin(hard_intents), strict).when(
        F.col("intent").isin("RECOMMENDATION", "PRODUCT_QA"), soft
    ).otherwise(F.col("rows"))
    empty_rows = F.slice("rows", 1, 0)
    pooled = joined.withColumn("rows", F.coalesce(rows, empty_rows))
    r = F.col("rows")
    risk_rows = F.coalesce("risk_rows", F.array().cast(f"array<{PICK}>"))
    negative_only = as_evidence(greedy(_of(r, ["negative"]), limit, fill=False))
    split = F.concat(
        as_evidence(greedy(_of(r, ["negative"]), 3)), as_evidence(greedy(_of(r, ["positive"]), 3))
    )
    evidence = (
        F.when(F.col("intent") == "COMPLAINT_SUMMARY", negative_only)
        .when(F.col("intent") == "RISK_CHECK", dedupe(F.concat(risk_rows, negative_only), limit))
        .when(F.col("intent") == "RECOMMENDATION", dedupe(split, limit))
        .otherwise(as_evidence(greedy(_of(r, SENTIMENT_ORDER), limit)))
    )
    answers = pooled.select(*what, evidence.alias("evidence"))
    return requests.join(answers, what).select(*requests.columns, "evidence")


def dedupe_evidence(rows: DataFrame, key: str, order: str, limit: int = EVIDENCE_LIMIT) -> DataFrame:
    """Deduplicated evidence of a table whose groups are short ranked lists."""
    row = F.struct(order, "review_id", "aspect", "sentiment", "confidence", "text")
    lists = rows.groupBy(key).agg(F.sort_array(F.collect_list(row)).alias("r"))
    return explode_evidence(lists.select(key, dedupe(F.col("r"), limit).alias("evidence")), "evidence")


def pick_quotes(items: DataFrame, labelled: DataFrame | None = None, max_len: int = 300) -> DataFrame:
    """One quote per product, aspect and sentiment.

    A labelled corpus (aspect_category, sentiment, text_preview) comes first:
    its longest text of at least 15 characters. Else the product's sentences
    with a required and no forbidden keyword, else with a required one. Where
    the original draws at random from the best, the best is taken.
    """
    keys = ["product_id", "aspect", "sentiment"]
    pool = items.withColumn("low", F.lower("sentence"))
    required = X.keyword_match(F.col("aspect"), F.col("low"), K.REQUIRED_KEYWORDS)
    strict = X.keyword_match(F.col("aspect"), F.col("low"), K.REQUIRED_KEYWORDS, K.FORBIDDEN_KEYWORDS)
    pool = pool.withColumn("tier", F.when(strict, 1).when(required, 2)).filter(F.col("tier").isNotNull())
    order = ["tier", F.desc("helpful_count"), F.desc("confidence"), F.desc(F.length("sentence")), "item_id", "sentence"]
    own = top_rows(pool, keys, order, 1).select(*keys, "tier", F.substring(X.squeeze("sentence"), 1, max_len).alias("quote"))
    if labelled is None:
        return own
    long = labelled.filter(F.length("text_preview") >= 15)
    best = top_rows(long, ["aspect_category", "sentiment"], [F.desc(F.length("text_preview")), "text_preview"], 1)
    best = best.select(F.col("aspect_category").alias("aspect"), "sentiment", F.substring("text_preview", 1, max_len).alias("corpus"))
    wanted = items.select(*keys).distinct().join(best, ["aspect", "sentiment"], "left").join(own, keys, "left")
    found = wanted.withColumns({
        "quote": F.coalesce("corpus", "quote"), "tier": F.when(F.col("corpus").isNotNull(), 0).otherwise(F.col("tier"))
    })
    return found.filter(F.col("quote").isNotNull()).select(*keys, "tier", "quote")
