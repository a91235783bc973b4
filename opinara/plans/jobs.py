"""End-to-end jobs built from the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara import constants as K
from opinara.functions import lexicon as LX
from opinara.operators import aspects as A
from opinara.operators import dataset as DS
from opinara.operators import evidence as EV
from opinara.operators import items as I
from opinara.operators import metrics as M
from opinara.operators import questions as Q
from opinara.operators import recommend as R
from opinara.operators import retrieval as RT
from opinara.operators import reviews as RV
from opinara.operators import scoring as S
from opinara.operators.risk import detect_risks
from opinara.session import materialise
from opinara.sources import writers as W


def opinion_items(reviews: DataFrame, score: Callable[[DataFrame], DataFrame] | None = None, order: list | None = None, review_cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Preprocessed reviews and their weighted opinion items.

    ``score`` adds aspect, sentiment and confidence to sentences; the rule
    scorer is used by default.
    """
    pre = RV.preprocess_reviews(reviews)
    if review_cap is not None:
        pre = I.cap_reviews(pre, order or ["review_id"], review_cap)
    columns = ["product_id", "review_id", "rating", "helpful_count"]
    sentences = I.explode_sentences(pre.select(*columns, "clean_text"), "clean_text")
    items = I.weigh_items((score or I.rule_items)(sentences))
    item_id = F.abs(F.xxhash64("product_id", "review_id", "sentence_no", "aspect"))
    return pre, items.withColumn("item_id", item_id)


def _list(df: DataFrame, order: list[str | Column], fields: list[str], name: str) -> DataFrame:
    """A short ranked list per product."""
    head = [F.col(c) if isinstance(c, str) else c for c in order]
    row = F.struct(*[c.alias(f"__o{i}") for i, c in enumerate(head)], F.struct(*fields).alias("v"))
    lists = df.groupBy("product_id").agg(F.sort_array(F.collect_list(row)).alias("r"))
    return lists.select("product_id", F.transform("r", lambda x: x["v"]).alias(name))


def analyze_products(reviews: DataFrame, products: DataFrame, categories: DataFrame, listing: DataFrame,
                     score: Callable[[DataFrame], DataFrame] | None = None, order: list | None = None) -> DataFrame:
    """One row per product with every analysis output.

    Only ranked, limited lists are nested. The items are written once, as
    every output reads them.
    """
    pre, items = opinion_items(reviews, score, order)
    pre, items = materialise(pre, "reviews"), materialise(items, "items")
    scores = I.review_scores(items)
    table = A.aspect_table(items)
    quotes = EV.pick_quotes(items)
    best = quotes.filter(F.col("sentiment") == "positive").select("product_id", "aspect", F.col("quote").alias("best_positive_quote"))
    worst = quotes.filter(F.col("sentiment") == "negative").select("product_id", "aspect", F.col("quote").alias("best_negative_quote"))
    shown = A.ranked_aspect_table(table).join(best, ["product_id", "aspect"], "left").join(worst, ["product_id", "aspect"], "left")
    recommended = R.similar_products(products, categories, listing)
    row = ["aspect", "display_name", "positive", "negative", "mentions", "avg_score_0_1"]
    parts = [
        I.product_score(items).drop("reviews_used"),
        pre.groupBy("product_id").agg(F.count("*").alias("total_reviews_used")),
        I.sentiment_distribution(scores).select("product_id", "positive_ratio", "neutral_ratio", "negative_ratio"),
        _list(shown, ["rank"], [*row, "neutral", "best_positive_quote", "best_negative_quote"], "aspect_table"),
        _list(A.radar(table), ["aspect"], ["aspect", "score"], "radar"),
        _list(A.strengths(table), ["rank"], row, "strengths"),
        _list(A.weaknesses(table), ["rank"], row, "weaknesses"),
        _list(A.opinion_table(items), ["rank"], ["aspect", "sentiment", "display_name", "count", "confidence", "example"], "opinions"),
        _list(detect_risks(items), ["rank"], ["risk_type", "severity", "confidence", "evidence", "review_id", "source"], "risk_flags"),
        _list(R.representative_reviews(pre, scores), ["role"], ["role", "text", "label", "rating"], "representative_reviews"),
        _list(recommended, ["rank"], ["candidate_id", "name", "price", "rating_average", "rating_score"], "recommendations"),
        _list(R.compare_with_top(recommended, items), ["aspect"], ["aspect", "score"], "top1_aspect_scores"),
    ]
    analysed = items.select("product_id").distinct()
    out = analysed.join(products.select("product_id", "name", "price", "brand", "rating_average", "review_count"), "product_id", "left")
    for part in parts:
        out = out.join(part, "product_id", "left")
    return out


def purchase_advice(items: DataFrame, review_counts: DataFrame | None = None) -> DataFrame:
    """Score, label, first risks and evidence for and against, per product."""
    scores = S.purchase_score(items, review_counts)
    fields = ["review_id", "aspect", "sentiment", "confidence", "text"]
    plus = _list(EV.select_evidence(items, "positive", 3), ["rank"], fields, "reasons")
    minus = _list(EV.select_evidence(items, "negative", 3), ["rank"], fields, "objections")
    risks = _list(_first_risks(detect_risks(items)), ["rank"], ["risk_type", "severity", "confidence", "evidence"], "risks")
    out = scores
    for part in (plus, minus, risks):
        out = out.join(part, "product_id", "left")
    none = F.slice(F.coalesce("reasons", "objections"), 1, 0)
    evidence = F.slice(F.concat(F.coalesce("objections", none), F.coalesce("reasons", none)), 1, 5)
    return out.withColumn("evidence", evidence)


def _first_risks(risks: DataFrame, k: int = 3) -> DataFrame:
    return risks.filter(F.col("rank") <= k)


def answer_questions(questions: DataFrame, items: DataFrame, embedder=None, external: DataFrame | None = None) -> DataFrame:
    """Facts for each question: intent, statistics, risks and ranked evidence.

    With an embedder, the nearest opinion chunks join the structured evidence.
    """
    items = materialise(items.join(questions.select("product_id").distinct(), "product_id", "left_semi"), "asked-items")
    asked = materialise(Q.accept_analysis(Q.analyze_by_rule(questions), external), "questions")
    risks = detect_risks(items)
    stats = A.aspect_distribution(A.aspect_stats(items), None)
    records = items.groupBy("product_id").agg(F.count("*").alias("records"))
    evidence = EV.evidence_for_questions(asked.select("question_id", "product_id", "intent", "target_aspects"), items, risks)
    if embedder is not None:
        structured = EV.explode_evidence(evidence.select("question_id", "evidence"), "evidence")
        chunks = RT.embed_texts(RT.opinion_chunks(items), "text", embedder).withColumnRenamed("point_id", "chunk_id")
        wanted = RT.embed_texts(asked, "question", embedder, "q_vector").select(
            F.col("question_id").alias("query_id"), "product_id", "q_vector",
            RT.sentiments_for_intent(F.col("intent")).alias("sentiments"), F.col("target_aspects").alias("aspects"),
        )
        near = RT.vector_search(wanted, chunks, 8).select(
            F.col("query_id").alias("question_id"), "rank", "review_id", F.col("aspect").alias("aspect_code"),
            F.col("aspect_label").alias("aspect"), "sentiment", "confidence", "text", "semantic_score",
        )
        ranked = RT.hybrid_rank(asked, structured, near)
        fields = ["review_id", "aspect_code", "aspect", "sentiment", "confidence", "text"]
        row = F.struct("rank", F.struct(*fields).alias("e"))
        best = ranked.groupBy("question_id").agg(F.sort_array(F.collect_list(row)).alias("r"), F.first("strategy").alias("strategy"))
        best = best.select("question_id", F.transform("r", lambda x: x["e"]).alias("best"))
        evidence = evidence.join(best, "question_id", "left").withColumn("evidence", F.coalesce("best", "evidence")).drop("best")
    return Q.answer_facts(asked, evidence, Q.scope_stats(asked, stats, records), Q.scope_risks(asked, risks))


def build_dataset(annotated: DataFrame, folder: str | None = None, seed: int = 42, draw: Column | None = None) -> dict[str, DataFrame]:
    """Samples, splits, oversampled train set, vocabulary, exports and report.

    The split comes before oversampling, and only train rows are copied.
    """
    # written first, as the split reads its samples several times
    samples = materialise(DS.training_samples(annotated), "samples")
    split = materialise(DS.stratified_split(samples, seed, draw), "split")
    columns = ["review_id", "text", "labels", "quadruples", "is_augmented", "split"]
    train = DS.oversample(split.filter(F.col("split") == "train"), seed).select(*columns)
    sets = {"train": materialise(train, "train"), "val": split.filter(F.col("split") == "val"), "test": split.filter(F.col("split") == "test")}
    vocab = DS.vocabulary(sets["train"])
    everything = sets["train"].unionByName(sets["val"].select(*columns)).unionByName(sets["test"].select(*columns))
    if folder:
        for name, rows in sets.items():
            W.write_blocks(DS.bio_blocks(rows), f"{folder}/bio_{name}")
            W.write_quoted_csv(DS.label_columns(rows), f"{folder}/labels_{name}")
            W.write_quoted_csv(DS.target_rows(rows), f"{folder}/target_{name}")
        W.save_table(vocab, f"{folder}/vocabulary")
    return {**sets, "vocabulary": vocab, "report": DS.split_report(everything)}


def label_quality(human: DataFrame, model: DataFrame, pos: list[str], reviewed: M.Reviewed = None) -> DataFrame:
    """All agreement figures of two label sets as long rows."""
    sides = materialise(M.distinct_sides(M.both_sides(human, model, pos, reviewed)), "sides")
    counts = materialise(M.category_counts(sides), "category-counts")
    pairs = materialise(M.sentiment_pairs(sides), "sentiment-pairs")
    none = F.lit(None).cast("string")

    def rows(df: DataFrame, metric: str, name: Column, values: list[str]) -> DataFrame:
        picks = F.array(*[F.struct(F.lit(v).alias("figure"), F.col(v).cast("double").alias("value")) for v in values])
        return df.select(F.lit(metric).alias("metric"), name.alias("name"), F.explode(picks).alias("p")).select("metric", "name", "p.figure", "p.value")

    prf = ["precision", "recall", "f1"]
    partial = M.quad_f1(M.quad_matches(sides))
    full = M.quad_f1(M.quad_matches(sides, "full"), "full")
    out = rows(partial.unionByName(full), "quadruples", F.col("match_type"), [*prf, "exact_match", "n_reviews"])
    out = out.unionByName(rows(M.category_f1(counts), "category", F.col("category"), [*prf, "tp", "fp", "fn", "tn"]))
    out = out.unionByName(rows(M.sentiment_agreement(pairs), "sentiment", F.col("sentiment"), [*prf, "accuracy", "n_pairs"]))
    kappa = M.cohen_kappa(counts, pairs)
    return out.unionByName(rows(kappa, "kappa", F.concat_ws(":", "scope", F.coalesce("name", none)), ["kappa"]))


def preprocess(reviews: DataFrame, products: DataFrame, categories: DataFrame, lexicon: list[tuple[str, str]], order: list,
               folder: str | None = None) -> dict[str, DataFrame]:
    """Clean, merge and normalise reviews; when a folder is given, the tables are saved and returned as read from there."""

    def saved(df: DataFrame, name: str) -> DataFrame:
        if not folder:
            return df
        W.save_table(df, f"{folder}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")

    cleaned = RV.clean_reviews(reviews, order)
    cleaned = saved(cleaned, "cleaned") if folder else materialise(cleaned, "cleaned")
    return {
        "cleaned": cleaned,
        "merged": saved(RV.merge_reviews(cleaned, products, categories), "merged"),
        "normalized": saved(LX.normalize_reviews(cleaned, lexicon), "normalized"),
    }
