"""Registered queries: evidence, retrieval and shopper questions."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara import constants as K
from opinara.functions import arrays as R
from opinara.functions import text as X
from opinara.operators import aspects as A
from opinara.operators import evidence as EV
from opinara.operators import questions as Q
from opinara.operators import retrieval as RT
from opinara.operators import scoring as S
from opinara.operators.risk import detect_risks
from opinara.plans.analytics import ITEMS, ITEMS_T, RISKS, STATS, _keyword_sql, _percent
from opinara.plans.registry import query, sql_any, sql_case, sql_list, with_views
from opinara.plans.texts import WORD, fold_sql
from opinara.sources import fixtures as V


def _items(spark: SparkSession, d: str) -> DataFrame:
    return V.aspect_items(spark, d, with_sentence=True)


# sentences here are under 80 characters, so their summaries are the sentences
QUALITY = f"""pool AS (SELECT *, sentence AS text, trim(regexp_replace(lower(sentence), '[^{WORD}]+', ' ', 'g'), ' ') AS key,
    aspect IN ({sql_list(list(K.ASPECT_LABELS))}) AND length(sentence) >= 28
      AND len(list_filter(string_split(sentence, ' '), lambda w: length(w) > 0)) >= 5 AS quality,
    CASE sentiment WHEN 'negative' THEN 0 WHEN 'positive' THEN 1 ELSE 2 END AS s_rank FROM items)"""


def _greedy_sql(sentiments: list[str], limit: int, fill: bool) -> str:
    tail = f"""UNION ALL SELECT product_id, aspect, sentiment, review_id, confidence, text, key, quality, 1, 0, item_id FROM pool
      QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY confidence DESC, item_id, text) <= {limit}""" if fill else ""
    return f"""queue AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY phase, s_rank, confidence DESC, item_id, text) AS ord FROM (
      SELECT product_id, aspect, sentiment, review_id, confidence, text, key, quality, 0 AS phase, s_rank, item_id FROM pool
      WHERE sentiment IN ({sql_list(sentiments)}) {tail})),
    picks AS (
      SELECT DISTINCT product_id, 0 AS step, 0::BIGINT AS ord, []::VARCHAR[] AS aspects, []::VARCHAR[] AS keys, []::VARCHAR[] AS reviews FROM queue
      UNION ALL
      SELECT product_id, step, ord, aspects, keys, reviews FROM (
        SELECT p.product_id, p.step + 1 AS step, c.ord, list_append(p.aspects, c.aspect) AS aspects, list_append(p.keys, c.key) AS keys,
          list_append(p.reviews, c.review_id) AS reviews, row_number() OVER (PARTITION BY p.product_id ORDER BY c.ord) AS n
        FROM picks p JOIN queue c ON c.product_id = p.product_id AND c.ord > p.ord AND c.quality
          AND (c.phase = 1 OR NOT list_contains(p.aspects, c.aspect)) AND NOT list_contains(p.keys, c.key)
          AND NOT list_contains(p.reviews, c.review_id)
        WHERE p.step < {limit}) WHERE n = 1)"""


def _greedy_query(sentiments: list[str], limit: int, fill: bool) -> str:
    return "WITH RECURSIVE " + ",\n".join([ITEMS_T, QUALITY, _greedy_sql(sentiments, limit, fill)]) + f"""
      SELECT q.product_id, CAST(p.step AS INT) AS rank, q.review_id, q.aspect AS aspect_code, {sql_case('q.aspect', K.ASPECT_LABELS)} AS aspect,
        q.sentiment, CAST(q.confidence AS DOUBLE) AS confidence, q.text
      FROM picks p JOIN queue q ON p.product_id = q.product_id AND p.ord = q.ord WHERE p.step > 0"""


@query("diverse_evidence", _greedy_query(EV.SENTIMENT_ORDER, 6, True))
def diverse_evidence(spark: SparkSession, d: str) -> DataFrame:
    return EV.diverse_evidence(_items(spark, d), limit=6)


@query("complaint_evidence", _greedy_query(["negative"], 6, False))
def complaint_evidence(spark: SparkSession, d: str) -> DataFrame:
    return EV.diverse_evidence(_items(spark, d), ["negative"], limit=6, fill=False)


RISK_DEDUPE = f"""SELECT product_id, CAST(row_number() OVER (PARTITION BY product_id ORDER BY rank) AS INT) AS rank, review_id, label AS aspect_code, label AS aspect,
    'negative' AS sentiment, confidence, evidence AS text FROM (
  SELECT *, {sql_case('risk_type', K.RISK_LABELS)} AS label FROM risks
  WHERE length(evidence) >= 28
  QUALIFY row_number() OVER (PARTITION BY product_id, review_id ORDER BY rank) = 1
  AND row_number() OVER (PARTITION BY product_id, evidence ORDER BY rank) = 1)"""


@query("dedupe_evidence", with_views(ITEMS_T, RISKS, body=RISK_DEDUPE))
def dedupe_evidence(spark: SparkSession, d: str) -> DataFrame:
    from opinara.functions.labels import risk_label

    risks = detect_risks(_items(spark, d))
    rows = risks.select(
        "product_id", "rank", "review_id", risk_label(F.col("risk_type")).alias("aspect"), F.lit("negative").alias("sentiment"),
        "confidence", F.col("evidence").alias("text"),
    )
    return EV.dedupe_evidence(rows, "product_id", "rank", limit=7)


@query("quote_pick", with_views(ITEMS_T, body=f"""SELECT product_id, aspect, sentiment, CAST(tier AS INT) AS tier, sentence AS quote FROM (
  SELECT *, CASE WHEN strict THEN 1 WHEN loose THEN 2 END AS tier FROM (SELECT *, {_keyword_sql()} AS strict,
    CASE aspect {" ".join(f"WHEN '{a}' THEN {sql_any('lower(sentence)', w)}" for a, w in K.REQUIRED_KEYWORDS.items())} END AS loose FROM items))
  WHERE tier IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY product_id, aspect, sentiment
    ORDER BY tier, helpful_count DESC, confidence DESC, length(sentence) DESC, item_id, sentence) = 1"""))
def quote_pick(spark: SparkSession, d: str) -> DataFrame:
    return EV.pick_quotes(_items(spark, d))


@query("quote_pick_corpus", with_views(ITEMS_T, f"""corpus AS (SELECT aspect, sentiment, sentence FROM items WHERE annotator = 'human'
    QUALIFY row_number() OVER (PARTITION BY aspect, sentiment ORDER BY length(sentence) DESC, sentence) = 1)""",
  body="""SELECT DISTINCT i.product_id, i.aspect, i.sentiment, 0 AS tier, c.sentence AS quote FROM items i JOIN corpus c USING (aspect, sentiment)"""))
def quote_pick_corpus(spark: SparkSession, d: str) -> DataFrame:
    items = _items(spark, d)
    corpus = items.filter(F.col("annotator") == "human").select(
        F.col("aspect").alias("aspect_category"), "sentiment", F.col("sentence").alias("text_preview")
    )
    return EV.pick_quotes(items, corpus)


# ------------------------------------------------------------ chunks and vectors
CHUNKS = f"""chunks AS (SELECT CAST(('0x' || substr(sha1(product_id || '|' || review_id || '|' || aspect || '|' || sentiment || '|' || sentence), 1, 16))::UBIGINT AS DECIMAL(20,0)) AS point_id,
    product_id, review_id, aspect, sentiment, sentence AS text, CAST(confidence AS DOUBLE) AS confidence, {sql_case('aspect', K.ASPECT_LABELS, 'aspect')} AS aspect_label
  FROM items WHERE length(sentence) >= 24
  QUALIFY row_number() OVER (PARTITION BY product_id, review_id, aspect, sentiment, lower(sentence) ORDER BY item_id, confidence DESC, sentence) = 1)"""


@query("opinion_chunks", with_views(ITEMS_T, CHUNKS, body="SELECT * FROM chunks"))
def opinion_chunks(spark: SparkSession, d: str) -> DataFrame:
    return RT.opinion_chunks(_items(spark, d))


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    vectors = V.table(spark, d, "embeddings").withColumn("vector", R.l2_normalize(F.col("embedding")))
    codes = F.array(*[F.lit(c) for c in K.CATEGORIES])
    chunks = vectors.select(
        F.col("vec_id").alias("chunk_id"), F.col("label").cast("string").alias("product_id"),
        F.element_at(codes, (F.col("vec_id") % 17 + 1).cast("int")).alias("aspect"),
        F.element_at(F.array(*[F.lit(s) for s in K.SENTIMENTS]), (F.col("vec_id") % 3 + 1).cast("int")).alias("sentiment"), "vector",
    )
    negative = F.array(F.lit("negative"), F.lit("neutral"))
    queries = vectors.filter("vec_id % 20 = 0").select(
        F.col("vec_id").alias("query_id"), F.col("label").cast("string").alias("product_id"), F.col("vector").alias("q_vector"),
        F.when(F.col("vec_id") % 2 == 0, negative).alias("sentiments"),
        F.when(F.col("vec_id") % 5 == 0, F.slice(codes, 1, 9)).otherwise(F.slice(codes, 1, 0)).alias("aspects"),
    )
    return queries, chunks


@query("vector_topk", f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY semantic_score DESC, chunk_id) AS rank FROM (
    SELECT q.vec_id AS query_id, CAST(q.label AS VARCHAR) AS product_id, c.vec_id AS chunk_id,
      list_extract([{sql_list(K.CATEGORIES)}], CAST(c.vec_id % 17 + 1 AS INT)) AS aspect,
      list_extract([{sql_list(K.SENTIMENTS)}], CAST(c.vec_id % 3 + 1 AS INT)) AS sentiment,
      round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) + 1e-9, 6) AS semantic_score
    FROM embeddings q JOIN embeddings c ON q.label = c.label AND q.vec_id % 20 = 0
    WHERE (q.vec_id % 2 <> 0 OR sentiment IN ('negative', 'neutral')) AND (q.vec_id % 5 <> 0 OR c.vec_id % 17 < 9))
  QUALIFY rank <= 8""")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    queries, chunks = _vectors(spark, d)
    return RT.vector_search(queries, chunks, 8).drop("sentiments", "aspects")


def hashing_embedder(texts: list[str]) -> list[list[float]]:
    """Stand-in for an embedding model: hashed word counts."""
    out = []
    for t in texts:
        v = [0.0] * 32
        for w in t.split():
            v[zlib.crc32(w.encode()) % 32] += 1.0
        out.append(v)
    return out


@query("embed_texts")
def embed_texts(spark: SparkSession, d: str) -> DataFrame:
    docs = V.table(spark, d, "documents").select("doc_id", "text")
    return RT.embed_texts(docs, "text", hashing_embedder).select("doc_id", "vector")


# ------------------------------------------------------------ questions
INTENT_ARMS = " ".join(f"WHEN {sql_any('folded', words)} THEN '{intent}'" for intent, words in K.INTENT_RULES)


def _found(kind: int) -> str:
    parts = []
    for phrase, codes, constraints in K.PHRASE_MAP:
        values = [a for a in codes if a in K.ALLOWED_ASPECTS] if kind == 1 else constraints
        parts.append(f"CASE WHEN regexp_matches(folded, '(^|[^a-z0-9]){phrase}($|[^a-z0-9])') THEN [{sql_list(values)}] ELSE []::VARCHAR[] END")
    flat = f"flatten([{', '.join(parts)}])"
    return f"list_filter({flat}, lambda x, i: list_position({flat}, x) = i)"


def _union(intent: str) -> str:
    extra = f"[{sql_list(K.DEFAULT_ASPECTS[intent])}]"
    return f"list_concat(a0, list_filter({extra}, lambda x: NOT list_contains(a0, x)))"


RULES = f"""q1 AS (SELECT *, {fold_sql('question')} AS folded FROM questions),
q2 AS (SELECT *, CASE {INTENT_ARMS} WHEN folded <> '' THEN 'PRODUCT_QA' ELSE 'UNKNOWN' END AS i0, {_found(1)} AS a0, {_found(2)} AS constraints,
  {sql_any('folded', K.ASPECT_QUESTION_PHRASES)} AS asks FROM q1),
q3 AS (SELECT *, CASE WHEN i0 <> 'PRODUCT_FIT' AND len(a0) > 0 AND asks THEN 'ASPECT_QA' ELSE i0 END AS i1 FROM q2),
q4 AS (SELECT *, CASE WHEN i1 IN ('PRODUCT_QA', 'COMPLAINT_SUMMARY') AND len(a0) > 0 THEN 'ASPECT_QA' ELSE i1 END AS intent,
  CASE i1 WHEN 'PRICE_VALUE' THEN {_union('PRICE_VALUE')} WHEN 'DELIVERY_SERVICE' THEN {_union('DELIVERY_SERVICE')}
    WHEN 'RISK_CHECK' THEN {_union('RISK_CHECK')} WHEN 'PRODUCT_FIT' THEN CASE WHEN len(a0) > 0 THEN a0 ELSE [{sql_list(K.DEFAULT_ASPECTS['PRODUCT_FIT'])}] END
    ELSE a0 END AS target_aspects FROM q3),
analyzed AS (SELECT question_id, product_id, question, intent, target_aspects, constraints,
  round(least(0.95, 0.35 + CASE WHEN intent <> 'UNKNOWN' THEN 0.25 ELSE 0 END + CASE WHEN len(target_aspects) > 0 THEN 0.25 ELSE 0 END
    + CASE WHEN len(constraints) > 0 THEN 0.1 ELSE 0 END)::DOUBLE, 4) AS confidence FROM q4)"""


def _analyzed(spark: SparkSession, d: str) -> DataFrame:
    return Q.analyze_by_rule(V.questions(spark, d))


@query("question_intent", with_views(V.QUESTIONS_SQL, RULES, body="SELECT question_id, product_id, intent, confidence, 'rule' AS source FROM analyzed"))
def question_intent(spark: SparkSession, d: str) -> DataFrame:
    return _analyzed(spark, d).select("question_id", "product_id", "intent", "confidence", "source")


@query("question_aspects", with_views(V.QUESTIONS_SQL, RULES, body="""SELECT question_id, array_to_string(target_aspects, '|') AS target_aspects,
  array_to_string(constraints, '|') AS constraints FROM analyzed"""))
def question_aspects(spark: SparkSession, d: str) -> DataFrame:
    return _analyzed(spark, d).select(
        "question_id", F.array_join("target_aspects", "|").alias("target_aspects"), F.array_join("constraints", "|").alias("constraints")
    )


@query("accept_analysis", with_views(V.QUESTIONS_SQL, RULES, body="""SELECT question_id, CASE WHEN ext THEN 'PRICE_VALUE' ELSE intent END AS intent,
    CASE WHEN ext THEN ec ELSE confidence END AS confidence, CASE WHEN ext THEN 'llm' ELSE 'rule' END AS source FROM (
  SELECT *, NOT (confidence >= 0.65 OR (intent IN ('SUMMARY', 'COMPLAINT_SUMMARY', 'RECOMMENDATION') AND confidence >= 0.55)) AND ec >= 0.5 AS ext FROM (
    SELECT *, round((length(question) % 10) / 10.0::DOUBLE, 1) AS ec FROM analyzed))"""))
def accept_analysis(spark: SparkSession, d: str) -> DataFrame:
    rules = _analyzed(spark, d)
    none = F.array().cast("array<string>")
    external = rules.select("question_id", F.struct(
        F.lit("PRICE_VALUE").alias("intent"), none.alias("target_aspects"), none.alias("constraints"),
        F.round((F.length("question") % 10) / 10.0, 1).alias("confidence"), F.lit("llm").alias("source"),
    ).alias("analysis"))
    return Q.accept_analysis(rules, external).select("question_id", "intent", "confidence", "source")


def _all_stats(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    items = V.aspect_items(spark, d)
    stats = A.aspect_distribution(A.aspect_stats(items), None).drop("rank", "mean_confidence")
    return stats, items.groupBy("product_id").agg(F.count("*").alias("records"))


SCOPE = """scope0 AS (SELECT a.question_id, a.product_id, a.intent, intent IN ('PRODUCT_FIT', 'ASPECT_QA', 'PRICE_VALUE', 'DELIVERY_SERVICE') AND len(target_aspects) > 0 AS scoped,
    target_aspects, s.* EXCLUDE (product_id) FROM analyzed a JOIN stats s ON a.product_id = s.product_id),
scope1 AS (SELECT *, (NOT scoped OR list_contains(target_aspects, aspect)) AND (NOT scoped OR positive > 0) AS in_positive,
    (NOT scoped OR list_contains(target_aspects, aspect)) AND (NOT scoped OR negative > 0) AS in_negative FROM scope0),
scope AS (SELECT question_id, product_id, intent, aspect, positive, neutral, negative, total, positive_ratio, negative_ratio, avg_confidence, in_positive, in_negative,
    CASE WHEN scoped THEN CAST(sum(total) OVER (PARTITION BY question_id) AS BIGINT) ELSE (SELECT count(*) FROM items i WHERE i.product_id = scope1.product_id) END AS total_aspect_records
  FROM scope1 WHERE in_positive OR in_negative)"""


@query("question_scope", with_views(ITEMS, STATS, V.QUESTIONS_SQL, RULES, SCOPE, body="SELECT * FROM scope"))
def question_scope(spark: SparkSession, d: str) -> DataFrame:
    return Q.scope_stats(_analyzed(spark, d), *_all_stats(spark, d))


RANKINGS = """rankings AS (
  SELECT 'top_' || CASE sentiment WHEN 'negative' THEN 'complaints' ELSE 'praises' END AS ranking, product_id, aspect, sentiment, NULL::BIGINT AS positive, NULL::BIGINT AS negative,
    count(*) AS total, round(CAST(sum(confidence) AS DOUBLE) / count(*) + 1e-9, 4) AS avg_confidence, NULL::DOUBLE AS positive_ratio, NULL::DOUBLE AS negative_ratio,
    CAST(row_number() OVER (PARTITION BY product_id, sentiment ORDER BY count(*) DESC, aspect) AS INT) AS rank
  FROM items WHERE sentiment IN ('negative', 'positive') GROUP BY product_id, aspect, sentiment
  UNION ALL SELECT 'negative_ratio_by_aspect', product_id, aspect, NULL, positive, negative, total, avg_confidence, positive_ratio, negative_ratio,
    CAST(row_number() OVER (PARTITION BY product_id ORDER BY negative_ratio DESC, negative DESC, total DESC, aspect) AS INT) FROM stats
  UNION ALL SELECT 'positive_ratio_by_aspect', product_id, aspect, NULL, positive, negative, total, avg_confidence, positive_ratio, negative_ratio,
    CAST(row_number() OVER (PARTITION BY product_id ORDER BY positive_ratio DESC, positive DESC, total DESC, aspect) AS INT) FROM stats),
ranked AS (SELECT a.question_id, a.product_id, a.intent, r.* EXCLUDE (product_id) FROM analyzed a JOIN rankings r ON a.product_id = r.product_id
  WHERE intent NOT IN ('PRODUCT_FIT', 'ASPECT_QA', 'PRICE_VALUE', 'DELIVERY_SERVICE') OR len(target_aspects) = 0 OR list_contains(target_aspects, aspect))"""


def _rankings(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    items = V.aspect_items(spark, d)
    stats = A.aspect_stats(items)
    return {
        "top_complaints": A.top_by_sentiment(items, "negative", None), "top_praises": A.top_by_sentiment(items, "positive", None),
        "negative_ratio_by_aspect": A.negative_ratio_by_aspect(stats, None), "positive_ratio_by_aspect": A.positive_ratio_by_aspect(stats, None),
    }


@query("question_rankings", with_views(ITEMS, STATS, V.QUESTIONS_SQL, RULES, RANKINGS, body="SELECT * FROM ranked"))
def question_rankings(spark: SparkSession, d: str) -> DataFrame:
    return Q.scope_rankings(_analyzed(spark, d), _rankings(spark, d))


@query("compact_rankings", with_views(ITEMS, STATS, V.QUESTIONS_SQL, RULES, RANKINGS, body=f"""SELECT question_id, ranking, place, {sql_case('aspect', K.ASPECT_LABELS, f"'{K.UNKNOWN_ASPECT_LABEL}'")} AS aspect,
    coalesce(sentiment, '') AS sentiment, coalesce(negative, CASE sentiment WHEN 'negative' THEN total END, 0) AS negative,
    coalesce(positive, CASE sentiment WHEN 'positive' THEN total END, 0) AS positive, total, avg_confidence,
    coalesce({_percent('negative_ratio')}, '') AS negative_percent, coalesce({_percent('positive_ratio')}, '') AS positive_percent
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY question_id, ranking ORDER BY rank) AS INT) AS place FROM ranked) WHERE place <= 5"""))
def compact_rankings(spark: SparkSession, d: str) -> DataFrame:
    return Q.compact_rankings(Q.scope_rankings(_analyzed(spark, d), _rankings(spark, d)))


@query("compact_questions", with_views(V.QUESTIONS_SQL, RULES, V.PRODUCTS_SQL, body=f"""SELECT question_id, name, price, rating_average, review_count, brand, seller,
    array_to_string(list_transform(target_aspects, lambda x: {sql_case('x', K.ASPECT_LABELS, f"'{K.UNKNOWN_ASPECT_LABEL}'")}), '|') AS target_aspects,
    array_to_string(constraints, '|') AS constraints, confidence, 'rule' AS source
  FROM analyzed a LEFT JOIN products p ON a.product_id = p.product_id"""))
def compact_questions(spark: SparkSession, d: str) -> DataFrame:
    out = Q.compact_questions(_analyzed(spark, d), V.products(spark, d))
    return out.withColumns({c: F.array_join(c, "|") for c in ("target_aspects", "constraints")})


RISK_OF = sql_case("x", {a: n for a, (n, _) in K.RISK_ASPECTS.items()})


@query("question_risks", with_views(ITEMS_T, RISKS, V.QUESTIONS_SQL, RULES, body=f"""SELECT question_id, a.product_id, intent, risk_type, severity, rank
  FROM analyzed a JOIN risks r ON a.product_id = r.product_id WHERE CASE intent WHEN 'PRODUCT_FIT' THEN risk_type IN ('safety', 'material', 'size_fit')
    WHEN 'ASPECT_QA' THEN list_contains(list_transform(target_aspects, lambda x: {RISK_OF}), risk_type) ELSE TRUE END"""))
def question_risks(spark: SparkSession, d: str) -> DataFrame:
    return Q.scope_risks(_analyzed(spark, d), detect_risks(_items(spark, d)))


@query("answer_confidence", with_views(ITEMS, STATS, V.QUESTIONS_SQL, RULES, SCOPE, body="""SELECT question_id, v AS confidence_score,
    CASE WHEN v >= 0.67 THEN 'high' WHEN v >= 0.34 THEN 'medium' ELSE 'low' END AS confidence FROM (
  SELECT question_id, round(least(1.0::DOUBLE, records / 12.0::DOUBLE) * 0.45::DOUBLE + least(1.0::DOUBLE, evidence / 4.0::DOUBLE) * 0.3::DOUBLE + conf * 0.25::DOUBLE
      - CASE WHEN neg / tot BETWEEN 0.25 AND 0.55 AND tot >= 4 THEN 0.2::DOUBLE ELSE 0 END + 1e-9, 6) AS v
  FROM (SELECT question_id, max(total_aspect_records) AS records, count(*) FILTER (WHERE in_positive) AS evidence,
      sum(avg_confidence) / count(*) AS conf, sum(negative)::DOUBLE AS neg, sum(total)::DOUBLE AS tot FROM scope GROUP BY 1))"""))
def answer_confidence(spark: SparkSession, d: str) -> DataFrame:
    scope = Q.scope_stats(_analyzed(spark, d), *_all_stats(spark, d))
    evidence = scope.groupBy("question_id").agg(F.count(F.when(F.col("in_positive"), 1)).alias("evidence"))
    return S.answer_confidence(scope, evidence, ["question_id"])


@query("question_evidence")
def question_evidence(spark: SparkSession, d: str) -> DataFrame:
    items = _items(spark, d)
    asked = _analyzed(spark, d).select("question_id", "product_id", "intent", "target_aspects")
    return EV.explode_evidence(EV.evidence_for_questions(asked, items, detect_risks(items)), "evidence").drop("target_aspects")


def _two_sources(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    asked = _analyzed(spark, d).select("question_id", "product_id", "intent", "target_aspects")
    items = _items(spark, d)

    def rows(sentiment: str, k: int) -> DataFrame:
        top = EV.select_evidence(items, sentiment, k).withColumn("aspect_code", F.col("aspect"))
        return asked.select("question_id", "product_id").join(top, "product_id")

    vectors = rows("negative", 8).withColumn("semantic_score", F.round(F.col("confidence") * 0.9, 4))
    return asked, rows("positive", 6), vectors


HYBRID = f"""pos AS (SELECT *, row_number() OVER (PARTITION BY product_id, sentiment ORDER BY confidence DESC, item_id, sentence) AS rank FROM items),
both_rows AS (SELECT question_id, intent, target_aspects, rank, review_id, aspect, sentiment, p.confidence::DOUBLE AS confidence, sentence AS text,
    CASE WHEN sentiment = 'negative' THEN round(p.confidence::DOUBLE * 0.9::DOUBLE, 4) ELSE 0 END AS semantic,
    CASE WHEN sentiment = 'negative' THEN 'vector' ELSE 'structured' END AS source,
    intent IN ('SUMMARY', 'COMPLAINT_SUMMARY', 'PRICE_VALUE', 'DELIVERY_SERVICE') AS stat
  FROM analyzed a JOIN pos p ON a.product_id = p.product_id WHERE (sentiment = 'negative' AND rank <= 8) OR (sentiment = 'positive' AND rank <= 6)),
scored AS (SELECT *, round(CASE WHEN (source = 'vector') = stat THEN 0.35::DOUBLE ELSE 0.65::DOUBLE END + semantic * 0.35::DOUBLE + confidence * 0.25::DOUBLE
    + CASE WHEN list_contains(target_aspects, aspect) THEN 0.2::DOUBLE ELSE 0 END
    + CASE WHEN intent IN ('COMPLAINT_SUMMARY', 'RISK_CHECK') AND sentiment = 'negative' THEN 0.25::DOUBLE WHEN intent = 'ASPECT_QA' THEN 0.15::DOUBLE
        WHEN intent IN ('SUMMARY', 'RECOMMENDATION') THEN 0.1::DOUBLE ELSE 0 END + 1e-9, 4) AS hybrid_score,
    CASE WHEN (source = 'vector') = stat THEN rank + 1000 ELSE rank END AS place FROM both_rows),
keyed AS (SELECT *, min(place) OVER (PARTITION BY question_id, review_id) AS first_place,
    row_number() OVER (PARTITION BY question_id, review_id ORDER BY hybrid_score DESC, place) AS n FROM scored)"""


@query("hybrid_rank", with_views(ITEMS_T, V.QUESTIONS_SQL, RULES, HYBRID, body="""SELECT * EXCLUDE (new_rank), new_rank AS rank FROM (SELECT question_id,
    row_number() OVER (PARTITION BY question_id ORDER BY hybrid_score DESC, first_place) AS new_rank, review_id, aspect AS aspect_code, aspect, sentiment,
    confidence, text, source, hybrid_score, CASE WHEN stat THEN 'structured_first' ELSE 'vector_first' END AS strategy
  FROM keyed WHERE n = 1) WHERE new_rank <= 6"""))
def hybrid_rank(spark: SparkSession, d: str) -> DataFrame:
    return RT.hybrid_rank(*_two_sources(spark, d))


@query("request_cache", with_views(V.QUESTIONS_SQL, RULES, body="""SELECT question_id, length(question) % 3 <> 0 AND length(question) % 2 = 0 AS cache_hit FROM analyzed"""))
def request_cache(spark: SparkSession, d: str) -> DataFrame:
    asked = _analyzed(spark, d)
    key = RT.request_key(F.col("product_id"), F.concat_ws(" ", "question_id", "question"), F.col("intent"), F.col("target_aspects"))
    asked = asked.withColumn("cache_key", key)
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    age = F.when(F.length("question") % 2 == 0, 60).otherwise(7200)
    stored = asked.filter(F.length("question") % 3 != 0)
    cache = stored.select("cache_key", F.lit("x").alias("result"), (now - F.make_dt_interval(secs=age)).alias("created_at"))
    hits, misses = RT.split_by_cache(asked.select("question_id", "cache_key"), cache, now)
    return hits.select("question_id", F.lit(True).alias("cache_hit")).unionByName(
        misses.select("question_id", F.lit(False).alias("cache_hit"))
    )


@query("answer_facts")
def answer_facts(spark: SparkSession, d: str) -> DataFrame:
    items = _items(spark, d)
    asked = _analyzed(spark, d)
    risks = detect_risks(items)
    evidence = EV.evidence_for_questions(asked.select("question_id", "product_id", "intent", "target_aspects"), items, risks)
    return Q.answer_facts(asked, evidence, Q.scope_stats(asked, *_all_stats(spark, d)), Q.scope_risks(asked, risks))
