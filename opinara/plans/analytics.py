"""Registered queries: aspect analytics, risks, scores, recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara import constants as K
from opinara.functions import text as X
from opinara.operators import aspects as A
from opinara.operators import items as I
from opinara.operators import recommend as R
from opinara.operators.ranking import top_rows
from opinara.operators.reviews import preprocess_reviews
from opinara.operators.risk import detect_risks
from opinara.operators.scoring import fit_level, purchase_score
from opinara.plans.registry import query, sql_any, sql_case, sql_list, with_views
from opinara.sources import fixtures as V

ITEMS = V.items_sql()
ITEMS_T = V.items_sql(with_sentence=True)

# ---------------------------------------------------------------- SQL parts
ASPECT_TABLE = f"""aspect_table AS (
  SELECT product_id, aspect, {sql_case('aspect', K.TABLE_LABELS)} AS display_name,
    count(*) FILTER (WHERE sentiment = 'positive') AS positive,
    count(*) FILTER (WHERE sentiment = 'neutral') AS neutral,
    count(*) FILTER (WHERE sentiment = 'negative') AS negative,
    count(*) AS mentions,
    round((CAST(sum(sentiment_score * weight) AS DOUBLE) / CAST(sum(weight) AS DOUBLE) + 1) / 2 + 1e-9, 4)
      AS avg_score_0_1
  FROM items GROUP BY product_id, aspect)"""

STATS = """stats AS (
  SELECT product_id, aspect, CAST(sum(n) FILTER (WHERE sentiment = 'positive') AS BIGINT) AS p0,
    coalesce(CAST(sum(n) FILTER (WHERE sentiment = 'positive') AS BIGINT), 0) AS positive,
    coalesce(CAST(sum(n) FILTER (WHERE sentiment = 'neutral') AS BIGINT), 0) AS neutral,
    coalesce(CAST(sum(n) FILTER (WHERE sentiment = 'negative') AS BIGINT), 0) AS negative,
    CAST(sum(n) AS BIGINT) AS total,
    round(coalesce(CAST(sum(n) FILTER (WHERE sentiment = 'positive') AS DOUBLE), 0) / sum(n) + 1e-9, 4) AS positive_ratio,
    round(coalesce(CAST(sum(n) FILTER (WHERE sentiment = 'negative') AS DOUBLE), 0) / sum(n) + 1e-9, 4) AS negative_ratio,
    round(max(avg_c) + 1e-9, 4) AS avg_confidence,
    round(CAST(sum(conf_sum) AS DOUBLE) / sum(n) + 1e-9, 4) AS mean_confidence
  FROM (SELECT product_id, aspect, sentiment, count(*) AS n, sum(confidence) AS conf_sum,
          CAST(sum(confidence) AS DOUBLE) / count(*) AS avg_c FROM items GROUP BY ALL)
  GROUP BY product_id, aspect)"""

REVIEW_SCORES = """review_scores AS (
  SELECT *, CASE WHEN score > 0.15 THEN 'positive' WHEN score < -0.15 THEN 'negative' ELSE 'neutral' END AS label
  FROM (SELECT product_id, review_id,
          CAST(sum(sentiment_score * weight) AS DOUBLE) / CAST(sum(weight) AS DOUBLE) AS score,
          CAST(max(confidence) AS DOUBLE) AS confidence
        FROM items GROUP BY product_id, review_id))"""


def _boost() -> str:
    arms = " ".join(
        f"WHEN '{kind}' THEN CASE WHEN {sql_any('lower(sentence)', words)} THEN 1 ELSE 0 END"
        for kind, words in K.RISK_KEYWORDS.items()
    )
    return f"CASE risk_type {arms} ELSE 0 END"


RISKS = f"""risk_items AS (
  SELECT *, {sql_case('aspect', {a: w for a, (_, w) in K.RISK_ASPECTS.items()})} + {_boost()} AS w
  FROM (SELECT *, {sql_case('aspect', {a: n for a, (n, _) in K.RISK_ASPECTS.items()})} AS risk_type FROM items
        WHERE sentiment = 'negative')
  WHERE risk_type IS NOT NULL),
risk_sums AS (
  SELECT product_id, risk_type, CAST(sum(confidence * w) AS DOUBLE) AS total, count(*) AS n
  FROM risk_items GROUP BY ALL),
risk_best AS (
  SELECT product_id, risk_type, sentence AS evidence, review_id FROM risk_items
  QUALIFY row_number() OVER (PARTITION BY product_id, risk_type ORDER BY confidence DESC, item_id) = 1),
risks0 AS (
  SELECT product_id, risk_type,
    CASE WHEN total >= 5 OR n >= 4 THEN 'high' WHEN total >= 2.5 OR n >= 2 THEN 'medium' ELSE 'low' END AS severity,
    round(least(1.0, total / 8) + 1e-9, 4) AS confidence, evidence, review_id, '{K.RISK_SOURCE}' AS source
  FROM risk_sums JOIN risk_best USING (product_id, risk_type)),
risks AS (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY {sql_case('severity', K.SEVERITY_RANK)} DESC,
    confidence DESC, risk_type) AS rank
  FROM risks0)"""

PURCHASE = f"""scores AS (
  SELECT product_id,
    CASE WHEN raw >= 0.68 AND ev >= 0.35 THEN 'Nen mua' WHEN raw < 0.42 THEN 'Nen tranh' ELSE 'Can nhac' END AS label,
    round(raw + 1e-9, 4) AS score, round(ev + 1e-9, 4) AS confidence
  FROM (SELECT product_id, least(1.0, count(*) / 30.0::DOUBLE) AS ev,
      greatest(0.0, least(1.0, (CAST(sum(w * sentiment_score) AS DOUBLE) / CAST(sum(w) AS DOUBLE) + 1) / 2)) AS raw
    FROM (SELECT *, greatest(confidence, 0.05) *
            CAST({sql_case('aspect', {k: float(v) for k, v in K.ASPECT_WEIGHTS.items()}, '1.0')} AS DECIMAL(2,1)) AS w
          FROM items)
    GROUP BY product_id))"""


def _top(source: str, order: str, k: int | None, where: str = "TRUE", cols: str = "*") -> str:
    return f"""SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY {order}) AS rank
  FROM {source} WHERE {where}){f" WHERE rank <= {k}" if k else ""}"""


# ---------------------------------------------------------------- queries
@query("aspect_table", with_views(ITEMS, ASPECT_TABLE, body="SELECT * FROM aspect_table"))
def aspect_table(spark: SparkSession, d: str) -> DataFrame:
    return A.aspect_table(V.aspect_items(spark, d))


@query("aspect_table_ranked", with_views(ITEMS, ASPECT_TABLE, body=_top("aspect_table", "mentions DESC, aspect", None)))
def aspect_table_ranked(spark: SparkSession, d: str) -> DataFrame:
    return A.ranked_aspect_table(A.aspect_table(V.aspect_items(spark, d)))


@query("radar", with_views(ITEMS, ASPECT_TABLE, body="""SELECT product_id, aspect, avg_score_0_1 AS score
  FROM aspect_table WHERE avg_score_0_1 > 0 AND mentions > 0"""))
def radar(spark: SparkSession, d: str) -> DataFrame:
    return A.radar(A.aspect_table(V.aspect_items(spark, d)))


STRENGTHS = _top("aspect_table", "mentions DESC, avg_score_0_1 DESC, aspect", 4,
                 "positive > negative AND positive / mentions >= 0.3")
WEAKNESSES = _top("aspect_table", "negative DESC, mentions DESC, aspect", 4,
                  "negative > 0 AND (negative >= positive OR negative / mentions >= 0.3)")


@query("strengths", with_views(ITEMS, ASPECT_TABLE, body=STRENGTHS))
def strengths(spark: SparkSession, d: str) -> DataFrame:
    return A.strengths(A.aspect_table(V.aspect_items(spark, d)))


@query("weaknesses", with_views(ITEMS, ASPECT_TABLE, body=WEAKNESSES))
def weaknesses(spark: SparkSession, d: str) -> DataFrame:
    return A.weaknesses(A.aspect_table(V.aspect_items(spark, d)))


STAT_COLS = """product_id, aspect, positive, neutral, negative, total, positive_ratio, negative_ratio, avg_confidence,
  mean_confidence"""


@query("aspect_stats", with_views(ITEMS, STATS, body=f"SELECT {STAT_COLS} FROM stats"))
def aspect_stats(spark: SparkSession, d: str) -> DataFrame:
    return A.aspect_stats(V.aspect_items(spark, d))


def _top_sentiment(sentiment: str) -> str:
    return with_views(ITEMS, body=f"""SELECT *, '{sentiment}' AS sentiment FROM ({_top(
        "(SELECT product_id, aspect, count(*) AS total,"
        " round(CAST(sum(confidence) AS DOUBLE) / count(*) + 1e-9, 4) AS avg_confidence FROM items"
        f" WHERE sentiment = '{sentiment}' GROUP BY ALL)", "total DESC, aspect", 6)})""")


@query("top_complaints", _top_sentiment("negative"))
def top_complaints(spark: SparkSession, d: str) -> DataFrame:
    return A.top_by_sentiment(V.aspect_items(spark, d), "negative")


@query("top_praises", _top_sentiment("positive"))
def top_praises(spark: SparkSession, d: str) -> DataFrame:
    return A.top_by_sentiment(V.aspect_items(spark, d), "positive")


@query("negative_ratio", with_views(ITEMS, STATS, body=_top(
    "stats", "negative_ratio DESC, negative DESC, total DESC, aspect", 8, cols=STAT_COLS + ", rank")))
def negative_ratio(spark: SparkSession, d: str) -> DataFrame:
    return A.negative_ratio_by_aspect(A.aspect_stats(V.aspect_items(spark, d)))


@query("positive_ratio", with_views(ITEMS, STATS, body=_top(
    "stats", "positive_ratio DESC, positive DESC, total DESC, aspect", 8, cols=STAT_COLS + ", rank")))
def positive_ratio(spark: SparkSession, d: str) -> DataFrame:
    return A.positive_ratio_by_aspect(A.aspect_stats(V.aspect_items(spark, d)))


@query("aspect_distribution", with_views(ITEMS, STATS, body=_top(
    "stats", "total DESC, aspect", 8, cols=STAT_COLS + ", rank")))
def aspect_distribution(spark: SparkSession, d: str) -> DataFrame:
    return A.aspect_distribution(A.aspect_stats(V.aspect_items(spark, d)))


@query("two_rankings", with_views(ITEMS, STATS, body=f"""SELECT {STAT_COLS},
  row_number() OVER (PARTITION BY product_id ORDER BY negative DESC, negative_ratio DESC, total DESC, aspect) AS negative_rank,
  row_number() OVER (PARTITION BY product_id ORDER BY positive DESC, positive_ratio DESC, total DESC, aspect) AS positive_rank,
  CAST(sum(total) OVER (PARTITION BY product_id) AS BIGINT) AS total_aspect_records FROM stats"""))
def two_rankings(spark: SparkSession, d: str) -> DataFrame:
    return A.two_rankings(A.aspect_stats(V.aspect_items(spark, d)))


def _percent(c: str) -> str:
    # printf('%.0f') rounds exact halves to even in one engine and up in the other
    return f"CAST(CAST(floor({c} * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%'"


@query("friendly_stats", with_views(ITEMS, STATS, body=f"""SELECT product_id, aspect,
    {sql_case('aspect', K.ASPECT_LABELS, f"'{K.UNKNOWN_ASPECT_LABEL}'")} AS aspect_label, negative, positive, total,
    avg_confidence, {_percent('negative_ratio')} AS negative_percent, {_percent('positive_ratio')} AS positive_percent, rank
  FROM ({_top("stats", "negative DESC, negative_ratio DESC, total DESC, aspect", 4)})"""))
def friendly_stats(spark: SparkSession, d: str) -> DataFrame:
    ranked = A.rank_stats(A.aspect_stats(V.aspect_items(spark, d)), ["negative", "negative_ratio", "total"], 4)
    return A.friendly_stats(ranked)


@query("plain_aspect_statistics", with_views(ITEMS, body="""
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY negative DESC, total DESC, aspect) AS negative_rank,
    row_number() OVER (PARTITION BY product_id ORDER BY positive DESC, total DESC, aspect) AS positive_rank
  FROM (SELECT product_id, aspect, count(*) FILTER (WHERE sentiment = 'positive') AS positive,
    count(*) FILTER (WHERE sentiment = 'neutral') AS neutral, count(*) FILTER (WHERE sentiment = 'negative') AS negative,
    count(*) AS total,
    round(CAST(count(*) FILTER (WHERE sentiment = 'negative') AS DOUBLE) / count(*) + 1e-9, 3) AS negative_ratio
  FROM items GROUP BY ALL)"""))
def plain_aspect_statistics(spark: SparkSession, d: str) -> DataFrame:
    return A.plain_aspect_statistics(V.aspect_items(spark, d))


@query("aspect_summary", with_views(ITEMS, body="""SELECT product_id, aspect,
  count(*) FILTER (WHERE sentiment = 'positive') AS positive, count(*) FILTER (WHERE sentiment = 'neutral') AS neutral,
  count(*) FILTER (WHERE sentiment = 'negative') AS negative FROM items GROUP BY ALL"""))
def aspect_summary(spark: SparkSession, d: str) -> DataFrame:
    return A.aspect_summary(V.aspect_items(spark, d))


@query("review_statistics", with_views(ITEMS, V.REVIEWS_SQL, body="""
  SELECT coalesce(a.product_id, b.product_id) AS product_id, coalesce(a.n, 0) AS stored_review_count,
    coalesce(b.n, 0) AS aspect_record_count, avg_review_rating
  FROM (SELECT product_id, count(*) AS n, round(CAST(sum(rating) AS DOUBLE) / count(rating) + 1e-9, 4) AS avg_review_rating
        FROM reviews GROUP BY 1) a
  FULL JOIN (SELECT product_id, count(*) AS n FROM items GROUP BY 1) b ON a.product_id = b.product_id"""))
def review_statistics(spark: SparkSession, d: str) -> DataFrame:
    return A.review_statistics(V.reviews(spark, d), V.aspect_items(spark, d))


@query("item_weights", with_views(ITEMS, body="""SELECT product_id, review_id, aspect, sentiment, item_id,
  CAST(sentiment_score AS INT) AS sentiment_score, round(CAST(weight AS DOUBLE) + 1e-9, 6) AS weight FROM items"""))
def item_weights(spark: SparkSession, d: str) -> DataFrame:
    from opinara.functions.numbers import round_up

    items = I.weigh_items(V.aspect_items(spark, d).drop("weight", "sentiment_score"))
    return items.select(
        "product_id", "review_id", "aspect", "sentiment", "item_id", "sentiment_score",
        round_up(F.col("weight"), 6).alias("weight"),
    )


@query("review_scores", with_views(ITEMS, REVIEW_SCORES, body="""SELECT product_id, review_id,
  round(score + 1e-9, 6) AS score, label, confidence FROM review_scores"""))
def review_scores(spark: SparkSession, d: str) -> DataFrame:
    from opinara.functions.numbers import round_up

    out = I.review_scores(V.aspect_items(spark, d))
    return out.withColumn("score", round_up(F.col("score"), 6))


@query("sentiment_distribution", with_views(ITEMS, REVIEW_SCORES, body="""SELECT *,
    round(CAST(positive AS DOUBLE) / (positive + neutral + negative) + 1e-9, 4) AS positive_ratio,
    round(CAST(neutral AS DOUBLE) / (positive + neutral + negative) + 1e-9, 4) AS neutral_ratio,
    round(CAST(negative AS DOUBLE) / (positive + neutral + negative) + 1e-9, 4) AS negative_ratio
  FROM (SELECT product_id, count(*) FILTER (WHERE label = 'positive') AS positive,
    count(*) FILTER (WHERE label = 'neutral') AS neutral, count(*) FILTER (WHERE label = 'negative') AS negative
    FROM review_scores GROUP BY 1)"""))
def sentiment_distribution(spark: SparkSession, d: str) -> DataFrame:
    return I.sentiment_distribution(I.review_scores(V.aspect_items(spark, d)))


@query("product_score", with_views(ITEMS, body="""SELECT product_id,
    round(greatest(0.0, least(1.0, (CAST(sum(sentiment_score * weight) AS DOUBLE) / CAST(sum(weight) AS DOUBLE) + 1) / 2))
      + 1e-9, 4) AS absa_score,
    count(DISTINCT aspect) AS num_aspects, count(DISTINCT review_id) AS reviews_used
  FROM items GROUP BY product_id"""))
def product_score(spark: SparkSession, d: str) -> DataFrame:
    return I.product_score(V.aspect_items(spark, d))


def _keyword_sql() -> str:
    arms = []
    for code, words in K.REQUIRED_KEYWORDS.items():
        test = sql_any("lower(sentence)", words)
        if code in K.FORBIDDEN_KEYWORDS:
            test += f" AND NOT {sql_any('lower(sentence)', K.FORBIDDEN_KEYWORDS[code])}"
        arms.append(f"WHEN '{code}' THEN {test}")
    return "CASE aspect " + " ".join(arms) + " END"


OPINIONS = f"""opinions AS (
  SELECT c.product_id, c.aspect, c.sentiment, {sql_case('c.aspect', K.TABLE_LABELS)} AS display_name, c.count,
    c.confidence, coalesce(e.sentence, '') AS example, c.rank
  FROM ({_top("(SELECT product_id, aspect, sentiment, count(*) AS count,"
    " round(CAST(sum(confidence) AS DOUBLE) / count(*) + 1e-9, 3) AS confidence FROM items GROUP BY ALL)",
    "count DESC, aspect, sentiment", None)}) c
  LEFT JOIN (SELECT product_id, aspect, sentiment, sentence FROM items WHERE {_keyword_sql()}
    QUALIFY row_number() OVER (PARTITION BY product_id, aspect, sentiment ORDER BY item_id, sentence) = 1) e
  ON c.product_id = e.product_id AND c.aspect = e.aspect AND c.sentiment = e.sentiment)"""


@query("opinion_table", with_views(ITEMS_T, OPINIONS, body="SELECT * FROM opinions"))
def opinion_table(spark: SparkSession, d: str) -> DataFrame:
    return A.opinion_table(V.aspect_items(spark, d, with_sentence=True))


@query("opinion_union", with_views(ITEMS_T, ASPECT_TABLE, OPINIONS, body=f"""
  SELECT product_id, aspect, sentiment, confidence, 'opinion' AS origin FROM opinions
  UNION ALL SELECT product_id, aspect, 'positive', 0.8::DOUBLE, 'strength' FROM ({STRENGTHS})
  UNION ALL SELECT product_id, aspect, 'negative', 0.8::DOUBLE, 'weakness' FROM ({WEAKNESSES})"""))
def opinion_union(spark: SparkSession, d: str) -> DataFrame:
    items = V.aspect_items(spark, d, with_sentence=True)
    table = A.aspect_table(V.aspect_items(spark, d))
    return A.opinion_union(A.opinion_table(items), A.strengths(table), A.weaknesses(table))


@query("opinion_percent", with_views(ITEMS_T, OPINIONS, body="""SELECT product_id,
    round(coalesce(sum(count) FILTER (WHERE sentiment = 'positive'), 0)::DOUBLE * 100 / sum(count) + 1e-9, 1) AS positive_percent,
    round(coalesce(sum(count) FILTER (WHERE sentiment = 'neutral'), 0)::DOUBLE * 100 / sum(count) + 1e-9, 1) AS neutral_percent,
    round(coalesce(sum(count) FILTER (WHERE sentiment = 'negative'), 0)::DOUBLE * 100 / sum(count) + 1e-9, 1) AS negative_percent
  FROM opinions GROUP BY product_id"""))
def opinion_percent(spark: SparkSession, d: str) -> DataFrame:
    return A.opinion_percent(A.opinion_table(V.aspect_items(spark, d, with_sentence=True)))


@query("merge_stat_rows", with_views(ITEMS, STATS, body=f"""
  SELECT {STAT_COLS}, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY product_id, aspect ORDER BY list) AS n FROM (
      SELECT *, 0 AS list FROM ({_top("stats", "positive DESC, positive_ratio DESC, total DESC, aspect", 4)})
      UNION ALL SELECT *, 1 FROM ({_top("stats", "negative DESC, negative_ratio DESC, total DESC, aspect", 4)})))
  WHERE n = 1"""))
def merge_stat_rows(spark: SparkSession, d: str) -> DataFrame:
    stats = A.aspect_stats(V.aspect_items(spark, d))
    positive = A.rank_stats(stats, ["positive", "positive_ratio", "total"], 4)
    negative = A.rank_stats(stats, ["negative", "negative_ratio", "total"], 4)
    return A.merge_ranked(positive, negative)


@query("risk_flags", with_views(ITEMS_T, RISKS, body="SELECT * FROM risks"))
def risk_flags(spark: SparkSession, d: str) -> DataFrame:
    return detect_risks(V.aspect_items(spark, d, with_sentence=True))


@query("friendly_risks", with_views(ITEMS_T, RISKS, body=f"""SELECT product_id, {sql_case('risk_type', K.RISK_LABELS)} AS risk,
  severity, confidence, evidence FROM risks"""))
def friendly_risks(spark: SparkSession, d: str) -> DataFrame:
    return A.friendly_risks(detect_risks(V.aspect_items(spark, d, with_sentence=True)))


@query("purchase_score", with_views(ITEMS, PURCHASE, body="SELECT * FROM scores"))
def q_purchase_score(spark: SparkSession, d: str) -> DataFrame:
    return purchase_score(V.aspect_items(spark, d))


@query("fit_level", with_views(ITEMS, PURCHASE, body="""SELECT product_id, label, confidence,
  CASE WHEN confidence < 0.25 THEN 'insufficient_data' WHEN label = 'Nen mua' THEN 'fit' ELSE 'consider' END AS fit_level
  FROM scores"""))
def q_fit_level(spark: SparkSession, d: str) -> DataFrame:
    return fit_level(purchase_score(V.aspect_items(spark, d)))


RECOMMEND = """own AS (
  SELECT DISTINCT product_id, category_lv2, category_lv3 FROM categories
  QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY category_lv3, category_lv2) = 1),
members AS (SELECT DISTINCT product_id, category_lv2, category_lv3 FROM categories),
outsider AS (
  SELECT p.category_lv2, p.category_lv3, m.product_id
  FROM (SELECT DISTINCT category_lv2, category_lv3 FROM own) p
  JOIN (SELECT DISTINCT product_id, category_lv2 FROM members) m ON p.category_lv2 = m.category_lv2),
cand AS (
  SELECT o.product_id, c.product_id AS candidate_id
  FROM own o JOIN outsider c USING (category_lv2, category_lv3) WHERE c.product_id <> o.product_id),
recommended AS (
  SELECT c.product_id, candidate_id, p.name, p.price, p.rating_average,
    round(p.rating_average / 5 + 1e-9, 4) AS rating_score,
    row_number() OVER (PARTITION BY c.product_id ORDER BY p.rating_average DESC, coalesce(quantity_sold, 0) DESC, candidate_id)
      AS rank
  FROM cand c JOIN products p ON p.product_id = c.candidate_id LEFT JOIN listing l ON l.product_id = c.candidate_id
  QUALIFY rank <= 5)"""


@query("recommendations", with_views(V.PRODUCTS_SQL, V.CATEGORIES_SQL, V.LISTING_SQL, RECOMMEND,
                                     body="SELECT * FROM recommended"))
def recommendations(spark: SparkSession, d: str) -> DataFrame:
    return R.similar_products(V.products(spark, d), V.categories(spark, d), V.listing(spark, d))


@query("compare_top1", with_views(ITEMS, V.PRODUCTS_SQL, V.CATEGORIES_SQL, V.LISTING_SQL, RECOMMEND, body="""
  SELECT r.product_id, candidate_id, aspect, score FROM recommended r JOIN (
    SELECT product_id, aspect,
      round(greatest(0.0, least(1.0, (sum(sentiment_score)::DOUBLE / count(*) + 1) / 2)) + 1e-9, 4) AS score
    FROM items GROUP BY ALL) s ON s.product_id = r.candidate_id WHERE rank = 1"""))
def compare_top1(spark: SparkSession, d: str) -> DataFrame:
    recommended = R.similar_products(V.products(spark, d), V.categories(spark, d), V.listing(spark, d))
    return R.compare_with_top(recommended, V.aspect_items(spark, d))


WS = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
NWS = r"[^\s\x0B\x1C-\x1F\x{85}\p{Z}]"
PREPROCESSED = rf"""pre AS (
  SELECT * FROM (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(full_text, '<[^>]+>', ' ', 'g'),
      'https?://{NWS}+|www\.{NWS}+', ' ', 'g'), '{WS}+', ' ', 'g'), ' ') AS clean_text
    FROM (SELECT *, trim(coalesce(title, '') || '. ' || coalesce(content, ''), '. ') AS full_text FROM reviews))
  WHERE length(clean_text) > 20)"""
LOCAL_SCORES = """local_scores AS (
  SELECT review_id, product_id, CAST((rating - 3) * (helpful_count % 3) AS DOUBLE) AS score,
    CASE WHEN (rating - 3) * (helpful_count % 3) > 0.15 THEN 'positive'
         WHEN (rating - 3) * (helpful_count % 3) < -0.15 THEN 'negative' ELSE 'neutral' END AS label FROM pre)"""


@query("representative_reviews", with_views(V.REVIEWS_SQL, PREPROCESSED, LOCAL_SCORES, """scored AS (
  SELECT p.*, s.score, s.label, max(s.score <> 0) OVER (PARTITION BY p.product_id) AS any_scored
  FROM pre p JOIN local_scores s USING (product_id, review_id))""", """valid AS (
  SELECT * FROM scored WHERE NOT any_scored OR score <> 0)""", """best AS (
  SELECT *, 'best' AS role FROM valid QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY score DESC, review_id) = 1)""",
  """worst AS (SELECT v.*, 'worst' AS role FROM (SELECT * FROM valid
    QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY score, review_id) = 1) v
    ANTI JOIN best b ON v.product_id = b.product_id AND v.review_id = b.review_id)""",
  """worst_any AS (SELECT * FROM valid QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY score, review_id) = 1)""",
  """helpful AS (SELECT *, 'helpful' AS role FROM (SELECT v.* FROM valid v
      ANTI JOIN best b ON v.product_id = b.product_id AND v.review_id = b.review_id
      ) x ANTI JOIN worst_any w ON x.product_id = w.product_id AND x.review_id = w.review_id
    QUALIFY row_number() OVER (PARTITION BY x.product_id ORDER BY helpful_count DESC, review_id) = 1)""",
  body="""SELECT product_id, review_id, role, clean_text AS text, label, rating, score FROM (
    SELECT * FROM best UNION ALL SELECT * FROM worst UNION ALL SELECT * FROM helpful)"""))
def representative_reviews(spark: SparkSession, d: str) -> DataFrame:
    pre = preprocess_reviews(V.reviews(spark, d))
    raw = ((F.col("rating") - 3) * (F.col("helpful_count") % 3)).cast("double")
    scores = pre.select("product_id", "review_id", raw.alias("score"), I.score_label(raw).alias("label"))
    return R.representative_reviews(pre, scores)


@query("cap_reviews", with_views(V.REVIEWS_SQL, body="""SELECT product_id, review_id, rating FROM reviews
  QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY seq) <= 3"""))
def cap_reviews(spark: SparkSession, d: str) -> DataFrame:
    return I.cap_reviews(V.reviews(spark, d), ["seq"], 3).select("product_id", "review_id", "rating")


@query("evidence_select", with_views(ITEMS_T, body="""SELECT product_id, review_id, aspect, sentiment,
    CAST(confidence AS DOUBLE) AS confidence, sentence AS text, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY confidence DESC, item_id, sentence) AS rank FROM items
    WHERE sentiment = 'negative') WHERE rank <= 4"""))
def evidence_select(spark: SparkSession, d: str) -> DataFrame:
    from opinara.operators.evidence import select_evidence

    return select_evidence(V.aspect_items(spark, d, with_sentence=True), "negative", 4)
