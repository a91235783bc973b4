"""Views that map the driver's generic tables onto the review domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara import constants as K
from opinara.functions.numbers import dec


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(c: str):
    return F.col(c).cast("string")


def aspect_items(spark: SparkSession, sf_dir: str, with_sentence: bool = False) -> DataFrame:
    """Opinion items: one per line item.

    The sentence needs the part table, so it is joined only on request.
    """
    li = table(spark, sf_dir, "lineitem")
    codes = F.array(*[F.lit(c) for c in K.CATEGORIES])
    flag = F.col("l_returnflag")
    rating = (F.lit(1) + (F.col("l_linenumber") - 1) % 5).cast("int")
    helpful = F.col("l_quantity").cast("int")
    confidence = (F.lit(0.5) + F.col("l_discount") * 5).cast("decimal(4,2)")
    columns = [
        _text("l_partkey").alias("product_id"),
        _text("l_orderkey").alias("review_id"),
        F.element_at(codes, (F.col("l_suppkey") % 17 + 1).cast("int")).alias("aspect"),
        F.when(flag == "A", "positive").when(flag == "N", "neutral").otherwise("negative").alias("sentiment"),
        F.when(flag == "A", 1).when(flag == "N", 0).otherwise(-1).alias("sentiment_score"),
        confidence.alias("confidence"),
        helpful.alias("helpful_count"),
        rating.alias("rating"),
        (rating * (10 + helpful) * confidence * dec("0.02")).alias("weight"),
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100000 + F.col("l_suppkey")).alias("item_id"),
        F.when(F.col("l_linestatus") == "F", "human").otherwise("model").alias("annotator"),
        F.col("l_linenumber").alias("line"),
    ]
    if not with_sentence:
        return li.select(*columns)
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    sentence = F.concat_ws(
        " ", "p_name", "p_brand", "p_type", F.lit("order"), _text("l_orderkey"), F.lit("line"), _text("l_linenumber")
    )
    joined = li.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(*columns, sentence.alias("sentence"))


ITEMS_SQL = """items AS (
  SELECT CAST(l_partkey AS VARCHAR) AS product_id, CAST(l_orderkey AS VARCHAR) AS review_id,
    list_extract([{codes}], CAST(l_suppkey % 17 + 1 AS INT)) AS aspect,
    CASE l_returnflag WHEN 'A' THEN 'positive' WHEN 'N' THEN 'neutral' ELSE 'negative' END AS sentiment,
    CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 0 ELSE -1 END AS sentiment_score,
    CAST(0.5 + l_discount * 5 AS DECIMAL(4,2)) AS confidence,
    CAST(l_quantity AS INT) AS helpful_count,
    CAST(1 + (l_linenumber - 1) % 5 AS INT) AS rating,
    CAST(1 + (l_linenumber - 1) % 5 AS INT) * (10 + CAST(l_quantity AS INT))
      * CAST(0.5 + l_discount * 5 AS DECIMAL(4,2)) * 0.02 AS weight,
    (l_orderkey * 8 + l_linenumber) * 100000 + l_suppkey AS item_id,
    CASE l_linestatus WHEN 'F' THEN 'human' ELSE 'model' END AS annotator,
    l_linenumber AS line{sentence}
  FROM lineitem{part})"""


def items_sql(with_sentence: bool = False) -> str:
    codes = ", ".join(f"'{c}'" for c in K.CATEGORIES)
    if not with_sentence:
        return ITEMS_SQL.format(codes=codes, sentence="", part="")
    sentence = (
        ",\n    concat_ws(' ', p_name, p_brand, p_type, 'order', CAST(l_orderkey AS VARCHAR), 'line',"
        " CAST(l_linenumber AS VARCHAR)) AS sentence"
    )
    return ITEMS_SQL.format(codes=codes, sentence=sentence, part=" JOIN part ON l_partkey = p_partkey")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews: one per document."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        _text("doc_id").alias("review_id"),
        (F.col("doc_id") % 200).cast("string").alias("product_id"),
        F.col("source").alias("title"),
        F.col("text").alias("content"),
        (1 + F.col("doc_id") % 5).cast("int").alias("rating"),
        (F.col("n_chars") % 20).cast("int").alias("helpful_count"),
        (F.col("doc_id") % 3).cast("int").alias("images_count"),
        (F.col("doc_id") % 4 != 0).alias("is_verified"),
        F.date_add(F.lit("2023-01-01").cast("date"), (F.col("doc_id") % 720).cast("int")).alias("created_at_date"),
        F.concat(F.lit("c"), (F.col("doc_id") % 77).cast("string")).alias("customer_id"),
        F.col("doc_id").alias("seq"),
    )


REVIEWS_SQL = """reviews AS (
  SELECT CAST(doc_id AS VARCHAR) AS review_id, CAST(doc_id % 200 AS VARCHAR) AS product_id, source AS title,
    text AS content, CAST(1 + doc_id % 5 AS INT) AS rating, CAST(n_chars % 20 AS INT) AS helpful_count,
    CAST(doc_id % 3 AS INT) AS images_count, doc_id % 4 <> 0 AS is_verified,
    DATE '2023-01-01' + CAST(doc_id % 720 AS INT) AS created_at_date,
    'c' || CAST(doc_id % 77 AS VARCHAR) AS customer_id, doc_id AS seq
  FROM documents)"""


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products: one per part, with the number of its items as review_count."""
    part = table(spark, sf_dir, "part")
    counts = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("review_count"))
    return part.join(counts, F.col("p_partkey") == F.col("l_partkey"), "left").select(
        _text("p_partkey").alias("product_id"),
        F.col("p_name").alias("name"),
        F.col("p_retailprice").alias("price"),
        F.col("p_brand").alias("brand"),
        F.concat(F.lit("seller"), (F.col("p_partkey") % 13).cast("string")).alias("seller"),
        F.col("p_type").alias("category_lv2"),
        F.concat_ws("-", "p_type", (F.col("p_size") % 5).cast("string")).alias("category_lv3"),
        ((F.col("p_partkey") % 41).cast("double") / 10 + 1).alias("rating_average"),
        F.coalesce("review_count", F.lit(0)).alias("review_count"),
    )


PRODUCTS_SQL = """products AS (
  SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_name AS name, p_retailprice AS price, p_brand AS brand,
    'seller' || CAST(p_partkey % 13 AS VARCHAR) AS seller, p_type AS category_lv2,
    p_type || '-' || CAST(p_size % 5 AS VARCHAR) AS category_lv3,
    CAST(p_partkey % 41 AS DOUBLE) / 10 + 1 AS rating_average, coalesce(n, 0) AS review_count
  FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON p_partkey = l_partkey)"""


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category rows: 1:N per product, and missing for some products."""
    part = table(spark, sf_dir, "part").filter(F.col("p_partkey") % 25 != 1)
    copies = F.explode(F.sequence(F.lit(0), F.when(F.col("p_partkey") % 10 == 0, 1).otherwise(0))).alias("copy")
    rows = part.select("p_partkey", "p_type", "p_size", copies)
    return rows.select(
        _text("p_partkey").alias("product_id"),
        F.lit(K.SHOP_CATEGORY_LV1).alias("category_lv1"),
        F.col("p_type").alias("category_lv2"),
        F.concat_ws("-", "p_type", ((F.col("p_size") + F.col("copy")) % 5).cast("string")).alias("category_lv3"),
        ((F.col("p_size") + F.col("copy")) % 5).cast("int").alias("category_id"),
    )


CATEGORIES_SQL = """categories AS (
  SELECT CAST(p_partkey AS VARCHAR) AS product_id, 'Mẹ & Bé' AS category_lv1, p_type AS category_lv2,
    p_type || '-' || CAST((p_size + copy) % 5 AS VARCHAR) AS category_lv3, CAST((p_size + copy) % 5 AS INT) AS category_id
  FROM part, (SELECT unnest([0, 1]) AS copy) WHERE p_partkey % 25 <> 1 AND (copy = 0 OR p_partkey % 10 = 0))"""


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(_text("l_partkey").alias("product_id"))
        .agg(F.sum(F.col("l_quantity").cast("bigint")).alias("quantity_sold"))
    )


LISTING_SQL = """listing AS (
  SELECT CAST(l_partkey AS VARCHAR) AS product_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity_sold
  FROM lineitem GROUP BY 1)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shopper questions: one per user turn, tagged with a topic phrase.

    The turns hold invented words only, so the event type of the same number
    decides which phrase is put in front.
    """
    conv = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    phrases = F.array(*[F.lit(p) for p in QUESTION_PHRASES])
    pick = F.element_at(phrases, ((F.col("conv_id") * 3 + F.col("turn")) % len(QUESTION_PHRASES) + 1).cast("int"))
    return conv.select(
        F.concat_ws("-", "conv_id", "turn").alias("question_id"),
        (F.col("conv_id") % 200).cast("string").alias("product_id"),
        F.concat_ws(" ", pick, F.col("text")).alias("question"),
    )


QUESTION_PHRASES = [
    "Tóm tắt giúp mình,", "Có bị tràn không?", "Mọi người phàn nàn gì?", "Có rủi ro gì không?", "Có nên mua không?",
    "Phù hợp với da nhạy cảm không?", "Giá có đáng tiền?", "Giao hàng và đóng gói ổn?", "Chất liệu mềm, size vừa?", "",
]

QUESTIONS_SQL = """questions AS (
  SELECT concat_ws('-', CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR)) AS question_id,
    CAST(conv_id % 200 AS VARCHAR) AS product_id,
    concat_ws(' ', list_extract([{phrases}], CAST((conv_id * 3 + turn) % {n} + 1 AS INT)), text) AS question
  FROM conversations WHERE role = 'user')""".format(
    phrases=", ".join(f"'{p}'" for p in QUESTION_PHRASES), n=len(QUESTION_PHRASES)
)


def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat labelled quadruples of two annotators, keyed by review."""
    items = aspect_items(spark, sf_dir)
    return items.select(
        "review_id",
        "annotator",
        F.concat(F.lit("term"), (F.col("helpful_count") % 3).cast("string")).alias("aspect_term"),
        F.col("aspect").alias("aspect_category"),
        F.concat(F.lit("op"), (F.col("rating") % 2).cast("string")).alias("opinion_term"),
        "sentiment",
        "product_id",
        F.col("item_id").alias("pos"),
        "line",
    )


QUADS_SQL = """quads AS (
  SELECT review_id, annotator, 'term' || CAST(helpful_count % 3 AS VARCHAR) AS aspect_term, aspect AS aspect_category,
    'op' || CAST(rating % 2 AS VARCHAR) AS opinion_term, sentiment, product_id, item_id AS pos, line
  FROM items)"""


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated reviews: text, quadruples and conflict flag per order.

    An order has at most seven lines per supplier here, so its list is short.
    """
    q = quads(spark, sf_dir)
    quad = F.struct("pos", "product_id", "aspect_term", "aspect_category", "opinion_term", "sentiment")
    nested = q.groupBy("review_id").agg(
        F.array_sort(F.collect_list(quad)).alias("q"), F.size(F.collect_set("sentiment")).alias("n")
    )
    strip = F.transform(
        "q",
        lambda s: F.struct(
            s["aspect_term"].alias("aspect_term"), s["aspect_category"].alias("aspect_category"),
            s["opinion_term"].alias("opinion_term"), s["sentiment"].alias("sentiment"),
        ),
    )
    words = F.concat_ws(" ", F.flatten(F.transform("q", lambda s: F.array(s["opinion_term"], s["aspect_term"]))))
    return nested.select(
        "review_id",
        F.concat_ws(" ", F.lit("order"), "review_id", F.lit(":"), words).alias("text"),
        strip.alias("quadruples"),
        (F.col("n") > 2).alias("conflict"),
    )


ANNOTATED_SQL = """annotated AS (
  SELECT review_id, 'order ' || review_id || ' : ' || string_agg(opinion_term || ' ' || aspect_term, ' '
      ORDER BY pos, product_id, aspect_term, aspect_category, opinion_term, sentiment) AS text,
    list({{'aspect_term': aspect_term, 'aspect_category': aspect_category, 'opinion_term': opinion_term,
      'sentiment': sentiment}} ORDER BY pos, product_id, aspect_term, aspect_category, opinion_term, sentiment)
      AS quadruples,
    count(DISTINCT sentiment) > 2 AS conflict
  FROM quads GROUP BY review_id)""".replace("{{", "{").replace("}}", "}")
