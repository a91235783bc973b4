"""Registered queries: descriptive statistics, joins, sets and casts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara import constants as K
from opinara.functions import casts as C
from opinara.functions.labels import aspect_label
from opinara.operators import eda as E
from opinara.operators import reviews as RV
from opinara.plans.analytics import ITEMS
from opinara.plans.registry import query, sql_case, with_views
from opinara.plans.texts import WS, clean_sql
from opinara.sources import fixtures as V

DOCS_LABELLED = "docs AS (SELECT d.doc_id, lang, source, n_chars, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id))"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    docs = V.table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(V.table(spark, d, "labels"), "doc_id", "left")


@query("overview", with_views(DOCS_LABELLED, body="""SELECT 'docs' AS dataset, n_rows, 6 AS n_columns, missing_cells,
  round(missing_cells::DOUBLE * 100 / (n_rows * 6) + 1e-9, 2) AS missing_percent FROM (
    SELECT count(*) AS n_rows, 6 * count(*) - count(doc_id) - count(lang) - count(source) - count(n_chars) - count(quality)
      - count(toxic) AS missing_cells FROM docs)"""))
def overview(spark: SparkSession, d: str) -> DataFrame:
    return E.overview(_docs(spark, d), "docs")


@query("missing_by_column", with_views(DOCS_LABELLED, body="""SELECT * FROM (
  SELECT 'quality' AS column, count(*) - count(quality) AS missing, round((count(*) - count(quality))::DOUBLE * 100 / count(*) + 1e-9, 2) AS percent FROM docs
  UNION ALL SELECT 'toxic', count(*) - count(toxic), round((count(*) - count(toxic))::DOUBLE * 100 / count(*) + 1e-9, 2) FROM docs
  UNION ALL SELECT 'lang', count(*) - count(lang), round((count(*) - count(lang))::DOUBLE * 100 / count(*) + 1e-9, 2) FROM docs)
  WHERE missing > 0"""))
def missing_by_column(spark: SparkSession, d: str) -> DataFrame:
    return E.missing_by_column(_docs(spark, d))


@query("review_facts", with_views(V.REVIEWS_SQL, body="""SELECT count(*) AS reviews,
  round(sum(rating)::DOUBLE / count(*) + 1e-9, 2) AS mean_rating, count(*) FILTER (WHERE images_count > 0) AS with_images,
  count(*) FILTER (WHERE is_verified) AS verified, min(rating) AS min_rating, max(rating) AS max_rating,
  round(count(*) FILTER (WHERE images_count > 0)::DOUBLE * 100 / count(*) + 1e-9, 1) AS with_images_percent,
  round(count(*) FILTER (WHERE is_verified)::DOUBLE * 100 / count(*) + 1e-9, 1) AS verified_percent,
  count(DISTINCT customer_id) AS customers, count(DISTINCT product_id) AS products FROM reviews"""))
def review_facts(spark: SparkSession, d: str) -> DataFrame:
    return E.review_facts(V.reviews(spark, d))


@query("value_distribution", with_views(V.REVIEWS_SQL, body="""SELECT rating AS value, count(*) AS n,
  round(count(*)::DOUBLE * 100 / (SELECT count(*) FROM reviews) + 1e-9, 1) AS percent FROM reviews GROUP BY 1"""))
def value_distribution(spark: SparkSession, d: str) -> DataFrame:
    return E.value_distribution(V.reviews(spark, d), "rating")


@query("top_brands", "SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def top_brands(spark: SparkSession, d: str) -> DataFrame:
    return E.top_values(V.table(spark, d, "part"), "p_brand", 10)


@query("date_range", with_views(V.REVIEWS_SQL, body="""SELECT min(created_at_date) AS first_date, max(created_at_date) AS last_date,
  CAST(date_diff('day', min(created_at_date), max(created_at_date)) AS INT) AS span_days FROM reviews"""))
def date_range(spark: SparkSession, d: str) -> DataFrame:
    return E.date_range(V.reviews(spark, d), "created_at_date")


@query("categories_per_product", with_views(V.CATEGORIES_SQL, body="""SELECT round(avg(n) + 1e-9, 2) AS mean_categories,
  min(n) AS min_categories, max(n) AS max_categories,
  (SELECT product_id FROM categories GROUP BY 1 ORDER BY count(*) DESC, product_id LIMIT 1) AS example_product
  FROM (SELECT product_id, count(*) AS n FROM categories GROUP BY 1)"""))
def categories_per_product(spark: SparkSession, d: str) -> DataFrame:
    return E.categories_per_product(V.categories(spark, d))


@query("category_histogram", with_views(V.CATEGORIES_SQL, body="""SELECT c AS value, count(*) AS n,
  round(count(*)::DOUBLE * 100 / sum(count(*)) OVER () + 1e-9, 1) AS percent
  FROM (SELECT product_id, count(*) AS c FROM categories GROUP BY 1) GROUP BY c"""))
def category_histogram(spark: SparkSession, d: str) -> DataFrame:
    return E.category_histogram(V.categories(spark, d))


@query("price_describe", with_views(V.PRODUCTS_SQL, body="""SELECT category_lv2, count(*) AS count, round(avg(price), 2) AS mean,
  round(stddev_samp(price), 2) AS std, min(price) AS min, max(price) AS max,
  round(quantile_cont(price, 0.25) + 1e-9, 4) AS q25, round(quantile_cont(price, 0.5) + 1e-9, 4) AS q50,
  round(quantile_cont(price, 0.75) + 1e-9, 4) AS q75 FROM products GROUP BY 1"""))
def price_describe(spark: SparkSession, d: str) -> DataFrame:
    return E.price_describe(V.products(spark, d), "category_lv2", "price")


@query("outlier_cut", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag FROM lineitem
  WHERE l_extendedprice < (SELECT quantile_cont(l_extendedprice, 0.99) FROM lineitem) AND l_returnflag IS NOT NULL""")
def outlier_cut(spark: SparkSession, d: str) -> DataFrame:
    li = V.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag"
    )
    return E.outlier_cut(li, "l_extendedprice", "l_returnflag")


MONTHS = """months AS (SELECT CAST(date_trunc('month', created_at_date) AS DATE) AS month, count(*) AS n FROM reviews GROUP BY 1)"""


@query("monthly_trend", with_views(V.REVIEWS_SQL, MONTHS, body="SELECT * FROM months"))
def monthly_trend(spark: SparkSession, d: str) -> DataFrame:
    return E.monthly_counts(V.reviews(spark, d), "created_at_date")


@query("monthly_extremes", with_views(V.REVIEWS_SQL, MONTHS, body="""SELECT
  (SELECT month FROM months ORDER BY n DESC, month LIMIT 1) AS max_month, max(n) AS max_n,
  (SELECT month FROM months ORDER BY n, month LIMIT 1) AS min_month, min(n) AS min_n, max(month) AS last_month FROM months"""))
def monthly_extremes(spark: SparkSession, d: str) -> DataFrame:
    return E.monthly_extremes(E.monthly_counts(V.reviews(spark, d), "created_at_date"))


@query("yearly_extremes", with_views(V.REVIEWS_SQL, MONTHS, body="""SELECT *, max_n - min_n AS spread,
    round((max_n::DOUBLE / min_n - 1) * 100 + 1e-9, 1) AS spread_percent FROM (
  SELECT CAST(year(month) AS INT) AS year, arg_min(month, (-n, month)) AS max_month, max(n) AS max_n,
    arg_min(month, (n, month)) AS min_month, min(n) AS min_n, round(sum(n)::DOUBLE / count(*) + 1e-9, 2) AS mean_n
  FROM months GROUP BY 1)"""))
def yearly_extremes(spark: SparkSession, d: str) -> DataFrame:
    return E.yearly_extremes(E.monthly_counts(V.reviews(spark, d), "created_at_date"))


SEGMENTS = """segments AS (SELECT *, CASE WHEN rating >= 4 THEN 'positive' ELSE 'negative' END AS segment FROM reviews
  WHERE (rating >= 4 OR rating <= 2) AND content IS NOT NULL)"""


@query("rating_segments", with_views(V.REVIEWS_SQL, SEGMENTS, body="SELECT segment, count(*) AS n FROM segments GROUP BY 1"))
def rating_segments(spark: SparkSession, d: str) -> DataFrame:
    return E.segment_counts(RV.rating_segments(V.reviews(spark, d)))


@query("term_frequency", with_views(V.REVIEWS_SQL, SEGMENTS, body=f"""SELECT segment, term, count(*) AS n FROM (
  SELECT segment, unnest(string_split_regex({clean_sql('content')}, '{WS}+')) AS term FROM segments) WHERE length(term) > 0
  GROUP BY ALL"""))
def term_frequency(spark: SparkSession, d: str) -> DataFrame:
    return E.term_frequency(RV.rating_segments(V.reviews(spark, d)))


@query("potential_score", with_views(V.PRODUCTS_SQL, body="""SELECT product_id, name, brand, rating_average, review_count, price,
    round(s + 1e-9, 6) AS potential_score FROM (
    SELECT *, rating_average * 0.5::DOUBLE + review_count / (SELECT max(review_count)::DOUBLE FROM products) * 0.3::DOUBLE
      + (1 - price / (SELECT max(price) FROM products)) * 0.2::DOUBLE AS s FROM products)
  ORDER BY s DESC, product_id LIMIT 5"""))
def potential_score(spark: SparkSession, d: str) -> DataFrame:
    return E.potential_score(V.products(spark, d))


OVERLAP = """overlap AS (SELECT coalesce(a.product_id, b.product_id) AS product_id,
    CASE WHEN a.product_id IS NULL THEN 'right_only' WHEN b.product_id IS NULL THEN 'left_only' ELSE 'both' END AS side
  FROM (SELECT DISTINCT product_id FROM products) a FULL JOIN (SELECT DISTINCT product_id FROM categories) b USING (product_id))"""


@query("id_overlap", with_views(V.PRODUCTS_SQL, V.CATEGORIES_SQL, OVERLAP, body="SELECT side, count(*) AS n FROM overlap GROUP BY 1"))
def id_overlap(spark: SparkSession, d: str) -> DataFrame:
    return E.id_overlap(V.products(spark, d), V.categories(spark, d))


@query("id_overlap_samples", with_views(V.PRODUCTS_SQL, V.CATEGORIES_SQL, OVERLAP, body="""SELECT product_id, side FROM overlap
  WHERE side <> 'both' QUALIFY row_number() OVER (PARTITION BY side ORDER BY product_id) <= 10"""))
def id_overlap_samples(spark: SparkSession, d: str) -> DataFrame:
    return E.id_overlap_samples(V.products(spark, d), V.categories(spark, d))


@query("eda_merge", with_views(V.PRODUCTS_SQL, V.CATEGORIES_SQL, V.LISTING_SQL, body="""SELECT product_id, name, price, brand,
  c.category_lv1, c.category_lv3, c.category_id AS category_id_x, quantity_sold
  FROM products p LEFT JOIN categories c USING (product_id) LEFT JOIN listing USING (product_id)"""))
def eda_merge(spark: SparkSession, d: str) -> DataFrame:
    detail = V.products(spark, d).select("product_id", "name", "price", "brand")
    cats = V.categories(spark, d).drop("category_lv2")
    return E.eda_merge(detail, cats, V.listing(spark, d))


@query("exclude_categories", with_views(V.PRODUCTS_SQL, V.CATEGORIES_SQL, body="""SELECT p.product_id, c.category_lv3
  FROM products p LEFT JOIN categories c USING (product_id)
  WHERE coalesce(c.category_lv3 NOT IN ('ECONOMY-0', 'SMALL-1', 'LARGE-2'), true)"""))
def exclude_categories(spark: SparkSession, d: str) -> DataFrame:
    joined = V.products(spark, d).select("product_id").join(
        V.categories(spark, d).select("product_id", "category_lv3"), "product_id", "left"
    )
    return RV.exclude_categories(joined, "category_lv3", ["ECONOMY-0", "SMALL-1", "LARGE-2"])


@query("unseen_reviews", with_views(V.REVIEWS_SQL, body="""SELECT review_id, product_id FROM reviews r WHERE NOT EXISTS (
  SELECT 1 FROM labels l WHERE CAST(l.doc_id AS VARCHAR) = r.review_id)"""))
def unseen_reviews(spark: SparkSession, d: str) -> DataFrame:
    seen = V.table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("review_id"))
    return RV.unseen(V.reviews(spark, d).select("review_id", "product_id"), seen, ["review_id"])


MESSY = """messy AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber
    WHEN 1 THEN ' ' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ' ' WHEN 2 THEN 'nan' WHEN 3 THEN '' WHEN 4 THEN 'None'
    WHEN 5 THEN 'x' || CAST(l_partkey AS VARCHAR) WHEN 6 THEN CAST(l_partkey AS VARCHAR) || '.75' END AS raw FROM lineitem)"""


def _messy(spark: SparkSession, d: str) -> DataFrame:
    n, part = F.col("l_linenumber"), F.col("l_partkey").cast("string")
    raw = (
        F.when(n == 1, F.concat(F.lit(" "), F.col("l_quantity").cast("bigint").cast("string"), F.lit(" ")))
        .when(n == 2, "nan").when(n == 3, "").when(n == 4, "None")
        .when(n == 5, F.concat(F.lit("x"), part))
        .when(n == 6, F.concat(part, F.lit(".75")))
    )
    return V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", raw.alias("raw"))


@query("safe_casts", with_views(MESSY, body="""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  coalesce(TRY_CAST(p AS DOUBLE), 0.0) AS as_double, coalesce(CAST(trunc(TRY_CAST(p AS DOUBLE)) AS BIGINT), 0) AS as_long,
  coalesce(p, '') AS as_string
  FROM (SELECT *, CASE WHEN trim(raw) NOT IN ('', 'nan', 'None') THEN trim(raw) END AS p FROM messy)"""))
def safe_casts(spark: SparkSession, d: str) -> DataFrame:
    return _messy(spark, d).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", C.safe_double("raw").alias("as_double"),
        C.safe_long("raw").alias("as_long"), C.safe_string("raw").alias("as_string"),
    )


@query("to_numeric", with_views(MESSY, body="""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN raw = 'nan' THEN 'nan'::DOUBLE ELSE TRY_CAST(trim(raw) AS DOUBLE) END AS raw FROM messy"""))
def to_numeric(spark: SparkSession, d: str) -> DataFrame:
    return C.to_numeric(_messy(spark, d), ["raw", "absent_column"])


@query("price_parse", r"""SELECT p_partkey, TRY_CAST(trim(regexp_replace(t, '[,. đ₫]|VND', '', 'g')) AS DOUBLE) AS price,
    TRY_CAST(nullif(regexp_extract(replace(t, ',', ''), '(\d+)', 1), '') AS DOUBLE) AS first_number
  FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS VARCHAR) || '.290.000 đ' WHEN 1 THEN CAST(p_size AS VARCHAR) || ',500 VND'
    WHEN 2 THEN 'contact ' || p_name ELSE CAST(p_size AS VARCHAR) || '₫' END AS t FROM part)""")
def price_parse(spark: SparkSession, d: str) -> DataFrame:
    size, kind = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    t = (
        F.when(kind == 0, F.concat(size, F.lit(".290.000 đ"))).when(kind == 1, F.concat(size, F.lit(",500 VND")))
        .when(kind == 2, F.concat(F.lit("contact "), "p_name")).otherwise(F.concat(size, F.lit("₫")))
    )
    rows = V.table(spark, d, "part").select("p_partkey", t.alias("t"))
    return rows.select("p_partkey", C.price_from_text("t").alias("price"), C.first_digits("t").alias("first_number"))


@query("fix_scientific", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 3 = 0
    THEN CAST(CAST(l_partkey * 1000 AS HUGEINT) AS VARCHAR) WHEN l_linenumber % 3 = 1 THEN CAST(l_partkey AS VARCHAR)
    ELSE 'sku-' || CAST(l_partkey AS VARCHAR) END AS product_id FROM lineitem""")
def fix_scientific(spark: SparkSession, d: str) -> DataFrame:
    part, kind = F.col("l_partkey").cast("string"), F.col("l_linenumber") % 3
    raw = F.when(kind == 0, F.concat(part, F.lit("E+03"))).when(kind == 1, part).otherwise(F.concat(F.lit("sku-"), part))
    rows = V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", raw.alias("product_id"))
    return rows.withColumn("product_id", C.fix_scientific("product_id"))


@query("tidy_strings", """SELECT doc_id, trim(replace(regexp_replace(text, '[\\n\\r]', ' ', 'g'), '"', '')) AS text, lang, source, n_chars
  FROM documents""")
def tidy_strings(spark: SparkSession, d: str) -> DataFrame:
    return C.tidy_strings(V.table(spark, d, "documents"))


@query("rating_labels", with_views(V.REVIEWS_SQL, body="""SELECT review_id, CASE rating WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2
  WHEN 4 THEN 3 END AS label FROM reviews"""))
def rating_labels(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ["very_negative", "negative", "neutral", "positive", "unknown"]])
    rows = V.reviews(spark, d).select("review_id", F.element_at(names, F.col("rating")).alias("sentiment_label"))
    return rows.select("review_id", C.rating_label("sentiment_label", K.RATING_LABELS).alias("label"))


@query("aspect_labels", with_views(ITEMS, body=f"""SELECT item_id, product_id,
  {sql_case('aspect', K.ASPECT_LABELS, f"'{K.UNKNOWN_ASPECT_LABEL}'")} AS label FROM items"""))
def aspect_labels(spark: SparkSession, d: str) -> DataFrame:
    return V.aspect_items(spark, d).select("item_id", "product_id", aspect_label(F.col("aspect")).alias("label"))


@query("annotation_stats", with_views(ITEMS, V.QUADS_SQL, V.ANNOTATED_SQL, body="""
  SELECT 'category' AS kind, aspect_category AS value, count(*) AS n FROM quads GROUP BY ALL
  UNION ALL SELECT 'sentiment', sentiment, count(*) FROM quads GROUP BY ALL
  UNION ALL SELECT 'reviews', 'all', count(DISTINCT review_id) FROM quads"""))
def annotation_stats(spark: SparkSession, d: str) -> DataFrame:
    return E.annotation_stats(V.annotated(spark, d))
