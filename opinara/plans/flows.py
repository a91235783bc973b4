"""Registered queries: payloads, files, upserts, streams and whole jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara import constants as K
from opinara.functions import text as X
from opinara.operators import aspects as A
from opinara.operators import retrieval as RT
from opinara.operators.risk import detect_risks
from opinara.plans import jobs
from opinara.plans.analytics import ASPECT_TABLE, ITEMS, ITEMS_T, PURCHASE, RISKS
from opinara.plans.answers import CHUNKS, hashing_embedder
from opinara.plans.labelling import COUNTS, FULL, KAPPA_SQL, PAIRS, PARTIAL, POS, QUADS, SENTIMENT_ROWS, SENTIMENT_SQL, _f1_sql, _match_sql, _prf_sql, _reviewed, _sides
from opinara.plans.registry import query, with_views
from opinara.plans.texts import CLEANED, LEXICON
from opinara.plans.training import SPLIT, _draw
from opinara.session import materialise, scratch_dir
from opinara.sources import fixtures as V
from opinara.sources import payloads as P
from opinara.sources import readers as RD
from opinara.sources import writers as W
from opinara.sources.store import VersionedTable
from opinara.streaming import ingest as ST


# ------------------------------------------------------------ payloads
def _product_payloads(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_partkey")
    sometimes = lambda k, c: F.when(n % k != 0, c)
    attr = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    size = F.col("p_size").cast("string")
    specs = F.array(
        F.struct(F.array(attr("type", F.col("p_type")), attr("size", size)).alias("attributes")),
        F.struct(F.array(attr("type", F.col("p_brand")), attr("", size), attr("empty", F.lit(""))).alias("attributes")),
    )
    images = F.transform(F.sequence(F.lit(0), F.col("p_size") % 9), lambda i: F.struct(
        F.when(i % 4 == 1, "").otherwise(F.concat(F.lit("img"), i.cast("string"))).alias("base_url")
    ))
    body = F.struct(
        n.cast("string").alias("id"), F.concat(F.lit("sku"), n.cast("string")).alias("sku"), F.col("p_name").alias("name"),
        F.col("p_retailprice").alias("price"), sometimes(3, F.col("p_retailprice") + 10).alias("list_price"),
        sometimes(4, F.struct(F.col("p_size").alias("qty"))).alias("stock_item"),
        sometimes(5, F.struct(F.lit("b").alias("id"), F.col("p_brand").alias("name"))).alias("brand"),
        F.when(n % 2 == 0, F.concat(F.lit(K.SHOP_URL + "x-p"), n.cast("string"), F.lit(".html"))).otherwise("").alias("short_url"),
        F.concat(F.lit("<div><p>"), "p_name", F.lit("</p><script>x</script>&amp; <b>"), "p_type", F.lit("</b></div>")).alias("description"),
        specs.alias("specifications"),
        sometimes(7, F.struct(F.lit("s").alias("name"), (n % 2 == 0).alias("is_official"))).alias("current_seller"),
        images.alias("images"),
        F.array(*[F.struct(c.alias("name")) for c in (F.lit("Mẹ & Bé"), F.col("p_type"))]).alias("breadcrumbs"),
    )
    return V.table(spark, d, "part").select(F.to_json(body).alias("payload"), n.alias("n"), F.col("p_size").alias("sold"))


@query("flatten_product", f"""SELECT CAST(p_partkey AS VARCHAR) AS product_id, 'sku' || CAST(p_partkey AS VARCHAR) AS sku, p_name AS name, p_retailprice AS price,
  CASE WHEN p_partkey % 3 <> 0 THEN p_retailprice + 10 END AS list_price, CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_size AS BIGINT) END AS stock_qty,
  CASE WHEN p_partkey % 5 <> 0 THEN p_brand END AS brand_name,
  CASE WHEN p_partkey % 2 = 0 THEN '{K.SHOP_URL}x-p' || CAST(p_partkey AS VARCHAR) || '.html' ELSE '{K.SHOP_URL}p/' || CAST(p_partkey AS VARCHAR) END AS product_url,
  p_name || ' & ' || p_type AS description, '{{"type":"' || p_brand || '","size":"' || CAST(p_size AS VARCHAR) || '"}}' AS specifications,
  CASE WHEN p_partkey % 7 <> 0 THEN 's' END AS seller_name, p_partkey % 7 <> 0 AND p_partkey % 2 = 0 AS seller_is_official FROM part""")
def flatten_product(spark: SparkSession, d: str) -> DataFrame:
    out = P.flatten_products(_product_payloads(spark, d))
    return out.select(
        "product_id", "sku", "name", "price", "list_price", "stock_qty", "brand_name", "product_url", "description", "specifications",
        "seller_name", "seller_is_official",
    )


@query("flatten_product_page", """SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_name AS name, CAST(trunc(p_retailprice) AS BIGINT) AS price,
  CAST(trunc(CASE WHEN p_partkey % 3 <> 0 THEN p_retailprice + 10 ELSE p_retailprice END) AS BIGINT) AS original_price, CAST(p_size AS BIGINT) AS sold_quantity,
  'img0' AS thumbnail_url, array_to_string(list_transform(list_filter(range(0, p_size % 9 + 1), lambda i: i % 4 <> 1), lambda i: 'img' || CAST(i AS VARCHAR)), '|') AS images,
  'Mẹ & Bé' AS category_lv1, p_type AS category_lv2, '' AS category_lv3 FROM part""")
def flatten_product_page(spark: SparkSession, d: str) -> DataFrame:
    rows = _product_payloads(spark, d)
    sold = F.col("sold").cast("string")
    quantity = F.when(F.col("n") % 2 == 0, F.concat(F.lit('{"value": '), sold, F.lit("}"))).otherwise(sold)
    payload = F.concat(F.expr("substring(payload, 1, length(payload) - 1)"), F.lit(', "quantity_sold": '), quantity, F.lit("}"))
    out = P.flatten_product_pages(rows.select(payload.alias("payload")))
    return out.select(
        "product_id", "name", "price", "original_price", "sold_quantity", "thumbnail_url", F.array_join("images", "|").alias("images"),
        "category_lv1", "category_lv2", "category_lv3",
    )


@query("flatten_listing", """SELECT CAST(p_size % 5 AS INT) AS category_id, CAST(p_partkey AS VARCHAR) AS product_id, p_name AS product_name,
  CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size END::BIGINT AS quantity_sold FROM part""")
def flatten_listing(spark: SparkSession, d: str) -> DataFrame:
    part = V.table(spark, d, "part")
    item = F.struct(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"),
        F.when(F.col("p_partkey") % 3 != 0, F.struct(F.col("p_size").alias("value"), F.lit("x").alias("text"))).alias("quantity_sold"),
    )
    page = F.to_json(F.struct(F.array(item, item).alias("data")))
    pages = part.select(page.alias("payload"), (F.col("p_size") % 5).cast("int").alias("cat"))
    pages = pages.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("page"))
    pages = pages.withColumn("category_id", F.when(F.col("page") == 1, F.col("cat")).otherwise(F.col("cat") + 1))
    pages = materialise(pages.select("payload", "page", "category_id"), "listing-pages")
    return P.flatten_listing(pages, ["page", "category_id"]).drop("quantity_sold_text")


@query("flatten_reviews", """SELECT CAST(event_id AS VARCHAR) AS review_id, CAST(user_id AS VARCHAR) AS product_id, epoch(ts)::BIGINT AS created_at_ts,
    strftime(ts, '%Y-%m-%d') AS created_at_date, CASE WHEN user_id % 3 <> 0 THEN strftime(to_timestamp(bought), '%Y-%m-%d') END AS purchased_at_date,
    CASE WHEN user_id % 3 <> 0 THEN CAST(trunc((sec - bought) / 86400.0) AS INT) END AS days_since_purchase, user_id % 3 <> 0 AS is_verified,
    CAST(event_id % 4 AS INT) AS images_count, CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS INT) ELSE 0 END AS helpful_count
  FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS sec, CAST(floor(epoch(ts)) AS BIGINT) - CAST(trunc(value * 10000) AS BIGINT) AS bought FROM events)
""".replace("epoch(ts)::BIGINT AS created_at_ts", "sec AS created_at_ts"))
def flatten_reviews(spark: SparkSession, d: str) -> DataFrame:
    sec = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("bigint")
    bought = sec - (F.col("value") * 10000).cast("bigint")
    body = F.struct(
        F.col("event_id").cast("string").alias("id"), sec.alias("created_at"),
        F.when(F.col("event_id") % 2 == 0, F.col("user_id")).alias("thank_count"),
        F.slice(F.array(*[F.lit("i")] * 3), F.lit(1), (F.col("event_id") % 4).cast("int")).alias("images"),
        F.struct(F.col("user_id").cast("string").alias("id"), F.when(F.col("user_id") % 3 != 0, bought).alias("purchased_at")).alias("created_by"),
    )
    rows = V.table(spark, d, "events").select(F.col("user_id").cast("string").alias("product_id"), F.to_json(body).alias("payload"))
    return P.flatten_reviews(rows).select(
        "review_id", "product_id", "created_at_ts", "created_at_date", "purchased_at_date", "days_since_purchase", "is_verified",
        "images_count", "helpful_count",
    )


@query("category_tree", """SELECT 'Mẹ & Bé' AS category_lv1, p_type AS category_lv2, p_type || '-' || CAST(p_size % 5 AS VARCHAR) AS category_lv3,
  p_type || '/' || CAST(p_size % 5 AS VARCHAR) AS category_id, p_partkey AS product_id FROM part WHERE p_type IN ('ECONOMY', 'SMALL')""")
def category_tree(spark: SparkSession, d: str) -> DataFrame:
    part = V.table(spark, d, "part")
    size = (F.col("p_size") % 5).cast("string")
    level2 = part.select(F.col("p_type").alias("id"), F.col("p_type").alias("name")).distinct()
    level3 = part.select(F.concat_ws("/", "p_type", size).alias("id"), F.concat_ws("-", "p_type", size).alias("name"), F.col("p_type").alias("parent_id")).distinct()
    rows = part.select(F.concat_ws("/", "p_type", size).alias("category_id"), F.col("p_partkey").alias("product_id"))
    return P.category_tree(level2, level3, rows, ["ECONOMY", "SMALL"])


# ------------------------------------------------------------ files
@query("multiline_csv", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, replace(text, chr(10), ' ') AS text, source FROM documents")
def multiline_csv(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_dir(spark, "csv")
    W.write_quoted_csv(V.table(spark, d, "documents").select("doc_id", "text", "source"), path)
    return RD.read_multiline_csv(spark, path, "doc_id string, text string, source string")


@query("string_csv", "SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CASE WHEN l_linenumber = 3 THEN '' ELSE l_returnflag END AS flag, '' AS absent FROM lineitem")
def string_csv(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_dir(spark, "csv")
    flag = F.when(F.col("l_linenumber") != 3, F.col("l_returnflag"))
    rows = V.table(spark, d, "lineitem").select("l_orderkey", flag.alias("flag"), F.lit(None).cast("string").alias("absent"))
    rows.write.option("header", True).csv(path)
    return RD.read_string_csv(spark, path, ["l_orderkey", "flag", "absent"])


@query("json_lines", "SELECT event_id, event_type FROM events WHERE event_id % 10 <> 7")
def json_lines(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_dir(spark, "jsonl")
    good = F.to_json(F.struct("event_id", "event_type"))
    kind = F.col("event_id") % 10
    line = F.when(kind == 7, F.expr("substring(to_json(struct(event_id, event_type)), 1, 12)")).when(kind == 3, F.concat(good, F.lit("\n\n"))).otherwise(good)
    V.table(spark, d, "events").select(line.alias("value")).write.text(path)
    return RD.read_json_lines(spark, path, "event_id bigint, event_type string")[0]


@query("json_lines_bad", "SELECT count(*) AS bad_lines FROM events WHERE event_id % 10 = 7")
def json_lines_bad(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_id") % 10
    line = F.when(kind == 7, F.expr("substring(to_json(struct(event_id, event_type)), 1, 12)")).otherwise(F.to_json(F.struct("event_id", "event_type")))
    lines = V.table(spark, d, "events").select(line.alias("value"))
    return RD.split_json_lines(lines, "value", "event_id bigint, event_type string")[1].agg(F.count("*").alias("bad_lines"))


@query("raw_payload", with_views(V.PRODUCTS_SQL, body="""SELECT product_id, '{"product_id":"' || product_id || '","name":"' || name || '","brand":"' || brand || '"}' AS raw_payload FROM products"""))
def raw_payload(spark: SparkSession, d: str) -> DataFrame:
    return W.with_payload(V.products(spark, d).select("product_id", "name", "brand")).select("product_id", "raw_payload")


@query("stored_products", with_views(V.PRODUCTS_SQL, V.CATEGORIES_SQL, body="""SELECT CAST(o_custkey AS VARCHAR) AS product_id, coalesce(name, '') AS name,
    coalesce(CAST(trunc(price) AS BIGINT), 0) AS price, coalesce(brand, '') AS brand_name, rating_average, coalesce(c.category_lv3, '') AS category_lv3
  FROM (SELECT DISTINCT o_custkey FROM orders) LEFT JOIN products p ON p.product_id = CAST(o_custkey AS VARCHAR)
  LEFT JOIN (SELECT product_id, min(category_lv3) AS category_lv3 FROM categories GROUP BY 1) c ON c.product_id = CAST(o_custkey AS VARCHAR)"""))
def stored_products(spark: SparkSession, d: str) -> DataFrame:
    wanted = V.table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("product_id"))
    out = RD.stored_products(wanted, V.products(spark, d), V.categories(spark, d))
    return out.select("product_id", "name", "price", "brand_name", "rating_average", "category_lv3")


@query("stored_reviews", with_views(V.REVIEWS_SQL, body="""SELECT review_id, product_id, CAST(rating AS BIGINT) AS rating, CAST(helpful_count AS BIGINT) AS helpful_count
  FROM reviews WHERE product_id IN (SELECT CAST(o_custkey AS VARCHAR) FROM orders)"""))
def stored_reviews(spark: SparkSession, d: str) -> DataFrame:
    wanted = V.table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("product_id"))
    return RD.stored_reviews(V.reviews(spark, d), wanted).select("review_id", "product_id", "rating", "helpful_count")


@query("product_context", with_views(ITEMS_T, RISKS, V.PRODUCTS_SQL, V.REVIEWS_SQL, body="""SELECT f.*, p.name AS product_name FROM (
    SELECT product_id, 'review' AS section, review_id, NULL AS aspect, NULL AS sentiment, NULL AS risk_type, NULL AS severity, rating, NULL::DOUBLE AS confidence, content AS text FROM reviews
    UNION ALL SELECT i.product_id, 'aspect', coalesce(r.review_id, ''), aspect, sentiment, NULL, NULL, NULL, confidence::DOUBLE, sentence
      FROM items i LEFT JOIN reviews r ON i.product_id = r.product_id AND i.review_id = r.review_id
    UNION ALL SELECT product_id, 'risk', NULL, NULL, NULL, risk_type, severity, NULL, confidence, evidence FROM risks) f
  JOIN products p USING (product_id)"""))
def product_context(spark: SparkSession, d: str) -> DataFrame:
    items = V.aspect_items(spark, d, with_sentence=True)
    return RD.product_context(V.products(spark, d), V.reviews(spark, d), items, detect_risks(items))


# ------------------------------------------------------------ upserts
def _stages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Reviews in two loads; the second repeats some keys with a new rating."""
    rows = V.reviews(spark, d).select("product_id", "review_id", "rating", "seq")
    first = rows.filter(F.col("seq") % 3 != 0)
    return first, rows.filter(F.col("seq") % 2 == 0).withColumn("rating", F.col("rating") + 10)


@query("upsert_reviews", with_views(V.REVIEWS_SQL, body="""SELECT product_id, review_id, CASE WHEN seq % 2 = 0 THEN rating + 10 ELSE rating END AS rating, seq
  FROM reviews WHERE seq % 3 <> 0 OR seq % 2 = 0"""))
def upsert_reviews(spark: SparkSession, d: str) -> DataFrame:
    table = VersionedTable(spark, scratch_dir(spark, "reviews"), ["product_id", "review_id"])
    for rows in _stages(spark, d):
        table.upsert(rows, ["seq"])
    return table.read()


@query("upsert_chunks", with_views(ITEMS_T, CHUNKS, body="""SELECT point_id, product_id, review_id, aspect, sentiment, text,
    CASE sentiment WHEN 'neutral' THEN confidence ELSE confidence + 1 END AS confidence, aspect_label FROM chunks"""))
def upsert_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks come in two batches that share one sentiment, the last of them twice; the newer confidence stays."""
    table = VersionedTable(spark, scratch_dir(spark, "chunks"), ["product_id", "point_id"])
    chunks = RT.opinion_chunks(V.aspect_items(spark, d, with_sentence=True), stored=True)
    newer = chunks.filter("sentiment <> 'neutral'").withColumn("confidence", F.col("confidence") + 1)
    for batch in (chunks.filter("sentiment <> 'negative'"), newer, newer):
        table.upsert(batch, ["confidence"])
    return table.read()


@query("replace_aspects", with_views(ITEMS, ASPECT_TABLE, body="""SELECT product_id, aspect, CASE WHEN CAST(product_id AS BIGINT) % 2 = 0 THEN -mentions ELSE mentions END AS mentions
  FROM aspect_table WHERE CAST(product_id AS BIGINT) % 4 <> 0"""))
def replace_aspects(spark: SparkSession, d: str) -> DataFrame:
    stored = VersionedTable(spark, scratch_dir(spark, "aspects"), group="product_id")
    table = materialise(A.aspect_table(V.aspect_items(spark, d)).select("product_id", "aspect", "mentions"), "aspect-rows")
    even = F.col("product_id").cast("bigint") % 2 == 0
    stored.replace(table, table.select("product_id"))
    # the even products come again: negated, and those divisible by four lose their rows
    again = table.filter(even & (F.col("product_id").cast("bigint") % 4 != 0)).withColumn("mentions", -F.col("mentions"))
    stored.replace(again, table.filter(even).select("product_id"))
    return stored.read()


# ------------------------------------------------------------ streams
def _batches(spark: SparkSession, parts: list[DataFrame]) -> DataFrame:
    """A stream with one micro-batch per table: files are read in the order of their times, and a batch takes as many as each table has.

    There are the more files the larger the tables are, so that all cores write and read them.
    """
    path, files = f"{scratch_dir(spark, 'batches')}/files", max(4, *(part.rdd.getNumPartitions() for part in parts))
    for part in parts:
        part.repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", files).parquet(path)


def _event_stream(spark: SparkSession, d: str, batches: int = 3, again: bool = False) -> DataFrame:
    """The events in order of time, in several micro-batches; ``again`` sends the first of them once more, as round 1, in the end."""
    events = V.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    at = F.col("ts").cast("double")
    cuts = events.agg(F.percentile_approx(at, [i / batches for i in range(1, batches)])).first()[0] or []
    part = sum((at > c).cast("int") for c in cuts) if cuts else F.lit(0)
    parts = [events.filter(part == i).withColumn("round", F.lit(0)) for i in range(batches)]
    return _batches(spark, [*parts, parts[0].withColumn("round", F.lit(1))] if again else parts).drop(*[] if again else ["round"])


@query("stream_ingest", "SELECT event_id, user_id, event_type FROM events")
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_dir(spark, "stream")
    events = _event_stream(spark, d, again=True).select(F.col("user_id").cast("string").alias("product_id"), "event_id", "user_id", "event_type")
    # every row arrives twice in its batch, and the first batch's rows once more in the last
    ST.ingest_once(events.union(events), f"{path}/table", f"{path}/checkpoint", ["product_id", "event_id"]).awaitTermination()
    return spark.read.parquet(f"{path}/table").select("event_id", "user_id", "event_type")


@query("stream_first_rows", "SELECT event_id, user_id, '1 ' || event_type AS event_type, ts FROM events")
def stream_first_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of one key differ; the first of the first batch stays, type and time of day unchanged."""
    path = scratch_dir(spark, "stream")
    events = _event_stream(spark, d, again=True).select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"), "round")
    marked = lambda n: events.withColumn("event_type", F.concat(F.col("round") + n, F.lit(" "), "event_type"))
    rows = marked(2).union(marked(1)).drop("round")
    ST.ingest_once(rows, f"{path}/table", f"{path}/checkpoint", ["event_id"], ["event_type"]).awaitTermination()
    return spark.read.parquet(f"{path}/table").select("event_id", "user_id", "event_type", "ts")


@query("stream_dedupe", "SELECT event_id, event_type FROM events")
def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_dir(spark, "stream")
    events = _event_stream(spark, d).select("event_id", "event_type", "ts")
    rows = ST.dedupe_within(events.union(events), "ts", ["event_id"], "60 days")
    ST.annotate_stream(rows, lambda batch: batch, f"{path}/table", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/table").select("event_id", "event_type")


@query("stream_annotate", """SELECT event_id, CASE WHEN event_type IN ('error') THEN 'negative' WHEN event_type IN ('purchase') THEN 'positive' ELSE 'neutral' END AS sentiment FROM events""")
def stream_annotate(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_dir(spark, "stream")

    def annotate(batch: DataFrame) -> DataFrame:
        kind = F.when(F.col("event_type") == "error", "negative").when(F.col("event_type") == "purchase", "positive").otherwise("neutral")
        return batch.select("event_id", kind.alias("sentiment"))

    ST.annotate_stream(_event_stream(spark, d), annotate, f"{path}/table", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/table").select("event_id", "sentiment")


CHANGED = "WHEN item_id % 3 = 0 THEN 'positive' ELSE sentiment"
CHANGED_ITEMS = f"""changed AS (SELECT * REPLACE (
    CASE WHEN item_id % 5 = 1 THEN 'moved' ELSE product_id END AS product_id, CASE {CHANGED} END AS sentiment, CASE WHEN item_id % 3 = 0 THEN 1 ELSE sentiment_score END AS sentiment_score)
  FROM items WHERE item_id % 7 <> 2)"""


@query("stream_refresh", with_views(ITEMS, CHANGED_ITEMS, ASPECT_TABLE.replace("FROM items", "FROM changed"), body="SELECT * FROM aspect_table"))
def stream_refresh(spark: SparkSession, d: str) -> DataFrame:
    """Items are inserted, moved to one hot product or given another sentiment, and deleted; a batch comes twice, an old change late."""
    path = scratch_dir(spark, "stream")
    columns = ["item_id", "product_id", "aspect", "sentiment", "sentiment_score", "weight"]
    items = V.aspect_items(spark, d).select(*columns).withColumns({"key": F.concat_ws(":", "item_id", "product_id", "sentiment", "weight"), "version": F.lit(1), "deleted": F.lit(False)})
    i, two = F.col("item_id"), F.lit(2)
    new = items.withColumns({
        "product_id": F.when(i % 5 == 1, "moved").otherwise(F.col("product_id")), "version": two,
        "sentiment": F.when(i % 3 == 0, "positive").otherwise(F.col("sentiment")), "sentiment_score": F.when(i % 3 == 0, 1).otherwise(F.col("sentiment_score")),
    }).filter((i % 5 == 1) | (i % 3 == 0))
    gone = items.filter(i % 7 == 2).withColumns({"version": F.lit(3), "deleted": F.lit(True)})
    late = items.filter(i % 2 == 0)
    stream = _batches(spark, [items.filter(i % 4 != 0), items.filter(i % 4 == 0).unionByName(new), new, gone, late])
    table = VersionedTable(spark, f"{path}/table", ["product_id", "aspect"], sums=A.MEASURES)
    ST.refresh_sums(stream, "key", "version", "deleted", A.aspect_measures, table, f"{path}/checkpoint").awaitTermination()
    return A.aspect_table_of_sums(table.read())


@query("stream_replace", "SELECT CAST(user_id AS VARCHAR) AS product_id, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1")
def stream_replace(spark: SparkSession, d: str) -> DataFrame:
    """Figures that do not add up are recomputed for the products of a batch and replaced."""
    path = scratch_dir(spark, "stream")
    stored = V.table(spark, d, "events").select(F.col("user_id").cast("string").alias("product_id"), "event_type")

    def recompute(ids: DataFrame) -> DataFrame:
        return stored.join(ids, "product_id", "left_semi").groupBy("product_id").agg(F.count_distinct("event_type").alias("kinds"))

    table = VersionedTable(spark, f"{path}/table", group="product_id")
    ST.refresh_products(_event_stream(spark, d).select(F.col("user_id").cast("string").alias("product_id")), recompute, table, f"{path}/checkpoint").awaitTermination()
    return table.read()


@query("stream_monthly", "SELECT CAST(date_trunc('month', ts) AS DATE) AS month, count(*) AS n FROM events GROUP BY 1")
def stream_monthly(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_dir(spark, "stream")
    ST.keep_latest(ST.monthly_counts(_event_stream(spark, d), "ts"), f"{path}/table", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/table")


@query("stream_windows", """SELECT CAST(strftime(date_trunc('day', ts), '%Y-%m-%d') AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY 1""")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_dir(spark, "stream")
    counts = ST.windowed_counts(_event_stream(spark, d), "ts")
    ST.keep_updates(counts, f"{path}/table", f"{path}/checkpoint").awaitTermination()
    last = ST.latest(spark.read.parquet(f"{path}/table"), "window_start", "n")
    return last.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "n")


# ------------------------------------------------------------ jobs
@query("analyze_products")
def analyze_products(spark: SparkSession, d: str) -> DataFrame:
    return jobs.analyze_products(V.reviews(spark, d), V.products(spark, d), V.categories(spark, d), V.listing(spark, d))


@query("purchase_advice", with_views(ITEMS_T, RISKS, PURCHASE, body="""SELECT s.*, coalesce(n_risks, 0)::INT AS n_risks, coalesce(neg, 0)::INT AS n_objections,
    coalesce(pos, 0)::INT AS n_reasons, least(5, coalesce(neg, 0) + coalesce(pos, 0))::INT AS n_evidence
  FROM scores s LEFT JOIN (SELECT product_id, least(3, count(*)) AS n_risks FROM risks GROUP BY 1) USING (product_id)
  LEFT JOIN (SELECT product_id, least(3, count(*) FILTER (WHERE sentiment = 'negative')) AS neg, least(3, count(*) FILTER (WHERE sentiment = 'positive')) AS pos
    FROM items GROUP BY 1) USING (product_id)"""))
def purchase_advice(spark: SparkSession, d: str) -> DataFrame:
    out = jobs.purchase_advice(V.aspect_items(spark, d, with_sentence=True))
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    return out.select(
        "product_id", "label", "score", "confidence", n("risks").alias("n_risks"), n("objections").alias("n_objections"),
        n("reasons").alias("n_reasons"), n("evidence").alias("n_evidence"),
    )


@query("answer_questions")
def answer_questions(spark: SparkSession, d: str) -> DataFrame:
    return jobs.answer_questions(V.questions(spark, d), V.aspect_items(spark, d, with_sentence=True), hashing_embedder)


@query("build_dataset", with_views(*QUADS, SPLIT, body="""SELECT split, count(*)::DOUBLE AS samples FROM (
  SELECT 'val' AS split FROM split WHERE split = 'val' UNION ALL SELECT 'test' FROM split WHERE split = 'test' UNION ALL
  SELECT 'train' FROM (SELECT unnest(range(1 + CASE WHEN list_contains(labels, 2) THEN 5 ELSE 0 END + CASE WHEN list_contains(labels, 3) THEN 1 ELSE 0 END)) FROM split WHERE split = 'train'))
  GROUP BY 1"""))
def build_dataset(spark: SparkSession, d: str) -> DataFrame:
    out = jobs.build_dataset(V.annotated(spark, d), scratch_dir(spark, "dataset"), draw=_draw())
    return out["report"].filter(F.col("kind") == "samples").select("split", F.col("value").alias("samples"))


@query("label_quality", with_views(*QUADS, _match_sql("aspect_category, sentiment"), f"""f AS ({_f1_sql('partial')})""",
  body="SELECT 'quadruples' AS metric, 'partial' AS name, figure, value FROM (UNPIVOT (SELECT precision, recall, f1, exact_match, n_reviews::DOUBLE AS n_reviews FROM f) ON COLUMNS(*) INTO NAME figure VALUE value)"))
def label_quality(spark: SparkSession, d: str) -> DataFrame:
    out = jobs.label_quality(*_sides(spark, d), POS, _reviewed(spark, d))
    return out.filter((F.col("metric") == "quadruples") & (F.col("name") == "partial"))


def _figures(sql: str, metric: str, name: str, figures: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{metric}' AS metric, {name} AS name, '{f}' AS figure, {f}::DOUBLE AS value FROM ({sql})" for f in figures)


PRF = ["precision", "recall", "f1"]
REPORT = " UNION ALL ".join([
    _figures(f"WITH {_match_sql(PARTIAL)} {_f1_sql('partial')}", "quadruples", "match_type", [*PRF, "exact_match", "n_reviews"]),
    _figures(f"WITH {_match_sql(FULL)} {_f1_sql('full')}", "quadruples", "match_type", [*PRF, "exact_match", "n_reviews"]),
    _figures(f"SELECT category, {_prf_sql()}, tp, fp, fn, tn FROM counts", "category", "category", [*PRF, "tp", "fp", "fn", "tn"]),
    _figures(SENTIMENT_SQL, "sentiment", "sentiment", [*PRF, "accuracy", "n_pairs"]),
    _figures("SELECT scope, name, round(kappa + 1e-9, 4) AS kappa FROM k", "kappa", "scope || ':' || name", ["kappa"]),
])


@query("label_quality_report", with_views(*QUADS, COUNTS, PAIRS, KAPPA_SQL, SENTIMENT_ROWS, body=REPORT))
def label_quality_report(spark: SparkSession, d: str) -> DataFrame:
    return jobs.label_quality(*_sides(spark, d), POS, _reviewed(spark, d))


@query("preprocess", with_views(V.REVIEWS_SQL, CLEANED, V.CATEGORIES_SQL, body="""SELECT 'cleaned' AS name, count(*) AS n FROM cleaned
  UNION ALL SELECT 'merged', count(*) FROM cleaned LEFT JOIN categories USING (product_id)
  UNION ALL SELECT 'normalized', count(*) FROM cleaned"""))
def preprocess(spark: SparkSession, d: str) -> DataFrame:
    tables = jobs.preprocess(V.reviews(spark, d), V.products(spark, d), V.categories(spark, d), LEXICON, ["seq"], scratch_dir(spark, "tables"))
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])
