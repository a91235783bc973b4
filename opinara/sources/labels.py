"""Readers for human label exports, display text and BIO blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara import constants as K
from opinara.functions import text as X
from opinara.functions.casts import lookup

EXPORT_SCHEMA = (
    "struct<data:struct<review_id:string>,annotations:array<struct<result:array<struct<"
    "from_name:string,value:struct<choices:array<string>,text:array<string>>>>>>>"
)
ALIAS_CODES = {**K.CATEGORY_ALIASES, **{c: c for c in K.CATEGORIES}}


def parse_human_export(tasks: DataFrame, column: str = "task") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Quadruples, reviews with their verdict, and rejects of a label export.

    Only the last annotation of a task counts. Its fields ``catN``, ``aspN``,
    ``opiN`` and ``sentN`` belong to slot N; a later valid value of a slot
    replaces an earlier one, and slots without a category are dropped.
    """
    parsed = tasks.select(F.from_json(column, EXPORT_SCHEMA).alias("t")).select(
        F.col("t.data.review_id").alias("review_id"), F.try_element_at("t.annotations", F.lit(-1)).alias("last")
    )
    fields = parsed.select("review_id", F.posexplode("last.result").alias("pos", "i")).select(
        "review_id", "pos", F.col("i.from_name").alias("field"),
        F.regexp_extract("i.from_name", r"^(cat|sent|asp|opi)\d+$", 1).alias("kind"),
        F.regexp_extract("i.from_name", r"^[a-z]+(\d+)$", 1).try_cast("int").alias("slot"),
        F.get("i.value.choices", 0).alias("choice"), F.nullif(F.trim(F.get("i.value.text", 0)), F.lit("")).alias("text"),
    )
    category = F.when(~F.col("choice").isin(K.ALIAS_SKIP_VALUES), lookup(F.col("choice"), ALIAS_CODES))
    value = F.when(F.col("kind") == "cat", category).when(
        F.col("kind") == "sent", F.lower(F.trim("choice"))
    ).otherwise(F.lower("text"))
    slots = fields.filter(F.col("kind") != "").withColumn("v", value).filter(F.col("v").isNotNull())
    last = lambda kind: F.max_by("v", F.when(F.col("kind") == kind, F.col("pos")))
    quads = slots.groupBy("review_id", "slot").agg(
        F.coalesce(last("asp"), F.lit("null")).alias("aspect_term"), last("cat").alias("aspect_category"),
        F.coalesce(last("opi"), F.lit("null")).alias("opinion_term"), F.coalesce(last("sent"), F.lit("")).alias("sentiment"),
    ).filter(F.col("aspect_category").isNotNull())

    verdicts = fields.filter((F.col("field") == "llm_verdict") & F.col("choice").isNotNull())
    verdicts = verdicts.groupBy("review_id").agg(F.max_by("choice", "pos").alias("verdict"))
    done = parsed.filter(F.col("last").isNotNull()).select("review_id")
    reviews = done.join(verdicts, "review_id", "left")

    strange = fields.filter(
        (F.col("kind") == "cat") & ~F.col("choice").isin(K.ALIAS_SKIP_VALUES) & lookup(F.col("choice"), ALIAS_CODES).isNull()
    ).select("review_id", F.lit("unknown category").alias("reason"), F.col("choice").alias("value"))
    empty = parsed.filter(F.col("last").isNull()).select(
        "review_id", F.lit("no annotation").alias("reason"), F.lit(None).cast("string").alias("value")
    )
    return quads, reviews, strange.unionByName(empty)


DISPLAY_PATTERN = r"(?i)^\[\d+\]\s+([A-Z#_]+)\s*\|\s*aspect=(.+?)\s*\|\s*opinion=(.+?)\s*\|\s*(\w+)"


def parse_display(tasks: DataFrame, column: str = "display") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Flat quadruples from display lines, the lines that do not match, and all reviews, with quadruples or not."""
    lines = tasks.select("review_id", F.posexplode(F.split(X.strip_ws(column), "\n")).alias("pos", "line"))
    lines = lines.withColumn("line", X.strip_ws("line")).filter(F.length("line") > 0)
    hit = F.col("line").rlike(DISPLAY_PATTERN)
    part = lambda n: F.trim(F.regexp_extract("line", DISPLAY_PATTERN, n))
    quads = lines.filter(hit).select(
        "review_id", "pos", F.lower(part(2)).alias("aspect_term"), F.upper(part(1)).alias("aspect_category"),
        F.lower(part(3)).alias("opinion_term"), F.lower(part(4)).alias("sentiment"),
    )
    return quads, lines.filter(~hit).select("review_id", "line"), tasks.select("review_id").distinct()


def read_bio(spark: SparkSession, path: str) -> DataFrame:
    """BIO blocks (a '# labels:' line, token/tag lines, a blank line) as rows."""
    blocks = spark.read.option("lineSep", "\n\n").text(path)
    return parse_bio(blocks, "value")


def parse_bio(blocks: DataFrame, column: str, max_len: int | None = None) -> DataFrame:
    """Labels, tokens and tags of each block; blocks without either are dropped."""
    lines = F.split(column, "\n")
    head = F.get(F.filter(lines, lambda s: F.startswith(s, F.lit("# labels:"))), 0)
    pairs = F.transform(F.filter(lines, lambda s: ~F.startswith(s, F.lit("# labels:"))), lambda s: F.split(s, "\t"))
    pairs = F.filter(pairs, lambda p: F.size(p) == 2)
    pairs = pairs if max_len is None else F.slice(pairs, 1, max_len)
    keep = [c for c in blocks.columns if c != column]
    out = blocks.select(
        *keep,
        F.transform(F.split(F.regexp_extract(head, r": (.*)$", 1), " "), lambda x: x.try_cast("int")).alias("labels"),
        F.transform(pairs, lambda p: p[0]).alias("tokens"),
        F.transform(pairs, lambda p: p[1]).alias("tags"),
    )
    return out.filter(F.col("labels").isNotNull() & (F.size("tokens") > 0))


def encode_bio(blocks: DataFrame, key: str, vocab: DataFrame, unknown: int = 1) -> DataFrame:
    """Token and tag ids; the vocabulary (word, id) is joined, unknown words get 1.

    A block holds one review, whose tokens become one list.
    """
    tags = {t: i for i, t in enumerate(K.BIO_TAGS)}
    rows = blocks.select(key, F.posexplode(F.arrays_zip("tokens", "tags")).alias("pos", "p"))
    rows = rows.select(key, "pos", F.col("p.tokens").alias("word"), F.coalesce(lookup(F.col("p.tags"), tags), F.lit(0)).alias("tag_id"))
    joined = rows.join(vocab.select("word", "id"), "word", "left")
    ids = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("id", F.lit(unknown)).alias("id"), "tag_id")))
    return joined.groupBy(key).agg(ids.alias("r")).select(
        key, F.transform("r", lambda s: s["id"]).alias("token_ids"), F.transform("r", lambda s: s["tag_id"]).alias("tag_ids"),
        F.size("r").alias("length"),
    )
