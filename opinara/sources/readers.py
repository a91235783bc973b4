"""File readers with fixed schemas, and lookups of stored products."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinara import constants as K
from opinara.functions.casts import safe_double, safe_long, safe_string


def read_multiline_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV whose quoted fields may span lines; line breaks inside become blanks."""
    raw = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').schema(schema).csv(path)
    joined = {f.name: F.regexp_replace(f.name, r"\r?\n", " ") for f in raw.schema.fields if isinstance(f.dataType, T.StringType)}
    return raw.withColumns(joined)


def read_string_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns as text, missing as ''; a missing file gives no rows."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    try:
        raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').schema(schema).csv(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return raw.na.fill("")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good rows and unreadable lines of a JSON-lines file; blank lines are skipped."""
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    return split_json_lines(lines, "value", schema)


def split_json_lines(lines: DataFrame, column: str, schema: str) -> tuple[DataFrame, DataFrame]:
    parsed = lines.select(
        F.col(column).alias("line"),
        F.from_json(column, f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"),
    )
    bad = F.col("r").isNull() | F.col("r._corrupt").isNotNull()
    return parsed.filter(~bad).select("r.*").drop("_corrupt"), parsed.filter(bad).select("line")


def read_label_csv(spark: SparkSession, path: str) -> DataFrame:
    """Text and 17 label columns as one array; missing text '' and labels 0."""
    names = [f"label_{i}" for i in range(len(K.CATEGORIES))]
    schema = ", ".join(["text string", *[f"{n} string" for n in names]])
    raw = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').schema(schema).csv(path)
    labels = F.array(*[F.coalesce(F.col(n).try_cast("double").cast("int"), F.lit(0)) for n in names])
    return raw.select(F.coalesce("text", F.lit("")).alias("text"), labels.alias("y_true"))


def stored_reviews(reviews: DataFrame, wanted: DataFrame) -> DataFrame:
    """Stored reviews of the wanted products, with defaults for missing fields."""
    rows = reviews.withColumn("product_id", F.trim(F.col("product_id").cast("string")))
    return rows.join(wanted.select("product_id").distinct(), "product_id", "left_semi").select(
        safe_string("review_id").alias("review_id"), "product_id", safe_long("rating", 0).alias("rating"),
        safe_string("title").alias("title"), safe_string("content").alias("content"), safe_long("helpful_count", 0).alias("helpful_count"),
    )


def stored_products(wanted: DataFrame, detail: DataFrame, categories: DataFrame) -> DataFrame:
    """Stored facts of the wanted products; unknown ones keep default values."""
    from opinara.operators.ranking import top_rows

    keyed = lambda df: df.withColumn("product_id", F.trim(F.col("product_id").cast("string")))
    paths = [c for c in detail.columns if c.startswith("category_lv")]
    one = top_rows(keyed(detail).drop(*paths), ["product_id"], ["name", "price"], 1)
    cat = top_rows(keyed(categories), ["product_id"], ["category_lv3", "category_lv2"], 1).select(
        "product_id", "category_lv1", "category_lv2", "category_lv3"
    )
    joined = wanted.select("product_id").distinct().join(one, "product_id", "left").join(cat, "product_id", "left")
    return joined.select(
        "product_id", safe_string("name", "").alias("name"), safe_long("price", 0).alias("price"),
        safe_string("brand").alias("brand_name"), safe_string("seller").alias("seller_name"),
        safe_double("rating_average", None).alias("rating_average"), safe_long("review_count", 0).alias("review_count"),
        *[safe_string(c).alias(c) for c in ("category_lv1", "category_lv2", "category_lv3")],
        F.concat(F.lit(K.SHOP_URL + "p/"), "product_id").alias("product_url"),
    )


def product_context(products: DataFrame, reviews: DataFrame, items: DataFrame, risks: DataFrame) -> DataFrame:
    """Everything stored about known products, one row per fact.

    Sections: review, aspect, risk. A product may have any number of reviews,
    so they stay rows instead of one list per product.
    """
    known = products.select("product_id", F.col("name").alias("product_name"))
    none = F.lit(None)

    def section(df: DataFrame, name: str, **cols) -> DataFrame:
        shape = {"review_id": "string", "aspect": "string", "sentiment": "string", "risk_type": "string", "severity": "string",
                 "rating": "int", "confidence": "double", "text": "string"}
        return df.select("product_id", F.lit(name).alias("section"), *[F.coalesce(cols[c].cast(t), none.cast(t)).alias(c) if c in cols else none.cast(t).alias(c) for c, t in shape.items()])

    c = F.col
    facts = section(reviews, "review", review_id=c("review_id"), rating=c("rating"), text=c("content"))
    # an item of an unknown review keeps an empty id
    stored = reviews.select("product_id", c("review_id").alias("known_id"))
    linked = items.join(stored, (items["product_id"] == stored["product_id"]) & (items["review_id"] == c("known_id")), "left").drop(stored["product_id"])
    facts = facts.unionByName(section(
        linked, "aspect", review_id=F.coalesce(c("known_id"), F.lit("")), aspect=c("aspect"), sentiment=c("sentiment"),
        confidence=c("confidence"), text=c("sentence"),
    ))
    facts = facts.unionByName(section(
        risks, "risk", risk_type=c("risk_type"), severity=c("severity"), confidence=c("confidence"), text=c("evidence")
    ))
    return facts.join(known, "product_id")
