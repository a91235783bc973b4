"""Review cleaning, merging and row filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara import constants as K
from opinara.functions import text as X
from opinara.functions.casts import safe_double
from opinara.operators.ranking import compute_once, first_rows


def clean_reviews(reviews: DataFrame, order: list, min_length: int = K.MIN_CLEAN_LENGTH) -> DataFrame:
    """Cleaned text, short rows dropped, the first of equal texts kept.

    Copies are grouped by a hash and the text itself, so that the sort mostly
    compares eight bytes; each task drops its own copies before the shuffle.
    """
    out = compute_once(reviews.dropna(subset=["content", "title"]), "cleaned_content", X.clean_text("content"))
    out = out.filter(F.length("cleaned_content") >= min_length)
    out = out.withColumn("__h", F.xxhash64("cleaned_content"))
    out = first_rows(out, ["__h", "cleaned_content"], order).drop("__h")
    return out.withColumn("review_length", F.length("cleaned_content"))


def preprocess_reviews(reviews: DataFrame, min_length: int = K.MIN_DASHBOARD_LENGTH) -> DataFrame:
    """Title and content in one light-cleaned text; defaults for rating and helpful count."""
    out = reviews.withColumn("full_text", X.full_text("title", "content"))
    out = compute_once(out, "clean_text", X.light_clean("full_text")).filter(F.length("clean_text") > min_length)
    return out.withColumns({
        "helpful_count": safe_double("helpful_count", 0.0).cast("int"),
        "rating": safe_double("rating", 3.0).cast("int"),
    })


def merge_reviews(reviews: DataFrame, products: DataFrame, categories: DataFrame) -> DataFrame:
    """Reviews with product and category columns.

    A product may have several categories; its reviews are multiplied then,
    as intended.
    """
    info = products.select(
        F.col("product_id").cast("string"), "name", "price", "rating_average", F.col("brand").alias("brand_name"),
        F.col("seller").alias("seller_name"),
    )
    cats = categories.select(F.col("product_id").cast("string"), "category_lv1", "category_lv2", "category_lv3")
    keyed = reviews.withColumn("product_id", F.col("product_id").cast("string"))
    return keyed.join(info, "product_id", "left").join(cats, "product_id", "left")


def text_or_fallback(df: DataFrame, columns: list[str], id_col: str = "review_id", limit: int | None = None) -> DataFrame:
    """First non-empty of the text columns, cut to ``limit`` if given; rows without id or text dropped."""
    # a blank column stops the search, as only empty strings fall through
    text = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns if c in df.columns])
    out = df.select(X.strip_ws(F.col(id_col).cast("string")).alias("review_id"), X.strip_ws(text).alias("text"))
    out = out.filter((F.length("review_id") > 0) & (F.length("text") > 0))
    return out if limit is None else out.withColumn("text", F.substring("text", 1, limit))


def exclude_categories(df: DataFrame, column: str, unwanted: list[str]) -> DataFrame:
    """Drop listed categories; a missing category stays."""
    return df.filter(~F.coalesce(F.col(column).isin(unwanted), F.lit(False)))


def rating_segments(reviews: DataFrame) -> DataFrame:
    """Positive (4-5) and negative (1-2) reviews that have text."""
    segment = F.when(F.col("rating") >= 4, "positive").when(F.col("rating") <= 2, "negative")
    return reviews.withColumn("segment", segment).filter(F.col("segment").isNotNull() & F.col("content").isNotNull())


def unseen(df: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(seen.select(*keys), keys, "left_anti")


def kept(df: DataFrame, keep: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(keep.select(*keys), keys, "left_semi")
