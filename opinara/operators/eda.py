"""Descriptive statistics of review and product tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.functions import text as X
from opinara.functions.numbers import count_if, mean, round_up
from opinara.operators.quantiles import exact_quantiles, overall_quantiles


def _percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return round_up(part.cast("double") * 100 / F.nullif(whole.cast("double"), F.lit(0.0)), digits)


def _missing(df: DataFrame) -> list[Column]:
    return [count_if(F.col(c).isNull()).alias(c) for c in df.columns]


def overview(df: DataFrame, name: str) -> DataFrame:
    """Rows, columns and missing cells of a table, in one pass."""
    one = df.agg(F.count("*").alias("__rows"), *_missing(df))
    cells = sum((F.col(c) for c in df.columns), F.lit(0))
    out = one.select(
        F.lit(name).alias("dataset"), F.col("__rows").alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"),
        cells.cast("bigint").alias("missing_cells"),
    )
    return out.withColumn("missing_percent", _percent(F.col("missing_cells"), F.col("n_rows") * F.col("n_columns")))


def missing_by_column(df: DataFrame) -> DataFrame:
    """Columns with missing values, in one pass."""
    one = df.agg(F.count("*").alias("__rows"), *_missing(df))
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in df.columns])
    out = one.select("__rows", F.explode(pairs).alias("p")).select("p.column", "p.missing", "__rows")
    out = out.filter(F.col("missing") > 0)
    return out.select("column", "missing", _percent(F.col("missing"), F.col("__rows")).alias("percent"))


def value_distribution(df: DataFrame, column: str, digits: int = 1) -> DataFrame:
    """Count and percent of each non-null value."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    # the total reuses the shuffle of the counts
    total = counts.agg(F.sum("n").alias("total")).scalar()
    return counts.withColumn("percent", _percent(F.col("n"), total, digits))


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The most frequent values; ties in value order."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "value").limit(k)


def distinct_of(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.lit(1).alias("one")).agg(F.count("*").alias("n"))


def review_facts(reviews: DataFrame) -> DataFrame:
    """Counts, distinct customers and products, mean rating and shares."""
    out = reviews.agg(
        F.count("*").alias("reviews"),
        round_up(mean("rating"), 2).alias("mean_rating"),
        count_if(F.col("images_count") > 0).alias("with_images"),
        count_if(F.col("is_verified")).alias("verified"),
        F.min("rating").alias("min_rating"),
        F.max("rating").alias("max_rating"),
    )
    return out.select(
        "reviews", "mean_rating", "with_images", "verified", "min_rating", "max_rating",
        _percent(F.col("with_images"), F.col("reviews"), 1).alias("with_images_percent"),
        _percent(F.col("verified"), F.col("reviews"), 1).alias("verified_percent"),
        # distinct values are counted by their own aggregation, not in one set
        distinct_of(reviews, "customer_id").scalar().alias("customers"),
        distinct_of(reviews, "product_id").scalar().alias("products"),
    )


def date_range(df: DataFrame, column: str) -> DataFrame:
    out = df.agg(F.min(column).alias("first_date"), F.max(column).alias("last_date"))
    return out.withColumn("span_days", F.datediff("last_date", "first_date"))


def categories_per_product(categories: DataFrame) -> DataFrame:
    """Mean, lowest and highest number of categories, and a product that has the most."""
    per = categories.groupBy("product_id").agg(F.count("*").alias("n"))
    return per.agg(
        round_up(mean("n"), 2).alias("mean_categories"),
        F.min("n").alias("min_categories"),
        F.max("n").alias("max_categories"),
        F.min_by("product_id", F.struct(-F.col("n"), F.col("product_id"))).alias("example_product"),
    )


def category_histogram(categories: DataFrame) -> DataFrame:
    per = categories.groupBy("product_id").agg(F.count("*").alias("n_categories"))
    return value_distribution(per, "n_categories")


def price_describe(df: DataFrame, group: str, price: str) -> DataFrame:
    """count, mean, std, min, quartiles and max of the price per group."""
    rows = df.filter(F.col(group).isNotNull() & F.col(price).isNotNull())
    basic = rows.groupBy(group).agg(
        F.count("*").alias("count"),
        F.round(F.avg(price), 2).alias("mean"),
        F.round(F.stddev_samp(price), 2).alias("std"),
        F.min(price).cast("double").alias("min"),
        F.max(price).cast("double").alias("max"),
    )
    quartiles = exact_quantiles(rows, [group], price, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    rounded = quartiles.select(group, *[round_up(F.col(q), 4).alias(q) for q in ("q25", "q50", "q75")])
    return basic.join(rounded, group)


def outlier_cut(df: DataFrame, value: str, group: str, share: float = 0.99) -> DataFrame:
    """Rows below the exact quantile whose group is known."""
    limit = F.lit(overall_quantiles(df, value, {"limit": share})["limit"]).cast("double")
    return df.filter((F.col(value) < limit) & F.col(group).isNotNull())


def monthly_counts(df: DataFrame, column: str) -> DataFrame:
    month = F.trunc(column, "month")
    return df.filter(F.col(column).isNotNull()).groupBy(month.alias("month")).agg(F.count("*").alias("n"))


def monthly_extremes(months: DataFrame) -> DataFrame:
    """Months with most and fewest rows (the earlier one on ties), and the last month."""
    return months.agg(
        F.min_by("month", F.struct(-F.col("n"), F.col("month"))).alias("max_month"),
        F.max("n").alias("max_n"),
        F.min_by("month", F.struct(F.col("n"), F.col("month"))).alias("min_month"),
        F.min("n").alias("min_n"),
        F.max("month").alias("last_month"),
    )


def yearly_extremes(months: DataFrame) -> DataFrame:
    """Per year: extreme months, mean, spread and spread in percent."""
    out = months.groupBy(F.year("month").alias("year")).agg(
        F.min_by("month", F.struct(-F.col("n"), F.col("month"))).alias("max_month"),
        F.max("n").alias("max_n"),
        F.min_by("month", F.struct(F.col("n"), F.col("month"))).alias("min_month"),
        F.min("n").alias("min_n"),
        round_up(mean("n"), 2).alias("mean_n"),
    )
    return out.withColumns({
        "spread": F.col("max_n") - F.col("min_n"),
        "spread_percent": round_up((F.col("max_n") / F.col("min_n") - 1) * 100, 1),
    })


def term_frequency(segments: DataFrame, text: str = "content") -> DataFrame:
    """Word counts by segment."""
    words = segments.select("segment", F.explode_outer(X.words(X.clean_text(text))).alias("term"))
    return words.filter(F.col("term").isNotNull()).groupBy("segment", "term").agg(F.count("*").alias("n"))


def segment_counts(segments: DataFrame) -> DataFrame:
    return segments.groupBy("segment").agg(F.count("*").alias("n"))


def potential_score(products: DataFrame, k: int = 5) -> DataFrame:
    """The k products with the best mix of rating, reviews and price."""
    top = products.agg(F.max("review_count").cast("double").alias("m")).scalar()
    dear = products.agg(F.max("price").cast("double").alias("m")).scalar()
    score = F.col("rating_average") * 0.5 + F.col("review_count") / top * 0.3 + (1 - F.col("price") / dear) * 0.2
    out = products.withColumn("__s", score).orderBy(F.desc("__s"), "product_id").limit(k)
    out = out.withColumn("potential_score", round_up(F.col("__s"), 6))
    return out.select("product_id", "name", "brand", "rating_average", "review_count", "price", "potential_score")


def _overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    a = left.select(key).distinct().withColumn("in_left", F.lit(True))
    b = right.select(key).distinct().withColumn("in_right", F.lit(True))
    side = F.when(F.col("in_left") & F.col("in_right"), "both").when(F.col("in_left"), "left_only").otherwise("right_only")
    return a.join(b, key, "full_outer").select(key, side.alias("side"))


def id_overlap(left: DataFrame, right: DataFrame, key: str = "product_id") -> DataFrame:
    return _overlap(left, right, key).groupBy("side").agg(F.count("*").alias("n"))


def id_overlap_samples(left: DataFrame, right: DataFrame, key: str = "product_id", k: int = 10) -> DataFrame:
    """The first k ids found on one side only."""
    from opinara.operators.ranking import top_rows

    return top_rows(_overlap(left, right, key).filter(F.col("side") != "both"), ["side"], [key], k)


def eda_merge(detail: DataFrame, categories: DataFrame, listing: DataFrame) -> DataFrame:
    """Detail with category and listing columns; category_id of both sides kept apart."""
    cats = categories.withColumnRenamed("category_id", "category_id_x")
    sold = listing.withColumnRenamed("category_id", "category_id_y") if "category_id" in listing.columns else listing
    return detail.join(cats, "product_id", "left").join(sold, "product_id", "left")


def annotation_stats(annotated: DataFrame) -> DataFrame:
    """Quadruple counts by category and by sentiment, with the number of reviews."""
    flat = annotated.select(F.explode("quadruples").alias("q"))
    kinds = F.array(
        F.struct(F.lit("category").alias("kind"), F.col("q.aspect_category").alias("value")),
        F.struct(F.lit("sentiment").alias("kind"), F.col("q.sentiment").alias("value")),
    )
    counts = flat.select(F.explode(kinds).alias("k")).groupBy("k.kind", "k.value").agg(F.count("*").alias("n"))
    reviews = annotated.agg(F.count("*").alias("n")).select(
        F.lit("reviews").alias("kind"), F.lit("all").alias("value"), "n"
    )
    return counts.unionByName(reviews)
