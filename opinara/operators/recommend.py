"""Similar products, comparison with the best one, representative reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara import constants as K
from opinara.functions.numbers import clamp01, round_up
from opinara.operators.items import cap_item_reviews
from opinara.operators.ranking import top_rows


def similar_products(products: DataFrame, categories: DataFrame, listing: DataFrame | None = None,
                     top_k: int = K.RECOMMENDATION_TOP_K) -> DataFrame:
    """Best-rated products sharing category level 3 or 2, per product.

    Instead of pairing products inside a category, the best ``top_k + 1`` of
    each category serve all its products, since a product leaves out only
    itself. Products of the same two categories then join a single short list.
    """
    ids = categories.select("product_id", "category_lv2", "category_lv3").distinct()
    info = products.filter(F.col("name").isNotNull()).select("product_id", "name", "price", "rating_average")
    if listing is not None:
        info = info.join(listing.select("product_id", "quantity_sold"), "product_id", "left")
    else:
        info = info.withColumn("quantity_sold", F.lit(0))
    info = info.select(
        "product_id", "name", F.col("price").cast("double").alias("price"), F.col("rating_average").cast("double").alias("rating_average"),
        (-F.coalesce(F.col("rating_average").cast("double"), F.lit(-1.0))).alias("k1"), (-F.coalesce(F.col("quantity_sold").cast("bigint"), F.lit(0))).alias("k2"),
    )
    order = ["k1", "k2", "product_id"]

    def best(level: str) -> DataFrame:
        group = ids.select(F.col(level).alias("group"), "product_id").filter(F.col("group") != "").distinct()
        return top_rows(group.join(info, "product_id"), ["group"], order, top_k + 1)

    own = top_rows(ids, ["product_id"], ["category_lv3", "category_lv2"], 1)
    pair = ["category_lv2", "category_lv3"]
    pairs = own.select(*pair).distinct()
    by3 = pairs.join(best("category_lv3"), F.col("category_lv3") == F.col("group")).drop("group")
    by2 = pairs.join(best("category_lv2"), F.col("category_lv2") == F.col("group")).drop("group")
    # at most 2 * (top_k + 1) rows per pair
    candidate = F.struct(*order, "name", "price", "rating_average")
    lists = by3.unionByName(by2).distinct().groupBy(*pair).agg(F.sort_array(F.collect_list(candidate)).alias("ranked"))
    others = F.slice(F.filter("ranked", lambda c: c["product_id"] != F.col("product_id")), 1, top_k)
    return own.join(lists, pair).select("product_id", F.posexplode(others).alias("pos", "c")).select(
        "product_id",
        F.col("c.product_id").alias("candidate_id"),
        F.col("c.name").alias("name"),
        F.col("c.price").alias("price"),
        F.col("c.rating_average").alias("rating_average"),
        round_up(F.col("c.rating_average") / 5).alias("rating_score"),
        (F.col("pos") + 1).alias("rank"),
    )


def compare_with_top(recommended: DataFrame, items: DataFrame, review_cap: int | None = None) -> DataFrame:
    """Unweighted aspect scores of each product's best recommendation, from all its reviews or the first ``review_cap``."""
    top = recommended.filter(F.col("rank") == 1).select("product_id", "candidate_id")
    wanted = top.select(F.col("candidate_id").alias("product_id")).distinct()
    rated = items.join(wanted, "product_id", "left_semi")
    if review_cap is not None:
        rated = cap_item_reviews(rated, review_cap)
    scores = rated.groupBy(F.col("product_id").alias("candidate_id"), "aspect").agg(
        round_up(clamp01((F.sum("sentiment_score") / F.count("*") + 1) / 2)).alias("score")
    )
    return top.join(scores, "candidate_id").select("product_id", "candidate_id", "aspect", "score")


def representative_reviews(reviews: DataFrame, scores: DataFrame) -> DataFrame:
    """Best, worst and most helpful review of each product.

    Reviews with score 0 count only where a product has no other. A review is
    shown once.
    """
    scored = reviews.join(scores.select("product_id", "review_id", "score", "label"), ["product_id", "review_id"], "left")
    scored = scored.withColumns({
        "score": F.coalesce("score", F.lit(0.0)), "label": F.coalesce("label", F.lit("neutral"))
    })
    zero = (F.col("score") == 0).cast("int")
    # a zero-score row ranks after all others, so it is reached only if all are zero
    sets = []
    for role, order in (("best", F.desc("score")), ("worst", F.asc("score"))):
        sets.append(top_rows(scored, ["product_id"], [zero, order, "review_id"], 1).withColumn("role", F.lit(role)))
    # the chosen two may be the most helpful ones, so three candidates are enough
    helpful = top_rows(scored, ["product_id"], [zero, F.desc("helpful_count"), "review_id"], 3)
    sets.append(helpful.withColumn("role", F.lit("helpful")))
    rows = sets[0].unionByName(sets[1]).unionByName(sets[2])
    order = F.when(F.col("role") == "best", 0).when(F.col("role") == "worst", 1).otherwise(2)
    rows = rows.withColumn("__role", order)
    # a product has five rows here at most
    any_scored = F.max((F.col("score") != 0).cast("int")).over(_per_product())
    rows = rows.withColumn("__any", any_scored).filter((F.col("__any") == 0) | (F.col("score") != 0))
    once = top_rows(rows, ["product_id", "review_id"], ["__role"], 1)
    kept = top_rows(once, ["product_id", "role"], [F.desc("helpful_count"), "review_id"], 1)
    return kept.select(
        "product_id", "review_id", "role", F.col("clean_text").alias("text"), "label", "rating", "score"
    )


def _per_product():
    from pyspark.sql import Window

    return Window.partitionBy("product_id")
