"""Flattening of JSON payloads into typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara import constants as K
from opinara.functions import text as X
from opinara.operators.ranking import top_rows

PRODUCT_SCHEMA = """id string, sku string, name string, short_description string, price double, list_price double, discount double,
  discount_rate double, rating_average double, review_count bigint, order_count bigint, stock_item struct<qty:bigint,max_sale_qty:bigint>,
  brand struct<id:string,name:string>, inventory_status string, is_visible boolean, short_url string, description string,
  specifications array<struct<attributes:array<struct<name:string,value:string>>>>,
  current_seller struct<id:string,name:string,type:string,rating_average:double,review_count:bigint,product_count:bigint,is_official:boolean,link:string>"""

LISTING_SCHEMA = "id string, name string, quantity_sold struct<value:bigint,text:string>"

REVIEW_SCHEMA = """id string, rating int, title string, content string, created_at bigint, thank_count int, images array<string>,
  created_by struct<id:string,name:string,purchased_at:bigint>"""


def specification_map(specs: Column) -> Column:
    """Named values of all groups; empty ones skipped, the last value of a name wins."""
    entries = F.flatten(F.transform(F.coalesce(specs, F.array().cast("array<struct<attributes:array<struct<name:string,value:string>>>>")),
                                    lambda g: F.coalesce(g["attributes"], F.array().cast("array<struct<name:string,value:string>>"))))
    named = F.filter(entries, lambda a: (F.coalesce(a["name"], F.lit("")) != "") & (F.coalesce(a["value"], F.lit("")) != ""))
    names = F.array_distinct(F.transform(named, lambda a: a["name"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.try_element_at(F.filter(named, lambda a: a["name"] == n), F.lit(-1))["value"]))


def flatten_products(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Product detail rows."""
    p = payloads.select(F.from_json(column, PRODUCT_SCHEMA).alias("p")).select("p.*")
    seller = {"id": "id", "name": "name", "type": "type", "rating": "rating_average", "review_count": "review_count",
              "product_count": "product_count", "link": "link"}
    return p.select(
        F.col("id").alias("product_id"), "sku", "name", "short_description", "price", "list_price", "discount", "discount_rate",
        "rating_average", "review_count", "order_count", F.col("stock_item.qty").alias("stock_qty"),
        F.col("stock_item.max_sale_qty").alias("max_sale_qty"), F.col("brand.id").alias("brand_id"), F.col("brand.name").alias("brand_name"),
        "inventory_status", "is_visible",
        F.coalesce(F.nullif("short_url", F.lit("")), F.concat(F.lit(K.SHOP_URL + "p/"), "id")).alias("product_url"),
        X.html_to_text("description").alias("description"), F.to_json(specification_map(F.col("specifications"))).alias("specifications"),
        *[F.col(f"current_seller.{field}").alias(f"seller_{name}") for name, field in seller.items()],
        F.coalesce("current_seller.is_official", F.lit(False)).alias("seller_is_official"),
    )


def flatten_product_pages(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Product facts of the analysis page: defaults, images and category path.

    ``quantity_sold`` may be a number or an object with a value.
    """
    v = payloads.select(F.try_parse_json(column).alias("v"))
    get = lambda path, kind="string": F.try_variant_get("v", f"$.{path}", kind)
    whole = lambda c: F.coalesce(c.cast("bigint"), F.lit(0))
    images = F.filter(
        F.transform(F.coalesce(get("images", "array<variant>"), F.array().cast("array<variant>")), lambda i: F.try_variant_get(i, "$.base_url", "string")),
        lambda u: F.coalesce(u, F.lit("")) != "",
    )
    rows = v.select("v", images.alias("imgs"))
    price = F.coalesce(get("price", "double"), F.lit(0.0))
    list_price = get("list_price", "double")
    url = get("short_url")
    crumb = lambda i: F.coalesce(get(f"breadcrumbs[{i}].name"), F.lit(""))
    lv1 = F.when(crumb(0) == "", F.coalesce(get("categories.name"), F.lit(""))).otherwise(crumb(0))
    return rows.select(
        get("id").alias("product_id"), get("name").alias("name"), whole(price).alias("price"),
        whole(F.when(F.coalesce(list_price, F.lit(0.0)) != 0, list_price).otherwise(price)).alias("original_price"),
        F.coalesce(get("rating_average", "double"), F.lit(0.0)).alias("rating_average"),
        F.coalesce(get("review_count", "bigint"), F.lit(0)).alias("review_count"),
        F.coalesce(get("brand.name"), F.lit("")).alias("brand_name"), F.coalesce(get("current_seller.name"), F.lit("")).alias("seller_name"),
        F.coalesce(get("current_seller.is_official", "boolean"), F.lit(False)).alias("seller_is_official"),
        F.coalesce(get("quantity_sold.value", "bigint"), get("quantity_sold", "bigint"), F.lit(0)).alias("sold_quantity"),
        F.coalesce(F.nullif(get("thumbnail_url"), F.lit("")), F.get("imgs", 0), F.lit("")).alias("thumbnail_url"),
        F.col("imgs").alias("images"),
        F.when(F.startswith(url, F.lit(K.SHOP_URL)), url).otherwise(F.concat(F.lit(K.SHOP_URL + "p/"), get("id"))).alias("product_url"),
        lv1.alias("category_lv1"), crumb(1).alias("category_lv2"), crumb(2).alias("category_lv3"),
    )


def flatten_listing(pages: DataFrame, order: list, column: str = "payload", category: str = "category_id") -> DataFrame:
    """Listing rows; a product seen twice keeps its first row."""
    keep = [c for c in pages.columns if c != column]
    rows = pages.select(*keep, F.explode(F.from_json(column, f"struct<data:array<struct<{_inline(LISTING_SCHEMA)}>>>")["data"]).alias("i"))
    rows = rows.withColumn("product_id", F.col("i.id"))
    first = top_rows(rows, ["product_id"], order, 1)
    return first.select(
        category, "product_id", F.col("i.name").alias("product_name"),
        F.coalesce("i.quantity_sold.value", F.lit(0)).alias("quantity_sold"), F.col("i.quantity_sold.text").alias("quantity_sold_text"),
    )


def _inline(schema: str) -> str:
    """'a string, b int' as the inside of a struct type."""
    import re

    return re.sub(r"\s+", " ", re.sub(r"(^|, )(\w+) ", r"\1\2:", schema))


def flatten_reviews(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Review rows with dates in UTC, days since purchase and counts."""
    keep = [c for c in payloads.columns if c != column]
    rows = payloads.select(*keep, F.from_json(column, REVIEW_SCHEMA).alias("r")).select(*keep, "r.*")
    created, bought = F.col("created_at"), F.col("created_by.purchased_at")
    day = lambda ts: F.when(ts != 0, F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd"))
    return rows.select(
        F.col("id").alias("review_id"), *keep, F.col("created_by.id").alias("customer_id"), F.col("created_by.name").alias("customer_name"),
        "rating", "title", "content", created.alias("created_at_ts"), day(created).alias("created_at_date"),
        bought.alias("purchased_at_ts"), day(bought).alias("purchased_at_date"),
        F.when((created != 0) & (bought != 0), ((created - bought) / 86400).cast("int")).alias("days_since_purchase"),
        F.coalesce("thank_count", F.lit(0)).alias("helpful_count"), (F.coalesce(bought, F.lit(0)) != 0).alias("is_verified"),
        F.coalesce(F.size("images"), F.lit(0)).alias("images_count"),
    )


def category_tree(level2: DataFrame, level3: DataFrame, products: DataFrame, wanted: list[str] | None = None,
                  level1: str = K.SHOP_CATEGORY_LV1) -> DataFrame:
    """Products with their category path; level 2 must be wanted and have level 3.

    ``level2``: id, name; ``level3``: id, name, parent_id; ``products``:
    category_id, product_id.
    """
    top = level2.filter(F.col("name").isin(wanted or K.WANTED_CATEGORY_LV2)).select(F.col("id").alias("parent_id"), F.col("name").alias("category_lv2"))
    mid = level3.select(F.col("id").alias("category_id"), F.col("name").alias("category_lv3"), "parent_id").join(top, "parent_id")
    return products.join(mid, "category_id").select(
        F.lit(level1).alias("category_lv1"), "category_lv2", "category_lv3", "category_id", "product_id"
    )
