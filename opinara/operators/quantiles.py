"""Exact quantiles by selection: value ranges that hold a wanted rank are narrowed in rounds, never sorted as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.session import materialise

#: Parts that a round cuts a range into, and distinct values that may be sorted together.
CELLS, SORTED = 1024, 100_000
#: The logarithm of the least positive double is above minus this.
LEAST_LOG = 745.0


def _scale(v: Column, by_magnitude: bool) -> Column:
    """Grows with the value: its signed order of magnitude, or half of itself (the whole range of doubles would overflow)."""
    if not by_magnitude:
        return v / 2
    return F.when(v == 0, F.lit(0.0)).otherwise(F.signum(v) * (F.ln(F.abs(v)) + LEAST_LOG))


def _finite(v: Column) -> Column:
    return ~F.isnan(v) & (F.abs(v) != float("inf"))


def _cell(v: Column, low: Column, high: Column, by_magnitude: bool) -> Column:
    """Number of a value's part of its range, never falling with the value; infinities and NaN have their own."""
    place = lambda x: _scale(x, by_magnitude)
    width = (place(high) - place(low)) / F.lit(CELLS)
    at = F.greatest(F.lit(0), F.least(F.floor((place(v) - place(low)) / F.nullif(width, F.lit(0.0))), F.lit(CELLS - 1)))
    inner = F.when(width > 0, at).otherwise(0)
    return F.when(F.isnan(v), CELLS + 1).when(v == float("inf"), CELLS).when(v == float("-inf"), -1).otherwise(inner).cast("int")


def _narrowed(rows: DataFrame, ranks: DataFrame, by_magnitude: bool) -> tuple[DataFrame, DataFrame]:
    """Rows and ranks one round on: ranges with too many values are cut, and of their parts only those with a wanted rank stay.

    ``rows``: ``key, range, v, n``, one per distinct value; ``ranks``: ``key,
    range, rank`` counted from the range's beginning, and what a rank is for.
    """
    finite = F.when(_finite(F.col("v")), F.col("v"))
    spans = rows.groupBy("key", "range").agg(F.min(finite).alias("low"), F.max(finite).alias("high"), F.count("*").alias("values"))
    cell = F.when(F.col("values") > SORTED, F.coalesce(_cell(F.col("v"), F.col("low"), F.col("high"), by_magnitude), F.lit(0))).otherwise(0)
    placed = rows.join(spans, ["key", "range"]).withColumn("cell", cell).select("key", "range", "cell", "v", "n")
    sizes = placed.groupBy("key", "range", "cell").agg(F.sum("n").alias("size"))  # a thousand rows per range at most
    before = F.sum("size").over(Window.partitionBy("key", "range").orderBy("cell")) - F.col("size")
    sizes = sizes.withColumn("before", before)
    inside = (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("size"))
    path = F.concat_ws("/", "range", "cell")
    ranks = ranks.join(sizes, ["key", "range"]).filter(inside).withColumn("rank", F.col("rank") - F.col("before"))
    ranks = materialise(ranks.select("key", "range", "cell", path.alias("to"), "rank", "name", "side", "part"), "quantile-ranks")
    wanted = ranks.select("key", "range", "cell", "to").distinct()
    rows = placed.join(wanted, ["key", "range", "cell"]).select("key", F.col("to").alias("range"), "v", "n")
    return materialise(rows, "quantile-rows"), ranks.select("key", F.col("to").alias("range"), "rank", "name", "side", "part")


def _largest(rows: DataFrame) -> int:
    return rows.groupBy("key", "range").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def exact_quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per key that has a value.

    Equal values are counted first, so copies cost nothing. Ranges start as
    whole keys; a round cuts those of more than ``SORTED`` distinct values into
    ``CELLS`` parts between their least and greatest value, by order of
    magnitude and by value in turn, counts the parts, and keeps those that hold
    a wanted rank. A part has fewer values than its range, so neither one huge
    value nor many close ones stop it; a few rounds do, as a double has 64
    bits. Only then are values sorted, ``SORTED`` together at most.

    NaN is the greatest value; null values are left out, a null key is a key.
    """
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    counted = df.filter(F.col(value).isNotNull()).groupBy(key.alias("key"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    rows = materialise(counted.withColumn("range", F.lit("")), "quantile-values")
    totals = rows.groupBy("key").agg(F.sum("n").alias("total"))
    wanted = []
    for name, share in shares.items():
        at = F.lit(float(share)) * (F.col("total") - 1)
        low, part = F.floor(at), at - F.floor(at)
        for side, rank in ((0, low), (1, F.least(low + 1, F.col("total") - 1))):
            wanted.append(F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), rank.alias("rank"), part.alias("part")))
    ranks = totals.select("key", F.lit("").alias("range"), F.explode(F.array(*wanted)).alias("w"))
    ranks = ranks.select("key", "range", "w.rank", "w.name", "w.side", "w.part")
    by_magnitude = True
    while _largest(rows) > SORTED:
        rows, ranks = _narrowed(rows, ranks, by_magnitude)
        by_magnitude = not by_magnitude
    end = F.sum("n").over(Window.partitionBy("key", "range").orderBy("v"))
    hits = rows.withColumn("end", end).join(ranks, ["key", "range"])
    hits = hits.filter((F.col("rank") < F.col("end")) & (F.col("rank") >= F.col("end") - F.col("n")))
    aggs = []
    for name in shares:
        low = F.max(F.when((F.col("name") == name) & (F.col("side") == 0), F.col("v")))
        high = F.max(F.when((F.col("name") == name) & (F.col("side") == 1), F.col("v")))
        part = F.max(F.when(F.col("name") == name, F.col("part")))
        aggs.append(F.when((low == high) | (part == 0), low).otherwise(low + (high - low) * part).alias(name))
    return hits.groupBy("key").agg(*aggs).select(*[F.col(f"key.`{k}`") for k in keys], *shares)


def overall_quantiles(df: DataFrame, value: str, shares: dict[str, float]) -> dict[str, float | None]:
    """Exact quantiles of a whole column; none of an empty one."""
    row = exact_quantiles(df, [], value, shares).first()
    return {name: row[name] if row else None for name in shares}
