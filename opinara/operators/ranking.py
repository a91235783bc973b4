"""Ranking helpers that hold up under hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.session import materialise

RANK_BUCKETS = 4096


def compute_once(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """Add a costly column that later filters read.

    A filter on a plain column is pushed below it, and its expression is then
    evaluated in the filter and again in the projection. A one-element
    ``explode_outer`` stops that and costs no shuffle.
    """
    return df.select(*[c for c in df.columns if c != name], F.explode_outer(F.array(expr)).alias(name))


def top_rows(df: DataFrame, keys: list[str], order: list, k: int | None, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of each key in ``order``, which should be total; all rows, numbered, without ``k``.

    ``row_number() <= k`` is planned with a group limit before the shuffle, so
    each task sends at most ``k`` rows of a key, however hot the key is.
    """
    name = rank or "__rank"
    if len(keys) > 1:
        # rows sort by the eight bytes of a hash first, and by the keys only on a tie
        df, keys = df.withColumn("__key", F.xxhash64(*keys)), ["__key", *keys]
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    out = out if k is None else out.filter(F.col(name) <= k)
    return out.drop("__key") if rank else out.drop("__key", name)


def first_rows(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Keep-first dedupe."""
    return top_rows(df, keys, order, 1)


def repeated_keys(df: DataFrame, keys: list) -> DataFrame | None:
    """Hashes, ``__key``, that more than one row's keys have, as a written table; None without any. Only hashes move."""
    found = materialise(df.groupBy(F.xxhash64(*keys).alias("__key")).count().filter("count > 1").select("__key"), "repeated-keys")
    return None if found.isEmpty() else found


def first_of_stored(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Keep-first dedupe of a written table, which is read more than once: whole rows move only if their key may be there twice."""
    repeated = repeated_keys(df, keys)
    if repeated is None:
        return df
    df, columns = df.withColumn("__key", F.xxhash64(*keys)), df.columns
    several = top_rows(df.join(repeated, "__key", "left_semi"), keys, order, 1)
    return df.join(repeated, "__key", "left_anti").select(columns).unionByName(several.select(columns))


def seeded_hash(seed: int, *cols: Column | str) -> Column:
    """Repeatable pseudo-random 64-bit number of a row."""
    return F.xxhash64(F.lit(seed), *cols)


def number_rows(df: DataFrame, order: list, name: str) -> DataFrame:
    """Rows numbered from 1 in a total ``order``.

    The rows are sorted into ranges once, as a written table, and numbered
    inside them; the ranges' sizes, one row each, give the numbers before.
    """
    part = F.spark_partition_id()
    rows = df.repartitionByRange(*order).withColumn("__part", part)
    rows = materialise(rows.withColumn("__in", F.row_number().over(Window.partitionBy("__part").orderBy(*order))), "numbered")
    sizes = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    return rows.join(before, "__part").withColumn(name, F.col("__before") + F.col("__in")).drop("__part", "__in", "__before")


def rank_in_group(df: DataFrame, keys: list[str], hash_col: str, ties: list[str], rank: str,
                  total: str | None = None, buckets: int = RANK_BUCKETS) -> DataFrame:
    """Exact rank by ``hash_col`` (then ``ties``) inside each key.

    A key may hold a third of all rows, so no window spans a whole key: rows
    are cut into order-preserving hash ranges, ranked inside their range, and
    shifted by the number of rows in the ranges before it.
    """
    shift = 64 - (buckets - 1).bit_length()
    # top bits of the hash, moved from signed to unsigned order
    parted = df.withColumn("__range", F.shiftright(F.col(hash_col), shift) + F.lit(buckets // 2))
    sizes = parted.groupBy(*keys, "__range").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__range")
    sizes = sizes.select(
        *[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)],
        F.col("__range").alias("__r"),
        (F.sum("__n").over(before) - F.col("__n")).alias("__before"),
        F.sum("__n").over(Window.partitionBy(*keys)).alias("__of"),
    )
    inside = Window.partitionBy(*keys, "__range").orderBy(hash_col, *ties)
    ranked = parted.withColumn("__inside", F.row_number().over(inside))
    match = F.col("__range") == F.col("__r")
    for i, c in enumerate(keys):
        match = match & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    out = ranked.join(sizes, match).withColumn(rank, F.col("__before") + F.col("__inside"))
    if total:
        out = out.withColumn(total, F.col("__of"))
    return out.drop("__range", "__r", "__inside", "__before", "__of", *[f"__k{i}" for i in range(len(keys))])
