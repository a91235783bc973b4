"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

A normalised text is cut where its own characters say so, so equal stretches of
different texts give equal chunks. A chunk's 64-bit hash serves as its
identifier once verified: all chunks of one hash must be the same text, which
is checked by moving each distinct chunk once. Documents are then compared by
their lists of identifiers; whole texts are never moved. Should different
chunks ever share a hash, the SHA-256 of the texts is compared as well.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.llm.common import SPACES, fresh, row_hash
from opinara.session import materialise

#: A chunk has at least LEAST code points and ends after three characters of the cut class, or after MOST.
LEAST, MOST = 512, 4096
CUT_CLASS = "".join(f"\\x{{{c:x}}}" for c in range(0x21, 0x250) if c % 4 == 0)
CHUNK = rf"(?s).{{{LEAST},{MOST}}}?[{CUT_CLASS}]{{3}}|.{{1,{MOST}}}"


def without_spaces(text: Column) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), SPACES, text)


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, text_sha256, parts``: the chunks of each row, in order."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].alias("doc_id"), F.char_length(text).cast("long").alias("n_chars"), without_spaces(text).alias("t"))
    return rows.select("doc_id", "n_chars", F.sha2("t", 256).alias("text_sha256"), chunks(F.col("t")).alias("parts"))


def shared_hashes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``h``: hashes that belong to more than one chunk text (normally none)."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return _shared(docs.select(chunks(without_spaces(text)).alias("parts")))


def _shared(parts: DataFrame) -> DataFrame:
    rows = parts.select(F.explode("parts").alias("c")).select(F.xxhash64("c").alias("h"), "c")
    return rows.groupBy("h").agg(F.min("c").alias("a"), F.max("c").alias("b")).filter("a <> b").select("h")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256, n_chars`` for each row of ``docs``.

    Texts are equal when identical without white space; a null text is empty,
    and all empty texts are equal. The row with the most code points, then the
    smallest ``doc_id`` (null last), stays. Rows repeated with the same id and
    length as the row that stays are all ``kept``. An empty table gives an
    empty one; other columns of ``docs`` are ignored.
    """
    cut = materialise(chunked(docs, id_col, text_col), "chunks")  # texts are cut once
    also = F.lit("") if materialise(_shared(cut), "shared-hashes").isEmpty() else F.col("text_sha256")
    recipe = F.transform("parts", lambda c: F.xxhash64(c))
    rows = materialise(cut.select("doc_id", "n_chars", "text_sha256", recipe.alias("recipe"), also.alias("also")), "recipes")
    rows = rows.withColumn("recipe_hash", F.xxhash64("recipe"))
    key = ["recipe_hash", "recipe", "also"]
    order = F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"))
    groups = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("group_size"), F.min(order).alias("best"))
    joined = rows.join(groups, key)
    kept = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("n_chars") == -F.col("best.n"))
    return joined.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256", "n_chars")


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stay; of rows equal in all columns, one.

    A task sends at most one row per group, however many copies there are.
    """
    t, n, recipe, sha, first = (fresh(docs, f"dedup_{x}") for x in ("text", "n", "recipe", "sha", "first"))
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.withColumns({t: without_spaces(text), n: F.char_length(text)}).withColumn(recipe, F.transform(chunks(F.col(t)), lambda c: F.xxhash64(c)))
    exact = materialise(shared_hashes(docs, text_col), "shared-hashes").isEmpty()
    rows = rows.withColumn(sha, F.lit("") if exact else F.sha2(t, 256)).drop(t)
    group = Window.partitionBy(F.xxhash64(recipe), F.col(recipe), F.col(sha)).orderBy(F.desc(n), docs[id_col].asc_nulls_last(), row_hash(docs))
    return rows.withColumn(first, F.row_number().over(group)).filter(F.col(first) == 1).drop(n, recipe, sha, first)
