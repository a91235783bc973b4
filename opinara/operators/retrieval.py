"""Opinion chunks, exact vector search and hybrid ranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara import constants as K
from opinara.functions import text as X
from opinara.functions.labels import chunk_label
from opinara.functions.numbers import round_up
from opinara.operators.ranking import first_of_stored, first_rows, top_rows
from opinara.session import materialise

#: Rows that a task forms into blocks at once.
HELD = 1 << 16


def indexable(text: Column, aspect: Column, sentiment: Column) -> Column:
    return (F.length(F.trim(text)) >= 24) & (F.trim(aspect) != "") & sentiment.isin(K.SENTIMENTS)


def opinion_chunks(items: DataFrame, stored: bool = False) -> DataFrame:
    """Distinct short texts of opinions with a deterministic id.

    To be read more than once they are ``stored``: then the texts are written, and move only if they may be there twice.
    """
    out = items.select(
        "product_id", F.coalesce("review_id", F.lit("")).alias("review_id"), F.trim("aspect").alias("aspect"),
        F.trim(F.coalesce("sentiment", F.lit("neutral"))).alias("sentiment"),
        F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("confidence"),
        F.explode_outer(F.array(X.compress("sentence"))).alias("text"), "item_id",
    ).filter(indexable(F.col("text"), F.col("aspect"), F.col("sentiment")))
    out = (materialise(out, "chunk-texts") if stored else out).withColumn("low", F.lower("text"))
    first = first_of_stored if stored else first_rows
    out = first(out, ["product_id", "review_id", "aspect", "sentiment", "low"], ["item_id", F.desc("confidence"), "text"])
    columns = [F.col(c) for c in ("product_id", "review_id", "aspect", "sentiment", "text")]
    return out.select(
        X.point_id(*columns).alias("point_id"), *columns, "confidence", chunk_label(F.col("aspect")).alias("aspect_label")
    )


def embed_texts(df: DataFrame, text: str, embedder: Callable[[list[str]], list[list[float]]], vector: str = "vector") -> DataFrame:
    """Unit vectors of a text column from an external embedder, in Arrow batches."""
    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            raw = np.asarray(embedder(batch.tolist()), dtype="float64").reshape(len(batch), -1)
            norm = np.linalg.norm(raw, axis=1, keepdims=True)
            yield pd.Series(list((raw / np.where(norm == 0, 1.0, norm)).astype("float32")))

    return df.withColumn(vector, embed(F.col(text)))


def sentiments_for_intent(intent: Column) -> Column:
    """Sentiments a search is limited to; NULL means all."""
    return F.when(intent.isin(K.NEGATIVE_INTENTS), F.array(F.lit("negative"))).when(
        intent.isin(K.ALL_SENTIMENT_INTENTS), F.array(*[F.lit(s) for s in ("negative", "positive", "neutral")])
    )


def strategy_for_intent(intent: Column) -> Column:
    first = intent.isin(K.STATISTICAL_INTENTS)
    return F.struct(
        F.when(first, "structured_first").otherwise("vector_first").alias("strategy"),
        F.when(first, 0.35).otherwise(0.65).alias("vector_weight"), F.when(first, 0.65).otherwise(0.35).alias("structured_weight"),
    )


def _blocks(rows: DataFrame, id_col: str, name: str, size: int) -> DataFrame:
    """``product_id`` and an array of rows, ordered by id: a product's rows in arrays of ``size`` at most.

    Rows of a product need not all come together, so they are dealt by product
    in parts of a moderate size, and a hot product is several of these.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    columns = [id_col, *(c for c in rows.columns if c not in ("product_id", id_col))]

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def formed() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).sort_by([("product_id", "ascending"), (id_col, "ascending")]).combine_chunks()
            product = table["product_id"].chunk(0)
            runs = np.append(0, np.flatnonzero(pc.not_equal(product[1:], product[:-1]).to_numpy(zero_copy_only=False)) + 1)
            begin = np.concatenate([np.arange(a, b, size) for a, b in zip(runs, [*runs[1:], len(product)], strict=True)])
            whole = pa.StructArray.from_arrays([table[c].chunk(0) for c in columns], columns)
            lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(product)), pa.int32()), whole)
            held.clear()
            return pa.RecordBatch.from_arrays([product.take(pa.array(begin)), lists], ["product_id", name])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= HELD:
                yield formed()
        if held:
            yield formed()

    fields = ",".join(f"`{c}`:{kinds[c]}" for c in columns)
    dealt = rows.filter(F.col("product_id").isNotNull()).hint("rebalance", "product_id")
    return dealt.mapInArrow(form, f"product_id {kinds['product_id']}, {name} array<struct<{fields}>>")


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(vectors), -1)


def _allowed(wanted: pa.ListScalar, values: pa.DictionaryArray) -> np.ndarray | None:
    """Which rows a filter lets through; none given lets all."""
    if not wanted.is_valid or not len(wanted):
        return None
    allowed = set(wanted.as_py())
    inside = np.array([v in allowed for v in values.dictionary.to_pylist()] + [False])
    return inside[values.indices.fill_null(len(inside) - 1).to_numpy()]


def _nearest(queries: pa.StructArray, chunks: pa.StructArray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each query the places of its k best chunks, and their scores; equal scores in order of place."""
    # rounded as ``round_up`` does, here, so that order and score are one
    scores = np.floor((_matrix(queries.field("q_vector")) @ _matrix(chunks.field("vector")).T + 1e-9) * 1e6 + 0.5) / 1e6
    sentiments, aspects = (chunks.field(c).dictionary_encode() for c in ("sentiment", "aspect"))
    for i, score in enumerate(scores):
        place = np.arange(len(score))
        for wanted, values in ((queries.field("sentiments")[i], sentiments), (queries.field("aspects")[i], aspects)):
            if (ok := _allowed(wanted, values)) is not None:
                place = place[ok[place]]
        own = score[place]
        if len(own) > k:
            place = place[own >= np.partition(own, -k)[-k]]  # ties included
        place = place[np.argsort(-score[place], kind="stable")[:k]]
        yield i, place, score[place]


def vector_search(queries: DataFrame, chunks: DataFrame, k: int = 8, block: int = 2048, asked: int = 512) -> DataFrame:
    """The k nearest chunks of each query by cosine, exact.

    ``queries``: query_id, product_id, q_vector, sentiments, aspects (NULL or
    empty arrays do not filter). Vectors must be unit; rows without one are
    left out; a chunk_id names one chunk of a product.

    Queries and chunks of a product meet as blocks, each a matrix: a block of
    questions times a block of chunks is one product of matrices, of which k
    places per question go on. So no pair of a question and a chunk is ever a
    row, and a product with any number of chunks is spread over its blocks.
    """
    wanted = queries.filter("q_vector is not null").select("query_id", "product_id", "q_vector", "sentiments", "aspects")
    pool = chunks.filter("vector is not null").join(queries.select("product_id").distinct(), "product_id", "left_semi")
    pool = pool.select("chunk_id", "product_id", "aspect", "sentiment", "vector")
    pairs = _blocks(wanted, "query_id", "queries", asked).join(_blocks(pool, "chunk_id", "chunks", block), "product_id")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for product, some, others in zip(*(batch.column(c) for c in ("product_id", "queries", "chunks")), strict=True):
                for i, place, score in _nearest(some.values, others.values, k):
                    at = pa.array(place)
                    columns = [pa.repeat(product, len(place)), pa.repeat(some.values.field("query_id")[i], len(place)), others.values.field("chunk_id").take(at), pa.array(score, pa.float64())]
                    yield pa.RecordBatch.from_arrays(columns, ["product_id", "query_id", "chunk_id", "semantic_score"])

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    found = pairs.select("product_id", "queries", "chunks").mapInArrow(
        search, f"product_id {kind(pool, 'product_id')}, query_id {kind(wanted, 'query_id')}, chunk_id {kind(pool, 'chunk_id')}, semantic_score double",
    )
    best = top_rows(found, ["query_id"], [F.desc("semantic_score"), "chunk_id"], k, rank="rank")
    own = [c for c in queries.columns if c not in ("product_id", "q_vector")]
    return best.join(queries.select(*own), "query_id").join(chunks.drop("vector"), ["product_id", "chunk_id"])


def hybrid_score(vector_weight: Column, structured_weight: Column) -> Column:
    """Source weight, similarity, confidence and bonuses for aspect and sentiment."""
    aspect = F.when(F.array_contains("target_aspects", F.coalesce("aspect_code", "aspect")), 0.2).otherwise(0.0)
    s, intent = F.col("sentiment"), F.col("intent")
    sentiment = (
        F.when(intent.isin(K.NEGATIVE_INTENTS) & (s == "negative"), 0.25)
        .when((intent == "ASPECT_QA") & s.isin("negative", "positive"), 0.15)
        .when(intent.isin("SUMMARY", "RECOMMENDATION") & s.isin("positive", "negative"), 0.1)
        .otherwise(0.0)
    )
    base = F.when(F.col("source") == "vector", vector_weight).otherwise(structured_weight)
    return round_up(
        base + F.coalesce("semantic_score", F.lit(0.0)) * 0.35 + F.coalesce("confidence", F.lit(0.0)) * 0.25 + aspect + sentiment
    )


def hybrid_rank(questions: DataFrame, structured: DataFrame, vectors: DataFrame, limit: int = 6) -> DataFrame:
    """Both evidence lists of a question merged, best row per review, ordered by score.

    ``structured`` and ``vectors``: question_id, rank, review_id, aspect_code,
    aspect, sentiment, confidence, text; vectors also semantic_score. A
    question has a handful of rows of each.
    """
    columns = ["question_id", "rank", "review_id", "aspect_code", "aspect", "sentiment", "confidence", "text"]
    both = structured.select(*columns, F.lit(None).cast("double").alias("semantic_score"), F.lit("structured").alias("source")).unionByName(
        vectors.select(*columns, "semantic_score", F.lit("vector").alias("source"))
    )
    rows = both.filter(F.length(F.trim("text")) > 0).join(
        questions.select("question_id", "intent", "target_aspects"), "question_id"
    )
    plan = strategy_for_intent(F.col("intent"))
    rows = rows.withColumn("plan", plan)
    rows = rows.withColumn("hybrid_score", hybrid_score(F.col("plan.vector_weight"), F.col("plan.structured_weight")))
    leads = (F.col("plan.strategy") == "vector_first") == (F.col("source") == "vector")
    rows = rows.withColumns({
        "place": F.when(leads, F.col("rank")).otherwise(F.col("rank") + 1000),
        "key": F.when(F.coalesce("review_id", F.lit("")) != "", F.col("review_id")).otherwise(X.text_key("text")),
    })
    # a question brings a dozen rows, so these windows are short
    per_key = Window.partitionBy("question_id", "key")
    rows = rows.withColumn("first_place", F.min("place").over(per_key))
    best = rows.withColumn("__n", F.row_number().over(per_key.orderBy(F.desc("hybrid_score"), "place"))).filter("__n = 1")
    top = top_rows(best.drop("rank"), ["question_id"], [F.desc("hybrid_score"), "first_place"], limit, rank="rank")
    return top.select(
        "question_id", "rank", "review_id", "aspect_code", "aspect", "sentiment", "confidence", "text", "source",
        "hybrid_score", F.col("plan.strategy").alias("strategy"),
    )


def request_key(product: Column, question: Column, intent: Column, aspects: Column) -> Column:
    """sha1 of the request as JSON with sorted keys."""
    record = F.struct(
        aspects.alias("aspects"), intent.alias("intent"), product.alias("product_id"),
        F.lower(F.trim(question)).alias("question"),
    )
    return F.concat(F.lit("retrieval:"), F.sha1(F.to_json(record)))


def split_by_cache(requests: DataFrame, cache: DataFrame, now: Column, ttl_seconds: int = K.CACHE_TTL_SECONDS) -> tuple[DataFrame, DataFrame]:
    """Requests answered by a fresh cached result, and those that are not."""
    fresh = cache.filter(F.col("created_at") > now - F.make_dt_interval(secs=F.lit(ttl_seconds)))
    fresh = top_rows(fresh, ["cache_key"], [F.desc("created_at")], 1)
    hits = requests.join(fresh, "cache_key")
    return hits, requests.join(fresh.select("cache_key"), "cache_key", "left_anti")
