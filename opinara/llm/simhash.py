"""SimHash near-dedup with pigeonhole blocks.

Fingerprints within ``distance`` bits agree on all but ``distance`` of any
``m`` blocks, so each choice of ``m - distance`` blocks is a join key, and
close pairs share at least one. Only distinct fingerprints are joined. Rows of
one key are compared by a search from one member to the next over those not
yet reached: it gives the links of a spanning forest, so a group of thousands
of near copies gives about as many links as members, never all pairs, and no
link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opinara.llm.common import add_columns, fresh, row_hash
from opinara.llm.graph import components
from opinara.session import materialise

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SEED = 42
#: Members of a key that are compared in one group; larger groups are dealt out as pairs of tiles.
TILE = 50_000
SMALL = 16
SLICE = 256


def fingerprint(text: str | None, words: int = 4) -> int:
    """Unsigned 64 bits; no word: 0."""
    parts = (text or "").encode().translate(LOWER).split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts, k = ends - lengths, min(words, len(parts))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    hashes = np.array([digest(joined[s:e], SEED) for s, e in spans], np.uint64)
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def with_fingerprint(docs: DataFrame, column: str, words: int = 4, text_col: str = "text") -> DataFrame:
    """``docs`` and a bigint ``column`` with the bits of the fingerprint."""

    def compute(texts: list[str]) -> list[pa.Array]:
        return [pa.array(np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64))]

    return add_columns(docs, text_col, compute, [column], ["long"], SLICE)


def block_masks(distance: int, count: int) -> list[int]:
    """Masks of the chosen blocks, so many that a key has about as many values as there are fingerprints."""
    m = distance + 2
    while (m - distance) * (64 // m) < max(1, count).bit_length() and m < distance + 5:
        m += 1
    edges = [64 * i // m for i in range(m + 1)]
    blocks = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(m)]
    return [sum(c) for c in combinations(blocks, m - distance)]


def _close(values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest over distinct ``values``: a search that compares each reached member with those not yet reached."""
    left, right, rest = [], [], values
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= distance
            if near.any():
                found, rest = rest[near], rest[~near]
                left.append(np.full(len(found), x))
                right.append(found)
                queue.extend(found)
    none = np.empty(0, np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _links(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Links within each run of equal keys; rows come sorted by key, the fingerprint is the last column."""

    def links(keys: list[np.ndarray], fp: np.ndarray) -> pa.RecordBatch:
        new = np.ones(len(fp), bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(fp)))
        run = np.repeat(np.arange(len(start)), size)
        left, right = [], []
        few = np.repeat(size <= SMALL, size)
        for lag in range(1, min(SMALL, int(size.max(initial=1)))):
            i = np.flatnonzero(few[:-lag] & (run[lag:] == run[:-lag]))
            i = i[np.bitwise_count(fp[i] ^ fp[i + lag]) <= distance]
            left.append(fp[i])
            right.append(fp[i + lag])
        for r in np.flatnonzero(size > SMALL):
            a, b = _close(fp[start[r] : start[r] + size[r]], distance)
            left.append(a)
            right.append(b)
        none = np.empty(0, np.uint64)
        a, b = (np.concatenate([none, *x]).view(np.int64) for x in (left, right))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    kept = None
    for batch in batches:
        columns = [np.asarray(c) for c in batch.columns]
        if kept is not None:
            columns = [np.concatenate(x) for x in zip(kept, columns, strict=True)]
        if not len(columns[0]):
            continue
        same = np.logical_and.reduce([c == c[-1] for c in columns[:-1]])
        last = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if last:
            yield links([c[:last] for c in columns[:-1]], columns[-1][:last].view(np.uint64))
        kept = [c[last:] for c in columns]
    if kept is not None and len(kept[0]):
        yield links(kept[:-1], kept[-1].view(np.uint64))


def close_links(prints: DataFrame, distance: int = 4) -> DataFrame:
    """``a, b``: links that connect all distinct fingerprints (``fp``) within ``distance`` bits, directly or by others."""
    masks = block_masks(distance, prints.count())
    keyed = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in masks])).alias("t", "k"))
    sizes = keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = keyed.join(sizes, ["t", "k"]).withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int"))
    own = F.pmod(F.hash("fp"), F.col("tiles"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.struct(F.least(o, own).alias("u"), F.greatest(o, own).alias("v")))
    dealt = rows.select("t", "k", "fp", F.explode(pairs).alias("p")).select("t", "k", "p.u", "p.v", "fp")
    key = ["t", "k", "u", "v"]
    return dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(lambda b: _links(b, distance), "a long, b long").distinct()


def classes(rows: DataFrame, distance: int = 4) -> DataFrame:
    """``fp, component_id, stays`` for the distinct ``fp`` of ``rows``: the least ``doc_id`` reachable, and the fingerprint that has it."""
    prints = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "prints")
    roots = materialise(components(materialise(close_links(prints.select("fp"), distance), "links")).withColumnRenamed("node", "fp"), "roots")
    known = prints.join(roots, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    first = F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "fp"))
    least = known.groupBy("root").agg(first.alias("x")).select("root", F.col("x.first_id").alias("component_id"), F.col("x.fp").alias("stays"))
    return known.join(least, "root").select("fp", "component_id", "stays")


def near_groups(docs: DataFrame, words: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``docs``.

    A null text has no word, so its fingerprint is zero; zero links like any
    other fingerprint. Repeated rows get equal results; a null ``doc_id`` never
    names a component that has another. An empty table gives an empty one.
    """
    rows = with_fingerprint(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), "fp", words).select("doc_id", "fp")
    rows = materialise(rows, "fingerprints")
    return rows.join(classes(rows, distance), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, words: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stay: of each component the one with the least ``doc_id`` (null last).

    A task sends at most one row per fingerprint, however many copies there are.
    """
    fp, first = fresh(docs, "near_fp"), fresh(docs, "near_first")
    rows = materialise(with_fingerprint(docs, fp, words, text_col), "with-fingerprints")
    known = classes(rows.select(rows[id_col].alias("doc_id"), rows[fp].alias("fp")), distance)
    order = Window.partitionBy(fp).orderBy(F.col(f"`{id_col}`").asc_nulls_last(), row_hash(docs))
    alone = rows.withColumn(first, F.row_number().over(order)).filter(F.col(first) == 1).drop(first)
    stay = known.filter("fp = stays").select(F.col("fp").alias(fp))
    return alone.join(stay, fp, "left_semi").drop(fp)
