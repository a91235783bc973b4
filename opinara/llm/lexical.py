"""Ranked lexical search over bit-sliced Bloom signatures.

The documents are cut into blocks of about equal length. A block holds the
signature of each of its documents as a column of bits: every distinct term
sets a few bits, and sets them again, mixed otherwise, at each level of
``LEVELS`` that its occurrences reach. The bits are stored by row, a bitmap
over the documents of the block per bit, so the rows of a term, joined by
``and``, are a bitmap of the documents that may hold it that often. Bits of
other terms only add documents, so the weights of a question's terms, each
times the most that its level allows in a document of that length, sum up to
an upper bound for every document of the block at once.

A document is scored exactly, from its text, unless its bound lies below the
score of ten documents already scored. Such a threshold begins with what a pass
over some of the blocks has found and rises as a task goes on; where it begins
changes the work, never the result.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm.common import id_and_text
from opinara.operators.ranking import top_rows
from opinara.session import materialise, scratch_dir

#: Terms are the runs of ASCII letters, digits and everything beyond ASCII; only A-Z are lower-cased.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Occurrences at which a term sets its bits again; a term at level j occurs at most one time less than level j + 1 asks.
LEVELS = (1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64, 96, 128, 256, 512, 1024)
#: Rows of a block are this many times the entries of its longest document; bits that an entry sets.
ROWS_PER_ENTRY, PROBES = 16, 3
#: Rows at most, however long a text: beyond, more false bits raise the bounds of very long documents.
MOST_ROWS = 1 << 22
#: Documents and bytes of text of a block at most (a longer text is a block of its own), and bytes kept open by a task.
BLOCK_DOCS, BLOCK_BYTES, OPEN_BYTES = 512, 1 << 20, 16 << 20
#: Blocks in a row group: a task reads one group at a time.
GROUP_BLOCKS = 4
#: Distinct terms of the questions that are answered in one go; questions beyond go in further blocks.
QUESTION_TERMS = 1 << 15
#: One block in so many is read for the thresholds to begin with.
PROBE_EVERY = 16
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def index_schema(id_type: str) -> str:
    return f"doc_ids array<{id_type}>, lengths array<int>, rows int, slices binary, texts array<binary>"


class Backwards:
    """An id that sorts the other way round."""

    __slots__ = ("id",)

    def __init__(self, value):
        self.id = value

    def __lt__(self, other: Backwards) -> bool:
        return other.id < self.id


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def levels_of(tf: np.ndarray) -> np.ndarray:
    """How many of ``LEVELS`` each number of occurrences reaches."""
    return np.searchsorted(np.array(LEVELS), tf, side="right")


def bit_rows(hashes: np.ndarray, levels: np.ndarray, rows: int) -> np.ndarray:
    """The rows that entries set, ``PROBES`` each; ``rows`` is a power of two."""
    h = (hashes ^ (levels.astype(np.uint64) * MIX[0])) * MIX[1]
    h ^= h >> np.uint64(29)
    return np.stack([((h * MIX[i]) >> np.uint64(40)).astype(np.int64) & (rows - 1) for i in range(PROBES)])


@dataclass
class _Open:
    """Documents of one size class that wait for their block to fill."""

    entries: int
    ids: list
    lengths: list
    bits: list
    texts: list
    size: int = 0


def _sealed(block: _Open) -> tuple:
    """A block's row: its signatures, sliced by bit."""
    rows = min(ROWS_PER_ENTRY * block.entries, MOST_ROWS)
    table = np.zeros((rows, -(-len(block.ids) // 8) * 8), bool)
    for at, (hashes, levels) in enumerate(block.bits):
        table[bit_rows(hashes, levels, rows).ravel(), at] = True
    return block.ids, block.lengths, rows, np.packbits(table, axis=1).tobytes(), block.texts


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of documents with bit-sliced signatures, as a table: ``doc_ids, lengths, rows, slices, texts``.

    Every row of ``docs`` with a term is in one block, repeated rows in their
    own right; null texts and texts without a term are in none, as no question
    can find them. A block holds documents of a similar number of distinct
    terms, so that its rows are filled alike, up to a number of documents and
    of bytes, whatever the table looks like; nothing is shuffled.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, _Open] = {}
        names = ["doc_ids", "lengths", "rows", "slices", "texts"]
        kinds = [None, pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.list_(pa.binary())]

        def emit(entries: int) -> pa.RecordBatch:
            row = _sealed(waiting.pop(entries))
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

        for batch in batches:
            kinds[0] = pa.list_(batch.schema.field(0).type)
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = text.encode()
                terms = terms_of(raw)
                if not terms:
                    continue
                counts = Counter(terms)
                tf = np.fromiter(counts.values(), np.int64, len(counts))
                hashes = np.fromiter((xxhash.xxh3_64_intdigest(t) for t in counts), np.uint64, len(counts))
                reached = levels_of(tf)
                entries = np.repeat(hashes, reached)
                level = np.arange(len(entries)) - np.repeat(np.cumsum(reached) - reached, reached)
                size = 1 << (len(entries) - 1).bit_length()
                block = waiting.get(size)
                if block and block.size + len(raw) > BLOCK_BYTES:
                    yield emit(size)
                    block = None
                if block is None:
                    block = waiting[size] = _Open(size, [], [], [], [])
                block.ids.append(doc_id)
                block.lengths.append(len(terms))
                block.bits.append((entries, level))
                block.texts.append(raw)
                block.size += len(raw)
                if len(block.ids) == BLOCK_DOCS:
                    yield emit(size)
                if sum(b.size for b in waiting.values()) > OPEN_BYTES:
                    yield emit(max(waiting, key=lambda s: waiting[s].size))
        for size in sorted(waiting):
            yield emit(size)

    pairs = id_and_text(docs, id_col, text_col)
    schema, path = index_schema(pairs.schema["doc_id"].dataType.simpleString()), scratch_dir(docs.sparkSession, "signatures")
    pairs.mapInArrow(build, schema).write.option("parquet.block.row.count.limit", GROUP_BLOCKS).parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def question_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, term, repeats``: the terms of each question, rows of one id taken together; one without terms has no row."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, terms, counts = [], [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for term, n in Counter(terms_of(text.encode())).items():
                    ids.append(item)
                    terms.append(term)
                    counts.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(terms, pa.binary()), pa.array(counts, pa.int64())], ["item_id", "term", "repeats"])

    pairs = id_and_text(items, id_col, text_col).withColumnRenamed("doc_id", "item_id")
    kind = pairs.schema["item_id"].dataType.simpleString()
    return pairs.mapInArrow(split, f"item_id {kind}, term binary, repeats long").groupBy("item_id", "term").agg(F.sum("repeats").alias("repeats"))


def document_frequencies(index: DataFrame, terms: list[bytes]) -> dict[bytes, int]:
    """Documents that hold each of the terms, exactly, in one pass over the texts."""
    wanted = frozenset(terms)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for texts in batch.column(0):
                for text in texts.values:
                    found.update(wanted.intersection(terms_of(text.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["term", "n"])

    counted = index.select("texts").mapInArrow(tally, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {bytes(r.term): r.n for r in counted.collect()}  # no more rows than terms were asked for


class Questions:
    """A block of questions as arrays, and the arithmetic of scores and bounds."""

    def __init__(self, rows: list[tuple], frequencies: dict[bytes, int], documents: int, length: int, k: int):
        held = [(item, term, repeats) for item, term, repeats in rows if frequencies.get(term)]
        self.k, self.documents, self.length = k, documents, length
        self.items = sorted({item for item, _, _ in held}, key=lambda i: (i is not None, i))
        self.terms = sorted({term for _, term, _ in held})
        place, at = {t: i for i, t in enumerate(self.terms)}, {x: i for i, x in enumerate(self.items)}
        self.place = place
        self.hashes = np.array([xxhash.xxh3_64_intdigest(t) for t in self.terms], np.uint64)
        weight = [math.floor(1000 * math.log((2 * documents + 2) / (2 * frequencies[t] + 1))) for t in self.terms]
        self.uses: list[tuple[np.ndarray, np.ndarray]] = []
        by_item: dict[int, list] = {}
        for item, term, repeats in sorted(held, key=lambda r: r[1]):
            by_item.setdefault(at[item], []).append((place[term], weight[place[term]] * repeats))
        for i in range(len(self.items)):
            self.uses.append((np.array([p for p, _ in by_item[i]]), np.array([w for _, w in by_item[i]], np.int64)))

    def damping(self, lengths: np.ndarray) -> np.ndarray:
        """Eight times m of each document."""
        return 8 * (25 + (75 * lengths.astype(np.int64) * self.documents) // self.length)

    @staticmethod
    def saturation(tf: np.ndarray, damping: np.ndarray) -> np.ndarray:
        return (1_000_000_000 * tf) // (1000 * tf + damping)

    def most_saturation(self, lengths: np.ndarray) -> np.ndarray:
        """The most that each level allows, 0 for absent, in documents of these lengths (level, document)."""
        most_tf = np.array([0, *(n - 1 for n in LEVELS[1:]), 0], np.int64)[:, None] + np.zeros(len(lengths), np.int64)
        most_tf[-1] = lengths
        return self.saturation(np.minimum(most_tf, lengths), self.damping(lengths))

    def bounds(self, slices: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """No score of a question (row) in a document (column) is higher."""
        rows, docs = len(slices), len(lengths)
        most = self.most_saturation(lengths)
        ceilings = np.zeros((len(self.terms), docs), np.int64)
        left, stood, reached = np.arange(len(self.terms)), None, np.zeros((len(self.terms), docs), np.uint8)
        for level in range(len(LEVELS)):
            if not len(left):
                break
            at = bit_rows(self.hashes[left], np.full(len(left), level), rows)
            bits = slices[at[0]]
            for more in at[1:]:
                bits = bits & slices[more]
            bits = bits if stood is None else bits & stood  # a level counts where all below it do
            some = bits.any(axis=1)
            left, stood = left[some], bits[some]
            reached[left] += np.unpackbits(stood, axis=1, count=docs)
        some = np.flatnonzero(reached.any(axis=1))
        ceilings[some] = most[reached[some], np.arange(docs)]
        return np.stack([weights @ ceilings[terms] for terms, weights in self.uses])

    def scores(self, text: bytes, length: int, of: np.ndarray) -> list[int]:
        """The exact scores of a document for some of the questions."""
        tf = np.zeros(len(self.terms), np.int64)
        for term, n in Counter(terms_of(text)).items():
            if (p := self.place.get(term)) is not None:
                tf[p] = n
        parts = self.saturation(tf, self.damping(np.array([length]))[0])
        return [int(self.uses[i][1] @ parts[self.uses[i][0]]) for i in of]


def _best(index: DataFrame, questions: Questions, least: list[int]) -> DataFrame:
    """``item, doc_id, score``: per task, the best of its documents that reach the question's ``least``."""
    k, id_type = questions.k, index.schema["doc_ids"].dataType.elementType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = np.maximum(np.array(least, np.int64), 1)
        best: list[list] = [[] for _ in questions.items]  # heaps, the worst first: score, with an id, id
        kind, ties = pa.null(), count()

        def worth(bound: np.ndarray, i: int) -> np.ndarray:
            return bound >= max(floor[i], best[i][0][0] if len(best[i]) == k else 0)

        for batch in batches:
            kind = batch.schema.field("doc_ids").type.value_type
            for doc_ids, lengths, rows, slices, texts in zip(*(batch.column(c) for c in ("doc_ids", "lengths", "rows", "slices", "texts")), strict=True):
                ids, n = doc_ids.as_py(), np.array(lengths.as_py(), np.int64)
                bound = questions.bounds(np.frombuffer(slices.as_py(), np.uint8).reshape(rows.as_py(), -1), n)
                # the most promising documents first, so that thresholds rise early
                for d in np.argsort(-bound.max(axis=0), kind="stable") if len(bound) else []:
                    of = np.array([i for i in np.flatnonzero(bound[:, d] >= floor) if worth(bound[i, d], i)], np.int64)
                    if not len(of):
                        continue
                    for i, score in zip(of, questions.scores(texts.values[d].as_py(), int(n[d]), of), strict=True):
                        if score >= floor[i]:
                            entry = (score, ids[d] is not None, Backwards(ids[d]) if ids[d] is not None else next(ties))
                            if len(best[i]) < k:
                                heapq.heappush(best[i], entry)
                            else:
                                heapq.heappushpop(best[i], entry)
        out = [(i, e[2].id if e[1] else None, e[0]) for i, heap in enumerate(best) for e in heap]
        if out:
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], kind), pa.array(columns[2], pa.int64())], ["item", "doc_id", "score"])

    return index.select("doc_ids", "lengths", "rows", "slices", "texts").mapInArrow(search, f"item int, doc_id {id_type}, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    return top_rows(found, ["item"], [F.desc("score"), F.asc_nulls_last("doc_id")], k, rank="rank")


def search_index(index: DataFrame, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text", probe_every: int = PROBE_EVERY) -> DataFrame:
    """The ``k`` best documents of each question: ``item_id, rank, doc_id, score``.

    Scores are positive and equal ones go by id, null ids last. A question
    without a term, or whose terms are in no document, has no row; rows of one
    question id count together; an empty index or table gives no row. Questions
    go in blocks of a bounded number of terms; each block reads the texts once
    for its document frequencies and the signatures once for its answers.
    """
    spark = index.sparkSession
    documents, length = index.select(F.explode("lengths").alias("n")).agg(F.count("*"), F.sum("n")).first()
    terms = materialise(question_terms(items, id_col, text_col), "question-terms")
    kind = terms.schema["item_id"].dataType.simpleString()
    blocks = -(-terms.count() // QUESTION_TERMS) if documents else 0
    id_type = index.schema["doc_ids"].dataType.elementType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id {id_type}, score long")
    for b in range(blocks):
        own = terms.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        rows = [(r.item_id, bytes(r.term), r.repeats) for r in own.collect()]  # a block of questions
        questions = Questions(rows, document_frequencies(index, sorted({t for _, t, _ in rows})), documents, length, k)
        if not questions.items:
            continue
        probe = _ranked(_best(index.filter(F.pmod(F.xxhash64("doc_ids"), F.lit(probe_every)) == 0), questions, [1] * len(questions.items)), k)
        least = {r.item: r.score for r in probe.filter(F.col("rank") == k).collect()}
        found = _ranked(_best(index, questions, [least.get(i, 1) for i in range(len(questions.items))]), k)
        names = spark.createDataFrame(list(enumerate(questions.items)), f"item int, item_id {kind}")
        out = out.unionByName(found.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return out


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``search_index`` over an index of ``docs`` built for the purpose."""
    return search_index(build_index(docs), items, k)
