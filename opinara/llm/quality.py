"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm import ftrl
from opinara.llm.common import add_columns, fresh, id_and_text, id_remainder

#: Hashed features; labelled rows of a fit; words a worker remembers (more only cost time).
BITS, SAMPLE, REMEMBERED = 18, 6000, 400_000
EPOCHS, THRESHOLD = 4, 0.3
MIX = np.uint64(0x9E3779B97F4A7C15)
_forms: dict[str, int] = {}


def _word(word: str) -> int:
    """The word's hash above, the hash of its form (letter case, digits, signs around it) in the low 16 bits."""
    core = word.strip("!?.,;:#$%&*|()[]{}<>\"'=-_~^+/\\@`")
    lead = word[: word.index(core)] if core else ""
    case = "U" if core.isupper() else "l" if core.islower() else "T" if core.istitle() else "x"
    form = f"{lead[:2]} {case * min(2, len(core))} {word[len(lead) + len(core) :][:3]} {any(c.isdigit() for c in core):d}"
    return zlib.crc32(word.lower().encode()) << 16 | zlib.crc32(form.encode()) & 0xFFFF


def features(text: str) -> np.ndarray:
    """Feature numbers of the word and form unigrams and bigrams of a text, repeats included; 0 is the constant."""
    words = text.split()
    if len(_forms) > REMEMBERED:
        _forms.clear()
    known = _forms
    codes = np.fromiter((known[w] if w in known else known.setdefault(w, _word(w)) for w in words), np.uint64, len(words))
    form = codes & np.uint64(0xFFFF)
    again = (codes[1:] == codes[:-1]).astype(np.uint64)
    parts = [codes >> np.uint64(16), form + np.uint64(1 << 40), (codes[:-1] >> np.uint64(16)) * MIX + (codes[1:] >> np.uint64(16)), (form[:-1] << np.uint64(17) | form[1:] << np.uint64(1) | again) + np.uint64(1 << 50)]
    mixed = np.concatenate(parts) * MIX
    return ((mixed >> np.uint64(64 - BITS)) | np.uint64(1)).astype(np.int64)


def row_of(text: str) -> ftrl.Row:
    at, count = np.unique(features(text), return_counts=True)
    return np.append(at, 0), np.append(SCALE * count / max(1, count.sum()), 1.0)


#: A feature's value is this times its share of the text's n-grams.
SCALE = 20.0


def scores(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """Chance of label 1: a sparse dot product per text."""
    sums = np.array([weights[0] + (SCALE * weights[f].sum() / len(f) if len(f := features(t)) else 0.0) for t in texts])
    return 1 / (1 + np.exp(-np.clip(sums, -40, 40)))


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, modulus: int = 5) -> DataFrame:
    """``text, label`` of at most ``bound`` labelled ids whose remainder isn't 0, chosen by a hash of the id.

    The chosen ids are at most ``bound`` rows, so they can be sent to every task.
    """
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("label"))
    chosen = known.filter(id_remainder(F.col("doc_id"), modulus) != 0).orderBy(F.xxhash64("doc_id", F.lit("quality")), "doc_id").limit(bound)
    found = id_and_text(docs).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> np.ndarray:
    """Weights learned in one task from at most ``bound`` labelled texts; without labelled texts all weights are 0."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, target = [], [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            rows += [row_of(t) for t in batch.column(1).to_pylist()]
            target += batch.column(2).to_pylist()
        order = np.argsort(np.array(ids, np.int64), kind="stable")  # whatever order the rows came in
        weights = ftrl.fit([rows[i] for i in order], np.array(target, float)[order].reshape(-1, 1), 1 << BITS, EPOCHS)
        yield pa.RecordBatch.from_arrays([pa.array([weights[:, 0].astype("<f4").tobytes()])], ["w"])

    (row,) = labelled_sample(docs, labels, bound).select("doc_id", "text", F.col("label").cast("int")).coalesce(1).mapInArrow(learn, "w binary").collect() or [None]
    return np.frombuffer(row.w, "<f4").astype(float) if row else np.zeros(1 << BITS)


def with_score(docs: DataFrame, weights: np.ndarray, column: str, text_col: str = "text") -> DataFrame:
    """``docs``, all its columns, and the score of each row. The model has a fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    return add_columns(docs, text_col, lambda texts: [pa.array(scores(texts, shared.value))], [column], ["double"])


def score_documents(docs: DataFrame, weights: np.ndarray, modulus: int = 5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``.

    A null text counts as empty and gets the score of the constant alone.
    Repeated rows get equal scores; an empty table gives an empty one.
    """
    rows = with_score(id_and_text(docs), weights, "score").drop("text")
    return rows.select("doc_id", (id_remainder(F.col("doc_id"), modulus) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier doesn't reject."""
    column = fresh(docs, "quality_score")
    return with_score(docs, weights, column).filter(F.col(column) >= THRESHOLD).drop(column)
