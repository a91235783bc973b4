"""Language ID: sparse multinomial regression on TF-IDF character n-grams, with temperature calibration."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm import ftrl
from opinara.llm.common import add_columns, id_and_text, id_remainder

#: Hashed n-grams; the longest n-gram; labelled texts of a fit, a fifth of them for the temperature.
BITS, LONGEST, SAMPLE = 16, 3, 4000
EPOCHS = 3
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
#: Fixed odd multipliers that mix the characters of an n-gram.
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


@dataclass
class Model:
    classes: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float


def counts(text: str) -> np.ndarray:
    """How often each hashed n-gram of 1 to ``LONGEST`` characters occurs."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    parts, h = [], c
    for n in range(1, LONGEST + 1):
        if n > 1:
            h = h[:-1] * MIX[0] + c[n - 1 :]
        parts.append(((h + np.uint64(n)) * MIX[1]) >> np.uint64(64 - BITS))
    return np.bincount(np.concatenate(parts).astype(np.int64), minlength=1 << BITS)


def row_of(text: str, idf: np.ndarray) -> ftrl.Row:
    """TF-IDF row of length 1, with a constant as the last feature."""
    count = counts(text)
    at = np.flatnonzero(count)
    x = np.log1p(count[at]) * idf[at]
    return np.append(at, 1 << BITS), np.append(x / (math.sqrt(float(x @ x)) or 1.0), 1.0)


def _training(docs: DataFrame, modulus: int, left_out: int) -> DataFrame:
    return docs.filter(id_remainder(docs["doc_id"], modulus) != left_out)


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """Of each hashed n-gram, over all rows of ``docs``: a task sends one number per n-gram, 2**BITS at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen += counts(t) > 0
                rows += 1
        at = np.append(np.flatnonzero(seen), 1 << BITS)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(seen[at[:-1]], rows))], ["k", "n"])

    total = docs.select("text").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros((1 << BITS) + 1)
    seen[np.asarray(total["k"])] = np.asarray(total["n"])
    return np.log((1 + seen[-1]) / (1 + seen[:-1])) + 1


def labelled_sample(docs: DataFrame, bound: int = SAMPLE, modulus: int = 4, left_out: int = 2) -> DataFrame:
    """``doc_id, text, lang`` of at most ``bound`` ids with a language, chosen by a hash of the id; the ids are sent to every task."""
    known = _training(docs.select("doc_id", "lang"), modulus, left_out).filter("doc_id IS NOT NULL AND lang IS NOT NULL")
    chosen = known.groupBy("doc_id").agg(F.min("lang").alias("label")).orderBy(F.xxhash64("doc_id", F.lit("lang")), "doc_id").limit(bound)
    return id_and_text(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))


def _learn(ids: list[int], texts: list[str], labels: list[str], idf: np.ndarray) -> Model:
    classes = sorted(set(labels))
    if not classes:
        return Model([], idf, np.zeros(((1 << BITS) + 1, 0)), 1.0)
    order = np.argsort(np.array(ids, np.int64), kind="stable")  # whatever order the rows came in
    rows = [row_of(texts[i], idf) for i in order]
    target = np.eye(len(classes))[[classes.index(labels[i]) for i in order]]
    if len(classes) == 1:
        return Model(classes, idf, np.zeros(((1 << BITS) + 1, 1)), 1.0)
    tested = np.arange(len(rows)) % 5 == 4
    weights = ftrl.fit([r for r, x in zip(rows, tested, strict=True) if not x], target[~tested], (1 << BITS) + 1, EPOCHS, alpha=0.5, l1=0.02, l2=0.02)
    held = np.array([x @ weights[at] for (at, x), t in zip(rows, tested, strict=True) if t])
    temperature = 1.0
    if len(held):
        choices = np.geomspace(0.05, 20, 121)
        loss = [-np.log(np.maximum((ftrl.chances(held / t) * target[tested]).sum(axis=1), 1e-12)).mean() for t in choices]
        temperature = float(choices[int(np.argmin(loss))])
    return Model(classes, idf, weights, temperature)


def fit(docs: DataFrame, bound: int = SAMPLE, modulus: int = 4, left_out: int = 2) -> Model:
    """A model of at most ``bound`` labelled texts, with the document frequencies of all texts it may learn from."""
    idf = inverse_frequencies(id_and_text(_training(docs.filter(docs["lang"].isNotNull()), modulus, left_out)))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, labels = [], [], []
        for batch in batches:
            ids, texts, labels = ids + batch.column(0).to_pylist(), texts + batch.column(1).to_pylist(), labels + batch.column(2).to_pylist()
        m = _learn(ids, texts, labels, idf)
        yield pa.RecordBatch.from_arrays([pa.array([m.classes], pa.list_(pa.string())), pa.array([m.weights.astype("<f4").tobytes()]), pa.array([m.temperature])], ["classes", "weights", "temperature"])

    sample = labelled_sample(docs, bound, modulus, left_out)
    (row,) = sample.select("doc_id", "text", "label").coalesce(1).mapInArrow(learn, "classes array<string>, weights binary, temperature double").collect() or [None]
    if row is None:
        return Model([], idf, np.zeros(((1 << BITS) + 1, 0)), 1.0)
    weights = np.frombuffer(row.weights, "<f4").reshape((1 << BITS) + 1, -1) if row.classes else np.zeros(((1 << BITS) + 1, 0))
    return Model(list(row.classes), idf, weights.astype(float), row.temperature)


def classify(texts: list[str], model: Model) -> tuple[list[str], list[float]]:
    names, sure = [], []
    for t in texts:
        if not model.classes or not LETTER.search(t):
            names.append(UNKNOWN)
            sure.append(0.0)
            continue
        at, x = row_of(t, model.idf)
        p = ftrl.chances(x @ model.weights[at] / model.temperature) if len(model.classes) > 1 else np.ones(1)
        best = int(np.argmax(p))
        names.append(model.classes[best])
        sure.append(float(p[best]))
    return names, sure


def predict(docs: DataFrame, model: Model, modulus: int = 4, left_out: int = 2) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row of ``docs``.

    Null, empty and letterless texts are ``und`` with score 0, and so is every
    text if nothing could be learned. Repeated rows get equal results; an
    empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(texts: list[str]) -> list[pa.Array]:
        names, sure = classify(texts, shared.value)
        return [pa.array(names, pa.string()), pa.array(sure, pa.float64())]

    rows = add_columns(id_and_text(docs), "text", compute, ["lang_pred", "score"], ["string", "double"])
    return rows.select("doc_id", (id_remainder(F.col("doc_id"), modulus) == left_out).alias("held_out"), "lang_pred", "score")
