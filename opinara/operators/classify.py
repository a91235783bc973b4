"""TF-IDF features and two-stage linear classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara import constants as K
from opinara.functions import text as X
from opinara.functions.numbers import round_up
from opinara.operators import ngram_blocks
from opinara.operators.ranking import number_rows

#: Features of the classifiers unless more are asked for; features per gradient block; numbers of a product held at once.
MAX_FEATURES, BLOCK, CELLS = 50_000, 4096, 4_000_000
#: Parts that an input partition's texts are dealt to before their n-grams are counted.
PARTS = 8


def ngrams(c: Column | str, high: int = 3) -> Column:
    """Word n-grams, n = 1 .. high, of lower-case, blank-separated words.

    Each length is zipped from the one below, so the work grows with the
    number of words and no lambda reads the word list again.
    """
    words = X.words(F.lower(F.col(c) if isinstance(c, str) else c))
    grams, out = words, [words]
    for n in range(2, high + 1):
        # concat gives NULL past the end of the shorter list
        grams = F.zip_with(grams, F.slice(words, n, F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))
        out.append(F.array_compact(grams))
    return F.concat(*out)


def term_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, term, tf``. Texts are moved by key before they become n-grams, which are then counted where they are.

    There are the more parts the larger the input, so that a part's counts stay small.
    """
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), PARTS * docs.rdd.getNumPartitions())
    grams = docs.select(key, text).repartition(parts, key).select(key, F.explode_outer(ngrams(text)).alias("term")).filter(F.col("term").isNotNull())
    return grams.groupBy(key, "term").agg(F.count("*").alias("tf"))


def _features(docs: DataFrame, vocab: DataFrame, n_docs: int, key: str, text: str, *more: str) -> DataFrame:
    """``idx`` and ``weight`` of each document's terms beside ``more`` columns, two arrays in order of number; empty for a document without terms."""
    lists = ngram_blocks.features(docs, key, text, vocab.toArrow(), n_docs)
    part = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    return docs.select(key, *more).join(lists, key, "left").select(key, *more, part("idx", "int"), part("weight", "double"))


@dataclass(frozen=True)
class Question:
    """One linear model: is the category present, or, with a ``label``, has a present one this polarity? ``weights`` by label."""

    category: int
    label: int | None
    weights: tuple

    def targets(self, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """+1 or -1 of each row, and its weight, 0 where it is not asked."""
        own = labels[:, self.category]
        yes = own != 0 if self.label is None else own == self.label
        return np.where(yes, 1.0, -1.0), np.array(self.weights)[own]


def _questions(tally: dict[int, dict[int, int]]) -> tuple[list[Question], dict[int, int]]:
    """The models to fit, classes balanced, and the polarity of categories that have but one."""
    asked, fixed = [], {}
    balanced = lambda counts: tuple(sum(counts.values()) / (len(counts) * counts[v]) if v in counts else 0.0 for v in range(4))
    for i in range(len(K.CATEGORIES)):
        found = tally.get(i, {})
        present = {v: n for v, n in found.items() if v != 0}
        n = sum(present.values())
        if n >= 5 and found.get(0):
            two = balanced({0: found[0], 1: n})
            asked.append(Question(i, None, (two[0], two[1], two[1], two[1])))
            if n >= 10 and len(present) == 1:
                fixed[i] = next(iter(present))
            elif n >= 10:
                kinds = sorted(present)
                # two kinds need one model, more one for each
                asked += [Question(i, v, balanced(present)) for v in (kinds[1:] if len(kinds) == 2 else kinds)]
    return asked, fixed


@dataclass
class AspectModel:
    """Vocabulary, and the coefficients (feature and intercept, model) of all that is asked."""

    vocab: DataFrame
    n_docs: int
    questions: list[Question]
    fixed: dict[int, int]
    kinds: dict[int, list[int]]
    coefficients: np.ndarray


def _slices(batch: pa.RecordBatch, models: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Where a few rows begin, their numbers of terms, terms and weights; so few that all models fit on them."""
    ids, weights = batch.column("idx"), batch.column("weight")
    sizes = np.diff(ids.offsets.to_numpy())
    idx, data = ids.flatten().to_numpy(), weights.flatten().to_numpy()
    end, at, most = np.cumsum(sizes), 0, CELLS // max(models, 1)
    while at < len(sizes):
        begin = end[at] - sizes[at]
        to = max(at + 1, int(np.searchsorted(end, begin + most, side="right")))
        yield at, sizes[at:to], idx[begin : end[to - 1]], data[begin : end[to - 1]]
        at = to


def _margins(sizes: np.ndarray, idx: np.ndarray, data: np.ndarray, coefficients: np.ndarray) -> np.ndarray:
    """Value of each model (column) for each row."""
    out = np.zeros((len(sizes), coefficients.shape[1]))
    some = np.flatnonzero(sizes)
    if len(some):
        out[some] = np.add.reduceat(data[:, None] * coefficients[idx], (np.cumsum(sizes) - sizes)[some])
    return out + coefficients[-1]


def _loss(sizes: np.ndarray, idx: np.ndarray, data: np.ndarray, y: np.ndarray, cost: np.ndarray, coefficients: np.ndarray, gradient: np.ndarray) -> np.ndarray:
    """Squared hinge loss of each model; its gradient is added to ``gradient``."""
    short = np.maximum(0.0, 1.0 - y * _margins(sizes, idx, data, coefficients))
    pull = -2.0 * cost * short * y
    row = np.repeat(np.arange(len(sizes)), sizes)
    for model in range(gradient.shape[1]):
        gradient[:, model] += np.bincount(idx, data * pull[row, model], len(gradient))
    gradient[-1] += pull.sum(axis=0)
    return (cost * short * short).sum(axis=0)


def _objective(rows: DataFrame, questions: list[Question], size: int, cost: float) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Loss and gradient of all models at given coefficients, from one job over the rows.

    A task sends one gradient, in blocks of features; blocks are summed in two
    steps, so that no task gets one from every other. What the driver gets is one
    gradient of all models.
    """
    spark, models = rows.sparkSession, len(questions)

    def evaluate(coefficients: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shared = spark.sparkContext.broadcast(coefficients)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, gradient, loss = shared.value, np.zeros((size + 1, models)), np.zeros(models)
            for batch in batches:
                labels = batch.column("labels").flatten().to_numpy().reshape(batch.num_rows, -1)
                y, c = (np.stack(x, axis=1) for x in zip(*(q.targets(labels) for q in questions), strict=True))
                for begin, sizes, idx, data in _slices(batch, models):
                    own = slice(begin, begin + len(sizes))
                    loss += _loss(sizes, idx, data, y[own], cost * c[own], at, gradient)
            blocks = [(-1, loss), *((b, gradient[b * BLOCK : (b + 1) * BLOCK]) for b in range(-(-len(gradient) // BLOCK)))]
            for block, values in blocks:
                if values.any():
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([values.ravel()], pa.list_(pa.float64()))], ["block", "values"])

        def total(group: pd.DataFrame) -> pd.DataFrame:
            out = group.iloc[:1].copy()
            out["values"] = [np.sum(np.stack(group["values"].to_numpy()), axis=0)]
            return out

        sums = rows.select("idx", "weight", "labels").mapInArrow(part, "block int, values array<double>").withColumn("salt", F.spark_partition_id() % 64)
        for by in (["block", "salt"], ["block"]):
            sums = sums.groupBy(*by).applyInPandas(total, sums.schema)
        # the penalty, intercepts included, is known here
        loss, gradient = 0.5 * (coefficients * coefficients).sum(axis=0), coefficients.copy()
        for r in sums.select("block", "values").toLocalIterator():
            values = np.array(r["values"])
            if r["block"] < 0:
                loss = loss + values
            else:
                gradient[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] += values.reshape(-1, models)
        shared.destroy()
        return loss, gradient

    return evaluate


def minimise(evaluate: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], shape: tuple[int, int], steps: int, tolerance: float = 1e-4, memory: int = 5) -> np.ndarray:
    """Minima of many functions at once, one per column, by limited-memory BFGS.

    All columns share each evaluation: a column whose step was too long tries a
    shorter one while the others go on, so ``steps`` evaluations serve all.
    """
    x = np.zeros(shape)
    f, g = evaluate(x)
    moved, turned = np.zeros((memory, *shape)), np.zeros((memory, *shape))
    inverse = np.zeros((memory, shape[1]))  # 0 where a column has no such pair yet
    step = 1.0 / np.maximum(1.0, np.abs(g).sum(axis=0))
    direction = -g
    least = tolerance * np.maximum(1.0, np.abs(g).max(axis=0))
    for _ in range(steps):
        going = np.abs(g).max(axis=0) > least
        if not going.any():
            break
        tried = x + np.where(going, step, 0.0) * direction
        f2, g2 = evaluate(tried)
        fine = going & (f2 <= f + 1e-4 * step * (direction * g).sum(axis=0))
        s, y = tried - x, g2 - g
        curve = (s * y).sum(axis=0)
        kept = fine & (curve > 1e-12)
        for history, new in ((moved, s), (turned, y), (inverse, 1.0 / np.where(kept, curve, 1.0))):
            history[:-1][..., kept] = history[1:][..., kept]
            history[-1][..., kept] = new[..., kept]
        x, f, g = np.where(fine, tried, x), np.where(fine, f2, f), np.where(fine, g2, g)
        step = np.where(fine, 1.0, step * 0.5)
        q, a = g.copy(), np.zeros((memory, shape[1]))
        for i in range(memory - 1, -1, -1):
            a[i] = inverse[i] * (moved[i] * q).sum(axis=0)
            q -= a[i] * turned[i]
        last = (turned[-1] * turned[-1]).sum(axis=0)
        q *= np.where(inverse[-1] > 0, 1.0 / np.where(inverse[-1] > 0, inverse[-1] * last, 1.0), 1.0)
        for i in range(memory):
            q += moved[i] * (a[i] - inverse[i] * (turned[i] * q).sum(axis=0))
        downhill = (q * g).sum(axis=0) > 0
        direction = np.where(fine, np.where(downhill, -q, -g), direction)
    return x


def fit(train: DataFrame, key: str = "review_id", text: str = "text", max_iter: int = 100, cost: float = 1.0, max_features: int | None = MAX_FEATURES) -> AspectModel:
    """A detector and polarity models per category, all at once, on shared features.

    Linear models with squared hinge loss, balanced classes and a quadratic
    penalty. Categories with under five present rows get no detector, with
    under ten no polarity model; a single polarity is kept as a constant. Each
    step is one job for all models together. The coefficients, at most
    ``max_features`` times 68 numbers, are what driver and tasks share.
    """
    from opinara.session import materialise

    terms = ngram_blocks.vocabulary(train, key, text, most=max_features)
    vocab = materialise(number_rows(terms, ["term"], "idx").select("term", "df", (F.col("idx") - 1).cast("int").alias("idx")), "tfidf-vocabulary", done=True)
    n_docs, size = train.count(), vocab.count()
    rows = materialise(_features(train, vocab, n_docs, key, text, "labels"), "tfidf-features", done=True)
    # label counts of all categories in one pass: 17 x 4 numbers
    tally: dict = {}
    for r in rows.select(F.posexplode("labels").alias("i", "v")).groupBy("i", "v").count().collect():
        tally.setdefault(r["i"], {})[r["v"]] = r["count"]
    questions, fixed = _questions(tally)
    coefficients = np.zeros((size + 1, 0))
    if questions:
        coefficients = minimise(_objective(rows, questions, size, cost), (size + 1, len(questions)), max_iter)
    kinds = {i: sorted(v for v in found if v) for i, found in tally.items()}
    return AspectModel(vocab, n_docs, questions, fixed, kinds, coefficients)


def predict(model: AspectModel, docs: DataFrame, key: str = "review_id", text: str = "text") -> DataFrame:
    """Label arrays: polarity only where an aspect is detected, positive by default."""
    rows = _features(docs, model.vocab, model.n_docs, key, text)
    spark, questions, fixed, kinds = docs.sparkSession, model.questions, model.fixed, model.kinds
    shared = spark.sparkContext.broadcast(model.coefficients)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coefficients = shared.value
        for batch in batches:
            values = np.zeros((batch.num_rows, len(questions)))
            for begin, sizes, idx, data in _slices(batch, len(questions)):
                values[begin : begin + len(sizes)] = _margins(sizes, idx, data, coefficients)
            out = np.zeros((batch.num_rows, len(K.CATEGORIES)), np.int32)
            for j, q in enumerate(questions):
                if q.label is None:
                    named = [(m, p.label) for m, p in enumerate(questions) if p.category == q.category and p.label is not None]
                    polarity = np.full(batch.num_rows, fixed.get(q.category, 1))
                    if len(named) == 1:
                        polarity = np.where(values[:, named[0][0]] > 0, *reversed(kinds[q.category]))
                    elif named:
                        polarity = np.array([p for _, p in named])[np.argmax(values[:, [m for m, _ in named]], axis=1)]
                    out[:, q.category] = np.where(values[:, j] > 0, polarity, 0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], [key, "y_pred"])

    return rows.mapInArrow(label, f"{key} {rows.schema[key].dataType.simpleString()}, y_pred array<int>")


def train_and_report(samples: DataFrame, max_iter: int = 100) -> DataFrame:
    """Fit on train and report on val; refit on both and report on test."""
    from opinara.operators import metrics as M
    from opinara.session import materialise

    samples = materialise(samples, "samples")
    part = lambda *names: samples.filter(F.col("split").isin(list(names)))
    reports = []
    for fit_on, judge in ((("train",), "val"), (("train", "val"), "test")):
        model = fit(part(*fit_on), max_iter=max_iter)
        truth = part(judge).select("review_id", F.col("labels").alias("y_true"))
        pairs = truth.join(predict(model, part(judge)), "review_id").withColumn("model", F.lit(judge))
        reports.append(M.confusion_cube(pairs))
    return M.model_comparison(reports[0].unionByName(reports[1])).withColumnRenamed("model", "split").drop("is_best")


def weights_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """TF-IDF weights of every document and term, fitted on the same documents."""
    return ngram_blocks.weights(docs, key, text).select(key, "term", "idx", round_up(F.col("weight"), 6).alias("weight"))


__all__ = ["AspectModel", "fit", "predict", "train_and_report", "weights_table"]
