"""Katz back-off language model over words.

``p(v | u)`` is the Good-Turing discounted share of a bigram counted at least
``least`` times, or else ``alpha(u) * p(v)``; ``p(v)`` is the discounted share
of a word, or else the mass left for an unknown one. ``alpha`` is what
normalises the sum over all words and the unknown one to exactly 1. The
recursion of a token telescopes: its log chance is ``log p(v) + log alpha(u)``,
plus, if the bigram is kept, one number that belongs to the bigram.

Most bigrams are counted once. All of them count in the discounts and in their
context's weight. In a text that was learned from, a bigram that is not stored
with a higher count has count 1, and its chance then only depends on the
context; so bigrams counted once are stored only if another text has them too.

Words are counted first. Bigrams are counted in shards of their contexts, those
of the most frequent contexts spread over all: a task sends each shard the
distinct ones it has read, as arrays. To score, a task knows the most frequent
words and bigrams and a bit table of which bigrams may be stored, all of fixed
size, and asks the shards for the others.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.llm.common import id_and_text, id_remainder
from opinara.session import materialise

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Tokens read before a task sends their bigrams; documents per shard; most frequent entries that every task knows; contexts whose bigrams are spread; bits of the bit table.
FLUSH, SHARD_DOCS, FREQUENT, HOT, BITS = 4_000_000, 2500, 1 << 17, 1 << 12, 26
#: Counts up to this are discounted; bigrams with fewer are left to the back-off unless ``least`` says otherwise.
DISCOUNTED, LEAST_BIGRAM = 5, 2
REMEMBERED, SLICE = 500_000, 256
START, END = (np.uint64(xxhash.xxh64_intdigest(x, 1)) for x in (b" start", b" end"))
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def pair(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Key of a bigram."""
    h = (u * MIX[0] + v) * MIX[1]
    return (h ^ (h >> np.uint64(31))) * MIX[0]


def shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    return ((key >> np.uint64(24)).astype(np.int64)) % shards


def shard_column(key: Column, shards: int) -> Column:
    return F.shiftrightunsigned(key, 24) % shards


def split_words(text: str) -> list[bytes]:
    return text.encode().translate(LOWER).split()


class Words:
    """Numbers of the words a worker has met, and their keys. Forgetting them all only costs time."""

    def __init__(self):
        self.number: dict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__  # a new word gets the next number
        self.keys = np.empty(0, np.uint64)

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words of the texts, and how many each text has."""
        if len(self.number) > REMEMBERED:
            self.number.clear()
            self.keys = np.empty(0, np.uint64)
        number, split = self.number, [split_words(t) for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        before = len(number)
        ids = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        if len(number) > before:
            self.keys = np.append(self.keys, np.fromiter(map(xxhash.xxh64_intdigest, islice(number, before, None)), np.uint64, len(number) - before))
        return ids, sizes


def sequences(keys: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts one after the other: context and token at each place, an end after each text, and the text's row."""
    ends = np.cumsum(sizes)
    token = np.insert(keys, ends, END)
    context = np.empty(len(token), np.uint64)
    context[1:] = token[:-1]
    context[np.concatenate([[0], ends[:-1] + np.arange(1, len(sizes))]) if len(sizes) else []] = START
    return context, token, np.repeat(np.arange(len(sizes)), sizes + 1)


def _counted(u: np.ndarray, v: np.ndarray, *numbers: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct pairs, by context, with their summed numbers."""
    if not len(u):
        return u, v, *numbers
    order = np.lexsort((v, u))
    u, v = u[order], v[order]
    first = np.flatnonzero(np.append(True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])))
    return u[first], v[first], *(np.add.reduceat(x[order], first) for x in numbers)


def count_words(texts: DataFrame) -> DataFrame:
    """``w, c``: how often each word is in the texts; an end and a start for each text."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times, n = Counter(), 0

        def sent() -> pa.RecordBatch:
            keys = np.fromiter(map(xxhash.xxh64_intdigest, times), np.uint64, len(times))
            keys, c = np.append(keys, [START, END]), np.append(np.fromiter(times.values(), np.int64, len(times)), [n, n])
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(c)], ["w", "c"])

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.column(0).slice(at, SLICE).to_pylist()
                times.update(chain.from_iterable(map(split_words, part)))
                n += len(part)
                if len(times) > REMEMBERED:
                    yield sent()
                    times, n = Counter(), 0
        if n:
            yield sent()

    return texts.mapInArrow(send, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


CLASSES = [f"n{r}" for r in range(1, DISCOUNTED + 1)]
#: Kinds of rows: bigrams counted twice or more; bigrams of texts to score; sums of a context; bigrams whose word is not a frequent one; how many bigrams have each count.
PLAIN, WANTED, CONTEXT, RARE, FEW = range(5)


def count_bigrams(rows: DataFrame, shards: int, least: int, frequent: tuple[np.ndarray, np.ndarray], hot: np.ndarray) -> DataFrame:
    """Bigrams of ``rows`` (``text, learned``) that are counted ``least`` times or more in the learned texts.

    ``frequent`` are words, sorted, and their chances. Of a context there are the number of
    bigrams with each small count, the counts above them (``more``), and the chances of its
    frequent words (``seen``), in one row, or in one of each shard if it is ``hot``.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, n = Words(), [], 0

        def flush() -> pa.RecordBatch:
            u, v, c, asked = _counted(*(np.concatenate(x) for x in zip(*held, strict=True)))
            s = np.where(_find(hot, u) >= 0, shard_of(pair(u, v), shards), shard_of(u, shards))
            order = np.argsort(s, kind="stable")
            cuts = np.searchsorted(s[order], np.arange(shards + 1))
            kept = np.flatnonzero(np.diff(cuts))
            offsets = pa.array(np.append(cuts[kept], len(s)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x[order])) for x in (u.view(np.int64), v.view(np.int64), 2 * c + (asked > 0))]
            return pa.RecordBatch.from_arrays([pa.array(kept), *lists], ["shard", "u", "v", "c"])

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                ids, sizes = words.tokens(batch.column(0).slice(at, SLICE).to_pylist())
                u, v, row = sequences(words.keys[ids], sizes)
                learned = np.array(batch.column(1).slice(at, SLICE).to_pylist(), np.int32)[row]
                held.append((u, v, learned, 1 - learned if least == 1 else np.ones_like(learned)))
                n += len(u)
                if n >= FLUSH:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    known, chances = frequent

    def merge(table: pa.Table) -> pa.Table:
        u, v, c = (pc.list_flatten(table[x]).to_numpy() for x in ("u", "v", "c"))
        u, v, c, asked = _counted(u.view(np.uint64), v.view(np.uint64), (c >> 1).astype(np.int64), c & 1)
        few = np.bincount(np.minimum(c, DISCOUNTED + 2), minlength=DISCOUNTED + 3)
        kept = c >= least
        u, v, c, asked = u[kept], v[kept], c[kept], asked[kept] > 0
        place = _find(known, v)
        chance = np.where(place >= 0, chances[place], 0.0) if len(known) else np.zeros(len(v))
        first = np.flatnonzero(np.append(True, u[1:] != u[:-1])) if len(u) else np.zeros(0, np.int64)
        total = lambda x: np.add.reduceat(x, first) if len(first) else np.zeros(0, x.dtype)
        counted = [total((c == r).astype(np.int64)) for r in range(1, DISCOUNTED + 1)]
        plain, rare = (c > 1) & ~asked, place < 0
        signed, h = lambda x: pa.array(x.view(np.int64)), pair(u, v)
        found = [
            (PLAIN, {"h": signed(h[plain]), "c": c[plain]}),
            (WANTED, {"u": signed(u[asked]), "v": signed(v[asked]), "h": signed(h[asked]), "c": c[asked]}),
            (CONTEXT, {"u": signed(u[first]), **dict(zip(CLASSES, counted, strict=True)), "more": total(np.where(c > DISCOUNTED, c, 0)), "seen": total(chance)}),
            (RARE, {"u": signed(u[rare]), "v": signed(v[rare])}),
            (FEW, {**{x: few[r : r + 1] for r, x in enumerate(CLASSES, 1)}, "more": few[DISCOUNTED + 1 : DISCOUNTED + 2]}),
        ]
        parts = []
        for kind, columns in found:
            n = len(next(iter(columns.values())))
            given = {"kind": np.full(n, kind, np.int32), **columns}
            parts.append(pa.table([pa.array(given[f.name], f.type) if f.name in given else pa.nulls(n, f.type) for f in fields], fields))
        return pa.concat_tables(parts)

    names = ["u", "v", "h", "c", *CLASSES, "more"]
    fields = pa.schema([("kind", pa.int32()), *((x, pa.int64()) for x in names), ("seen", pa.float64())])
    sent = rows.mapInArrow(send, "shard long, u array<long>, v array<long>, c array<long>")
    return sent.groupBy("shard").applyInArrow(merge, "kind int, " + ", ".join(f"{x} long" for x in names) + ", seen double")


def discounts(few: dict[int, int], least: int) -> dict[int, float]:
    """Good-Turing factor of each small count; where the counts of counts allow none in (0, 1), one that takes half a count."""
    out = {}
    k = DISCOUNTED
    for r in range(least, k + 1):
        n1, top = few.get(least, 0) * least, (k + 1) * few.get(k + 1, 0)
        share = top / n1 if n1 else 1.0
        star = (r + 1) * few.get(r + 1, 0) / (r * few[r]) if few.get(r) else 0.0
        d = (star - share) / (1 - share) if share < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


@dataclass
class Model:
    words: DataFrame  # w, c, value: log p(w) + log alpha(w), room: log of what counts after w are divided by
    bigrams: DataFrame  # h, c, value: log p(v | u) - log alpha(u) - log p(v), for the texts to score
    total: int  # N
    distinct: int  # V
    unknown: float  # log of the unknown word's chance
    small: dict[int, float]  # discount factors of the bigrams
    shards: int


def _factor(count: str, d: dict[int, float], common: float = 1.0) -> Column:
    out = F.lit(common)
    for r, x in d.items():
        out = F.when(F.col(count) == r, F.lit(x)).otherwise(out)
    return out


def train(rows: DataFrame, least: int = LEAST_BIGRAM) -> Model:
    """The model of the learned ones of ``rows`` (``text, learned``), as two stored tables, fit to score them all; without learned rows it knows no word.

    With a ``least`` above 1, rarer bigrams are left to the back-off, and ``score`` must take all texts as not learned from.
    """
    texts = rows.select("text", "learned")
    start = int(START.view(np.int64))
    counts = materialise(count_words(texts.filter("learned").select("text")), "counts")
    known = counts.filter(F.col("w") != start)
    few = {r.c: r.n for r in known.filter(F.col("c") <= DISCOUNTED + 1).groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    total, distinct = known.agg(F.sum("c"), F.count(F.lit(1))).first()
    total, common, d1 = total or 0, 1.0, discounts(few, 1)
    lost = sum(r * few.get(r, 0) * (1 - x) for r, x in d1.items())
    if total and not 0 < lost < total:  # no small count to discount: the unknown word counts once
        d1, common, lost = {}, total / (total + 1), total / (total + 1)
    unknown = float(np.log(lost / total)) if total else 0.0
    chance = F.col("c") * _factor("c", d1, common) / F.lit(float(total or 1))

    top = known.orderBy(F.desc("c"), "w").limit(FREQUENT).select("w", chance.alias("p")).toArrow()
    keys, chances = np.asarray(top["w"]).astype(np.int64).view(np.uint64), np.asarray(top["p"]).astype(np.float64)
    order = np.argsort(keys)
    shards = max(48, -(-rows.count() // SHARD_DOCS))
    hot = np.sort(np.append(keys[:HOT], START))
    table = materialise(count_bigrams(texts, shards, least, (keys[order], chances[order]), hot), "grams", by=["kind"])
    some = table.filter(F.col("kind") == FEW).agg(*[F.sum(x) for x in (*CLASSES, "more")]).first()
    d2 = discounts({r: n or 0 for r, n in enumerate(some, 1)}, least)

    kept = F.col("more").cast("double")
    for r, x in enumerate(CLASSES, 1):
        kept = kept + F.col(x) * F.lit(r * d2.get(r, 1.0))
    sums = table.filter(F.col("kind") == CONTEXT).select("u", kept.alias("kept"), "seen")
    rare = table.filter(F.col("kind") == RARE).select("u", "v").join(known.select(F.col("w").alias("v"), chance.alias("seen")), "v")
    sums = sums.unionByName(rare.select("u", F.lit(0.0).alias("kept"), "seen")).groupBy("u").agg(F.sum("kept").alias("kept"), F.sum("seen").alias("seen"))
    full = F.col("kept") > F.col("c") - 0.5 if least > 1 else F.col("kept") >= F.col("c")  # nothing, or hardly anything, is left for other words
    room = F.when(full, F.col("c") + 1).otherwise(F.col("c")).cast("double")
    words = counts.join(sums.withColumnRenamed("u", "w"), "w", "left")
    words = words.withColumn("alpha", F.coalesce(F.log((1 - F.col("kept") / room) / (1 - F.col("seen"))), F.lit(0.0)))
    words = materialise(words.select("w", "c", "alpha", F.when(F.col("kept").isNotNull(), F.log(room)).otherwise(0.0).alias("room")), "words")
    log_p = F.when(F.col("w") == start, 0.0).otherwise(F.log(chance))

    wanted = table.filter(F.col("kind") == WANTED).select("u", "v", "h", F.col("c").alias("n"))
    wanted = wanted.join(words.select(F.col("w").alias("v"), log_p.alias("p")), "v").drop("v").join(words.select(F.col("w").alias("u"), "alpha", "room"), "u")
    value = F.log(F.col("n") * _factor("n", d2)) - F.col("room") - F.col("alpha") - F.col("p")
    bigrams = wanted.select("h", F.col("n").alias("c"), value.alias("value"))
    plain = table.filter(F.col("kind") == PLAIN).select("h", "c", F.lit(None).cast("double").alias("value"))
    words = words.select("w", "c", (log_p + F.col("alpha")).alias("value"), "room")
    return Model(words, materialise(plain.unionByName(bigrams), "bigrams"), total, distinct, unknown, d2, shards)


def _frequent(table: DataFrame, key: str) -> tuple[np.ndarray, ...]:
    """The ``FREQUENT`` entries with the highest counts, by key, which comes first; a missing number is 0."""
    top = table.orderBy(F.desc("c"), key).limit(FREQUENT).fillna(0.0).select(key, *[c for c in table.columns if c != key]).toArrow()
    keys, *numbers = (np.asarray(x) for x in top.columns)
    keys = keys.astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], *(x[order].astype(np.float64) for x in numbers)


def _bit_table(bigrams: DataFrame) -> np.ndarray:
    """Bits of the stored bigrams' keys, ``2**BITS`` in all."""
    at = F.shiftrightunsigned("h", 64 - BITS)
    rows = bigrams.groupBy(F.shiftright(at, 3).alias("i")).agg(F.bit_or(F.expr(f"shiftleft(1, cast(shiftrightunsigned(h, {64 - BITS}) & 7 as int))")).alias("b")).toArrow()
    bits = np.zeros(1 << (BITS - 3), np.uint8)
    bits[np.asarray(rows["i"]).astype(np.int64)] = np.asarray(rows["b"]).astype(np.uint8)
    return bits


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of ``keys``, -1 where there is none."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


COLUMNS = ["n_tokens", "n_known", "base", "score"]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score`` (log10) for each row of ``docs`` (``doc_id, text, learned``).

    All bigrams of a ``learned`` text are kept ones: it adds up their logs as if each had count 1, and for a stored one what its count adds to that.
    """
    spark, shards, unknown = docs.sparkSession, model.shards, model.unknown
    shared = spark.sparkContext.broadcast((_frequent(model.words, "w"), _frequent(model.bigrams, "h"), _bit_table(model.bigrams)))
    start = model.words.filter(F.col("w") == int(START.view(np.int64))).select("value", "room").first()
    first_value, first_room = (start.value, start.room) if start else (0.0, 0.0)
    small = np.array([model.small.get(r, 1.0) for r in range(1, DISCOUNTED + 1)])
    least = float(np.log(1.0 / (model.total + model.distinct + 1)))  # a token's base chance, without its count
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"shard long, first long, word_rows array<int>, words array<long>, pair_rows array<int>, pairs array<long>, doc_ids array<{kind}>, " + ", ".join(f"{c} array<double>" for c in COLUMNS)

    def gain(c: np.ndarray) -> np.ndarray:
        """What a count adds to the log of a bigram of count 1."""
        return np.log(c * np.append(small, 1.0)[np.minimum(c.astype(np.int64) - 1, DISCOUNTED)]) - np.log(small[0])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (wk, wc, wv, wr), (bk, bc, bv), bits = shared.value
        bg = gain(bc)
        words, first = Words(), TaskContext.get().partitionId() << 33
        lookup = np.empty(0, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 4 * SLICE):
                part = batch.slice(at, 4 * SLICE)
                ids, sizes = words.tokens(part.column(1).to_pylist())
                if len(words.keys) < len(lookup):
                    lookup = np.empty(0, np.int64)
                lookup = np.append(lookup, _find(wk, words.keys[len(lookup) :]))
                u, v, row = sequences(words.keys[ids], sizes)
                place = np.insert(lookup[ids], np.cumsum(sizes), _find(wk, np.array([END]))[0])
                known, n = place >= 0, len(sizes)
                learned = np.array(part.column(2).to_pylist(), bool)
                of_word = np.where(learned[row], -wr[place], wv[place]) if len(wc) else np.zeros(len(row))
                sums = {
                    "n_tokens": (sizes + 1).astype(float),
                    "n_known": np.bincount(row, known, n),
                    "base": np.bincount(row, np.where(known, np.log1p(wc[place]), 0.0), n) if len(wc) else np.zeros(n),
                    "score": np.where(learned, (sizes + 1) * np.log(small[0]) - first_room, first_value) + np.bincount(row, np.where(known, of_word, 0.0), n),
                }
                sums["base"] = sums["base"] + least * sums["n_tokens"]
                h = pair(u, v)
                bit = (h >> np.uint64(64 - BITS)).astype(np.int64)
                may = np.flatnonzero(bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
                found = _find(bk, h[may])
                hit = found >= 0
                if len(bv):
                    at_hit = row[may[hit]]
                    sums["score"] = sums["score"] + np.bincount(at_hit, np.where(learned[at_hit], bg[found[hit]], bv[found[hit]]), n)
                lists, row = [], 2 * row + learned[row]  # a row's number tells if its text was learned from
                for rows, keys in ((row[~known], v[~known]), (row[may[~hit]], h[may[~hit]])):
                    s = shard_of(keys, shards)
                    order = np.argsort(s, kind="stable")
                    cuts = pa.array(np.searchsorted(s[order], np.arange(shards + 1)), pa.int32())
                    lists += [pa.ListArray.from_arrays(cuts, pa.array(rows[order].astype(np.int32))), pa.ListArray.from_arrays(cuts, pa.array(keys[order].view(np.int64)))]
                to = (first >> 33) * 7919 + first % 7919  # the texts' own sums go along with some shard's rows
                own = np.zeros(shards + 1, np.int32)
                own[to % shards + 1 :] = n
                cuts = pa.array(own)
                numbers = [pa.ListArray.from_arrays(cuts, pa.array(sums[c])) for c in COLUMNS]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(shards)), pa.array(np.full(shards, first)), *lists, pa.ListArray.from_arrays(cuts, part.column(0).combine_chunks() if hasattr(part.column(0), "combine_chunks") else part.column(0)), *numbers],
                    ["shard", "first", "word_rows", "words", "pair_rows", "pairs", "doc_ids", *COLUMNS],
                )
                first += n

    def answer(key: tuple, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values("h")
        pairs_, words_ = held[held["kind"] == 2], held[held["kind"] == 1]
        out = []
        keys = [x["h"].to_numpy().astype(np.int64) for x in (words_, pairs_)]
        counts, values, rooms = words_["c"].to_numpy(), [x["value"].to_numpy() for x in (words_, pairs_)], words_["room"].to_numpy()
        gains = gain(pairs_["c"].to_numpy())
        for r in asked.itertuples():
            (word_rows, word_learned), (pair_rows, pair_learned) = ((x >> 1, (x & 1).astype(bool)) for x in (r.word_rows, r.pair_rows))
            n = max([len(r.doc_ids), *(int(x.max()) + 1 for x in (word_rows, pair_rows) if len(x))])
            sums = {c: np.zeros(n) for c in COLUMNS}
            for c in COLUMNS:
                sums[c][: len(r.doc_ids)] += getattr(r, c)
            at = _find(keys[0], r.words.astype(np.int64))
            known = at >= 0
            if len(at):
                sums["n_known"] += np.bincount(word_rows, known, n)
                sums["score"] += np.bincount(word_rows, np.where(known, np.where(word_learned, -rooms[at], values[0][at]), unknown) if len(counts) else np.full(len(at), unknown), n)
                if len(counts):
                    sums["base"] += np.bincount(word_rows, np.where(known, np.log1p(counts[at]), 0.0), n)
            at = _find(keys[1], r.pairs.astype(np.int64))
            hit = at >= 0
            if hit.any():
                sums["score"] += np.bincount(pair_rows[hit], np.where(pair_learned[hit], gains[at[hit]], values[1][at[hit]]), n)
            frame = pd.DataFrame({"uid": r.first + np.arange(n), **sums})
            frame["doc_id"] = pd.Series([None if pd.isna(x) else x for x in r.doc_ids] or [None] * n, dtype=object) if len(r.doc_ids) else None
            touched = np.zeros(n, bool)
            touched[: len(r.doc_ids)] = True
            touched[word_rows] = True
            touched[pair_rows] = True
            out.append(frame[touched])
        columns = ["uid", "doc_id", *COLUMNS]
        return pd.concat(out)[columns] if out else pd.DataFrame({c: [] for c in columns})

    asked = docs.mapInArrow(ask, schema).filter("size(words) + size(pairs) + size(doc_ids) > 0")
    held = model.words.select(F.lit(1).alias("kind"), F.col("w").alias("h"), "c", "value", "room").union(model.bigrams.select(F.lit(2), "h", "c", "value", F.lit(None)))
    held = held.withColumn("shard", shard_column(F.col("h"), shards))
    parts = asked.groupBy("shard").cogroup(held.groupBy("shard")).applyInPandas(answer, f"uid long, doc_id {kind}, " + ", ".join(f"{c} double" for c in COLUMNS))
    ln10 = float(np.log(10))
    return parts.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in COLUMNS]).select(
        "doc_id", F.col("n_tokens").cast("long"), F.col("n_known").cast("long"), (F.col("base") / ln10).alias("base_score"), (F.col("score") / ln10).alias("score")
    )


def score_documents(docs: DataFrame, modulus: int = 7, left_out: int = 2, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_BIGRAM) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row of ``docs``; all but the held-out rows are learned from.

    A null text is empty: its one token is the end. Repeated rows are learned
    from, and scored, each time. If nothing can be learned from, every token is
    unknown, with chance 1. An empty table gives an empty one. Bigrams counted
    less than ``least`` times are left to the back-off; with 1, none are.
    """
    held_out = id_remainder(F.col("doc_id"), modulus) == left_out
    pairs = id_and_text(docs, id_col, text_col)
    model = train(pairs.select("text", (~held_out).alias("learned")), least)
    scores = score(pairs.select("doc_id", "text", (~held_out if least == 1 else F.lit(False)).alias("learned")), model)
    return scores.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
