"""TF-IDF weights of the n-grams of a corpus, without moving the n-grams.

Documents are dealt to blocks by key. In a block, words are numbered in the
order of their bytes, so that an n-gram is three numbers, and n-grams sorted by
them are sorted as texts. A block sends each of its distinct n-grams once, as
numbers into short word lists, to shards that are ranges of texts. A shard knows
in how many documents each of its n-grams is and numbers those it keeps; what it
answers are small numbers in the order of the question. With the answers, blocks
read their documents again and weigh them. So what is moved is the compressed
texts, twice, and some bytes for each distinct n-gram of a block.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.session import materialise

#: Bytes of text for a block and for a shard; a small corpus is still cut into some blocks.
BLOCK_BYTES, SHARD_BYTES, SMALL_BYTES, SOME = 6_000_000, 12_000_000, 1_000_000, 16
#: Texts from which the bounds of the shards are taken, rows of one table sent, and texts split at once.
BOUND_TEXTS, ROWS_OUT, SLICE = 1000, 200_000, 256
#: Above this, three numbers of words do not fit 63 bits.
MOST = 2_000_000
#: Characters below the blank.
LOW = re.compile(rb"[\x00-\x1f]")


def _packed(numbers: np.ndarray) -> bytes:
    """Integers from 0 to 2**32 - 1, byte by byte of their places, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel().astype(np.int64)


class Grams:
    """N-grams as numbers that are sorted as the texts are.

    A word has two numbers, as it ends a text or as a blank comes after it,
    because a word may go on with a character below the blank.
    """

    def __init__(self, words: list[bytes]):
        n = len(words)
        self.words, self.base = words, 2 * n + 1
        self.form = np.zeros((2, n + 1), np.int64)  # the last is no word, whose number is 0
        if LOW.search(b" ".join(words)):
            keys = [*words, *(w + b" " for w in words)]
            order = np.array(sorted(range(2 * n), key=keys.__getitem__), np.int64)
        else:  # nothing lies between a word and the same with a blank
            order = np.array(sorted(range(n), key=words.__getitem__), np.int64)
            order = np.stack([order, order + n], axis=1).ravel()
        self.form[order // max(n, 1), order % max(n, 1)] = np.arange(1, 2 * n + 1)
        self.word_of = np.full(self.base, -1, np.int32)
        self.word_of[1:] = order % max(n, 1)
        self.pairs: np.ndarray | None = None

    def _pair(self, first: np.ndarray, second: np.ndarray, third: np.ndarray) -> np.ndarray:
        end, more = self.form
        out = np.where(second < 0, end[first], more[first])
        out *= self.base
        out += np.where(third < 0, end[second], more[second])
        return out

    def codes(self, first: np.ndarray, second: np.ndarray, third: np.ndarray) -> np.ndarray:
        """Of n-grams as numbers of words, -1 for none."""
        out = self._pair(first, second, third)
        if self.base > MOST:
            self.pairs, out = np.unique(out, return_inverse=True)
        out *= self.base
        out += self.form[0, third]
        return out

    def find(self, first: np.ndarray, second: np.ndarray, third: np.ndarray) -> np.ndarray:
        """The same once ``codes`` has been called; -1 if none of its n-grams begins so."""
        out = self._pair(first, second, third)
        if self.pairs is not None:
            at = np.minimum(np.searchsorted(self.pairs, out), len(self.pairs) - 1)
            out = np.where(self.pairs[at] == out, at, -1)
        return np.where(out < 0, -1, out * self.base + self.form[0, third])

    def parts(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The numbers of words again."""
        pair, c = np.divmod(codes, self.base)
        a, b = np.divmod(pair if self.pairs is None else self.pairs[pair], self.base)
        return self.word_of[a], self.word_of[b], self.word_of[c]

    def text(self, code: int) -> bytes:
        return b" ".join(self.words[int(p[0])] for p in self.parts(np.array([code])) if p[0] >= 0)

    def texts(self, codes: np.ndarray) -> pa.Array:
        words = pa.array([w.decode() for w in self.words], pa.string())
        first, *rest = (pa.array(p, mask=p < 0) for p in self.parts(codes))
        out = words.take(first)
        for p in rest:
            out = pc.binary_join_element_wise(out, words.take(p), " ", null_handling="skip")
        return out


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, sorted, and the place of each code among them."""
    order = np.argsort(codes)
    codes = codes[order]
    new = np.append(True, codes[1:] != codes[:-1])[: len(codes)]
    place = np.empty(len(codes), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return codes[new], place


class Block:
    """The documents of a block: ``keys``, distinct ``codes``, and of each document's n-grams the document, the place of the code, and how often."""

    def __init__(self, table: pa.Table):
        pa.default_memory_pool().release_unused()  # a worker keeps no more than the next texts need
        rows = pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in table["rows"].to_pylist()]).combine_chunks()
        keys = pc.dictionary_encode(rows.column(0), null_encoding="encode").combine_chunks()
        self.keys, doc = keys.dictionary, keys.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        number: dict[str, int] = defaultdict()
        number.default_factory = number.__len__  # a new word gets the next number
        ids, sizes = [], []
        for at in range(0, rows.num_rows, SLICE):
            split = [(t or "").split() for t in rows.column(1).slice(at, SLICE).to_pylist()]
            sizes.append(np.fromiter(map(len, split), np.int64, len(split)))
            ids.append(np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int32, int(sizes[-1].sum())))
        w, sizes = np.concatenate(ids), np.concatenate(sizes)
        row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.grams = Grams([x.encode() for x in number])
        two, three = np.flatnonzero(row[1:] == row[:-1]), np.flatnonzero(row[2:] == row[:-2])
        none = lambda n: np.full(n, -1, np.int32)
        codes = self.grams.codes(
            np.concatenate([w, w[two], w[three]]),
            np.concatenate([none(len(w)), w[two + 1], w[three + 1]]),
            np.concatenate([none(len(w) + len(two)), w[three + 2]]),
        )
        found = doc[np.concatenate([row, row[two], row[three]])]
        del w, row, two, three, ids
        self.codes, place = _distinct(codes)
        found *= max(len(self.codes), 1)
        found += place
        found.sort()
        first = np.flatnonzero(np.append(True, found[1:] != found[:-1])) if len(found) else np.zeros(0, np.int64)
        self.times = np.diff(first, append=len(found))
        self.doc, self.place = np.divmod(found[first], max(len(self.codes), 1))

    def cuts(self, bounds: list[bytes]) -> list[int]:
        """Where the n-grams of each shard begin and end."""
        places = [bisect_left(range(len(self.codes)), b, key=lambda i: self.grams.text(self.codes[i])) for b in bounds]
        return [0, *places, len(self.codes)]


def _question(grams: Grams, codes: np.ndarray, df: np.ndarray, total: np.ndarray) -> tuple:
    """N-grams, in order, as a word list and numbers into it: ``n`` to ``total`` of ``QUESTION``."""
    parts = grams.parts(codes)
    used = np.unique(np.concatenate(parts))
    used = used[used >= 0]
    used = used[np.argsort(grams.form[0, used])]
    local = np.zeros(len(grams.words) + 1, np.int64)  # the last for none
    local[used] = np.arange(1, len(used) + 1)
    first, second, third = (local[p] for p in parts)
    text, steps = b" ".join([grams.words[i] for i in used.tolist()]), np.diff(first, prepend=0) & 0xFFFFFFFF
    return len(codes), len(text), pa.compress(text, codec="zstd", asbytes=True), *(_packed(x) for x in (steps, second, third, df, total))


def _asked_grams(row: dict, number: dict[bytes, int]) -> tuple[np.ndarray, ...]:
    """A question's n-grams, in ``number``'s numbers of words, -1 for none, and their document frequencies and counts in the block."""
    words = pa.decompress(row["words"], row["size"], codec="zstd", asbytes=True).split(b" ")
    known = np.append(-1, np.fromiter(map(number.__getitem__, words), np.int64, len(words))).astype(np.int32)
    steps, second, third, df, total = (_unpacked(row[c], row["n"]) for c in ("a", "b", "c", "df", "total"))
    return known[np.cumsum(steps) & 0xFFFFFFFF], known[second], known[third], df, total


QUESTION = "block long, shard long, n long, size long, words binary, a binary, b binary, c binary, df binary, total binary"
#: ``steps`` has 0 for an n-gram that is not kept, and else what to add to the number of the last one kept; ``kept`` is of the shard.
ANSWER = "block long, shard long, kept long, n long, steps binary, df binary"


def _table(rows: list[tuple], fields: str) -> pa.Table:
    schema = pa.schema([(x, pa.binary() if kind == "binary" else pa.int64()) for x, kind in (c.split() for c in fields.split(", "))])
    return pa.table([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [[]] * len(schema), schema, strict=True)], schema)


def _sent(docs: DataFrame, key: str, text: str, blocks: int) -> DataFrame:
    """``block, rows``: keys and lower-case texts of a block, as compressed tables."""
    rows = docs.select(F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"), F.col(key).alias("key"), F.lower(F.col(text)).alias("text"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column(0).to_numpy(zero_copy_only=False)
            order = np.argsort(block, kind="stable")
            found, first = np.unique(block[order], return_index=True)
            tables = []
            for at, to in zip(first, [*first[1:], len(order)], strict=True):
                part = pa.RecordBatch.from_arrays([c.take(pa.array(order[at:to])) for c in batch.columns[1:]], ["key", "text"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(part)
                tables.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(tables, pa.binary())], ["block", "rows"])

    return rows.mapInArrow(deal, "block long, rows binary")


def _asked(sent: DataFrame, bounds: list[bytes], totals: bool = False) -> DataFrame:
    """What each block asks each shard, see ``QUESTION``; counts are 0 without ``totals``."""

    def ask(table: pa.Table) -> pa.Table:
        block = Block(table)
        df, cuts, rows = np.bincount(block.place, minlength=len(block.codes)), block.cuts(bounds), []
        total = np.bincount(block.place, block.times if totals else np.zeros(len(block.place)), len(df)).astype(np.int64)
        for shard, (at, to) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if to > at:
                rows.append((table["block"][0].as_py(), shard, *_question(block.grams, block.codes[at:to], df[at:to], total[at:to])))
        return _table(rows, QUESTION)

    return sent.groupBy("block").applyInArrow(ask, QUESTION)


def _merged(rows: list[dict]) -> tuple[Grams, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a shard's questions: distinct n-grams, the place of each asked one among them, and their document frequencies and counts."""
    pa.default_memory_pool().release_unused()
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    *parts, df, total = (np.concatenate(x) for x in zip(*(_asked_grams(r, number) for r in rows), strict=True))
    grams = Grams(list(number))
    codes = grams.codes(*parts)
    del parts
    found, place = _distinct(codes)
    return grams, found, place, *(np.bincount(place, x, len(found)).astype(np.int64) for x in (df, total))


def _answered(asked: DataFrame, min_df: int) -> DataFrame:
    """Number in its shard and document frequency of each n-gram asked for, see ``ANSWER``."""

    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        _, found, place, total, _ = _merged(rows)
        numbers = np.where(total >= min_df, np.cumsum(total >= min_df), 0)
        out, at = [], 0
        for r in rows:
            own = place[at : at + r["n"]]
            kept = np.flatnonzero(numbers[own])
            steps = np.zeros(len(own), np.int64)
            steps[kept] = np.diff(numbers[own[kept]], prepend=0)
            out.append((r["block"], r["shard"], int(numbers.max()), r["n"], _packed(steps), _packed(total[own[kept]])))
            at += r["n"]
        return _table(out, ANSWER)

    return asked.groupBy("shard").applyInArrow(answer, ANSWER)


def _bounds(docs: DataFrame, key: str, text: str, n: int, shards: int) -> list[bytes]:
    """Texts that cut n-grams into ranges of about the same size, from evenly spaced n-grams of some documents; they decide nothing else."""
    if shards == 1:
        return []
    some = docs.filter(F.pmod(F.xxhash64(key, text), F.lit(max(1, n // BOUND_TEXTS))) == 0).select(F.lower(F.col(text)).alias("text"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0).to_pylist():
                words = (t or "").split()
                grams = [" ".join(words[i : i + k]) for i in range(0, len(words), len(words) // 64 + 1) for k in (1, 2, 3)]
                yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string())], ["gram"])

    grams = sorted(g.encode() for g in some.mapInArrow(pick, "gram string").distinct().toArrow()["gram"].to_pylist())
    return sorted({grams[len(grams) * i // shards] for i in range(1, shards)}) if grams else []


def _size(docs: DataFrame, text: str) -> tuple[int, int]:
    """Rows, and bytes of text."""
    n, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col(text).cast("string")))).first()
    return n, size or 0


def _parts(size: int, each: int) -> int:
    return max(-(-size // each), min(SOME, -(-size // SMALL_BYTES)), 1)


def weights(docs: DataFrame, key: str, text: str, min_df: int = 2) -> DataFrame:
    """``key, term, idx, weight`` of every document and n-gram that ``min_df`` documents have, fitted on the same documents.

    Rows of one key are one document; rows without key are one too, which counts but gets no weights.
    """
    n, size = _size(docs, text)
    sent = _sent(docs, key, text, _parts(size, BLOCK_BYTES))
    answers = materialise(_answered(_asked(sent, _bounds(docs, key, text, n, _parts(size, SHARD_BYTES))), min_df), "tfidf-answers", done=True)
    first, before = {}, 0
    for r in answers.groupBy("shard").agg(F.max("kept").alias("kept")).orderBy("shard").collect():  # a number for each shard
        first[r["shard"]], before = before, before + r["kept"]
    kind = docs.schema[key].dataType.simpleString()

    def weigh(texts: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(texts)
        schema = pa.schema([("key", block.keys.type), ("term", pa.string()), ("idx", pa.int32()), ("weight", pa.float64())])
        idx, df = np.full(len(block.codes), -1, np.int64), np.zeros(len(block.codes), np.int64)
        at = 0
        for r in answers.sort_by("shard").to_pylist():
            steps = _unpacked(r["steps"], r["n"])
            kept = at + np.flatnonzero(steps)
            idx[kept] = np.cumsum(steps)[kept - at] - 1 + first[r["shard"]]
            df[kept] = _unpacked(r["df"], len(kept))
            at += r["n"]
        named = block.keys.is_valid().to_numpy(zero_copy_only=False)
        rows = np.flatnonzero((idx[block.place] >= 0) & named[block.doc])
        doc, place = block.doc[rows], block.place[rows]
        w = (1 + np.log(block.times[rows])) * (np.log((1 + n) / (1 + df[place])) + 1)
        w = w / np.sqrt(np.bincount(doc, w * w, len(block.keys)))[doc]
        kept = np.flatnonzero(idx >= 0)
        terms, of = block.grams.texts(block.codes[kept]), np.cumsum(idx >= 0) - 1
        out = []
        for a in range(0, len(rows), ROWS_OUT):
            d, p = doc[a : a + ROWS_OUT], place[a : a + ROWS_OUT]
            out.append(pa.RecordBatch.from_arrays([block.keys.take(pa.array(d)), terms.take(pa.array(of[p])), pa.array(idx[p].astype(np.int32)), pa.array(w[a : a + ROWS_OUT])], schema=schema))
        return pa.Table.from_batches(out, schema)

    found = sent.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(weigh, f"key {kind}, term string, idx int, weight double")
    return found.withColumnRenamed("key", key)


def vocabulary(docs: DataFrame, key: str, text: str, min_df: int = 2, most: int | None = None) -> DataFrame:
    """``term, df, total`` of the n-grams that ``min_df`` documents have: all, or the ``most`` frequent in the corpus."""
    n, size = _size(docs, text)
    asked = _asked(_sent(docs, key, text, _parts(size, BLOCK_BYTES)), _bounds(docs, key, text, n, _parts(size, SHARD_BYTES)), totals=True)

    def top(table: pa.Table) -> pa.Table:
        grams, found, _, df, total = _merged(table.to_pylist())
        kept = np.flatnonzero(df >= min_df)
        kept = kept[np.lexsort((kept, -total[kept]))][:most]
        return pa.table({"term": grams.texts(found[kept]), "df": df[kept], "total": total[kept]})

    terms = asked.groupBy("shard").applyInArrow(top, "term string, df long, total long")
    return terms if most is None else terms.orderBy(F.desc("total"), "term").limit(most)


def features(docs: DataFrame, key: str, text: str, terms: pa.Table, n: int) -> DataFrame:
    """``key, idx, weight``: numbers, in order, and TF-IDF weights of the ``terms`` (``term, df, idx``) of each document that has any, out of ``n`` documents.

    The terms go to every task.
    """
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    split = [[number[w] for w in t.encode().split(b" ")] for t in terms["term"].to_pylist()]
    parts = np.array([x + [-1] * (3 - len(x)) for x in split], np.int32).reshape(-1, 3)
    spark, (_, size) = docs.sparkSession, _size(docs, text)
    shared = spark.sparkContext.broadcast((list(number), parts, *(np.asarray(terms[c]).astype(np.int64) for c in ("df", "idx"))))
    kind = docs.schema[key].dataType.simpleString()

    def weigh(table: pa.Table) -> pa.Table:
        words, parts, df, idx = shared.value
        block = Block(table)
        own = {w: i for i, w in enumerate(block.grams.words)}
        local = np.append([own.get(w, -2) for w in words], -1).astype(np.int32)[parts]
        here = np.flatnonzero((local > -2).all(axis=1))
        codes = block.grams.find(*local[here].T)
        at = np.minimum(np.searchsorted(block.codes, codes), max(len(block.codes) - 1, 0))
        hit = block.codes[at] == codes if len(block.codes) else np.zeros(0, bool)
        of = np.full(len(block.codes), -1, np.int64)
        of[at[hit]] = here[hit]
        named = block.keys.is_valid().to_numpy(zero_copy_only=False)
        rows = np.flatnonzero((of[block.place] >= 0) & named[block.doc])
        doc, term = block.doc[rows], of[block.place[rows]]
        rows = rows[np.lexsort((idx[term], doc))]
        doc, term = block.doc[rows], of[block.place[rows]]
        w = (1 + np.log(block.times[rows])) * (np.log((1 + n) / (1 + df[term])) + 1)
        w = w / np.sqrt(np.bincount(doc, w * w, len(block.keys)))[doc]
        docs, first = np.unique(doc, return_index=True)
        cuts = pa.array(np.append(first, len(doc)), pa.int32())
        lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (idx[term].astype(np.int32), w)]
        return pa.Table.from_arrays([block.keys.take(pa.array(docs)), *lists], ["key", "idx", "weight"])

    sent = _sent(docs, key, text, _parts(size, BLOCK_BYTES))
    return sent.groupBy("block").applyInArrow(weigh, f"key {kind}, idx array<int>, weight array<double>").withColumnRenamed("key", key)
