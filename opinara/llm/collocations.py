"""Phrase collocations by best-first branch and bound.

A phrase scores as twice its count over the counts of the two parts it is cut
into, at its lowest-scoring cut. Nothing that begins with a phrase ``p`` occurs
more often than ``p``, and cut after its first word it scores at most
``2 f(p) / (f(first word) + f(p))``: the bound of all that can be grown from
``p``, told by prefix counts alone.

Words and pairs of words are counted once. From then on the frontier holds the
phrases whose bound, or whose own score while it is open whether a longer
phrase takes their place, reaches the score of the last rank wanted. The best
of it are expanded, all in one pass over the documents: counted are the phrases
that are one word longer on a side where that is asked for. That settles
scores, which raises the score to be reached; the work ends when nothing on the
frontier reaches it, ties included.

What to count is told to the tasks as bit tables of a bounded size. A false bit
has one phrase more counted, in full; it changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.operators.ranking import top_rows
from opinara.session import materialise

#: ``.,;:!?`` and U+000A to U+000D end a piece, space and tab a word; A-Z are lower-cased. 0xFF is in no UTF-8 text.
BREAK = b"\xff"
FOLD = bytes(255 if chr(c) in ".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bytes of text a task holds before it counts, and rows of a batch it sends.
HELD, SENT = 12 << 20, 1 << 16
#: Bits of a bit table per phrase, and the most and the fewest bits as powers of two (8 MB at most).
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 16, 26
#: Phrases of a language that the first round expands; as long as too few are settled, each round takes four times as many.
FIRST_BATCH = 8000
UNKNOWN = "und"
SCALE = 2_000_000
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
COUNTS = "lang string, phrase string, n long"


def _score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """``floor(SCALE * a / (l + r))`` without overflow."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(19,0)") * wide(a), wide(l) + wide(r))


# ------------------------------------------------------------ bit tables
def _word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word, xxhash.xxh32_intdigest(lang))


def _longer(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase and one more word behind it."""
    h = (h * MIX[0] + word) * MIX[1]
    return h ^ (h >> np.uint64(31))


@dataclass(frozen=True)
class BitTable:
    """Two bits per phrase; a phrase that was put in is always found."""

    bits: int
    table: np.ndarray

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for slot in _slots(h, self.bits):
            out &= (self.table[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) != 0
        return out


def _slots(h: np.ndarray, bits: int) -> list[np.ndarray]:
    return [((h * m) >> np.uint64(64 - bits)).astype(np.int64) for m in (MIX[1], MIX[2])]


def bit_table(phrases: DataFrame) -> BitTable:
    """Of ``lang, phrase`` rows. At most 2^20 numbers come to the driver, however many phrases there are."""
    bits = min(MOST_BITS, max(LEAST_BITS, (phrases.count() * BITS_EACH).bit_length()))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.empty(batch.num_rows, np.uint64)
            with np.errstate(over="ignore"):
                for i, (lang, phrase) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                    words = np.array([_word_hash(lang, w) for w in phrase.encode().split(b" ")], np.uint64)
                    at = words[:1]
                    for j in range(1, len(words)):
                        at = _longer(at, words[j : j + 1])
                    h[i] = at[0]
                slots = np.unique(np.concatenate(_slots(h, bits)))
            place, first = np.unique(slots >> 6, return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (slots & 63).astype(np.uint64), first) if len(slots) else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array(value.view(np.int64))], ["place", "value"])

    table = np.zeros(1 << (bits - 6), np.uint64)
    rows = phrases.select("lang", "phrase").mapInArrow(fold, "place int, value long").groupBy("place").agg(F.bit_or("value").alias("value")).toArrow()
    table[rows["place"].to_numpy()] = rows["value"].to_numpy().view(np.uint64)
    return BitTable(bits, table)


# ------------------------------------------------------------ counting
def numbered(folded: bytes) -> tuple[np.ndarray, pa.Array]:
    """The words of folded text as numbers from 1, with a 0 where a piece ends between two, and the distinct words in order of their numbers."""
    text = np.frombuffer(folded, np.uint8)
    inside = (text != 0x20) & (text != 0x09) & (text != 0xFF)
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False)).astype(np.int32)  # a task holds far fewer bytes than that counts
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(text[inside])]).dictionary_encode()
    ends = np.searchsorted(starts, np.flatnonzero(text == 0xFF))  # before which word each piece begins
    ends = np.unique(ends[(ends > 0) & (ends < len(starts))])
    ids = np.insert(words.indices.to_numpy().astype(np.int64) + 1, ends, 0) if len(ends) else words.indices.to_numpy().astype(np.int64) + 1
    return ids, words.dictionary


class Held:
    """Folded texts by language that wait to be counted together."""

    def __init__(self):
        self.texts, self.size = {}, 0

    def add(self, batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, pa.Array]]:
        """Take in ``lang, text`` rows; gives what has come together once it is much."""
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            folded = text.encode().translate(FOLD)
            self.texts.setdefault(lang, []).append(folded)
            self.size += len(folded)
            if self.size > HELD:
                yield from self.flush()

    def flush(self) -> Iterator[tuple[str, np.ndarray, pa.Array]]:
        for lang in list(self.texts):
            yield lang, *numbered(BREAK.join(self.texts.pop(lang)))
            pa.default_memory_pool().release_unused()  # a worker keeps no more than the next texts need
        self.size = 0


def _batches(lang: str, phrases: pa.Array, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(n), SENT):
        part = phrases.slice(at, SENT)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), part, pa.array(n[at : at + SENT], pa.int64())], ["lang", "phrase", "n"])


def count_words(docs: DataFrame) -> DataFrame:
    """``lang, phrase, n`` of every word of ``lang, text`` rows; the row without a phrase has the number of all words of its language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held()

        def sent(lang: str, ids: np.ndarray, words: pa.Array) -> Iterator[pa.RecordBatch]:
            n = np.bincount(ids, minlength=len(words) + 1)[1:]
            yield from _batches(lang, pa.concat_arrays([words.cast(pa.string()), pa.nulls(1, pa.string())]), np.append(n, n.sum()))

        for batch in batches:
            for part in held.add(batch):
                yield from sent(*part)
        for part in held.flush():
            yield from sent(*part)

    return docs.mapInArrow(count, COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Wanted:
    """What a pass counts: pairs of known words, or phrases one longer than those to be grown ``right`` or ``left``, by number of words."""

    words: BitTable
    pairs: bool = False
    right: tuple = ()
    left: tuple = ()

    def phrases(self, ids: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Lengths, and the places in ``ids`` where phrases to be counted begin."""
        if self.pairs:
            yield 2, np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
            return
        right, left = dict(self.right), dict(self.left)
        h, whole = hashes[ids], ids > 0
        words, at = h, whole
        for size in range(2, max([*right, *left]) + 1):
            h, at = _longer(h[:-1], words[size - 1 :]), at[:-1] & whole[size - 1 :]
            grown = at[:-1] & whole[size:]
            places = np.flatnonzero(grown)
            asked = np.zeros(len(places), bool)
            if size in right:
                asked |= right[size].has(h[places])
            if size in left:
                asked |= left[size].has(h[places + 1])
            yield size + 1, places[asked]


def count_phrases(docs: DataFrame, wanted: Wanted) -> DataFrame:
    """``lang, phrase, n`` of what is wanted, over all ``lang, text`` rows; each phrase is counted in full or not at all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held()

        def sent(lang: str, ids: np.ndarray, words: pa.Array) -> Iterator[pa.RecordBatch]:
            hashes = np.zeros(len(words) + 1, np.uint64)
            hashes[1:] = np.fromiter((_word_hash(lang, w) for w in words.to_pylist()), np.uint64, len(words))
            often = wanted.words.has(hashes)
            often[0] = False
            ids[~often[ids]] = 0
            for n, places in wanted.phrases(ids, hashes):
                yield from _counted(lang, ids, words, n, places)

        for batch in batches:
            for part in held.add(batch):
                yield from sent(*part)
        for part in held.flush():
            yield from sent(*part)

    return docs.mapInArrow(count, COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _counted(lang: str, ids: np.ndarray, words: pa.Array, n: int, places: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Distinct phrases of ``n`` words that begin at ``places``, with their counts."""
    if not len(places):
        return
    key, heads = ids[places], []
    for j in range(1, n):
        if j > 1:  # two words fill a number: the distinct beginnings are numbered anew
            distinct, key = np.unique(key, return_inverse=True)
            heads.append(distinct)
        key = key << 32 | ids[places + j]
    key.sort()
    first = np.flatnonzero(np.diff(key, prepend=-1))
    key, counts = key[first], np.diff(first, append=len(key))
    for at in range(0, len(key), SENT):
        part, last = key[at : at + SENT], []
        for j in range(n - 1, 0, -1):
            last.insert(0, part & 0xFFFFFFFF)
            part = heads[j - 2][part >> 32] if j > 1 else part >> 32
        phrases = pc.binary_join_element_wise(*[words.take(pa.array(i - 1)) for i in (part, *last)], b" ").cast(pa.string())
        yield from _batches(lang, phrases, counts[at : at + SENT])


# ------------------------------------------------------------ growth
def _scored(new: DataFrame, known: DataFrame) -> DataFrame:
    """``new`` (``lang, phrase, n, size``) with its lowest-scoring cut, ``bound`` of all that begins with it, and the parts not counted yet.

    A part not counted occurs at least as often as the phrase, so the score is
    then an upper bound.
    """
    words = F.split("phrase", " ")
    cuts = new.withColumn("words", words).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    join = lambda a, b: F.array_join(F.slice("words", a, b), " ")
    cuts = cuts.select("lang", "phrase", "size", F.col("n").alias("a"), "k", join(F.lit(1), F.col("k")).alias("first"), join(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    side = lambda part, name: known.select(F.col("lang").alias(f"{name}_lang"), F.col("phrase").alias(f"{name}_phrase"), F.col("n").alias(name))
    for part, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(side(part, name), (F.col("lang") == F.col(f"{name}_lang")) & (F.col(part) == F.col(f"{name}_phrase")), "left")
    score = _score(F.col("a"), F.coalesce("l", "a"), F.coalesce("r", "a"))
    missing = F.filter(F.array(F.when(F.col("l").isNull(), F.col("first")), F.when(F.col("r").isNull(), F.col("rest"))), lambda p: p.isNotNull())
    out = cuts.groupBy("lang", "phrase", "size", "a").agg(
        F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"), F.flatten(F.collect_list(missing)).alias("missing"), F.max(F.when(F.col("k") == 1, F.col("l"))).alias("f1"),
    )
    return out.select("lang", "phrase", "size", "a", "cut.score", "cut.l", "cut.r", "missing", _score(F.col("a"), F.col("f1"), F.col("a")).alias("bound"))


def _nodes(scored: DataFrame, grams: DataFrame, done: DataFrame, longest: int) -> DataFrame:
    """``scored`` with what is known of longer phrases: ``dropped``, ``settled``, and the sides grown."""
    words = F.split("phrase", " ")
    shorter = F.array(F.array_join(F.slice(words, 1, F.col("size") - 1), " "), F.array_join(F.slice(words, F.lit(2), F.col("size") - 1), " "))
    longer = grams.filter("size > 2").select("lang", F.explode(shorter).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    grown = done.groupBy("lang", "phrase").agg(F.max("right").alias("right"), F.max("left").alias("left"))
    out = scored.join(longer, ["lang", "phrase"], "left").join(grown, ["lang", "phrase"], "left")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    dropped = F.coalesce(wide("longer") * 100 >= wide("a") * 80, F.lit(False))
    end = F.col("size") == longest
    right, left = F.coalesce("right", F.lit(False)) | end, F.coalesce("left", F.lit(False)) | end
    out = out.select("lang", "phrase", "size", "a", "score", "l", "r", "missing", "bound", dropped.alias("dropped"), right.alias("right"), left.alias("left"))
    settled = ~F.col("dropped") & F.col("right") & F.col("left") & (F.size("missing") == 0)
    open_score = F.when(~F.col("dropped") & ~settled, F.col("score"))
    reach = F.greatest(open_score, F.when(~F.col("right"), F.col("bound")))  # of the phrase while open, and of all that begins with it
    return out.withColumn("settled", settled).withColumn("open_score", open_score).withColumn("reach", reach)


def _last_score(nodes: DataFrame, k: int) -> DataFrame:
    """``lang, least``: the score of rank ``k`` among the settled phrases; no row for a language with fewer."""
    ranked = top_rows(nodes.filter("settled"), ["lang"], [F.desc("score"), "phrase"], k, rank="place")
    return ranked.filter(F.col("place") == k).select("lang", F.col("score").alias("least"))


def _to_grow(frontier: DataFrame) -> DataFrame:
    """``lang, phrase, size, right, left``: what to grow so that the frontier is settled."""
    words = F.split("phrase", " ")
    part = lambda a, n: F.array_join(F.slice(words, a, n), " ")
    row = lambda phrase, size, right, left: F.struct(phrase.alias("phrase"), size.alias("size"), right.alias("right"), left.alias("left"))
    yes, no = F.lit(True), F.lit(False)
    shorter = F.col("size") - 1
    grow_left = F.coalesce(F.col("open_score") >= F.col("least"), no) & ~F.col("left")
    grow_right = ~F.col("right")
    own = row(F.col("phrase"), F.col("size"), grow_right, grow_left)
    # the parts of what the phrase grows into: its end and one word more, and one word more and its beginning
    ends = F.when((F.col("size") > 2) & grow_right, row(part(F.lit(2), shorter), shorter, yes, no))
    beginnings = F.when((F.col("size") > 2) & grow_left, row(part(F.lit(1), shorter), shorter, no, yes))
    parts = F.transform("missing", lambda p: row(F.array_join(F.slice(F.split(p, " "), F.lit(1), F.size(F.split(p, " ")) - 1), " "), F.size(F.split(p, " ")) - 1, yes, no))
    asked = frontier.select("lang", F.explode(F.concat(F.array(own, ends, beginnings), parts)).alias("g")).filter("g.right or g.left")
    return asked.groupBy("lang", "g.phrase", "g.size").agg(F.max("g.right").alias("right"), F.max("g.left").alias("left"))


def mine_phrases(docs: DataFrame, k: int = 2000, least_count: int = 30, longest: int = 4, first_batch: int = FIRST_BATCH, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The ``k`` best phrases of 2 to ``longest`` words of each language: ``lang, rank, phrase, a, l, r, n, score``.

    A null text is empty and a null language ``und``; repeated rows count each;
    other columns are left out; a language without a phrase, and an empty table,
    give no row. Equal scores go by count, then by phrase. A phrase with
    ``least_count`` occurrences is left out if a longer one that holds it occurs
    at least 0.8 times as often; it is enough to look at those one word longer,
    as any between the two occurs at least as often as the longer one.

    Each round reads the documents once, whole. Texts and counts stay with the
    tasks; counted phrases and the frontier are written tables.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit(UNKNOWN)).alias("lang"), docs[text_col].cast("string").alias("text")).filter("text is not null")
    words = materialise(count_words(texts).filter((F.col("n") >= least_count) | F.col("phrase").isNull()), "words")
    totals = words.filter("phrase is null").select("lang", F.col("n").alias("all_words"))
    known = words.filter("phrase is not null")
    table = bit_table(known)
    often = lambda counts, tag: materialise(counts.filter(F.col("n") >= least_count).withColumn("size", F.size(F.split("phrase", " "))), tag)
    grams = often(count_phrases(texts, Wanted(table, pairs=True)), "pairs")
    known = known.unionByName(grams.drop("size"))
    scored = materialise(_scored(grams, known), "scored")
    done = spark.createDataFrame([], "lang string, phrase string, right boolean, left boolean")
    batch = first_batch
    while True:
        nodes = materialise(_nodes(scored, grams, done, longest), "nodes")
        reached = nodes.join(_last_score(nodes, k), "lang", "left")
        frontier = reached.filter(F.col("reach") >= F.coalesce("least", F.lit(0))).withColumn("least", F.coalesce("least", F.lit(0)))
        some = top_rows(frontier.filter("least = 0"), ["lang"], [F.desc("reach"), "phrase"], batch)
        frontier = materialise(frontier.filter("least > 0").unionByName(some), "frontier")
        if frontier.isEmpty():
            break
        asked = _to_grow(frontier).join(done.groupBy("lang", "phrase").agg(F.max("right").alias("had_right"), F.max("left").alias("had_left")), ["lang", "phrase"], "left")
        asked = asked.withColumn("right", F.col("right") & ~F.coalesce("had_right", F.lit(False))).withColumn("left", F.col("left") & ~F.coalesce("had_left", F.lit(False)))
        asked = materialise(asked.filter("right or left").drop("had_right", "had_left"), "asked")
        sides = {side: tuple((size, bit_table(asked.filter(F.col(side) & (F.col("size") == size)))) for size in range(2, longest)) for side in ("right", "left")}
        counted = often(count_phrases(texts, Wanted(table, **sides)), "phrases")
        new = materialise(counted.join(grams.select("lang", "phrase"), ["lang", "phrase"], "left_anti"), "new")
        done = materialise(done.unionByName(asked.drop("size")), "done")
        grams, known = grams.unionByName(new), known.unionByName(new.drop("size"))
        again = scored.filter(F.size("missing") > 0).select("lang", "phrase", F.col("a").alias("n"), "size")
        scored = materialise(scored.filter(F.size("missing") == 0).unionByName(_scored(new.unionByName(again), known)), "scored")
        batch *= 4
    ranked = top_rows(nodes.filter("settled"), ["lang"], [F.desc("score"), F.desc("a"), "phrase"], k, rank="rank")
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("all_words").alias("n"), "score")
