"""Best-fit packing of token sequences with a grouping genetic algorithm on islands.

Only a document longer than a sequence is cut. The short pieces are dealt at
random into blocks of about ``BLOCK`` pieces; a block is solved by several
islands, each a group of Spark's. An island keeps a small population of
packings; crossover injects whole well-filled bins of one parent into the
other, removes the pieces that are now there twice, and puts the displaced
ones back by best fit. After an epoch the elite of each island moves to the
next island of its block. Pieces in poorly filled bins of the best packing are
dealt anew, all blocks together, until one block holds them. So no task ever
sees more than a block, and the last, poorly filled bins of all blocks end up
together.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opinara.llm.common import id_and_text
from opinara.llm.words import word_ids
from opinara.session import materialise

BLOCK, ISLANDS, EPOCHS, POPULATION, GENERATIONS = 4096, 2, 2, 5, 6
#: A bin this full stays as it is; pieces of emptier ones are dealt anew.
WELL_FILLED = 0.995
ROUNDS = 12
SLICE = 512
STATE = "block long, island int, uids array<long>, lengths array<int>, bins array<int>, bins_used int"


def tokenize_pieces(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of each document: ``doc_id, piece, start, length, ids_crc32``.

    A document's ids end with ``end_id``, so an empty or null text has one
    piece of length 1. A document longer than ``size`` is cut every ``size`` ids.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = word_ids(tokenizer), end_id.to_bytes(4, "little")
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                row, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(coder.batch(part.column(1).to_pylist())):
                    ids += end
                    for k, begin in enumerate(range(0, len(ids), 4 * size)):
                        own = ids[begin : begin + 4 * size]
                        row.append(i)
                        piece.append(k)
                        start.append(begin // 4)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int32())), *(pa.array(x, t) for x, t in zip((piece, start, length, crc), kinds, strict=True))], names)

    pairs = id_and_text(docs)
    return pairs.mapInArrow(cut, f"doc_id {pairs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


class Packing:
    """Bins of piece numbers, with best fit over the bins' free room."""

    def __init__(self, lengths: list[int], size: int):
        self.lengths, self.size = lengths, size
        self.bins: list[list[int]] = []
        self.room: list[int] = []
        self.open: list[tuple[int, int]] = []  # (room, bin), sorted

    def add_bin(self, pieces: list[int]) -> None:
        room = self.size - sum(self.lengths[p] for p in pieces)
        if room:
            insort(self.open, (room, len(self.bins)))
        self.bins.append(list(pieces))
        self.room.append(room)

    def best_fit(self, pieces: list[int]) -> None:
        """Each piece into the open bin with the least sufficient room, or a new bin."""
        for p in pieces:
            need = self.lengths[p]
            at = bisect_left(self.open, (need, -1))
            if at == len(self.open):
                self.add_bin([p])
                continue
            room, b = self.open.pop(at)
            self.bins[b].append(p)
            self.room[b] = room - need
            if room > need:
                insort(self.open, (room - need, b))

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first, then fuller bins."""
        return -len(self.bins), sum((self.size - r) ** 2 for r in self.room)

    def assignment(self) -> list[int]:
        out = [0] * len(self.lengths)
        for b, pieces in enumerate(self.bins):
            for p in pieces:
                out[p] = b
        return out


def decreasing(pieces: list[int], lengths: list[int]) -> list[int]:
    return sorted(pieces, key=lambda p: -lengths[p])


def from_assignment(bins: list[int], lengths: list[int], size: int) -> Packing:
    groups: dict[int, list[int]] = {}
    for p, b in enumerate(bins):
        groups.setdefault(b, []).append(p)
    out = Packing(lengths, size)
    for pieces in groups.values():
        out.add_bin(pieces)
    return out


def crossover(a: Packing, b: Packing, rng: random.Random) -> Packing:
    """``b`` with whole well-filled bins of ``a``; what they displace goes back by best fit."""
    order = sorted(range(len(a.bins)), key=lambda i: a.room[i])
    chosen = [i for i in order[: max(1, len(order) // 2)] if rng.random() < 0.7]
    injected = {p for i in chosen for p in a.bins[i]}
    out, displaced = Packing(a.lengths, a.size), []
    for i in chosen:
        out.add_bin(a.bins[i])
    for pieces in b.bins:
        if injected.isdisjoint(pieces):
            out.add_bin(pieces)
        else:
            displaced += [p for p in pieces if p not in injected]
    out.best_fit(decreasing(displaced, a.lengths))
    return out


def mutate(a: Packing, rng: random.Random) -> Packing:
    """Empty the emptiest bins and a few others, and put their pieces back by best fit."""
    order = sorted(range(len(a.bins)), key=lambda i: -a.room[i])
    gone = {*order[: max(2, len(order) // 50)], *rng.sample(range(len(a.bins)), min(len(a.bins), 3))}
    out = Packing(a.lengths, a.size)
    for i, pieces in enumerate(a.bins):
        if i not in gone:
            out.add_bin(pieces)
    out.best_fit(decreasing([p for i in sorted(gone) for p in a.bins[i]], a.lengths))
    return out


def evolve(lengths: list[int], size: int, elites: list[list[int]], seed: int) -> Packing:
    """The best packing that an island finds from what it has and what moved in."""
    rng, bound = random.Random(seed), -(-sum(lengths) // size)
    people = [from_assignment(e, lengths, size) for e in elites]
    if not people:
        first = Packing(lengths, size)
        first.best_fit(decreasing(list(range(len(lengths))), lengths))
        people = [first]
    best = max(people, key=Packing.fitness)
    if len(best.bins) == bound:
        return best  # no packing has fewer
    while len(people) < POPULATION:
        order = sorted(range(len(lengths)), key=lambda p: -lengths[p] * rng.uniform(0.9, 1.1))
        other = Packing(lengths, size)
        other.best_fit(order)
        people.append(other)
    for _ in range(GENERATIONS):
        people.sort(key=Packing.fitness, reverse=True)
        if len(people[0].bins) == bound:
            break
        a, b = people[0], rng.choice(people[1:])
        people[-2:] = [crossover(a, b, rng), mutate(crossover(b, a, rng), rng)]
    return max(people, key=Packing.fitness)


def _islands(blocks: DataFrame, size: int) -> DataFrame:
    """The best packing of each block, after epochs with elite migration."""

    def epoch(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        block, island = key
        lengths = [int(x) for x in rows["lengths"].iloc[0]]
        elites = [[int(x) for x in r] for r in rows["bins"] if r is not None and len(r)]
        best = evolve(lengths, size, elites, hash((int(block), int(island), len(elites))))
        return pd.DataFrame({"block": [block], "island": [island], "uids": [rows["uids"].iloc[0]], "lengths": [lengths], "bins": [best.assignment()], "bins_used": [len(best.bins)]})

    state = blocks.select("block", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "uids", "lengths", F.lit(None).cast("array<int>").alias("bins"), F.lit(0).alias("bins_used"))
    for i in range(EPOCHS):
        if i:  # the elite of each island also moves to the next one
            state = state.withColumn("island", F.explode(F.array("island", ((F.col("island") + 1) % ISLANDS).cast("int"))))
        state = state.groupBy("block", "island").applyInPandas(epoch, STATE)
    best = F.min_by(F.struct("uids", "lengths", "bins"), F.struct("bins_used", "island"))
    return state.groupBy("block").agg(best.alias("b")).select("block", "b.uids", "b.lengths", "b.bins")


def pack(pieces: DataFrame, size: int = 2048, block: int = BLOCK) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``size``.

    Repeated rows are packed once each. An empty table gives an empty one.
    """
    kept = materialise(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    full = kept.filter(F.col("length") >= size).select("uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    placed, rest, base = [full], kept.filter(F.col("length") < size).select("uid", F.col("length").cast("int").alias("length")), 0
    n = rest.count()
    for turn in range(ROUNDS):
        if not n:
            break
        blocks = max(1, -(-n // block))
        number = F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(blocks))
        grouped = rest.groupBy(number.alias("block")).agg(F.sort_array(F.collect_list(F.struct("uid", "length"))).alias("p"))
        best = _islands(grouped.select("block", F.col("p.uid").alias("uids"), F.col("p.length").alias("lengths")), size)
        rows = best.select("block", F.explode(F.arrays_zip("uids", "lengths", "bins")).alias("x")).select("block", F.col("x.uids").alias("uid"), F.col("x.lengths").alias("length"), F.col("x.bins").alias("bin"))
        bins = Window.partitionBy("block", "bin")
        rows = rows.select(
            "uid", "length", F.sum("length").over(bins).alias("fill"),
            (F.sum("length").over(bins.orderBy("uid").rowsBetween(Window.unboundedPreceding, -1))).alias("before"),
            (F.lit(base) + F.col("block") * (2 * block + 1024) * 8 + F.col("bin")).alias("sequence_id"),
        )
        rows = materialise(rows, "packed")
        last = blocks == 1 or turn == ROUNDS - 1
        done = rows if last else rows.filter(F.col("fill") >= WELL_FILLED * size)
        placed.append(done.select("uid", F.col("sequence_id").cast("long"), F.coalesce("before", F.lit(0)).cast("long").alias("offset")))
        if last:
            break
        rest = rows.filter(F.col("fill") < WELL_FILLED * size).select("uid", "length")
        base += blocks * (2 * block + 1024) * 8
        n = rest.count()
    where = placed[0]
    for more in placed[1:]:
        where = where.unionByName(more)
    return kept.join(where, "uid").drop("uid")


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 2048) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece of every row of ``docs``."""
    return pack(tokenize_pieces(docs, tokenizer, size), size)
