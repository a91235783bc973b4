"""I-Match document fingerprints with randomised lexicon subsets.

The terms of a text that lie in a band of inverse document frequency are hashed
per lexicon subset. At scale ``j`` a subset holds a share of ``2**-j`` of all
terms, drawn at random, so texts of any length have subsets of which they hold
just a few terms; ``SUBSETS`` subsets are kept at each scale. Two fingerprints
are compared on the sparsest subsets that tell something about either.

Document frequencies are counted over all texts, in a table of ``2**BITS``
hashed terms; the band starts well above the number of rare terms that fall
together there. So what is sent to every task has a fixed size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm.common import id_and_text

BITS, REMEMBERED = 22, 400_000
#: The band: terms in at least this share of the documents (and in two), and at most that share.
RARE, COMMON = 2e-4, 0.05
SCALES, SUBSETS, EVIDENCE = 12, 12, 24
#: Rows of a group of neighbouring ids; the number of groups has a bound of its own.
GROUP_ROWS, MOST_GROUPS = 4096, 10_000
SLICE = 256
ODD = np.array([int.from_bytes(hashlib.sha256(f"scale {j}".encode()).digest()[:8], "little") | 1 for j in range(SCALES)], np.uint64)[:, None]
SHIFT = np.array([63 - j for j in range(SCALES)], np.uint64)[:, None]  # scale j: 2**(j+1) cells


def term(word: str) -> int:
    """Hash of a lower-case word without the signs around it; 0: no term."""
    core = word.strip("!?.,;:#$%&*|()[]{}<>\"'=-_~^+/\\@`")
    return xxhash.xxh64_intdigest(core) or 1 if core else 0


class Lexicon:
    """Hashes of terms: of all, and those in the band. Words are remembered, which only saves time."""

    def __init__(self, band: np.ndarray):
        self.band, self.known = band, {}

    def terms(self, text: str) -> np.ndarray:
        """Sorted distinct terms of the text in the band, or all its terms if the band holds none."""
        words = set(text.lower().split())
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        every = np.fromiter((known[w] if w in known else known.setdefault(w, term(w)) for w in words), np.uint64, len(words))
        every = np.unique(every[every > 0])
        inside = every[self.band[(every >> np.uint64(64 - BITS)).astype(np.int64)]]
        return inside if len(inside) else every


def fingerprint(terms: np.ndarray) -> np.ndarray:
    """16 bits per subset; 0: the subset has none of the terms."""
    mixed = terms * ODD
    cell = mixed >> SHIFT
    scale, at = np.nonzero(cell < SUBSETS)
    subset = scale * SUBSETS + cell[scale, at].astype(np.int64)
    sums = np.zeros(SCALES * SUBSETS, np.uint64)  # of a sorted set of distinct terms, in any order
    np.add.at(sums, subset, (terms[at] ^ (terms[at] >> np.uint64(29))) * ODD[0])
    found = np.zeros(len(sums), bool)
    found[subset] = True
    bits = (((sums ^ (sums >> np.uint64(32))) * ODD[1]) >> np.uint64(48)).astype(np.uint16)
    return np.where(found, np.maximum(bits, 1), 0).astype(">u2")


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of fingerprints: the equal share of the subsets that either row uses, from the sparsest scale to where there are ``EVIDENCE``; two empty ones are alike."""
    a, b = a.reshape(-1, SCALES, SUBSETS), b.reshape(-1, SCALES, SUBSETS)
    used = (a > 0) | (b > 0)
    told, same = used.sum(axis=2), ((a == b) & used).sum(axis=2)
    seen, equal = np.zeros(len(a)), np.zeros(len(a))
    for j in reversed(range(SCALES)):
        more = seen < EVIDENCE
        seen += np.where(more, told[:, j], 0)
        equal += np.where(more, same[:, j], 0)
    return np.where(seen > 0, equal / np.maximum(seen, 1), 1.0)


def band_of(docs: DataFrame) -> np.ndarray:
    """Whether each hashed term lies in the band, from the frequencies over all rows of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows, known = np.zeros(1 << BITS, np.int32), 0, {}
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                found = []
                if len(known) > REMEMBERED:
                    known.clear()
                for t in batch.column(0).slice(at, SLICE).to_pylist():
                    words = set(t.lower().split())
                    h = np.fromiter((known[w] if w in known else known.setdefault(w, term(w)) for w in words), np.uint64, len(words))
                    found.append(np.unique(h[h > 0] >> np.uint64(64 - BITS)))
                rows += len(found)
                np.add.at(seen, np.concatenate(found).astype(np.int64), 1)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], rows).astype(np.int64))], ["k", "n"])

    # A task sends one row per hashed term at most; those in the band are at most 2**BITS in all.
    totals = docs.select("text").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    n = docs.count()
    least, most = max(2, int(np.ceil(RARE * n))), max(2, int(COMMON * n))
    inside = totals.filter((F.col("k") >= 0) & F.col("n").between(least, most)).select("k").toArrow()
    band = np.zeros(1 << BITS, bool)
    band[np.asarray(inside["k"])] = True
    return band


LOWEST = -(1 << 63)  # stands for a null id


def _group_ends(docs: DataFrame) -> np.ndarray:
    """Ids, each the largest of its group, that part all ids into groups of about equal size."""
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("id"))
    n, largest = ids.agg(F.count(F.lit(1)), F.max("id")).first()
    groups = min(MOST_GROUPS, -(-n // GROUP_ROWS))
    inner = ids.agg(F.percentile_approx("id", [i / groups for i in range(1, groups)], 10 * MOST_GROUPS)).first()[0] if groups > 1 else []
    return np.unique(np.array([*(inner or []), largest if n else 0], np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` for each row of ``docs``.

    The edited text has its last half, floor(n_chars / 2) code points, replaced
    by the first as many (or all) of the next document by descending id; after
    the last comes the first. Null texts are empty; null ids come last; rows of
    one id follow each other in a fixed order of their texts. A text without
    terms has a fingerprint of zeros. An empty table gives an empty one.

    Texts are moved once, compressed, to groups of neighbouring ids. The first
    row of a group is also sent to the group that it follows.
    """
    pairs = id_and_text(docs, id_col, text_col)
    kind, ends = pairs.schema["doc_id"].dataType.simpleString(), _group_ends(pairs)
    spark = docs.sparkSession
    band = spark.sparkContext.broadcast(np.packbits(band_of(pairs)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids = np.array([LOWEST if i is None else i for i in batch.column(0).to_pylist()], np.int64)
            text = pa.array([squeeze.compress(t.encode()) for t in batch.column(1).to_pylist()], pa.binary())
            group = np.searchsorted(ends, ids)
            first = np.flatnonzero(ids == ends[group])  # largest ids of a group: the next group's last row is followed by one
            at = np.concatenate([np.arange(len(ids)), first])
            ahead = np.concatenate([group, (group[first] + 1) % len(ends)])
            extra = np.arange(len(at)) >= len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ahead), pa.array(extra), pa.array(ids[at]), batch.column(0).take(pa.array(at)), text.take(pa.array(at))], ["g", "extra", "id", "doc_id", "z"]
            )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(np.unpackbits(band.value).astype(bool))
        expand = zstandard.ZstdDecompressor()
        last, out = None, []

        def done() -> pa.RecordBatch:
            own, edited, after = (np.array([r[i] for r in out], np.uint16) for i in (3, 4, 5))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in out], batch.column(3).type), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string()),
                    pa.array([r[3].tobytes().hex() for r in out], pa.string()), pa.array([r[4].tobytes().hex() for r in out], pa.string()),
                    pa.array(likeness(own, edited)), pa.array(likeness(own, after)),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        for batch in batches:
            for g, extra, doc_id, z in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
                if extra and (last is None or last[0] != g):
                    continue  # only the first row of the next group is needed
                text = expand.decompress(z).decode()
                print_ = fingerprint(lexicon.terms(text))
                if last is not None:
                    _, before, whole, own = last
                    half = len(whole) // 2
                    edited = whole[: len(whole) - half] + text[:half]
                    out.append((before, len(whole), hashlib.sha256(edited.encode()).hexdigest(), own, fingerprint(lexicon.terms(edited)), print_))
                last = None if extra else (g, doc_id, text, print_)
                if len(out) >= SLICE:
                    yield done()
                    out = []
        if out:
            yield done()

    dealt = pairs.mapInArrow(deal, f"g long, extra boolean, id long, doc_id {kind}, z binary")
    ordered = dealt.repartition("g").sortWithinPartitions("g", "extra", F.desc("id"), "z")
    return ordered.mapInArrow(compare, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
