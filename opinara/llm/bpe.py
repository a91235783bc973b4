"""Byte-level BPE of whole texts; long ones by tree concatenation.

A long text is cut in halves, again and again, at any place; the pieces are
encoded in parallel as rows of their own, and joined in pairs. Around a join, a
window of tokens from both sides is encoded anew. It grows until it agrees
with the left side at a place where any encoding of the text has a boundary,
and with the right side likewise; what lies outside is then right as it is.

Two kinds of places serve. Between pre-tokens: a boundary that the
pre-tokenizer's rule makes whatever comes before or after (``SURE``). Inside an
unsplit run of one class of characters: any token that both encodings have in
common, since a token sequence is the BPE encoding of its text if each pair of
neighbours is the encoding of theirs. If neither is found, the window comes to
hold both sides, which is encoding them whole.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm.common import id_and_text
from opinara.llm.words import is_plain, library

#: Code points of a piece; texts of more than twice as many are cut.
PIECE = 16_384
WINDOW = 32
SLICE = 256
#: Fixed value: the special token of the vocabulary, which no cut may split.
SPECIAL = "<|endoftext|>"
SURE = regex.compile(r"(?<=\p{L})(?!\p{L})|(?<=\p{N})(?!\p{N})|(?<=[^\s\p{L}\p{N}])(?=\s)|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])")
UNSPLIT = regex.compile(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}']+")


class Coder:
    """Ids as the tokenizers library gives them.

    Texts of the plain alphabet are encoded by the same vocabulary's ranks,
    several times as fast; any other character or special string leaves the
    whole text to the library.
    """

    def __init__(self, tokenizer: str, ranks: str, pattern: str):
        import tiktoken

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = library(tokenizer)
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={SPECIAL: len(table)})
        self.size = np.array([len(k) for k, _ in sorted(table.items(), key=lambda x: x[1])] + [len(SPECIAL)], np.int64)

    def encode(self, text: str) -> np.ndarray:
        if is_plain(text):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        return self.fast.decode_bytes(ids.tolist()).decode("utf-8", "replace")

    def join(self, left: str, a: np.ndarray, right: str, b: np.ndarray) -> np.ndarray:
        """The ids of ``left + right``, given those of each."""
        if not len(a) or not len(b):
            return np.concatenate([a, b])
        before, after = left.encode(), right.encode()
        end_a, end_b = np.cumsum(self.size[a]), np.cumsum(self.size[b])
        width = WINDOW
        while width < max(len(a), len(b)):
            i, j = max(0, len(a) - width), min(len(b), width)
            while i and _inside(before, start := int(end_a[i - 1])):
                i -= 1
            start = int(end_a[i - 1]) if i else 0
            while j < len(b) and _inside(after, int(end_b[j - 1])):
                j += 1
            end = int(end_b[j - 1])
            text = (before[start:] + after[:end]).decode()
            ids = self.encode(text)
            places = self._agree(text, ids, len(before) - start, a[i:], b[:j], after[end : end + 4])
            if places is not None:
                cut_a, low, high, cut_b = places
                return np.concatenate([a[: i + cut_a], ids[low:high], b[cut_b:]])
            width *= 2
        return self.encode(left + right)

    def _agree(self, text: str, ids: np.ndarray, at: int, a: np.ndarray, b: np.ndarray, next_bytes: bytes) -> tuple[int, int, int, int] | None:
        """Tokens of ``a`` to keep, the part of the window's ids to take, and where ``b`` goes on; none: no agreement yet."""
        ends = np.cumsum(self.size[ids])
        ends_a, ends_b = np.cumsum(self.size[a]), at + np.cumsum(self.size[b])
        if UNSPLIT.fullmatch(text) and next_bytes:
            if len(ids) > 2 and ids[0] == a[0] and ids[-1] == b[-1]:
                return 1, 1, len(ids) - 1, len(b) - 1
            return None
        sure = np.array([len(text[:p].encode()) for p in (m.start() for m in SURE.finditer(text)) if 0 < p < len(text)], np.int64)
        sure = sure[np.isin(sure, ends)]
        low = sure[(sure < at) & np.isin(sure, ends_a)]
        high = sure[(sure > at) & np.isin(sure, ends_b)]
        if not len(low) or not len(high):
            return None
        cut_a, first = int(np.searchsorted(ends_a, low[0])) + 1, int(np.searchsorted(ends, low[0])) + 1
        last, cut_b = int(np.searchsorted(ends, high[-1])) + 1, int(np.searchsorted(ends_b, high[-1])) + 1
        same_a = cut_a < len(a) and first < len(ids) and a[cut_a] == ids[first] or low[-1] > low[0]
        same_b = b[cut_b - 1] == ids[last - 1] or high[0] < high[-1]
        return (cut_a, first, last, cut_b) if same_a and same_b else None


def _inside(data: bytes, at: int) -> bool:
    """Whether ``at`` lies within a code point."""
    return at < len(data) and data[at] & 0xC0 == 0x80


@lru_cache(maxsize=2)
def coder(tokenizer: str, ranks: str, pattern: str) -> Coder:
    return Coder(tokenizer, ranks, pattern)


def halves(text: str, piece: int) -> list[str]:
    """The text cut in two until no part has over ``piece`` code points; special strings stay whole."""
    if len(text) <= piece:
        return [text]
    middle = len(text) // 2
    found = text.find(SPECIAL, max(0, middle - len(SPECIAL) + 1), middle + len(SPECIAL) - 1)
    if 0 <= found < middle:
        middle = found or found + len(SPECIAL)
    if middle >= len(text):
        return [text]
    return halves(text[:middle], piece) + halves(text[middle:], piece)


def joined_tree(code: Coder, texts: list[str], ids: list[np.ndarray]) -> np.ndarray:
    """Neighbours joined in pairs until one is left."""
    while len(texts) > 1:
        ids = [code.join(texts[i], ids[i], texts[i + 1], ids[i + 1]) if i + 1 < len(texts) else ids[i] for i in range(0, len(texts), 2)]
        texts = ["".join(texts[i : i + 2]) for i in range(0, len(texts), 2)]
    return ids[0]


def digests(code: Coder, ids: np.ndarray) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(code.decode(ids).encode()).hexdigest()


def encode_documents(docs: DataFrame, tokenizer: str, ranks: str, pattern: str, piece: int = PIECE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for each row of ``docs``.

    A null text is empty: no token, digests of nothing. Repeated rows give
    repeated rows; an empty table an empty one. Only texts of more than two
    pieces are shuffled.
    """
    pairs = id_and_text(docs, id_col, text_col)
    kind = pairs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(tokenizer, ranks, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                n, ids, text = zip(*(digests(code, code.encode(t)) for t in part.column(1).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                parts = halves(text, piece)
                same = pa.array([i] * len(parts), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(same), batch.column(2).take(same), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.string())], ["doc_id", "uid", "k", "part"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(tokenizer, ranks, pattern)
        for batch in batches:
            ids = pa.array([code.encode(t).astype("<u4").tobytes() for t in batch.column(3).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, "ids"])

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        rows, code = rows.sort_values("k"), coder(tokenizer, ranks, pattern)
        ids = joined_tree(code, list(rows["part"]), [np.frombuffer(x, "<u4").astype(np.uint32) for x in rows["ids"]])
        own = rows["doc_id"].iloc[0]
        return pd.DataFrame([(None if pd.isna(own) else own, *digests(code, ids))], columns=names)

    long = F.char_length("text") > 2 * piece
    few = pairs.filter(~long).mapInArrow(short, out)
    columns = f"doc_id {kind}, uid long, k int, part string"
    parts = pairs.filter(long).withColumn("uid", F.monotonically_increasing_id()).mapInArrow(cut, columns)
    many = parts.repartition("uid", "k").mapInArrow(encode, f"{columns}, ids binary").groupBy("uid").applyInPandas(join, out)
    return few.unionByName(many)
