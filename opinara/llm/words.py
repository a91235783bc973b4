"""Word-level BPE (``word_bpe_49k.json``): ids and token counts of texts, pre-token by pre-token.

The library spends nearly all its time on words that it has merged before. Here
a text in the plain alphabet (ASCII and Latin-1, no special strings) is split by
the tokenizer's own pre-token rule, and each distinct pre-token is merged once
by the library. A text with any other character goes to the library as a whole,
so the ids are the library's in either case.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable
from functools import lru_cache

#: Fixed values of the tokenizer file: its pre-token rule, for lower-case letters of the plain alphabet.
LETTERS, DIGITS = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾"
PRE_TOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^\t-\r {LETTERS}{DIGITS}]+")
#: Texts of these characters are unchanged by NFC, lower-case one to one, and hold no other white space.
PLAIN = re.compile(r"[\t-\r -~¡-ÿ]*")
SPECIAL = "<|"
#: Most pre-tokens a worker remembers, and the longest one; more only cost time.
REMEMBERED, LONGEST = 600_000, 64


@lru_cache(maxsize=4)
def library(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def merger(path: str) -> Callable[[str], list]:
    """The library's merge of one pre-token, without the cost of a whole encoding."""
    merge, letters = library(path).model.tokenize, byte_letters()
    table = {b: c for b, c in letters.items() if chr(b) != c}

    def apply(word: str) -> list:
        return merge(word if word.isascii() else word.encode().decode("latin-1").translate(table))

    return apply


def is_plain(text: str) -> bool:
    return SPECIAL not in text and PLAIN.fullmatch(text) is not None


class WordIds:
    """Ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        self.tokenizer, self.known = library(path), {}
        self.merge = merger(path)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def batch(self, texts: list[str]) -> list[bytes]:
        split = [PRE_TOKEN.findall(t.lower()) if is_plain(t) else None for t in texts]
        self.learn(split)
        known = self.known
        return [self.whole(t) if s is None else b"".join([known[w] if w in known else self.whole(w) for w in s]) for t, s in zip(texts, split, strict=True)]

    def learn(self, split: list[list[str] | None]) -> None:
        new = set().union(*(s for s in split if s is not None)).difference(self.known)
        new = [w for w in new if len(w) <= LONGEST]
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = [w for w in set().union(*(s for s in split if s is not None)) if len(w) <= LONGEST]
        for w in new:
            self.known[w] = array("I", [t.id for t in self.merge(w)]).tobytes()


class WordCounts:
    """Numbers of tokens by the whole-token shortcut.

    ``single`` holds the vocabulary strings proven, by encoding each alone, to
    be one token; a pre-token among them counts 1 without merging.
    """

    def __init__(self, path: str):
        self.tokenizer = library(path)
        self.merge = merger(path)
        self.single = single_tokens(path)
        self.merged: dict[str, int] = {}

    def batch(self, texts: list[str]) -> list[int]:
        split = [PRE_TOKEN.findall(t.lower()) if is_plain(t) else None for t in texts]
        rest = [None if s is None else [w for w in s if w not in self.single] for s in split]
        new = [w for w in set().union(*(r for r in rest if r)) if w not in self.merged]
        if len(self.merged) + len(new) > REMEMBERED:
            self.merged.clear()
            new = list(set().union(*(r for r in rest if r)))
        for w in new:
            self.merged[w] = len(self.merge(w))
        merged = self.merged
        out = [
            len(self.tokenizer.encode(t, add_special_tokens=False)) if s is None else len(s) - len(r) + sum([merged[w] for w in r])
            for t, s, r in zip(texts, split, rest, strict=True)
        ]
        for w in [w for w in new if len(w) > LONGEST]:
            del merged[w]
        return out


@lru_cache(maxsize=4)
def single_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings of the plain alphabet that are one pre-token and that the library encodes alone as one token."""
    tokenizer = library(path)
    bytes_of = {c: b for b, c in byte_letters().items()}
    texts = set()
    for piece in tokenizer.get_vocab(with_added_tokens=False):
        raw = piece.removesuffix("</w>")
        if raw != piece and all(c in bytes_of for c in raw):
            try:
                texts.add(bytes(bytes_of[c] for c in raw).decode())
            except UnicodeDecodeError:
                continue
    ordered = sorted(t for t in texts if is_plain(t) and PRE_TOKEN.findall(t) == [t])
    return frozenset(t for t, e in zip(ordered, tokenizer.encode_batch(ordered, add_special_tokens=False), strict=True) if len(e) == 1)


def byte_letters() -> dict[int, str]:
    """The printable letter by which byte-level vocabularies write each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


@lru_cache(maxsize=2)
def word_counts(path: str) -> WordCounts:
    return WordCounts(path)
