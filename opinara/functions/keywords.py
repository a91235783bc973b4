"""Many keywords at once: one automaton walks a text, however many lists are asked for."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=8)
def _automaton(lists: tuple[tuple[str, ...], ...]):
    """The automaton of all words, and the lists that each word is in."""
    import ahocorasick

    words = list(dict.fromkeys(w for words in lists for w in words))
    automaton = ahocorasick.Automaton()
    for i, w in enumerate(words):
        automaton.add_word(w, i)
    automaton.make_automaton()
    return automaton, np.array([[w in words_of for words_of in lists] for w in words], np.int32)


def keyword_counts(text: Column, lists: list[list[str]]) -> Column:
    """How many different words of each list occur in a text, as substrings, overlapping or not; none in a null text.

    Texts go through as Arrow batches, and only words found cost a step of Python.
    """
    wanted = tuple(tuple(words) for words in lists)

    @F.arrow_udf("array<int>")
    def count(texts: pa.Array) -> pa.Array:
        automaton, member = _automaton(wanted)
        out = np.zeros((len(texts), len(wanted)), np.int32)
        for row, t in enumerate(texts.to_pylist()):
            if t and (found := {i for _, i in automaton.iter(t)}):
                out[row] = member[list(found)].sum(axis=0)
        ends = np.arange(len(texts) + 1, dtype=np.int32) * len(wanted)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))

    return count(text)
