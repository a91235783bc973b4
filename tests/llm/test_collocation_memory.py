"""Memory of a task that counts words."""

from __future__ import annotations

import tracemalloc

from opinara.llm import collocations as CO


def test_numbering_words_takes_few_bytes_per_byte_of_text():
    text = b" ".join(b"word%d" % (i % 5000) for i in range(600_000))
    CO.numbered(text[:100])
    tracemalloc.start()
    ids, words = CO.numbered(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (len(ids), len(words)) == (600_000, 5000)
    assert peak / len(text) < 4.5
