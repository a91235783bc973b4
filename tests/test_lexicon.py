"""Words replaced from a lexicon table."""

from __future__ import annotations

from opinara.functions import lexicon as LX


def test_joined_words_move_the_texts_whole(spark):
    """Only the words found come back to the texts; rows that share a key are merged by place, a null key has no text."""
    rows = [(1, "ko  a ko b"), (1, "a ko"), (None, "b dc"), (2, ""), (3, None), (4, " ".join(["x", "ko"] * 300))]
    table = spark.createDataFrame([("ko", "không"), ("dc", "được"), ("b", None)], "word string, value string")
    out = LX.replace_words_joined(spark.createDataFrame(rows, "id long, text string"), "id", "text", table)
    want = [(1, "a không a không không b")] * 2 + [(None, None), (2, None), (3, None), (4, " ".join(["x", "không"] * 300))]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    assert "posexplode" not in out._jdf.queryExecution().optimizedPlan().toString()
