"""Multi-pattern search and emoji sequences against plain Python."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from opinara.functions import lexicon as LX
from opinara.functions import text as X
from opinara.functions.keywords import keyword_counts


def column(spark, texts, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["x"] for r in df.select("i", expr.alias("x")).orderBy("i").collect()]


def test_words_that_occur_against_plain_search(spark):
    rng = random.Random(2)
    words = list(dict.fromkeys("".join(rng.choice("ab c.") for _ in range(rng.randint(1, 5))) for _ in range(60))) + ["đẹp", "đẹp lắm", "a+b", "(x", "\U0001F600"]
    texts = ["".join(rng.choice("ab c.đẹplắm+(x") for _ in range(rng.randint(0, 40))) for _ in range(200)] + ["rất đẹp lắm \U0001F600", "", None]
    lists = [words[:20], words[20:], words, [], words[10:30]]
    assert column(spark, texts, keyword_counts(F.col("t"), lists)) == [[sum(w in (t or "") for w in ws) for ws in lists] for t in texts]
    assert column(spark, texts, X.contains_any(F.col("t"), words[:9])) == [None if t is None else any(w in t for w in words[:9]) for t in texts]


def test_longest_of_a_tree():
    words = ["giao", "giao hàng", "giá", "gi", "a.c"]
    assert re.findall(X.longest_of(words), "giao hàng, giao, giá a.c abc gi") == ["giao hàng", "giao", "giá", "a.c", "gi"]


def test_emoji_sequences_by_their_parts(spark):
    cases = {
        "\U0001F1FB\U0001F1F3\U0001F1EB\U0001F1F7": ":flag_vn::flag_fr:", "\U0001F1FB": "\U0001F1FB", "ok\U0001F44D\U0001F3FDok": "ok:thumbs_up_sign_medium_skin_tone:ok",
        "❤️‍\U0001F525": ":heavy_black_heart_fire:", "\U0001F600\U0001F600": ":grinning_face::grinning_face:", "5*": "5*", "*️⃣": ":keycap_*:", "": "", None: None,
    }
    assert column(spark, list(cases), LX.demojize(F.col("t"))) == list(cases.values())


def test_the_longest_sequence_of_a_table(spark):
    table = {"\U0001F44D": ":up:", "\U0001F44D\U0001F3FD": ":up_medium:", "\U0001F468‍\U0001F4BB": ":coder:", "\U0001F468": ":man:", "❤️": ":love:"}
    cases = {
        "\U0001F44D\U0001F3FD\U0001F44D\U0001F3FF": ":up_medium::up:\U0001F3FF", "\U0001F468‍\U0001F4BB\U0001F468‍": ":coder::man:‍",
        "❤": ":love:", "❤️!": ":love:!", "\U0001F600": "\U0001F600", "a": "a",
    }
    assert column(spark, list(cases), LX.demojize(F.col("t"), table)) == list(cases.values())
    assert column(spark, ["\U0001F600"], LX.demojize(F.col("t"), {})) == ["\U0001F600"]


def test_classes_of_characters(spark):
    """The spelled-out classes are the categories, for every character."""
    chars = spark.range(0x30000).filter("id NOT BETWEEN 55296 AND 57343").selectExpr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32') AS c")
    same = [F.col("c").rlike(f"^(?s:{a})$") == F.col("c").rlike(f"^(?s:{b})$") for a, b in ((X.WS, r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"), (f"[{X.WORD}]", r"[\p{L}\p{N}_]"), (X.NOT_WS, r"[^\s\x0B\x1C-\x1F\x{85}\p{Z}]"))]
    assert chars.filter(~(same[0] & same[1] & same[2])).count() == 0
