"""Small literal inputs whose results are worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from opinara import constants as K
from opinara.functions import arrays as R
from opinara.functions import casts as C
from opinara.functions import jsons as J
from opinara.functions import lexicon as LX
from opinara.functions import text as X
from opinara.operators import metrics as M
from opinara.operators.quantiles import overall_quantiles
from opinara.operators.ranking import number_rows


def value(spark, expr_of, text):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(expr_of(F.col("t")).alias("v")).first()["v"]


@pytest.mark.parametrize("text,want", [
    ("<b>Tốt</b> lắm!! http://a.b/c  OK", "tốt lắm ok"),
    (None, ""),
    ("a b\tc", "a b c"),
])
def test_clean_text(spark, text, want):
    assert value(spark, X.clean_text, text) == want


@pytest.mark.parametrize("text,want", [
    ("3tháng", "3 tháng"), ("3 tháng", "3 tháng"), ("2t", "2 tuổi"), ("5kg", "5 kg"), ("5 ⭐", "5 sao"), ("10ml", "10 ml"), ("5 túi", "5 túi"),
])
def test_units(spark, text, want):
    assert value(spark, X.normalize_units, text) == want


def test_legacy_units_damage_months(spark):
    assert value(spark, lambda c: X.normalize_units(c, legacy=True), "3 tháng") == "3 tuổiháng"


def test_squash(spark):
    assert value(spark, X.squash_repeats, "quáaaaa !!!!") == "quáaa !!!!".replace("aaa", "aa")


@pytest.mark.parametrize("text,want", [("Độ ẩm ĐẸP?", "do am dep"), ("été #1", "ete #1")])
def test_fold(spark, text, want):
    assert value(spark, X.fold_accents, text) == want


@pytest.mark.parametrize("text,want", [("abc", True), ("!!!!", True), ("aaaaaa", True), ("12345", True), ("tốt lắm", False), ("  ok  ", True)])
def test_noise(spark, text, want):
    assert value(spark, X.is_noise, text) is want


@pytest.mark.parametrize("url,want", [
    ("https://x.vn/ao-p123.html?spid=9", "123"), ("https://x.vn/a?spid=9", "9"), ("https://x.vn/abc/77", "77"), ("https://x.vn/a?b=1", None),
])
def test_url_id(spark, url, want):
    assert value(spark, X.product_id_from_url, url) == want


def test_url_name(spark):
    assert value(spark, X.product_name_from_url, K.SHOP_URL + "ta-quan-em-p12.html") == "Ta Quan Em"


def test_compress_evidence_prefers_clause_end(spark):
    text = "a" * 85 + ". " + "b" * 100
    assert value(spark, lambda c: X.compress_evidence(c, 150), text) == "a" * 85


def test_summaries_drop_codes(spark):
    assert value(spark, X.summarize_opinion, "x PRODUCT#SIZE y size_fit z") == "x y z"


@pytest.mark.parametrize("page, want", [
    ("it&#39;s &eacute; &#x1F600; &amp;lt; &unknown; &#xD800; a & b", "it's é 😀 &lt; &unknown; &#xD800; a & b"),
    ("a<script>x</style>y</script>b", "a b"), ('<a title="1 > 0">c</a><b x=">d</b>', "c d"),
])
def test_html_references_and_tags(spark, page, want):
    assert value(spark, X.html_to_text, page) == want


def test_overall_quantiles(spark):
    import numpy as np

    values = [float(x % 997) for x in range(3000)] + [1e12, -5.5]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = overall_quantiles(df, "v", {"a": 0.0, "b": 0.333, "c": 0.99, "d": 1.0})
    assert [got[k] for k in "abcd"] == pytest.approx(list(np.quantile(values, [0, 0.333, 0.99, 1])))
    assert overall_quantiles(df.limit(0), "v", {"a": 0.5}) == {"a": None}


def test_number_rows(spark):
    df = spark.createDataFrame([(i * 37 % 500, "x") for i in range(500)], "v int, t string")
    assert sorted((r.v, r.n) for r in number_rows(df, [F.desc("v")], "n").collect()) == [(i, 500 - i) for i in range(500)]


def test_reviews_found_empty_count(spark):
    quad = "review_id string, aspect_term string, aspect_category string, opinion_term string, sentiment string"
    human = spark.createDataFrame([("1", "a", "PRODUCT#QUALITY", "o", "positive")], quad)
    model = spark.createDataFrame([("1", "a", "PRODUCT#QUALITY", "o", "positive"), ("2", "a", "PRODUCT#QUALITY", "o", "negative")], quad)
    ids = spark.createDataFrame([("1",), ("2",)], "review_id string")
    row = M.quad_f1(M.quad_matches(M.both_sides(human, model, reviewed=(ids, ids)))).first()
    assert (row.n_reviews, row.precision, row.recall, row.exact_match) == (2, 0.5, 1.0, 0.5)
    assert {r.n for r in M.category_counts(M.both_sides(human, model, reviewed=(ids, ids))).collect()} == {2}


def test_html(spark):
    page = "<div> A <script>var x;</script><!-- no --><p>B &amp; C</p></div>"
    assert value(spark, X.html_to_text, page) == "A B & C"


def test_full_text_of_empty_parts(spark):
    df = spark.createDataFrame([(None, "")], "a string, b string")
    assert df.select(X.full_text("a", "b").alias("v")).first()["v"] == ""


def test_safe_casts(spark):
    assert value(spark, C.safe_long, " 3.9 ") == 3
    assert value(spark, C.safe_double, "nan") == 0.0
    assert value(spark, C.fix_scientific, "1.2E+08") == "120000000"
    assert value(spark, C.price_from_text, "1.290.000 đ") == 1290000.0


def test_keywords_are_decoded():
    assert "chất lượng" in K.REQUIRED_KEYWORDS["PRODUCT#QUALITY"]
    assert len(K.CATEGORIES) == len(set(K.CATEGORIES)) == 17


def test_repair_and_think(spark):
    assert value(spark, J.repair_json, '```json\n{"a": {"b": 1}\n```') == '{"a": {"b": 1}}'
    assert value(spark, J.strip_thinking, "<think>a</think>b<think>c") == "b"
    assert value(spark, J.first_json_object, 'x ```json\n{"a":1}\n``` y') == '{"a":1}'


def test_bio_multi_token_and_overlap(spark):
    quads = [("ao dep", "C", "o", "positive"), ("dep qua", "C", "o", "negative"), ("qua", "C", "o", None), ("none", "C", "o", "bad")]
    df = spark.createDataFrame([(["ao", "dep", "qua", "!"], quads)], f"tokens array<string>, q {J.QUADS}")
    tags = df.select(R.bio_tags(F.col("tokens"), F.col("q")).alias("v")).first()["v"]
    assert tags == ["B-positive", "I-positive", "B-positive", "O"]


def test_label_vector_takes_the_worst(spark):
    quads = [("t", K.CATEGORIES[0], "o", "positive"), ("t", K.CATEGORIES[0], "o", "NEGATIVE "), ("t", "NOPE", "o", "positive"),
             ("t", K.CATEGORIES[1], "o", None), ("t", K.CATEGORIES[2], "o", "mixed")]
    df = spark.createDataFrame([(quads,)], f"q {J.QUADS}")
    got = df.select(R.label_vector(F.col("q")).alias("v")).first()["v"]
    assert got[:3] == [3, 1, 0] and sum(got[3:]) == 0


def test_normalize_text(spark):
    lexicon = [("ok", " được "), ("giao hang", " giao hàng "), ("ok", " tốt ")]
    got = value(spark, lambda c: LX.normalize_text(c, lexicon), "SP ok, Xem thêm giao hang nhanhhhh 😀 3tháng")
    assert got == "sản phẩm ok giao hàng nhanhh grinning face 3 tháng"


def test_chunk_ids_are_stable(spark):
    df = spark.createDataFrame([("1", None, "A", "s", "t")], "p string, r string, a string, s string, t string")
    import hashlib

    want = int(hashlib.sha1(b"1||A|s|t").hexdigest()[:16], 16)
    assert int(df.select(X.point_id(*[F.col(c) for c in "prast"]).alias("v")).first()["v"]) == want
