"""Registered queries: cleaning, normalisation and text scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara import constants as K
from opinara.functions import lexicon as LX
from opinara.functions import text as X
from opinara.operators import items as I
from opinara.operators import reviews as RV
from opinara.plans.analytics import ITEMS_T, NWS, PREPROCESSED, WS
from opinara.plans.registry import query, sql_any, sql_list, with_views
from opinara.sources import fixtures as V

WORD = r"\p{L}\p{N}_"


def clean_sql(c: str) -> str:
    return (
        rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({c}), '<[^\n]*?>', ' ', 'g'), "
        rf"'http{NWS}+|www{NWS}+', ' ', 'g'), '[^{WORD}\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]', ' ', 'g'), '{WS}+', ' ', 'g'), ' ')"
    )


CLEANED = f"""cleaned AS (
  SELECT * FROM (SELECT *, {clean_sql('content')} AS cleaned_content FROM reviews
                 WHERE content IS NOT NULL AND title IS NOT NULL)
  WHERE length(cleaned_content) >= 5
  QUALIFY row_number() OVER (PARTITION BY cleaned_content ORDER BY seq) = 1)"""


@query("clean_reviews", with_views(V.REVIEWS_SQL, CLEANED, body="""SELECT review_id, product_id, cleaned_content,
  CAST(length(cleaned_content) AS INT) AS review_length FROM cleaned"""))
def clean_reviews(spark: SparkSession, d: str) -> DataFrame:
    out = RV.clean_reviews(V.reviews(spark, d), ["seq"])
    return out.select("review_id", "product_id", "cleaned_content", "review_length")


@query("preprocess_reviews", with_views(V.REVIEWS_SQL, PREPROCESSED, body="""
  SELECT review_id, product_id, clean_text, rating, helpful_count FROM pre"""))
def preprocess_reviews(spark: SparkSession, d: str) -> DataFrame:
    out = RV.preprocess_reviews(V.reviews(spark, d))
    return out.select("review_id", "product_id", "clean_text", "rating", "helpful_count")


@query("merge_reviews", with_views(V.REVIEWS_SQL, CLEANED, V.PRODUCTS_SQL, V.CATEGORIES_SQL, body="""
  SELECT r.review_id, r.product_id, r.rating, r.cleaned_content, p.name, p.price, p.rating_average,
    p.brand AS brand_name, p.seller AS seller_name, c.category_lv1, c.category_lv2, c.category_lv3
  FROM cleaned r LEFT JOIN products p USING (product_id) LEFT JOIN categories c USING (product_id)"""))
def merge_reviews(spark: SparkSession, d: str) -> DataFrame:
    cleaned = RV.clean_reviews(V.reviews(spark, d), ["seq"])
    cleaned = cleaned.select("review_id", "product_id", "rating", "cleaned_content")
    return RV.merge_reviews(cleaned, V.products(spark, d), V.categories(spark, d))


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def squeeze_sql(c: str) -> str:
    return f"trim(regexp_replace({c}, '{WS}+', ' ', 'g'), ' ')"


@query("noise_filter", rf"""WITH lines AS (
    SELECT doc_id, n, {strip_sql("line")} AS t FROM (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n
      FROM documents))
  SELECT doc_id, n AS line_no, t AS line, length(t) < 4
    OR regexp_full_match(t, '[.\s!?*\-_👍❤\x{{FE0F}}✅⭐🌟💯]{{0,5}}') OR regexp_full_match(t, '\p{{Nd}}+')
    OR (length(t) >= 6 AND t = repeat(substr(t, 1, 1), CAST(length(t) AS BIGINT))) AS is_noise
  FROM lines""")
def noise_filter(spark: SparkSession, d: str) -> DataFrame:
    lines = V.table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select(
        "doc_id", F.col("line_no").cast("bigint").alias("line_no"), X.strip_ws("line").alias("line"),
        X.is_noise("line").alias("is_noise"),
    )


def fold_sql(c: str) -> str:
    folded = f"replace(strip_accents(lower({c})), 'đ', 'd')"
    return squeeze_sql(rf"regexp_replace({folded}, '[^a-z0-9#\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]+', ' ', 'g')")


@query("fold_accents", f"SELECT doc_id, {fold_sql('text')} AS folded FROM documents")
def fold_accents(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "documents").select("doc_id", X.fold_accents("text").alias("folded"))


SENTENCES = rf"""sentences AS (
  SELECT review_id, product_id, sentence, n - 1 AS sentence_no FROM (
    SELECT review_id, product_id, unnest(parts) AS sentence, generate_subscripts(parts, 1) AS n FROM (
      SELECT review_id, product_id, list_filter(list_transform(string_split_regex(clean_text, '[\n.!?;]+'),
        lambda s: {strip_sql("s")}), lambda s: length(s) > 0) AS parts FROM pre))
  WHERE length(sentence) >= 15)"""


@query("split_sentences", with_views(V.REVIEWS_SQL, PREPROCESSED, SENTENCES, body="""
  SELECT review_id, product_id, CAST(sentence_no AS INT) AS sentence_no, sentence FROM sentences"""))
def split_sentences(spark: SparkSession, d: str) -> DataFrame:
    pre = RV.preprocess_reviews(V.reviews(spark, d)).select("review_id", "product_id", "clean_text")
    return I.explode_sentences(pre, "clean_text")


def tokens_sql(c: str) -> str:
    spaced = rf"""regexp_replace(lower({c}), '([,.!?;:()\[\]{{}}"''])', ' \1 ', 'g')"""
    return f"list_filter(string_split_regex({spaced}, '{WS}+'), lambda w: length(w) > 0)"


@query("tokenize", f"SELECT doc_id, array_to_string({tokens_sql('text')}, '|') AS tokens FROM documents")
def tokenize(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "documents").select("doc_id", F.array_join(X.tokens("text"), "|").alias("tokens"))


def _entities(c: str) -> str:
    for name, char in X.ENTITIES.items():
        c = f"replace({c}, '&{name};', '{char.replace(chr(39), chr(39) * 2)}')"
    return c


@query("html_to_text", rf"""SELECT page_id, array_to_string(list_filter(list_transform(string_split({_entities(
    r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|template)\b.*?</(script|style|template)\s*>', chr(1), 'g'),"
    r" '(?s)<!--.*?-->', chr(1), 'g'), '(?s)<[/!?a-zA-Z][^>]*>', chr(1), 'g')")}, chr(1)),
    lambda s: {strip_sql("s")}), lambda s: length(s) > 0), ' ') AS text FROM pages""")
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "pages").select("page_id", X.html_to_text("html").alias("text"))


URLS = """urls AS (
  SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN url || '&spid=' || CAST(page_id AS VARCHAR)
    WHEN 2 THEN 'https://shop.example/ao-cho-be-p' || CAST(page_id AS VARCHAR) || '.html?ref=x'
    ELSE 'https://shop.example/none?id=' || CAST(page_id AS VARCHAR) || '#top' END AS url FROM pages)"""


def _urls(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("page_id").cast("string")
    kind = F.col("page_id") % 4
    url = (
        F.when(kind == 0, F.col("url"))
        .when(kind == 1, F.concat("url", F.lit("&spid="), n))
        .when(kind == 2, F.concat(F.lit("https://shop.example/ao-cho-be-p"), n, F.lit(".html?ref=x")))
        .otherwise(F.concat(F.lit("https://shop.example/none?id="), n, F.lit("#top")))
    )
    return V.table(spark, d, "pages").select("page_id", url.alias("url"))


@query("url_product_id", with_views(URLS, body=r"""SELECT page_id, url, coalesce(
    nullif(regexp_extract(path, '-p(\d+)\.html', 1), ''), nullif(regexp_extract(q, '(?:^|&)spid=([^&]+)', 1), ''),
    nullif(regexp_extract(q, '(?:^|&)product_id=([^&]+)', 1), ''), nullif(regexp_extract(q, '(?:^|&)id=([^&]+)', 1), ''),
    nullif(regexp_extract(path, '(\d+)', 1), '')) AS product_id
  FROM (SELECT *, regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)', 1) AS path,
          regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS q FROM urls)"""))
def url_product_id(spark: SparkSession, d: str) -> DataFrame:
    return _urls(spark, d).select("page_id", "url", X.product_id_from_url("url").alias("product_id"))


@query("url_slug_name", with_views(URLS, body=r"""SELECT page_id,
    array_to_string(list_transform(string_split(regexp_extract(url, 'shop\.example/(.+?)-p\d+', 1), '-'),
      lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS name FROM urls"""))
def url_slug_name(spark: SparkSession, d: str) -> DataFrame:
    return _urls(spark, d).select("page_id", X.product_name_from_url("url", host=r"shop\.example").alias("name"))


UNIT_TEXT = """unit_texts AS (
  SELECT doc_id, CAST(doc_id % 40 AS VARCHAR) || list_extract(['tháng', 't', ' tuổi', 'kg', 'g', 'ml', 'l', ' star', 'sao', 'túi'],
    CAST(doc_id % 10 + 1 AS INT)) || ' ' || lower(text) AS t FROM documents)"""


def _unit_texts(spark: SparkSession, d: str) -> DataFrame:
    units = F.array(*[F.lit(u) for u in ["tháng", "t", " tuổi", "kg", "g", "ml", "l", " star", "sao", "túi"]])
    n = (F.col("doc_id") % 40).cast("string")
    unit = F.element_at(units, (F.col("doc_id") % 10 + 1).cast("int"))
    return V.table(spark, d, "documents").select(
        "doc_id", F.concat(n, unit, F.lit(" "), F.lower("text")).alias("t")
    )


def _units(c: str) -> str:
    end = f"([^{WORD}]|$)"
    c = rf"regexp_replace({c}, '(\p{{Nd}}+){WS}*tháng', '\1 tháng', 'g')"
    c = rf"regexp_replace({c}, '(\p{{Nd}}+){WS}*(?:tuổi|t{end})', '\1 tuổi\2', 'g')"
    c = rf"regexp_replace({c}, '(\p{{Nd}}+){WS}*(kg|gram|g){end}', '\1 \2\3', 'g')"
    c = rf"regexp_replace({c}, '(\p{{Nd}}+){WS}*(ml|l){end}', '\1 \2\3', 'g')"
    return rf"regexp_replace({c}, '(\p{{Nd}}+){WS}*(?:sao|star|⭐)', '\1 sao', 'g')"


@query("normalize_units", with_views(UNIT_TEXT, body=f"SELECT doc_id, {_units('t')} AS normalized FROM unit_texts"))
def normalize_units(spark: SparkSession, d: str) -> DataFrame:
    return _unit_texts(spark, d).select("doc_id", X.normalize_units("t").alias("normalized"))


# a caller's lexicon: (key, value) in order; keys with a blank are phrases
LEXICON = [
    ("de", " của "), ("la", " là "), ("the", " cái "), ("and", " và "), ("of", " thuộc "), ("und", " và "),
    ("of the", " thuộc cái "), ("là que", " là rằng "), ("in the", " trong cái "), ("và của", " và thuộc "),
]


def _words_sql(c: str) -> str:
    table = {**dict(LEXICON), **K.ABBREVIATIONS}
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    return (
        f"array_to_string(list_transform(list_filter(string_split_regex({c}, '{WS}+'), lambda w: length(w) > 0), "
        f"lambda w: CASE w {arms} ELSE w END), ' ')"
    )


def _phrases_sql(c: str) -> str:
    for k, v in LEXICON:
        if " " in k:
            c = f"replace({c}, '{k}', '{v}')"
    return c


def _squash_sql(c: str) -> str:
    # without back-references: drop a word character equal to the two before it
    return (
        f"array_to_string(list_filter(string_split({c}, ''), lambda ch, i: NOT (i > 2 AND ch = string_split({c}, '')[i - 1] "
        rf"AND ch = string_split({c}, '')[i - 2] AND regexp_matches(ch, '[\p{{L}}\p{{M}}\p{{N}}_]'))), '')"
    )


@query("lexicon_words", f"SELECT doc_id, {_words_sql('lower(text)')} AS replaced FROM documents")
def lexicon_words(spark: SparkSession, d: str) -> DataFrame:
    docs = V.table(spark, d, "documents")
    return docs.select("doc_id", LX.replace_words(F.lower("text"), dict(LEXICON)).alias("replaced"))


@query("lexicon_words_joined", f"SELECT doc_id, {_words_sql('lower(text)')} AS text FROM documents")
def lexicon_words_joined(spark: SparkSession, d: str) -> DataFrame:
    docs = V.table(spark, d, "documents").select("doc_id", F.lower("text").alias("text"))
    table = spark.createDataFrame(list({**dict(LEXICON), **K.ABBREVIATIONS}.items()), "word string, value string")
    return LX.replace_words_joined(docs, "doc_id", "text", table).withColumn("text", F.coalesce("text", F.lit("")))


@query("lexicon_phrases", f"SELECT doc_id, {_phrases_sql('lower(text)')} AS replaced FROM documents")
def lexicon_phrases(spark: SparkSession, d: str) -> DataFrame:
    docs = V.table(spark, d, "documents")
    return docs.select("doc_id", LX.replace_phrases(F.lower("text"), LEXICON).alias("replaced"))


#: Emoji sequences and the labels of their parts: skin tones, joined emoji, selectors, flags, keycaps, an unnamed character.
EMOJI_ROWS = {
    "\U0001F600": ":grinning_face:", "\U0001F44D\U0001F3FD": ":thumbs_up_sign_medium_skin_tone:", "\u2764\uFE0F": ":heavy_black_heart:",
    "\U0001F468\u200D\U0001F4BB": ":man_personal_computer:", "\U0001F469\U0001F3FF\u200D\U0001F91D\u200D\U0001F469": ":woman_dark_skin_tone_handshake_woman:",
    "\U0001F1FB\U0001F1F3": ":flag_vn:", "\U0001F3F4\U000E0067\U000E0062\U000E0065\U000E006E\U000E0067\U000E007F": ":flag_gbeng:",
    "1\uFE0F\u20E3": ":keycap_1:", "#\u20E3": ":keycap_#:", "\u2B50": ":white_medium_star:", "5": "5", "\U0001F3FB": "\U0001F3FB",
}
_EMOJI, _LABELS = list(EMOJI_ROWS), list(EMOJI_ROWS.values())


@query("emoji_labels", f"""SELECT doc_id, concat(text, ' ', l[doc_id % 12 + 1], '-', l[doc_id * 5 % 12 + 1], l[doc_id % 10 + 1], 'x') AS labelled
  FROM documents, (SELECT [{sql_list(_LABELS)}] AS l)""")
def emoji_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = F.array(*[F.lit(e) for e in _EMOJI])
    at = lambda n: F.get(rows, n.cast("int"))
    i = F.col("doc_id")
    text = F.concat("text", F.lit(" "), at(i % 12), F.lit("-"), at(i * 5 % 12), at(i % 10), F.lit("x"))
    return V.table(spark, d, "documents").select("doc_id", LX.demojize(text).alias("labelled"))


@query("boilerplate_phrases", "SELECT doc_id, concat(' , ', text, '   xem thêmx') AS text FROM documents")
def boilerplate_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Phrases at the beginning, between blanks, and within a longer word, where they stay."""
    text = F.concat(F.lit("xem thêm, "), "text", F.lit(" thu gọn xem thêmx"))
    return V.table(spark, d, "documents").select("doc_id", X.drop_phrases(text, K.BOILERPLATE_PHRASES).alias("text"))


STRETCHED = r"""stretched AS (
  SELECT doc_id, regexp_replace(lower(text), '(e|5)', '\1\1\1\1', 'g') AS t FROM documents)"""
SQUASH = r"""SELECT doc_id, array_to_string(list_filter(cs, lambda ch, i: NOT (i > 2 AND ch = cs[i - 1] AND ch = cs[i - 2]
    AND regexp_matches(ch, '[\p{L}\p{M}\p{N}_]'))), '') AS squashed
  FROM (SELECT doc_id, string_split(t, '') AS cs FROM stretched)"""


@query("squash_repeats", with_views(STRETCHED, body=SQUASH))
def squash_repeats(spark: SparkSession, d: str) -> DataFrame:
    t = F.regexp_replace(F.lower("text"), "(e|5)", "$1$1$1$1")
    return V.table(spark, d, "documents").select("doc_id", X.squash_repeats(t).alias("squashed"))


NORMALIZED = rf"""n1 AS (SELECT review_id, regexp_replace(regexp_replace(regexp_replace(lower(content), '<[^\n]*?>', ' ', 'g'),
    'http{NWS}+|www{NWS}+', ' ', 'g'), '(^|[^{WORD}\p{{M}}])(?:xem thêm|thu gọn)([^{WORD}\p{{M}}]|$)', '\1 \2', 'g') AS t FROM reviews),
n2 AS (SELECT review_id, {_units('t')} AS t FROM n1),
n3 AS (SELECT review_id, {_words_sql('t')} AS t FROM n2),
n4 AS (SELECT review_id, string_split({_phrases_sql('t')}, '') AS cs FROM n3),
n5 AS (SELECT review_id, array_to_string(list_filter(cs, lambda ch, i: NOT (i > 2 AND ch = cs[i - 1] AND ch = cs[i - 2]
    AND regexp_matches(ch, '[\p{{L}}\p{{M}}\p{{N}}_]'))), '') AS t FROM n4),
n6 AS (SELECT review_id, trim(regexp_replace(regexp_replace(t, '[^\p{{L}}\p{{N}}\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]', ' ', 'g'), '{WS}+', ' ', 'g'), ' ')
    AS normalized_text FROM n5)"""


@query("normalize_reviews", with_views(V.REVIEWS_SQL, NORMALIZED, body="SELECT * FROM n6 WHERE length(normalized_text) > 0"))
def normalize_reviews(spark: SparkSession, d: str) -> DataFrame:
    out = LX.normalize_reviews(V.reviews(spark, d), LEXICON)
    return out.select("review_id", "normalized_text")


@query("text_or_fallback", rf"""SELECT * FROM (SELECT CAST(doc_id AS VARCHAR) AS review_id,
    {strip_sql("coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN text ELSE '' END, ''), nullif(CASE WHEN doc_id % 3 = 1 THEN source END, ''), nullif(CASE WHEN doc_id % 7 <> 2 THEN text ELSE '' END, ''))")} AS text
  FROM documents) WHERE length(text) > 0""")
def text_or_fallback(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    docs = V.table(spark, d, "documents").select(
        n.alias("review_id"),
        F.when(n % 3 == 0, F.col("text")).otherwise("").alias("normalized_text"),
        F.when(n % 3 == 1, F.col("source")).alias("cleaned_content"),
        F.when(n % 7 != 2, F.col("text")).otherwise("").alias("content"),
    )
    return RV.text_or_fallback(docs, ["normalized_text", "cleaned_content", "content"])


def compress_sql(c: str, limit: int) -> str:
    cut = f"trim(regexp_replace(substr({c}, 1, {limit}), '(?s) [^ ]*$', ''), ' ')"
    return f"CASE WHEN length({c}) <= {limit} THEN {c} ELSE {cut} END"


def evidence_sql(c: str, limit: int) -> str:
    cut = f"trim(regexp_replace(substr({c}, 1, {limit}), '(?s) [^ ]*$', ''), ' ')"
    out = f"CASE WHEN length({c}) <= {limit} THEN {c}"
    for m in (". ", "; ", ", "):
        at = f"CASE WHEN strpos(substr({c}, 81), '{m}') > 0 THEN strpos(substr({c}, 81), '{m}') + 79 ELSE -1 END"
        out += f" WHEN ({at}) > 0 AND ({at}) <= {limit} THEN trim(substr({c}, 1, {at}), ' ')"
    return out + f" ELSE {cut} END"


@query("compress_text", f"SELECT doc_id, {compress_sql('t', 180)} AS compressed FROM (SELECT doc_id, {squeeze_sql('text')} AS t FROM documents)")
def compress_text(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "documents").select("doc_id", X.compress("text").alias("compressed"))


@query("compress_evidence", f"""SELECT doc_id, {evidence_sql('t', 150)} AS compressed
  FROM (SELECT doc_id, {squeeze_sql('text')} AS t FROM documents)""")
def compress_evidence(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "documents").select("doc_id", X.compress_evidence("text", 150).alias("compressed"))


@query("evidence_keys", rf"""SELECT doc_id, trim(regexp_replace(lower({evidence_sql('t', 120)}), '[^{WORD}]+', ' ', 'g'), ' ') AS evidence_key,
    sha1(lower(t)) AS text_key FROM (SELECT doc_id, {squeeze_sql('text')} AS t FROM documents)""")
def evidence_keys(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "documents").select(
        "doc_id", X.evidence_key("text").alias("evidence_key"), X.text_key("text").alias("text_key")
    )


@query("public_text", rf"""SELECT doc_id, {squeeze_sql(rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace('<think>' || source || '</think> PRODUCT#SIZE ' || text || ' size_fit </think>', '(?is)<think>.*?</think>', '', 'g'), '\b(PRODUCT|PRICE|DELIVERY|SELLER)#[A-Z_]+\b', '', 'g'), '(?i)\b(delivery_accuracy|delivery_packaging|size_fit)\b', '', 'g'), '(?i)</?think>', '', 'g')")} AS shown FROM documents""")
def public_text(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(
        F.lit("<think>"), "source", F.lit("</think> PRODUCT#SIZE "), "text", F.lit(" size_fit </think>")
    )
    return V.table(spark, d, "documents").select("doc_id", X.public_text(raw).alias("shown"))


def _hit_count(c: str, words: list[str]) -> str:
    return " + ".join(f"CAST(contains({c}, '{w}') AS INT)" for w in words)


def _rule_aspects() -> str:
    out = []
    for code, words in K.REQUIRED_KEYWORDS.items():
        test = sql_any("low", words)
        if code in K.FORBIDDEN_KEYWORDS:
            test += f" AND NOT {sql_any('low', K.FORBIDDEN_KEYWORDS[code])}"
        out.append(f"CASE WHEN {test} THEN '{code}' END")
    return "list_filter([" + ", ".join(out) + "], lambda a: a IS NOT NULL)"


@query("rule_absa", with_views(V.REVIEWS_SQL, PREPROCESSED, SENTENCES, body=f"""
  SELECT review_id, CAST(sentence_no AS INT) AS sentence_no, unnest(aspects) AS aspect,
    CASE WHEN diff > 0 THEN 'positive' WHEN diff < 0 THEN 'negative' ELSE 'neutral' END AS sentiment,
    CASE WHEN diff > 0 THEN 0.7 WHEN diff < 0 THEN -0.7 ELSE 0.0 END::DOUBLE AS rule_score,
    round(least(0.8, 0.5 + abs(diff) / 10) + 1e-9, 4) AS confidence
  FROM (SELECT review_id, sentence_no, ({_hit_count('low', K.POSITIVE_WORDS)}) - ({_hit_count('low', K.NEGATIVE_WORDS)}) AS diff,
      {_rule_aspects()} AS aspects FROM (SELECT *, lower(sentence) AS low FROM sentences))"""))
def rule_absa(spark: SparkSession, d: str) -> DataFrame:
    pre = RV.preprocess_reviews(V.reviews(spark, d)).select("review_id", "product_id", "clean_text")
    out = I.rule_items(I.explode_sentences(pre, "clean_text"))
    return out.select("review_id", "sentence_no", "aspect", "sentiment", "rule_score", "confidence")


@query("keyword_predicate", with_views(ITEMS_T, body="SELECT item_id, aspect, sentence, coalesce(hit, false) AS hit FROM (SELECT *, "
       + "CASE aspect " + " ".join(
           f"WHEN '{a}' THEN {sql_any('lower(sentence)', w)}"
           + (f" AND NOT {sql_any('lower(sentence)', K.FORBIDDEN_KEYWORDS[a])}" if a in K.FORBIDDEN_KEYWORDS else "")
           for a, w in K.REQUIRED_KEYWORDS.items()) + " END AS hit FROM items)"))
def keyword_predicate(spark: SparkSession, d: str) -> DataFrame:
    items = V.aspect_items(spark, d, with_sentence=True)
    hit = X.keyword_match(F.col("aspect"), F.lower("sentence"), K.REQUIRED_KEYWORDS, K.FORBIDDEN_KEYWORDS)
    return items.select("item_id", "aspect", "sentence", hit.alias("hit"))


def _sample_scorer(texts: list[str]) -> list[list[tuple[str, str, float]]]:
    """Stand-in for a model: the sentence length decides aspect and sentiment."""
    return [
        [(K.CATEGORIES[len(t) % len(K.CATEGORIES)], K.SENTIMENTS[len(t) % 3], 0.5 + len(t) % 50 / 100)] for t in texts
    ]


@query("score_distinct", with_views(V.REVIEWS_SQL, PREPROCESSED, SENTENCES, body=f"""
  SELECT review_id, CAST(sentence_no AS INT) AS sentence_no, sentence,
    list_extract([{sql_list(K.CATEGORIES)}], CAST(length(sentence) % 17 + 1 AS INT)) AS aspect,
    list_extract([{sql_list(K.SENTIMENTS)}], CAST(length(sentence) % 3 + 1 AS INT)) AS sentiment,
    round(0.5 + length(sentence) % 50 / 100 + 1e-9, 4) AS confidence FROM sentences"""))
def score_distinct(spark: SparkSession, d: str) -> DataFrame:
    from opinara.functions.numbers import round_up

    pre = RV.preprocess_reviews(V.reviews(spark, d)).select("review_id", "clean_text")
    out = I.score_distinct(I.explode_sentences(pre, "clean_text"), _sample_scorer)
    return out.withColumn("confidence", round_up(F.col("confidence")))
