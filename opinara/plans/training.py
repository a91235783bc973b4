"""Registered queries: samples, splits, oversampling, vocabulary, classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara import constants as K
from opinara.functions import arrays as R
from opinara.operators import classify as CL
from opinara.operators import dataset as DS
from opinara.operators import metrics as M
from opinara.plans.analytics import ITEMS
from opinara.plans.labelling import QUADS, _vector_sql
from opinara.plans.registry import query, sql_list, with_views
from opinara.plans.texts import tokens_sql
from opinara.session import materialise, scratch_dir
from opinara.sources import fixtures as V
from opinara.sources import labels as SL
from opinara.sources import writers as W

ANNOTATED = [*QUADS, V.ANNOTATED_SQL]


def _draw(key: str = "review_id") -> Column:
    """An order both engines share: the review number scattered by a multiplier."""
    return F.pmod(F.col(key).cast("bigint") * 7919, F.lit(104729)) * 10_000_000_000_000 - 500_000_000_000_000_000


DRAW = "((CAST(review_id AS BIGINT) * 7919) % 104729)"


@query("quota_sample", with_views(*ANNOTATED, f"""strata AS (SELECT *, CASE WHEN conflict THEN 'conflict' WHEN len(quadruples) >= 3 THEN 'multi' ELSE 'normal' END AS stratum FROM annotated),
ranked AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {DRAW}, review_id) AS n FROM strata),
caps AS (SELECT least(20, count(*) FILTER (WHERE stratum = 'conflict')) AS c, least(40, count(*) FILTER (WHERE stratum = 'multi')) AS m FROM strata)""",
  body="""SELECT review_id, text, stratum FROM ranked, caps WHERE n <= CASE stratum WHEN 'conflict' THEN c WHEN 'multi' THEN m ELSE 200 - c - m END"""))
def quota_sample(spark: SparkSession, d: str) -> DataFrame:
    return DS.quota_sample(V.annotated(spark, d), 200, order=_draw()).select("review_id", "text", "stratum")


SPLIT = f"""labelled AS ({_vector_sql("TRUE")}),
keyed AS (SELECT *, coalesce(nullif(array_to_string(list_filter(list_transform(labels, lambda v, i: CASE WHEN v <> 0 THEN i - 1 END), lambda i: i IS NOT NULL)[1:2], '_'), ''), 'empty') AS k FROM labelled),
strata AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY k) >= 4 THEN k ELSE 'other' END AS stratum FROM keyed),
placed AS (SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY {DRAW}, review_id) - 0.5) / count(*) OVER (PARTITION BY stratum) AS share FROM strata),
split AS (SELECT review_id, labels, stratum, CASE WHEN share <= 0.70 THEN 'train' WHEN share <= 0.85 THEN 'val' ELSE 'test' END AS split FROM placed)"""


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return DS.training_samples(V.annotated(spark, d))


def _split(spark: SparkSession, d: str) -> DataFrame:
    return DS.stratified_split(_samples(spark, d), draw=_draw())


@query("stratified_split", with_views(*QUADS, SPLIT, body="SELECT review_id, stratum, split FROM split"))
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d).select("review_id", "stratum", "split")


@query("split_report", with_views(*QUADS, SPLIT, f"""cells AS (SELECT split, unnest(labels) AS v, generate_subscripts(labels, 1) AS i FROM split),
heads AS (SELECT split, count(*) AS samples, count(*) FILTER (WHERE len(list_filter(labels, lambda v: v <> 0)) > 1) AS multi FROM split GROUP BY 1)""", body=f"""
  SELECT split, 'samples' AS kind, 'all' AS name, samples::DOUBLE AS value FROM heads
  UNION ALL SELECT split, 'multi_aspect', 'count', multi::DOUBLE FROM heads
  UNION ALL SELECT split, 'multi_aspect', 'percent', round(multi::DOUBLE * 100 / samples + 1e-9, 1) FROM heads
  UNION ALL SELECT split, 'category', list_extract([{sql_list(K.CATEGORIES)}], CAST(i AS INT)), count(*)::DOUBLE FROM cells WHERE v <> 0 GROUP BY ALL
  UNION ALL SELECT split, 'sentiment', list_extract(['positive', 'neutral', 'negative'], v), count(*)::DOUBLE FROM cells WHERE v <> 0 GROUP BY ALL"""))
def split_report(spark: SparkSession, d: str) -> DataFrame:
    return DS.split_report(_split(spark, d))


_DRAW = "('0x' || substr(md5('42|' || {key} || '|' || ({at})), 1, 8))::UBIGINT / 4294967296.0"
_SPLIT_WORDS = r"list_filter(string_split_regex({t}, '[\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]+'), lambda w: length(w) > 0)"


def _swapped(words: str, key: str) -> str:
    """Pairs of neighbours swapped one after the other, the first word's place drawn anew each round."""
    draw = _DRAW.format(key=key, at="r")
    places = f"list_transform(range(1, greatest(1, len({words}) // 20) + 1), lambda r: [CAST(floor({draw} * (len({words}) - 1)) AS BIGINT)::VARCHAR])"
    at = "p[1]::BIGINT"
    return f"array_to_string(list_reduce({places}, lambda acc, p: acc[:{at}] || [acc[{at} + 2]] || [acc[{at} + 1]] || acc[{at} + 3:], {words}), ' ')"


def _kept(words: str, key: str, rate: str) -> str:
    return f"list_filter({words}, lambda x, i: {_DRAW.format(key=key, at='i - 1')} > {rate})"


COPIES = f"""copies AS (SELECT *, review_id || '#' || c AS key, {_SPLIT_WORDS.format(t='text')} AS w FROM (
  SELECT s.review_id, text, unnest(list_concat([0], CASE WHEN list_contains(labels, 2) THEN [1, 2, 3, 4, 5] ELSE []::INT[] END,
    CASE WHEN list_contains(labels, 3) THEN [6] ELSE []::INT[] END)) AS c FROM split s JOIN annotated a ON s.review_id = a.review_id WHERE split = 'train')),
moved AS (SELECT review_id, c, key, CASE WHEN c IN (3, 4) AND len(w) >= 4 THEN {_swapped('w', 'key')} ELSE text END AS t,
  CASE c WHEN 1 THEN 0.10 WHEN 2 THEN 0.08 WHEN 4 THEN 0.06 WHEN 5 THEN 0.12 WHEN 6 THEN 0.08 ELSE -1 END AS rate FROM copies),
cut AS (SELECT *, {_SPLIT_WORDS.format(t='t')} AS w FROM moved),
dropped AS (SELECT *, {_kept('w', 'key', 'rate')} AS kept FROM cut)"""


@query("oversample", with_views(*ANNOTATED, SPLIT, COPIES, body="""SELECT review_id, c::INT AS copy, c > 0 AS is_augmented,
    CASE WHEN rate < 0 OR len(w) <= 4 OR len(kept) < 3 THEN t ELSE array_to_string(kept, ' ') END AS text FROM dropped"""))
def oversample(spark: SparkSession, d: str) -> DataFrame:
    train = _split(spark, d).filter(F.col("split") == "train")
    return DS.oversample(train, number=DS.digest_number).select("review_id", "copy", "is_augmented", "text")


CHANGED = f"""split_words AS (SELECT doc_id, text, {_SPLIT_WORDS.format(t='text')} AS w FROM documents),
drawn AS (SELECT *, {_kept('w', 'doc_id', '0.1')} AS kept FROM split_words)"""


@query("word_dropout", with_views(CHANGED, body=f"""SELECT doc_id, CASE WHEN len(w) <= 4 OR len(kept) < 3 THEN text ELSE array_to_string(kept, ' ') END AS dropped,
    CASE WHEN len(w) < 4 THEN text ELSE {_swapped('w', 'doc_id')} END AS swapped FROM drawn"""))
def word_dropout(spark: SparkSession, d: str) -> DataFrame:
    docs = V.table(spark, d, "documents")
    key, number = F.col("doc_id").cast("string"), DS.digest_number
    return docs.select(
        "doc_id", DS.word_dropout(F.col("text"), 0.1, 42, key, number).alias("dropped"), DS.word_swap(F.col("text"), 42, key, number).alias("swapped")
    )


@query("vocabulary", with_views(f"""words AS (SELECT word, count(*) AS freq FROM (SELECT unnest({tokens_sql('text')}) AS word FROM documents) GROUP BY 1),
head AS (SELECT * FROM words)""", body="""
  SELECT word, CAST(row_number() OVER (ORDER BY freq DESC, word) + 1 AS INT) AS id, freq FROM head WHERE freq >= 2
  UNION ALL SELECT '<PAD>', 0, 0 UNION ALL SELECT '<UNK>', 1, 0"""))
def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return DS.vocabulary(V.table(spark, d, "documents"))


GRAMS = r"""docs AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[\s\x0B\x1C-\x1F\x{85}\p{Z}]+'), lambda w: length(w) > 0) AS w FROM documents),
grams AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
  list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS term FROM docs),
tf AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY ALL),
vocab AS (SELECT term, df, CAST(row_number() OVER (ORDER BY term) - 1 AS INT) AS idx FROM (
  SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY 1 HAVING df >= 2)),
w AS (SELECT doc_id, term, idx, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + df)) + 1) AS w FROM tf JOIN vocab USING (term))"""


@query("tfidf", with_views(GRAMS, body="""SELECT doc_id, term, idx, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) + 1e-9, 6) AS weight FROM w"""))
def tfidf(spark: SparkSession, d: str) -> DataFrame:
    return CL.weights_table(V.table(spark, d, "documents"), "doc_id", "text")


def _labelled_docs(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents as samples: quality is presence of the first category,
    toxic decides its polarity and the safety category."""
    docs = V.table(spark, d, "documents").join(V.table(spark, d, "labels"), "doc_id")
    quality = F.when(F.col("quality") == 1, F.when(F.col("toxic") == 1, 3).otherwise(1)).otherwise(0)
    safety = F.when(F.col("toxic") == 1, 3).otherwise(0)
    slots = [quality if c == "PRODUCT#QUALITY" else safety if c == "PRODUCT#SAFETY" else F.lit(0) for c in K.CATEGORIES]
    return docs.select(F.col("doc_id").cast("string").alias("review_id"), "text", F.array(*slots).alias("labels"))


@query("svm_train_predict")
def svm_train_predict(spark: SparkSession, d: str) -> DataFrame:
    return CL.train_and_report(DS.stratified_split(_labelled_docs(spark, d)), max_iter=30)


TAGGED = """tagged AS (SELECT review_id, toks, list_transform(toks, lambda t, i:
    CASE WHEN list_position(toks, t) = i AND len(list_filter(quadruples, lambda q: q.aspect_term = t)) > 0
      THEN 'B-' || list_filter(quadruples, lambda q: q.aspect_term = t)[1].sentiment ELSE 'O' END) AS tags
  FROM (SELECT review_id, quadruples, string_split(text, ' ') AS toks FROM annotated))"""


@query("bio_blocks", with_views(*ANNOTATED, f"labelled AS ({_vector_sql('TRUE')})", TAGGED, body="""SELECT review_id,
    '# labels: ' || array_to_string(labels, ' ') || chr(10) || array_to_string(list_transform(toks, lambda t, i: t || chr(9) || tags[i]), chr(10)) || chr(10) AS block
  FROM tagged JOIN labelled USING (review_id)"""))
def bio_blocks(spark: SparkSession, d: str) -> DataFrame:
    return DS.bio_blocks(_samples(spark, d))


@query("parse_bio", with_views(*ANNOTATED, f"labelled AS ({_vector_sql('TRUE')})", body="""SELECT review_id, labels, text AS tokens
  FROM annotated JOIN labelled USING (review_id)"""))
def parse_bio(spark: SparkSession, d: str) -> DataFrame:
    from opinara.sources.labels import parse_bio as parse

    out = parse(materialise(DS.bio_blocks(_samples(spark, d)), "bio"), "block")
    return out.select("review_id", "labels", F.array_join("tokens", " ").alias("tokens"))


@query("read_bio", with_views(*ANNOTATED, f"labelled AS ({_vector_sql('TRUE')})", TAGGED, body="""SELECT labels, array_to_string(toks, ' ') AS tokens,
  array_to_string(tags, ' ') AS tags FROM tagged JOIN labelled USING (review_id)"""))
def read_bio(spark: SparkSession, d: str) -> DataFrame:
    """Training blocks written as text files and read back."""
    path = scratch_dir(spark, "bio-files")
    W.write_blocks(DS.bio_blocks(_samples(spark, d)), path)
    return SL.read_bio(spark, path).select("labels", *[F.array_join(c, " ").alias(c) for c in ("tokens", "tags")])


VOCAB_IDS = f"""vocab_words AS (SELECT word, CAST(row_number() OVER (ORDER BY freq DESC, word) + 1 AS INT) AS id FROM (
    SELECT word, count(*) AS freq FROM (SELECT unnest(string_split(text, ' ')) AS word FROM annotated) GROUP BY 1) WHERE freq >= 2)"""


@query("encode_bio", with_views(*ANNOTATED, VOCAB_IDS, body="""SELECT review_id, list(coalesce(id, 1) ORDER BY n) AS token_ids, count(*)::INT AS length FROM (
    SELECT review_id, unnest(toks) AS word, generate_subscripts(toks, 1) AS n FROM (SELECT review_id, string_split(text, ' ') AS toks FROM annotated))
  LEFT JOIN vocab_words USING (word) GROUP BY 1"""))
def encode_bio(spark: SparkSession, d: str) -> DataFrame:
    from opinara.sources.labels import encode_bio as encode
    from opinara.sources.labels import parse_bio as parse

    samples = _samples(spark, d)
    blocks = parse(materialise(DS.bio_blocks(samples), "bio"), "block")
    return encode(blocks, "review_id", DS.vocabulary(samples)).select("review_id", "token_ids", "length")


@query("label_columns", with_views(*ANNOTATED, f"labelled AS ({_vector_sql('TRUE')})", body="SELECT text, "
       + ", ".join(f"labels[{i + 1}] AS label_{i}" for i in range(17)) + " FROM annotated JOIN labelled USING (review_id)"))
def label_columns(spark: SparkSession, d: str) -> DataFrame:
    return DS.label_columns(_samples(spark, d))


@query("label_csv_truth", with_views(*ANNOTATED, f"labelled AS ({_vector_sql('TRUE')})", body="SELECT text, labels AS y_true FROM annotated JOIN labelled USING (review_id)"))
def label_csv_truth(spark: SparkSession, d: str) -> DataFrame:
    from opinara.session import scratch_dir
    from opinara.sources.readers import read_label_csv
    from opinara.sources.writers import write_quoted_csv

    path = scratch_dir(spark, "label-csv")
    write_quoted_csv(DS.label_columns(_samples(spark, d)), path)
    return read_label_csv(spark, path)


@query("l2_normalize", """SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))) + 1e-9, 6)) AS unit FROM embeddings""")
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    from opinara.functions.numbers import round_up

    vectors = V.table(spark, d, "embeddings").select("vec_id", R.l2_normalize(F.col("embedding")).alias("u"))
    return vectors.select("vec_id", F.transform("u", lambda x: round_up(x, 6)).alias("unit"))
