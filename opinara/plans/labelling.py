"""Registered queries: model output, votes, label vectors, agreement, quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara import constants as K
from opinara.functions import arrays as R
from opinara.functions import jsons as J
from opinara.functions import text as X
from opinara.operators import metrics as M
from opinara.operators import reviews as RV
from opinara.operators import votes as VT
from opinara.plans.analytics import ITEMS
from opinara.session import materialise, scratch_dir
from opinara.plans.registry import query, sql_case, sql_list, with_views
from opinara.plans.texts import evidence_sql, squeeze_sql
from opinara.sources import fixtures as V
from opinara.sources import labels as SL
from opinara.sources import writers as W

QUADS = [ITEMS, V.QUADS_SQL]
POS = ["pos", "product_id", "aspect_term"]


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    q = V.quads(spark, d)
    return q.filter(F.col("annotator") == "human"), q.filter(F.col("annotator") == "model")


def _reviewed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Both sides went through every review; some were found to hold nothing."""
    ids = V.quads(spark, d).select("review_id")
    return ids, ids


def _both(spark: SparkSession, d: str) -> DataFrame:
    return M.both_sides(*_sides(spark, d), POS, _reviewed(spark, d))


# ------------------------------------------------------------ model output
def _responses(spark: SparkSession, d: str) -> DataFrame:
    """Model answers as JSON text: fenced, cut or with a bad category at times."""
    q = V.quads(spark, d)
    order = F.col("review_id").cast("bigint")
    bad = F.when(order % 11 == 0, "PRODUCT#UNKNOWN").otherwise(F.col("aspect_category"))
    quad = F.struct("pos", "product_id", "aspect_term", bad.alias("aspect_category"), "opinion_term", F.upper("sentiment").alias("sentiment"))
    nested = q.groupBy("review_id").agg(F.array_sort(F.collect_list(quad)).alias("q"))
    body = F.to_json(F.struct(F.create_map("review_id", "q").alias("results")))
    cut = F.when(order % 7 == 0, F.regexp_replace(body, r"\}$", "")).otherwise(body)
    raw = F.when(order % 5 == 0, F.concat(F.lit("```json\n"), cut, F.lit("\n```"))).otherwise(cut)
    broken = F.when(order % 13 == 0, F.concat(F.lit("sorry, "), raw)).otherwise(raw)
    asked = F.array(F.col("review_id"), F.concat("review_id", F.lit("x")))
    return nested.select(broken.alias("raw"), asked.alias("ids"))


@query("parse_model_output", with_views(*QUADS, body="""
  SELECT review_id, CAST(row_number() OVER (PARTITION BY review_id ORDER BY pos, product_id, aspect_term, aspect_category, opinion_term, sentiment) - 1 AS INT) AS pos,
    aspect_term, aspect_category, opinion_term, sentiment FROM quads
  WHERE CAST(review_id AS BIGINT) % 11 <> 0 AND CAST(review_id AS BIGINT) % 13 <> 0"""))
def parse_model_output(spark: SparkSession, d: str) -> DataFrame:
    return VT.parse_responses(_responses(spark, d), "raw", "ids")


def _provider_quads(spark: SparkSession, d: str) -> DataFrame:
    q = V.quads(spark, d)
    return q.withColumns({"provider": (F.col("line") % 3).cast("int"), "pos": F.struct("pos", "product_id", "opinion_term")})


PROVIDERS = "pq AS (SELECT *, CAST(line % 3 AS INT) AS provider FROM quads)"


@query("first_provider", with_views(*QUADS, PROVIDERS, body="""SELECT review_id, provider, product_id, aspect_term, aspect_category, sentiment
  FROM pq p WHERE provider = (SELECT min(provider) FROM pq x WHERE x.review_id = p.review_id)"""))
def first_provider(spark: SparkSession, d: str) -> DataFrame:
    out = VT.first_provider(_provider_quads(spark, d))
    return out.select("review_id", "provider", "product_id", "aspect_term", "aspect_category", "sentiment")


ANSWERED = """answered AS (SELECT review_id, provider FROM pq UNION SELECT review_id, 0 FROM pq WHERE CAST(review_id AS BIGINT) % 4 = 0),
found AS (SELECT * FROM pq WHERE NOT (provider = 0 AND CAST(review_id AS BIGINT) % 4 = 0))"""


@query("first_provider_answered", with_views(*QUADS, PROVIDERS, ANSWERED, body="""SELECT review_id, provider, product_id, aspect_term, aspect_category, sentiment
  FROM found p WHERE provider = (SELECT min(provider) FROM answered x WHERE x.review_id = p.review_id)"""))
def first_provider_answered(spark: SparkSession, d: str) -> DataFrame:
    """The first provider read a quarter of the reviews and found nothing in them: those keep nothing."""
    quads, empty = _provider_quads(spark, d), F.col("review_id").cast("bigint") % 4 == 0
    nothing = quads.filter(empty).select("review_id", F.lit(0).cast(quads.schema["provider"].dataType).alias("provider"))
    answered = quads.select("review_id", "provider").unionByName(nothing)
    out = VT.first_provider(quads.filter(~((F.col("provider") == 0) & empty)), answered=answered)
    return out.select("review_id", "provider", "product_id", "aspect_term", "aspect_category", "sentiment")


VOTE = """votes AS (
  SELECT review_id, aspect_term, aspect_category, sentiment, count(*) AS votes,
    arg_max(opinion_term, (provider, pos, product_id, opinion_term)) AS opinion_term FROM pq GROUP BY ALL),
flags AS (SELECT review_id, max(votes >= 2) AS agreed, max(votes < 2) AS minority FROM votes GROUP BY 1),
voted AS (SELECT v.review_id, aspect_term, aspect_category, sentiment, opinion_term, votes, NOT agreed OR minority AS conflict
  FROM votes v JOIN flags f ON v.review_id = f.review_id WHERE votes >= 2 OR NOT agreed)"""


@query("ensemble_vote", with_views(*QUADS, PROVIDERS, VOTE, body="SELECT * FROM voted"))
def ensemble_vote(spark: SparkSession, d: str) -> DataFrame:
    return VT.ensemble_vote(_provider_quads(spark, d), 3)


@query("assemble_annotations", with_views(*QUADS, PROVIDERS, VOTE, """texts AS (
    SELECT CAST(o_orderkey AS VARCHAR) AS review_id, CASE WHEN o_orderkey % 9 = 0 THEN '!!!!!' ELSE 'order ' || CAST(o_orderkey AS VARCHAR) END AS text
    FROM orders)""", body="""
  SELECT t.review_id, text, aspect_term, aspect_category, opinion_term, sentiment, coalesce(conflict, false) AS conflict,
    'ensemble' AS provider FROM texts t LEFT JOIN voted v USING (review_id) WHERE text <> '!!!!!'
  UNION ALL SELECT review_id, text, NULL, NULL, NULL, NULL, false, 'noise' FROM texts WHERE text = '!!!!!'"""))
def assemble_annotations(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    text = F.when(key % 9 == 0, "!!!!!").otherwise(F.concat(F.lit("order "), key.cast("string")))
    reviews = V.table(spark, d, "orders").select(key.cast("string").alias("review_id"), text.alias("text"))
    return VT.assemble_annotations(reviews, VT.ensemble_vote(_provider_quads(spark, d), 3))


ROUTES = """
  SELECT 'all' AS route, review_id, NULL AS reason FROM annotated UNION ALL
  SELECT 'conflicts', review_id, 'MODEL_DISAGREEMENT' FROM annotated WHERE conflict UNION ALL
  SELECT 'skipped', CAST(o_orderkey AS VARCHAR), 'NO_ASPECT' FROM orders WHERE CAST(o_orderkey AS VARCHAR) NOT IN (SELECT review_id FROM quads)
  UNION ALL SELECT 'all', CAST(o_orderkey AS VARCHAR), NULL FROM orders WHERE CAST(o_orderkey AS VARCHAR) NOT IN (SELECT review_id FROM quads)"""


@query("route_annotations", with_views(*QUADS, V.ANNOTATED_SQL, body=ROUTES))
def route_annotations(spark: SparkSession, d: str) -> DataFrame:
    routes = VT.route_annotations(_annotated_with_empty(spark, d))
    none = F.lit(None).cast("string")
    parts = [
        df.select(F.lit(name).alias("route"), "review_id", (F.col("reason") if "reason" in df.columns else none).alias("reason"))
        for name, df in routes.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _annotated_with_empty(spark: SparkSession, d: str) -> DataFrame:
    """Annotated reviews, with orders that have no line as empty ones."""
    done = V.annotated(spark, d)
    ids = V.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("review_id"))
    rest = ids.join(done.select("review_id"), "review_id", "left_anti").select(
        "review_id", F.concat_ws(" ", F.lit("order"), "review_id", F.lit(":")).alias("text"),
        F.array().cast(J.QUADS).alias("quadruples"), F.lit(False).alias("conflict"),
    )
    return done.unionByName(rest)


@query("routed_files", with_views(*QUADS, V.ANNOTATED_SQL, body=ROUTES))
def routed_files(spark: SparkSession, d: str) -> DataFrame:
    """The three outputs, appended as JSON lines in two batches each and read back."""
    annotated = materialise(_annotated_with_empty(spark, d), "annotated")
    odd = F.col("review_id").cast("bigint") % 2 == 1
    paths = {name: scratch_dir(spark, name) for name in VT.route_annotations(annotated)}
    for batch in (annotated.filter(odd), annotated.filter(~odd)):
        for name, df in VT.route_annotations(batch).items():
            W.append_json(df, paths[name])
    parts = [spark.read.schema("review_id string, reason string").json(p).select(F.lit(name).alias("route"), "review_id", "reason") for name, p in paths.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("kept_ids", with_views(*QUADS, V.ANNOTATED_SQL, body="""SELECT 'flat' AS name, CAST(l_orderkey AS VARCHAR) AS review_id, CAST(l_linenumber AS INT) AS line FROM lineitem
    WHERE CAST(l_orderkey AS VARCHAR) IN (SELECT review_id FROM annotated)
  UNION ALL SELECT 'done', CAST(o_orderkey AS VARCHAR), 0 FROM orders WHERE CAST(o_orderkey AS VARCHAR) IN (SELECT review_id FROM annotated)"""))
def kept_ids(spark: SparkSession, d: str) -> DataFrame:
    """The flat table and the list of finished reviews, both reduced to reviews that have a quadruple."""
    keep = materialise(VT.kept_quads(_annotated_with_empty(spark, d)).select("review_id"), "kept")
    flat = V.table(spark, d, "lineitem").select(F.lit("flat").alias("name"), F.col("l_orderkey").cast("string").alias("review_id"), F.col("l_linenumber").cast("int").alias("line"))
    done = V.table(spark, d, "orders").select(F.lit("done").alias("name"), F.col("o_orderkey").cast("string").alias("review_id"), F.lit(0).alias("line"))
    path = scratch_dir(spark, "kept-rows")
    for rows in (flat, done):
        W.append_json(RV.kept(rows, keep, ["review_id"]), path)
    return spark.read.schema("name string, review_id string, line int").json(path)


@query("kept_quads", with_views(*QUADS, V.ANNOTATED_SQL, body="SELECT review_id, text, len(quadruples)::INT AS n FROM annotated"))
def kept_quads(spark: SparkSession, d: str) -> DataFrame:
    return VT.kept_quads(_annotated_with_empty(spark, d)).select("review_id", "text", F.size("quadruples").alias("n"))


@query("flat_quads", with_views(*QUADS, V.ANNOTATED_SQL, body="""SELECT review_id, replace(substr(text, 1, 100), chr(10), ' ') AS text_preview,
    CAST(n - 1 AS INT) AS pos, q.aspect_term AS aspect_term, q.aspect_category AS aspect_category, q.opinion_term AS opinion_term, q.sentiment AS sentiment
  FROM (SELECT review_id, text, unnest(quadruples) AS q, generate_subscripts(quadruples, 1) AS n FROM annotated)"""))
def flat_quads(spark: SparkSession, d: str) -> DataFrame:
    return VT.flat_quads(V.annotated(spark, d))


DISPLAY = """displayed AS (SELECT review_id, text, quadruples, conflict, array_to_string(list_transform(quadruples, lambda q, i:
    '[' || CAST(i AS VARCHAR) || '] ' || q.aspect_category || ' | aspect=' || q.aspect_term || ' | opinion=' || q.opinion_term || ' | ' || q.sentiment),
    chr(10)) AS display FROM annotated)"""


@query("label_tasks", with_views(*QUADS, V.ANNOTATED_SQL, DISPLAY, body="""SELECT review_id, display AS llm_display,
    len(quadruples)::INT AS llm_quad_count, conflict AS llm_conflict FROM displayed"""))
def label_tasks(spark: SparkSession, d: str) -> DataFrame:
    tasks = VT.label_tasks(V.annotated(spark, d))
    schema = "struct<data:struct<review_id:string,text:string,llm_quad_count:int,llm_conflict:boolean,llm_display:string>>"
    return tasks.select(F.from_json("task", schema).alias("t")).select(
        "t.data.review_id", "t.data.llm_display", "t.data.llm_quad_count", "t.data.llm_conflict"
    )


@query("parse_display", with_views(*QUADS, V.ANNOTATED_SQL, body="""SELECT review_id, CAST(n - 1 AS INT) AS pos, q.aspect_term AS aspect_term,
    q.aspect_category AS aspect_category, q.opinion_term AS opinion_term, q.sentiment AS sentiment
  FROM (SELECT review_id, unnest(quadruples) AS q, generate_subscripts(quadruples, 1) AS n FROM annotated)"""))
def parse_display(spark: SparkSession, d: str) -> DataFrame:
    shown = V.annotated(spark, d).select("review_id", F.concat(VT.display_text(), F.lit("\nnot a quadruple")).alias("display"))
    return SL.parse_display(shown)[0]


NAMES = {code: name for name, code in K.CATEGORY_ALIASES.items()}
VERDICTS = ["correct", "partly", "wrong"]


def _human_export(spark: SparkSession, d: str) -> DataFrame:
    """A labelling export: aliases for categories, skipped slots, verdicts."""
    from opinara.functions.casts import lookup

    nested = V.annotated(spark, d)
    order = F.col("review_id").cast("bigint")
    alias = lambda q: F.when(order % 3 == 0, q["aspect_category"]).otherwise(lookup(q["aspect_category"], NAMES))
    item = lambda name, choice, text: F.struct(
        name.alias("from_name"), F.struct(F.array_compact(F.array(choice)).alias("choices"), F.array_compact(F.array(text)).alias("text")).alias("value")
    )
    none = F.lit(None).cast("string")
    slot = lambda i: (i + 1).cast("string")
    result = F.flatten(
        F.transform(
            "quadruples",
            lambda q, i: F.array(
                item(F.concat(F.lit("cat"), slot(i)), F.when((order % 17 == 0) & (i == 0), "__SKIP__").otherwise(alias(q)), none),
                item(F.concat(F.lit("asp"), slot(i)), none, F.concat(F.lit(" "), F.upper(q["aspect_term"]))),
                item(F.concat(F.lit("opi"), slot(i)), none, F.when(order % 2 == 0, q["opinion_term"]).otherwise(" ")),
                item(F.concat(F.lit("sent"), slot(i)), F.initcap(q["sentiment"]), none),
            ),
        )
    )
    verdict = F.element_at(F.array(*[F.lit(v) for v in VERDICTS]), (order % 3 + 1).cast("int"))
    last = F.struct(F.concat(result, F.array(item(F.lit("llm_verdict"), verdict, none))).alias("result"))
    old = F.struct(F.slice(result, 1, 1).alias("result"))
    annotations = F.when(order % 19 == 0, F.array().cast("array<struct<result:array<struct<from_name:string,value:struct<choices:array<string>,text:array<string>>>>>>")).otherwise(F.array(old, last))
    task = F.struct(F.struct("review_id").alias("data"), annotations.alias("annotations"))
    # the export arrives as text, so it is written as text before it is parsed
    return materialise(nested.select(F.to_json(task).alias("task")), "label-export")


@query("parse_human_export", with_views(*QUADS, V.ANNOTATED_SQL, body="""SELECT review_id, CAST(n AS INT) AS slot,
    q.aspect_term AS aspect_term, q.aspect_category AS aspect_category,
    CASE WHEN CAST(review_id AS BIGINT) % 2 = 0 THEN q.opinion_term ELSE 'null' END AS opinion_term, q.sentiment AS sentiment,
    list_extract(['correct', 'partly', 'wrong'], CAST(CAST(review_id AS BIGINT) % 3 + 1 AS INT)) AS verdict
  FROM (SELECT review_id, unnest(quadruples) AS q, generate_subscripts(quadruples, 1) AS n FROM annotated)
  WHERE CAST(review_id AS BIGINT) % 19 <> 0 AND NOT (CAST(review_id AS BIGINT) % 17 = 0 AND n = 1)"""))
def parse_human_export(spark: SparkSession, d: str) -> DataFrame:
    quads, reviews, _ = SL.parse_human_export(_human_export(spark, d))
    return quads.join(reviews, "review_id")


@query("human_export_rejects", with_views(*QUADS, body="""SELECT DISTINCT review_id, 'no annotation' AS reason, CAST(NULL AS VARCHAR) AS value
  FROM quads WHERE CAST(review_id AS BIGINT) % 19 = 0"""))
def human_export_rejects(spark: SparkSession, d: str) -> DataFrame:
    return SL.parse_human_export(_human_export(spark, d))[2]


@query("verdicts", with_views(*QUADS, body="""SELECT verdict, count(*) AS n, round(count(*)::DOUBLE * 100 / sum(count(*)) OVER () + 1e-9, 1) AS percent FROM (
  SELECT DISTINCT review_id, list_extract(['correct', 'partly', 'wrong'], CAST(CAST(review_id AS BIGINT) % 3 + 1 AS INT)) AS verdict
  FROM quads WHERE CAST(review_id AS BIGINT) % 19 <> 0) GROUP BY 1"""))
def verdicts(spark: SparkSession, d: str) -> DataFrame:
    return M.verdict_distribution(SL.parse_human_export(_human_export(spark, d))[1])


# ------------------------------------------------------------ label vectors
def _code_sql(c: str) -> str:
    return f"CASE {c} WHEN 'positive' THEN 1 WHEN 'neutral' THEN 2 WHEN 'negative' THEN 3 ELSE 0 END"


def _vector_sql(where: str) -> str:
    slots = ", ".join(f"coalesce(max({_code_sql('sentiment')}) FILTER (WHERE aspect_category = '{c}'), 0)" for c in K.CATEGORIES)
    return f"SELECT review_id, [{slots}] AS labels FROM quads WHERE {where} GROUP BY 1"


@query("label_vectors", with_views(*QUADS, body=_vector_sql("TRUE")))
def label_vectors(spark: SparkSession, d: str) -> DataFrame:
    return VT.label_vectors(V.quads(spark, d))


@query("label_vectors_nested", with_views(*QUADS, body=_vector_sql("TRUE")))
def label_vectors_nested(spark: SparkSession, d: str) -> DataFrame:
    return V.annotated(spark, d).select("review_id", R.label_vector(F.col("quadruples")).alias("labels"))


TARGET = f"""SELECT review_id, array_to_string(list_transform(list_filter(list_transform(labels, lambda v, i: [v, i]), lambda p: p[1] <> 0),
    lambda p: list_extract([{sql_list([K.TARGET_CATEGORY[c] for c in K.CATEGORIES])}], p[2]) || ':' || list_extract(['tot', 'tam', 'te'], p[1])), ' | ') AS target
  FROM ({_vector_sql("TRUE")})"""


@query("target_string", with_views(*QUADS, body=TARGET))
def target_string(spark: SparkSession, d: str) -> DataFrame:
    return VT.label_vectors(V.quads(spark, d)).select("review_id", R.target_string(F.col("labels")).alias("target"))


@query("bio_tags", with_views(*QUADS, V.ANNOTATED_SQL, body="""SELECT review_id, array_to_string(list_transform(toks, lambda t, i:
    CASE WHEN list_position(toks, t) = i AND len(list_filter(quadruples, lambda q: q.aspect_term = t)) > 0
      THEN 'B-' || list_filter(quadruples, lambda q: q.aspect_term = t)[1].sentiment ELSE 'O' END), ' ') AS tags
  FROM (SELECT review_id, quadruples, string_split(text, ' ') AS toks FROM annotated)"""))
def bio_tags(spark: SparkSession, d: str) -> DataFrame:
    rows = V.annotated(spark, d).withColumn("tokens", X.tokens("text"))
    return rows.select("review_id", F.array_join(R.bio_tags(F.col("tokens"), F.col("quadruples")), " ").alias("tags"))


# ------------------------------------------------------------ agreement
def _match_sql(key: str) -> str:
    return f"""per AS (SELECT review_id, count(*) FILTER (WHERE h) AS human_quads, count(*) FILTER (WHERE m) AS model_quads,
    count(*) FILTER (WHERE h AND m) AS tp, count(*) FILTER (WHERE m AND NOT h) AS fp, count(*) FILTER (WHERE h AND NOT m) AS fn,
    NOT bool_or(h <> m) AS exact_match
  FROM (SELECT review_id, {key}, max(annotator = 'human') AS h, max(annotator = 'model') AS m FROM quads GROUP BY ALL)
  GROUP BY 1)"""


def _f1_sql(kind: str) -> str:
    return f"""SELECT '{kind}' AS match_type, n_reviews, round(p + 1e-9, 4) AS precision, round(r + 1e-9, 4) AS recall,
    round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END + 1e-9, 4) AS f1, round(e + 1e-9, 4) AS exact_match
  FROM (SELECT count(*) AS n_reviews, coalesce(sum(tp)::DOUBLE / nullif(sum(tp) + sum(fp), 0)::DOUBLE, 0) AS p,
    coalesce(sum(tp)::DOUBLE / nullif(sum(tp) + sum(fn), 0)::DOUBLE, 0) AS r, count(*) FILTER (WHERE exact_match)::DOUBLE / count(*) AS e FROM per)"""


PARTIAL, FULL = "aspect_category, sentiment", "aspect_category, sentiment, aspect_term, opinion_term"


@query("quad_matches", with_views(*QUADS, _match_sql(PARTIAL), body="SELECT * FROM per"))
def quad_matches(spark: SparkSession, d: str) -> DataFrame:
    return M.quad_matches(_both(spark, d))


@query("quad_f1_partial", with_views(*QUADS, _match_sql(PARTIAL), body=_f1_sql("partial")))
def quad_f1_partial(spark: SparkSession, d: str) -> DataFrame:
    return M.quad_f1(M.quad_matches(_both(spark, d)))


@query("quad_f1_full", with_views(*QUADS, _match_sql(FULL), body=_f1_sql("full")))
def quad_f1_full(spark: SparkSession, d: str) -> DataFrame:
    return M.quad_f1(M.quad_matches(_both(spark, d), "full"), "full")


COUNTS = f"""common AS (SELECT DISTINCT review_id FROM quads),
presence AS (SELECT q.review_id, aspect_category AS category, max(annotator = 'human') AS h, max(annotator = 'model') AS m
  FROM quads q JOIN common c ON q.review_id = c.review_id GROUP BY ALL),
counts AS (SELECT category, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn,
    (SELECT count(*) FROM common) - coalesce(tp, 0) - coalesce(fp, 0) - coalesce(fn, 0) AS tn, (SELECT count(*) FROM common) AS n
  FROM (SELECT unnest([{sql_list(K.CATEGORIES)}]) AS category) LEFT JOIN (
    SELECT category, count(*) FILTER (WHERE h AND m) AS tp, count(*) FILTER (WHERE NOT h AND m) AS fp, count(*) FILTER (WHERE h AND NOT m) AS fn
    FROM presence GROUP BY 1) USING (category))"""


def _prf_sql(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> str:
    p, r = f"coalesce({tp}::DOUBLE / nullif({tp} + {fp}, 0)::DOUBLE, 0)", f"coalesce({tp}::DOUBLE / nullif({tp} + {fn}, 0)::DOUBLE, 0)"
    return f"""round({p} + 1e-9, 4) AS precision, round({r} + 1e-9, 4) AS recall,
    round(CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0 END + 1e-9, 4) AS f1"""


@query("category_f1", with_views(*QUADS, COUNTS, body=f"""SELECT category, {_prf_sql()}, tp, fp, fn, tn, tp + fn AS human_count, tp + fp AS model_count
  FROM counts"""))
def category_f1(spark: SparkSession, d: str) -> DataFrame:
    return M.category_f1(M.category_counts(_both(spark, d)))


PAIRS = """pairs AS (SELECT h.sentiment AS h_sentiment, m.sentiment AS m_sentiment, count(*) AS n FROM quads h JOIN (
    SELECT review_id, aspect_category, arg_min(sentiment, (pos, product_id, aspect_term)) AS sentiment FROM quads WHERE annotator = 'model' GROUP BY ALL) m
  ON h.review_id = m.review_id AND h.aspect_category = m.aspect_category WHERE h.annotator = 'human' GROUP BY ALL)"""


SENTIMENT_ROWS = """s AS (SELECT s AS sentiment,
    coalesce(sum(n) FILTER (WHERE h_sentiment = s AND m_sentiment = s), 0) AS tp, coalesce(sum(n) FILTER (WHERE h_sentiment <> s AND m_sentiment = s), 0) AS fp,
    coalesce(sum(n) FILTER (WHERE h_sentiment = s AND m_sentiment <> s), 0) AS fn, sum(n) AS n_pairs, sum(n) FILTER (WHERE h_sentiment = m_sentiment) AS correct
  FROM pairs CROSS JOIN (SELECT unnest(['positive', 'neutral', 'negative']) AS s) GROUP BY 1)"""
SENTIMENT_SQL = f"SELECT sentiment, n_pairs::BIGINT AS n_pairs, round(correct::DOUBLE / n_pairs::DOUBLE + 1e-9, 4) AS accuracy, {_prf_sql()} FROM s"


@query("sentiment_agreement", with_views(*QUADS, PAIRS, SENTIMENT_ROWS, body=SENTIMENT_SQL))
def sentiment_agreement(spark: SparkSession, d: str) -> DataFrame:
    return M.sentiment_agreement(M.sentiment_pairs(_both(spark, d)))


KAPPA_SQL = """k AS (
  SELECT 'category' AS scope, category AS name, CASE WHEN tp + fn > 0 AND tp + fp > 0 THEN
      ((tp + tn)::DOUBLE / n - ((tp + fn)::DOUBLE * (tp + fp) + (n - tp - fn)::DOUBLE * (n - tp - fp)) / (n::DOUBLE * n))
      / (1 - ((tp + fn)::DOUBLE * (tp + fp) + (n - tp - fn)::DOUBLE * (n - tp - fp)) / (n::DOUBLE * n)) END AS kappa FROM counts
  UNION ALL SELECT 'overall', 'all', (po - pe) / (1 - pe) FROM (SELECT sum(tp + tn)::DOUBLE / sum(n)::DOUBLE AS po,
      (sum((tp + fn)::DOUBLE * (tp + fp)) + sum(n - tp - fn)::DOUBLE * sum(n - tp - fp)::DOUBLE) / (sum(n)::DOUBLE * sum(n)::DOUBLE) AS pe FROM counts)
  UNION ALL SELECT 'sentiment', 'all', (po - pe) / (1 - pe) FROM (SELECT sum(n) FILTER (WHERE h_sentiment = m_sentiment)::DOUBLE / sum(n)::DOUBLE AS po,
      (SELECT sum(hn::DOUBLE * mn::DOUBLE) FROM (SELECT h_sentiment AS s, sum(n) AS hn FROM pairs GROUP BY 1) a
        JOIN (SELECT m_sentiment AS s, sum(n) AS mn FROM pairs GROUP BY 1) b USING (s)) / (sum(n)::DOUBLE * sum(n)::DOUBLE) AS pe FROM pairs))"""


@query("cohen_kappa", with_views(*QUADS, COUNTS, PAIRS, KAPPA_SQL, body="""SELECT scope, name, round(kappa + 1e-9, 4) AS kappa,
  CASE WHEN kappa IS NULL THEN 'N/A' WHEN round(kappa + 1e-9, 4) >= 0.8 THEN 'Rất tốt ✅' WHEN round(kappa + 1e-9, 4) >= 0.6 THEN 'Tốt 🟢'
    WHEN round(kappa + 1e-9, 4) >= 0.4 THEN 'Trung bình ⚠️' WHEN round(kappa + 1e-9, 4) >= 0.2 THEN 'Yếu 🟠' ELSE 'Rất yếu ❌' END AS meaning FROM k"""))
def cohen_kappa(spark: SparkSession, d: str) -> DataFrame:
    sides = _both(spark, d)
    return M.cohen_kappa(materialise(M.category_counts(sides), "category-counts"), materialise(M.sentiment_pairs(sides), "sentiment-pairs"))


# ------------------------------------------------------------ model quality
def _predictions(spark: SparkSession, d: str) -> DataFrame:
    """Two models judged against the human vectors: the model labels, and their neighbours."""
    human, model = _sides(spark, d)
    truth = VT.label_vectors(human).withColumnRenamed("labels", "y_true")
    pred = VT.label_vectors(model).withColumnRenamed("labels", "y_pred")
    both = truth.join(pred, "review_id")
    shifted = F.concat(F.slice("y_pred", 2, 16), F.slice("y_pred", 1, 1))
    models = F.array(
        F.struct(F.lit("direct").alias("model"), F.col("y_pred").alias("p")),
        F.struct(F.lit("shifted").alias("model"), shifted.alias("p")),
    )
    return both.select("review_id", "y_true", F.explode(models).alias("x")).select("review_id", "y_true", "x.model", F.col("x.p").alias("y_pred"))


CUBE = f"""truth AS ({_vector_sql("annotator = 'human'")}), pred AS ({_vector_sql("annotator = 'model'")}),
preds AS (SELECT 'direct' AS model, t.labels AS y_true, p.labels AS y_pred FROM truth t JOIN pred p USING (review_id)
  UNION ALL SELECT 'shifted', t.labels, list_concat(p.labels[2:17], p.labels[1:1]) FROM truth t JOIN pred p USING (review_id)),
cells AS (SELECT model, unnest(y_true) AS t, unnest(y_pred) AS p, generate_subscripts(y_true, 1) AS idx FROM preds),
detection AS (SELECT model, idx, count(*) FILTER (WHERE t <> 0 AND p <> 0) AS tp, count(*) FILTER (WHERE t = 0 AND p <> 0) AS fp,
  count(*) FILTER (WHERE t <> 0 AND p = 0) AS fn FROM cells GROUP BY ALL),
polarity AS (SELECT model, count(*) FILTER (WHERE t = p) AS tp, count(*) FILTER (WHERE p <> 0 AND t <> p) AS fp,
  count(*) FILTER (WHERE t <> p) AS fn FROM cells WHERE t <> 0 GROUP BY 1)"""


@query("aspect_detection", with_views(*QUADS, CUBE, body=f"""SELECT model, {_prf_sql()} FROM (
  SELECT model, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM detection GROUP BY 1)"""))
def aspect_detection(spark: SparkSession, d: str) -> DataFrame:
    return M.aspect_detection(M.confusion_cube(_predictions(spark, d)))


BY_CATEGORY = f"""SELECT model, list_extract([{sql_list(K.CATEGORIES)}], CAST(idx AS INT)) AS category, {_prf_sql()}, tp + fn AS support FROM detection"""


@query("aspect_detection_by_category", with_views(*QUADS, CUBE, body=BY_CATEGORY))
def aspect_detection_by_category(spark: SparkSession, d: str) -> DataFrame:
    return M.aspect_detection_by_category(M.confusion_cube(_predictions(spark, d)))


@query("aspect_polarity", with_views(*QUADS, CUBE, body=f"SELECT model, {_prf_sql()} FROM polarity"))
def aspect_polarity(spark: SparkSession, d: str) -> DataFrame:
    return M.aspect_polarity(M.confusion_cube(_predictions(spark, d)))


@query("polarity_by_sentiment", with_views(*QUADS, CUBE, body=f"""SELECT model, sentiment, f1, support FROM (SELECT model, sentiment, {_prf_sql()}, tp + fn AS support FROM (
  SELECT model, list_extract(['positive', 'neutral', 'negative'], code) AS sentiment, count(*) FILTER (WHERE t = code AND p = code) AS tp,
    count(*) FILTER (WHERE t <> code AND p = code) AS fp, count(*) FILTER (WHERE t = code AND p <> code) AS fn
  FROM cells CROSS JOIN (SELECT unnest([1, 2, 3]) AS code) WHERE t <> 0 GROUP BY model, code))"""))
def polarity_by_sentiment(spark: SparkSession, d: str) -> DataFrame:
    return M.polarity_by_sentiment(M.confusion_cube(_predictions(spark, d)))


def _raw_f1(tp: str, fp: str, fn: str) -> str:
    p, r = f"coalesce({tp}::DOUBLE / nullif({tp} + {fp}, 0)::DOUBLE, 0)", f"coalesce({tp}::DOUBLE / nullif({tp} + {fn}, 0)::DOUBLE, 0)"
    return f"CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0 END"


@query("model_comparison", with_views(*QUADS, CUBE, f"""f AS (SELECT model, ad, ap, (ad + ap) / 2 AS av FROM
    (SELECT model, {_raw_f1('sum(tp)', 'sum(fp)', 'sum(fn)')} AS ad FROM detection GROUP BY 1) JOIN
    (SELECT model, {_raw_f1('tp', 'fp', 'fn')} AS ap FROM polarity) USING (model))""", body="""
  SELECT model, round(ad + 1e-9, 4) AS ad_f1, round(ap + 1e-9, 4) AS ap_f1, round(av + 1e-9, 4) AS avg_f1,
    model = (SELECT model FROM f ORDER BY av DESC, model LIMIT 1) AS is_best,
    CASE WHEN av >= 0.8 THEN 'LLM rất đáng tin ✅' WHEN av >= 0.65 THEN 'LLM đủ dùng ⚠️ — nên review category yếu'
      WHEN av >= 0.5 THEN 'LLM trung bình — cân nhắc re-prompt 🟠' ELSE 'LLM chất lượng thấp ❌ — cần re-prompt hoặc tăng manual label' END AS meaning FROM f"""))
def model_comparison(spark: SparkSession, d: str) -> DataFrame:
    return M.model_comparison(M.confusion_cube(_predictions(spark, d)))


@query("category_by_model", with_views(*QUADS, CUBE, body=f"""SELECT category, max(f1) FILTER (WHERE model = 'direct') AS direct,
  max(f1) FILTER (WHERE model = 'shifted') AS shifted FROM ({BY_CATEGORY}) GROUP BY 1"""))
def category_by_model(spark: SparkSession, d: str) -> DataFrame:
    by = M.aspect_detection_by_category(M.confusion_cube(_predictions(spark, d)))
    return M.category_by_model(by, ["direct", "shifted"])


# ------------------------------------------------------------ free-form model answers
@query("question_json", """SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'PRICE_VALUE' WHEN 1 THEN 'UNKNOWN' ELSE 'SUMMARY' END AS intent,
    'PRODUCT#SIZE|PRODUCT#VALUE' AS aspects, CASE conv_id % 3 WHEN 0 THEN 'price|fit' WHEN 1 THEN 'age:' || CAST(turn AS VARCHAR) ELSE '' END AS constraints,
    CASE conv_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.25 ELSE 0.0 END::DOUBLE AS confidence
  FROM conversations""")
def question_json(spark: SparkSession, d: str) -> DataFrame:
    conv = V.table(spark, d, "conversations")
    kind = F.col("conv_id") % 3
    intent = F.when(kind == 0, " price_value ").when(kind == 1, "BUY_NOW").otherwise("summary")
    constraints = F.when(kind == 0, '["price", "", "fit", "price"]').when(
        kind == 1, F.concat(F.lit('{"age": "'), F.col("turn").cast("string"), F.lit('", "none": ""}'))
    ).otherwise("[]")
    confidence = F.when(kind == 0, "7.5").when(kind == 1, '"0.25"').otherwise("null")
    body = F.concat(
        F.lit('{"intent": "'), intent, F.lit('", "target_aspects": ["PRODUCT#SIZE", "NOPE", "PRODUCT#VALUE", "PRODUCT#SIZE"], "constraints": '),
        constraints, F.lit(', "confidence": '), confidence, F.lit("}"),
    )
    # model text around the object: a think block, prose, or a fence
    raw = F.when(kind == 0, F.concat(F.lit("<think>{\"intent\": 1}</think> Result: "), body, F.lit(" done"))).when(
        kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))
    ).otherwise(F.concat(body, F.lit("<think> and so on")))
    rows = conv.select("conv_id", "turn", J.question_analysis(raw).alias("a"))
    return rows.select(
        "conv_id", "turn", "a.intent", F.array_join("a.target_aspects", "|").alias("aspects"),
        F.array_join("a.constraints", "|").alias("constraints"), "a.confidence",
    )


SIZE_LABEL = K.ASPECT_LABELS["PRODUCT#SIZE"]
SANITIZED = f"""squeezed AS (SELECT doc_id, source, text, {squeeze_sql('text')} AS t FROM documents),
parts AS (SELECT *, substr(t, 1, 600) AS shown, substr({evidence_sql('t', 150)}, 1, 180) AS cited FROM squeezed)"""


@query("sanitize_answers", with_views(SANITIZED, body=f"""SELECT doc_id,
    CASE WHEN len(list_filter(string_split(shown, ' '), lambda w: length(w) > 0)) < 5 THEN {sql_list([K.NO_DATA_SUMMARY])} ELSE shown END AS summary,
    list_transform(list_filter(string_split(text, chr(10)), lambda s: s <> ''), lambda s: substr({squeeze_sql('s')}, 1, 220)) AS pros,
    [substr(source, 1, 220)] AS cons,
    CASE WHEN cited = '' THEN {sql_list([K.NO_DATA_RECOMMENDATION])} ELSE concat({sql_list([K.CITATION_RECOMMENDATION[0], SIZE_LABEL.lower(), K.CITATION_RECOMMENDATION[1]])}, cited) END AS recommendation,
    'medium' AS confidence, {sql_list([K.NO_DATA_REASON])} AS reason,
    CASE WHEN cited = '' THEN [] ELSE [{sql_list([SIZE_LABEL])}] END AS citation_aspects, CASE WHEN cited = '' THEN [] ELSE [cited] END AS citation_texts FROM parts"""))
def sanitize_answers(spark: SparkSession, d: str) -> DataFrame:
    docs = V.table(spark, d, "documents")
    answer = F.struct(
        F.col("text").alias("summary"), F.split("text", "\n").alias("pros"), F.array("source", F.lit("")).alias("cons"),
        F.lit("Nên xem xét.").alias("recommendation"), F.upper("lang").alias("confidence"),
        F.array().cast("array<string>").alias("confidence_reasons"),
        F.array(F.struct(F.lit("PRODUCT#SIZE").alias("aspect"), F.col("text").alias("evidence"))).alias("citations"),
    )
    none = F.array().cast("array<struct<aspect:string,evidence:string>>")
    out = docs.select("doc_id", J.sanitize_answer(answer, none).alias("a")).select("doc_id", "a.*")
    part = lambda c: F.transform("citations", lambda x: x[c])
    return out.select(
        "doc_id", "summary", "pros", "cons", "recommendation", "confidence", F.array_join("confidence_reasons", "|").alias("reason"),
        part("aspect").alias("citation_aspects"), part("evidence").alias("citation_texts"),
    )


# ------------------------------------------------------------ model scores
GATE = f"""logits AS (SELECT vec_id, g, list_transform(embedding[g * 4 + 1 : g * 4 + 4], lambda x: CAST(x AS DOUBLE) * 10) AS z
  FROM embeddings, (SELECT unnest(range(16)) AS g)),
probs AS (SELECT vec_id, g, list_transform(z, lambda x: exp(x - list_max(z)) / list_sum(list_transform(z, lambda y: exp(y - list_max(z))))) AS p FROM logits)"""


@query("softmax_gate", with_views(GATE, body=f"""SELECT vec_id, CAST(g AS INT) AS idx, list_extract([{sql_list(K.CATEGORIES)}], CAST(g + 1 AS INT)) AS aspect,
    list_extract(['none', 'positive', 'neutral', 'negative'], CAST(list_position(p, list_max(p)) AS INT)) AS sentiment, round(list_max(p) + 1e-9, 6) AS confidence
  FROM probs WHERE list_position(p, list_max(p)) > 1 AND list_max(p) >= 0.6"""))
def softmax_gate(spark: SparkSession, d: str) -> DataFrame:
    from opinara.operators.model_scores import gate_predictions

    vectors = V.table(spark, d, "embeddings")
    z = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda g: F.transform(F.slice("embedding", g * 4 + 1, 4), lambda x: x.cast("double") * 10))
    return gate_predictions(vectors.select("vec_id", z.alias("logits")), "logits")
