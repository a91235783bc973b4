"""Model answers to quadruples: parsing, fallback, voting, routing, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara import constants as K
from opinara.functions import arrays as R
from opinara.functions import text as X
from opinara.functions.jsons import QUADS, repair_json

FIELDS = ["aspect_term", "aspect_category", "opinion_term", "sentiment"]


def parse_responses(responses: DataFrame, raw: str = "raw", ids: str | None = None) -> DataFrame:
    """Valid quadruples of model answers ``{"results": {review: [quad]}}``.

    Unreadable answers give no rows. ``ids`` names an array column with the
    reviews that were asked for; others are dropped.
    """
    keep = [c for c in responses.columns if c not in (raw, ids)]
    parsed = responses.withColumn("__v", F.try_parse_json(repair_json(raw)))
    results = F.try_variant_get("__v", "$.results", "map<string,variant>")
    rows = parsed.select(*keep, *([ids] if ids else []), F.explode_outer(results).alias("review_id", "__quads"))
    rows = rows.filter(F.col("review_id").isNotNull())
    if ids:
        rows = rows.filter(F.array_contains(ids, F.col("review_id")))
    rows = rows.select(
        *keep, "review_id", F.posexplode_outer(F.try_variant_get("__quads", "$", "array<variant>")).alias("pos", "__q")
    )

    def field(name: str, default: str):
        return F.coalesce(F.try_variant_get("__q", f"$.{name}", "string"), F.lit(default))

    rows = rows.select(
        *keep, "review_id", "pos", field("aspect_term", "NULL").alias("aspect_term"),
        field("aspect_category", "").alias("aspect_category"), field("opinion_term", "NULL").alias("opinion_term"),
        F.lower(field("sentiment", "")).alias("sentiment"),
    )
    return rows.filter(F.col("aspect_category").isin(K.CATEGORIES) & F.col("sentiment").isin(K.SENTIMENTS))


def first_provider(quads: DataFrame, provider: str = "provider", answered: DataFrame | None = None) -> DataFrame:
    """Per review, the quadruples of the first provider that answered.

    ``answered`` has the reviews and providers of all answers that could be
    read, since an answer may hold nothing; without it, only answers with
    quadruples count.
    """
    best = (quads if answered is None else answered).groupBy("review_id").agg(F.min(provider).alias(provider))
    return quads.join(best, ["review_id", provider], "left_semi")


def ensemble_vote(quads: DataFrame, n_providers: int, provider: str = "provider") -> DataFrame:
    """Quadruples most providers agree on, one row each, with a conflict flag.

    Where none is agreed, all are kept with a conflict. The opinion term is
    the one given last. Rows stay flat: no list per review is built.
    """
    majority = n_providers // 2 + 1
    key = ["review_id", "aspect_term", "aspect_category", "sentiment"]
    votes = quads.groupBy(*key).agg(
        F.count("*").alias("votes"), F.max_by("opinion_term", F.struct(provider, "pos")).alias("opinion_term")
    )
    flags = votes.groupBy("review_id").agg(
        F.max(F.col("votes") >= majority).alias("agreed"), F.max(F.col("votes") < majority).alias("minority")
    )
    out = votes.join(flags, "review_id").filter((F.col("votes") >= majority) | ~F.col("agreed"))
    return out.select(*key, "opinion_term", "votes", (~F.col("agreed") | F.col("minority")).alias("conflict"))


def assemble_annotations(reviews: DataFrame, voted: DataFrame, provider: str = "ensemble") -> DataFrame:
    """One row per review and quadruple; reviews without any keep one row.

    Noise texts are never labelled.
    """
    marked = reviews.select("review_id", "text", X.is_noise("text").alias("noise"))
    quads = voted.select("review_id", *FIELDS, "conflict")
    joined = marked.filter(~F.col("noise")).join(quads, "review_id", "left")
    empty = [F.lit(None).cast("string").alias(c) for c in FIELDS]
    noise = marked.filter("noise").select("review_id", "text", *empty, F.lit(False).alias("conflict"), F.lit("noise").alias("provider"))
    rest = joined.select(
        "review_id", "text", *FIELDS, F.coalesce("conflict", F.lit(False)).alias("conflict"),
        F.lit(provider).alias("provider"),
    )
    return rest.unionByName(noise)


def route_annotations(annotated: DataFrame) -> dict[str, DataFrame]:
    """All reviews, those without quadruples, and those in conflict."""
    some = F.size("quadruples") > 0
    return {
        "all": annotated.select("review_id", "text", "quadruples", "conflict"),
        "skipped": annotated.filter(~some).select("review_id", "text", F.lit("NO_ASPECT").alias("reason")),
        "conflicts": annotated.filter(some & F.col("conflict")).select(
            "review_id", "text", "quadruples", F.lit("MODEL_DISAGREEMENT").alias("reason")
        ),
    }


def kept_quads(annotated: DataFrame) -> DataFrame:
    """Annotated reviews that have at least one quadruple."""
    return annotated.filter(F.size(F.coalesce("quadruples", F.array().cast(QUADS))) > 0)


def flat_quads(annotated: DataFrame, preview: int = 100) -> DataFrame:
    """Flat rows with a one-line text preview."""
    text = F.replace(F.substring("text", 1, preview), F.lit("\n"), F.lit(" "))
    rows = annotated.select("review_id", text.alias("text_preview"), F.posexplode("quadruples").alias("pos", "q"))
    return rows.select("review_id", "text_preview", "pos", *[F.col(f"q.{c}").alias(c) for c in FIELDS])


def label_vectors(quads: DataFrame) -> DataFrame:
    """17 label codes per review from flat quadruples, in one aggregation."""
    code = R.sentiment_code(F.col("sentiment"))
    slots = [F.coalesce(F.max(F.when(F.trim("aspect_category") == c, code)), F.lit(0)) for c in K.CATEGORIES]
    return quads.groupBy("review_id").agg(F.array(*slots).alias("labels"))


def display_text(quads: str = "quadruples"):
    """Numbered display lines of nested quadruples."""
    lines = F.transform(
        quads,
        lambda q, i: F.concat(
            F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(q["aspect_category"], F.lit("?")),
            F.lit(" | aspect="), F.coalesce(q["aspect_term"], F.lit("NULL")),
            F.lit(" | opinion="), F.coalesce(q["opinion_term"], F.lit("?")),
            F.lit(" | "), F.coalesce(q["sentiment"], F.lit("?")),
        ),
    )
    return F.when(F.size(quads) > 0, F.array_join(lines, "\n")).otherwise(F.lit(K.EMPTY_DISPLAY))


def label_tasks(annotated: DataFrame) -> DataFrame:
    """Labelling tasks as JSON: one object with a ``data`` record per review."""
    data = F.struct(
        F.col("review_id").cast("string").alias("review_id"), "text", F.size("quadruples").alias("llm_quad_count"),
        F.col("conflict").alias("llm_conflict"), display_text().alias("llm_display"),
    )
    return annotated.select("review_id", F.to_json(F.struct(data.alias("data"))).alias("task"))
