"""Agreement of two label sets, and model quality against the truth.

Each metric first reduces its input to a small count table in one or two
shuffles; the ratios are computed on that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara import constants as K
from opinara.functions.casts import lookup
from opinara.functions.labels import interpret_f1, interpret_kappa
from opinara.functions.numbers import count_if, f1_of, prf, round_up, safe_div

CATEGORY_BIT = {c: 1 << i for i, c in enumerate(K.CATEGORIES)}


def _norm(name: str, up: bool = False) -> Column:
    c = F.trim(F.coalesce(F.col(name), F.lit("")))
    return F.upper(c) if up else F.lower(c)


FIELDS = ["aspect_category", "sentiment", "aspect_term", "opinion_term"]
Reviewed = tuple[DataFrame, DataFrame] | None


def both_sides(human: DataFrame, model: DataFrame, pos: list[str] | None = None, reviewed: Reviewed = None) -> DataFrame:
    """Quadruples of both sides as rows of one table, all that the measures of agreement read.

    ``review_id``, the four fields, ``h`` and ``m`` (times on each side),
    ``hr`` and ``mr`` (the side went through the review), ``first`` (``pos``, the
    place of a model quadruple in its review). ``reviewed`` names the reviews that
    each side went through, as a review may have been found to hold nothing;
    without it, only reviews with quadruples count. Nothing is moved yet.
    """
    place = F.struct(*[F.col(c) for c in pos]) if pos else F.lit(None).cast("struct<x:int>")
    one = lambda v: F.lit(v).cast("bigint")
    told = reviewed is None

    def rows(df: DataFrame, h: int, m: int) -> DataFrame:
        first = place if m else F.when(F.lit(False), place)
        return df.select("review_id", *FIELDS, one(h).alias("h"), one(m).alias("m"), F.lit(told and bool(h)).alias("hr"), F.lit(told and bool(m)).alias("mr"), first.alias("first"))

    out = rows(human, 1, 0).unionByName(rows(model, 0, 1))
    if reviewed is not None:
        none = [F.lit(None).cast("string").alias(c) for c in FIELDS]
        first = F.lit(None).cast(out.schema["first"].dataType).alias("first")
        sides = [(reviewed[0], True, True)] if reviewed[0] is reviewed[1] else [(reviewed[0], True, False), (reviewed[1], False, True)]
        for df, hr, mr in sides:
            out = out.unionByName(df.select("review_id", *none, one(0).alias("h"), one(0).alias("m"), F.lit(hr).alias("hr"), F.lit(mr).alias("mr"), first))
    return out.filter(F.col("review_id").isNotNull())


def distinct_sides(sides: DataFrame) -> DataFrame:
    """The same with equal quadruples of a review as one row: what several measures share is read and moved once."""
    return sides.groupBy("review_id", *FIELDS).agg(F.sum("h").alias("h"), F.sum("m").alias("m"), F.max("hr").alias("hr"), F.max("mr").alias("mr"), F.min("first").alias("first"))


def quad_matches(sides: DataFrame, match: str = "partial") -> DataFrame:
    """Per review: sizes of both sets, tp, fp, fn and exact match.

    Reviews that both sides went through are kept. ``partial`` compares
    category and sentiment, ``full`` all four fields.
    """
    key = [_norm("aspect_category", True).alias("k1"), _norm("sentiment").alias("k2")]
    if match == "full":
        key += [_norm("aspect_term").alias("k3"), _norm("opinion_term").alias("k4")]
    h, m = F.col("h") > 0, F.col("m") > 0
    keys = sides.groupBy("review_id", *key).agg(F.max("h").alias("h"), F.max("m").alias("m"), F.max("hr").alias("hr"), F.max("mr").alias("mr"))
    out = keys.groupBy("review_id").agg(
        count_if(h).alias("human_quads"), count_if(m).alias("model_quads"), count_if(h & m).alias("tp"),
        count_if(m & ~h).alias("fp"), count_if(h & ~m).alias("fn"), F.max("hr").alias("hr"), F.max("mr").alias("mr"),
    )
    out = out.filter("hr and mr").drop("hr", "mr")
    return out.withColumn("exact_match", (F.col("fp") == 0) & (F.col("fn") == 0))


def quad_f1(per_review: DataFrame, match: str = "partial") -> DataFrame:
    """Precision, recall, F1 and exact-match rate over all reviews."""
    s = per_review.agg(
        F.count("*").alias("n_reviews"), F.coalesce(F.sum("tp"), F.lit(0)).alias("tp"),
        F.coalesce(F.sum("fp"), F.lit(0)).alias("fp"), F.coalesce(F.sum("fn"), F.lit(0)).alias("fn"),
        count_if(F.col("exact_match")).alias("exact"),
    )
    scores = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return s.select(
        F.lit(match).alias("match_type"), "n_reviews", *[c.alias(n) for n, c in scores.items()],
        round_up(safe_div(F.col("exact"), F.col("n_reviews"))).alias("exact_match"),
    )


def category_counts(sides: DataFrame) -> DataFrame:
    """tp, fp, fn, tn of each category's presence, and the number of reviews.

    The categories of a review are one bit mask per side, so a review is one
    row and absent pairs are never produced.
    """
    mask = F.coalesce(lookup(F.col("aspect_category"), CATEGORY_BIT), F.lit(0))
    per = sides.groupBy("review_id").agg(
        F.bit_or(F.when(F.col("h") > 0, mask).otherwise(0)).alias("hm"), F.bit_or(F.when(F.col("m") > 0, mask).otherwise(0)).alias("mm"),
        F.max("hr").alias("hr"), F.max("mr").alias("mr"),
    ).filter("hr and mr")
    aggs = [F.count("*").alias("n")]
    for i in range(len(K.CATEGORIES)):
        h, m = F.col("hm").bitwiseAND(1 << i) != 0, F.col("mm").bitwiseAND(1 << i) != 0
        aggs += [count_if(h & m).alias(f"tp{i}"), count_if(~h & m).alias(f"fp{i}"), count_if(h & ~m).alias(f"fn{i}")]
    rows = F.array(*[
        F.struct(F.lit(c).alias("category"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"), F.col(f"fn{i}").alias("fn"))
        for i, c in enumerate(K.CATEGORIES)
    ])
    out = per.agg(*aggs).select("n", F.explode(rows).alias("r")).select("n", "r.*")
    return out.withColumn("tn", F.col("n") - F.col("tp") - F.col("fp") - F.col("fn"))


def category_f1(counts: DataFrame) -> DataFrame:
    scores = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.select(
        "category", *[c.alias(n) for n, c in scores.items()], "tp", "fp", "fn", "tn",
        (F.col("tp") + F.col("fn")).alias("human_count"), (F.col("tp") + F.col("fp")).alias("model_count"),
    )


def sentiment_pairs(sides: DataFrame) -> DataFrame:
    """Counts of (human, model) sentiments where a category matches.

    Each human quadruple meets the first model quadruple of its category.
    """
    by_sentiment = sides.filter(F.col("aspect_category").isNotNull()).groupBy("review_id", "aspect_category", "sentiment")
    kinds = by_sentiment.agg(F.sum("h").alias("n"), F.sum("m").alias("m"), F.min(F.when(F.col("m") > 0, F.col("first"))).alias("first"))
    of_model = F.when(F.col("m") > 0, F.struct("first", "sentiment"))
    named = F.when((F.col("n") > 0) & (F.coalesce("sentiment", F.lit("")) != ""), F.struct(F.col("sentiment").alias("h_sentiment"), "n"))
    # the sentiments of a category are few, however many quadruples it has
    met = kinds.groupBy("review_id", "aspect_category").agg(F.min(of_model)["sentiment"].alias("m_sentiment"), F.collect_list(named).alias("named"))
    pairs = met.filter(F.coalesce("m_sentiment", F.lit("")) != "").select("m_sentiment", F.explode("named").alias("h"))
    return pairs.groupBy("h.h_sentiment", "m_sentiment").agg(F.sum("h.n").alias("n"))


def sentiment_agreement(pairs: DataFrame) -> DataFrame:
    """Accuracy over all pairs and precision, recall, F1 per sentiment."""
    h, m, n = F.col("h_sentiment"), F.col("m_sentiment"), F.col("n")
    zero = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0))
    aggs = [F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"), zero(h == m).alias("correct")]
    for s in K.SENTIMENTS:
        aggs += [
            zero((h == s) & (m == s)).alias(f"tp_{s}"), zero((h != s) & (m == s)).alias(f"fp_{s}"),
            zero((h == s) & (m != s)).alias(f"fn_{s}"),
        ]
    rows = F.array(*[
        F.struct(F.lit(s).alias("sentiment"), F.col(f"tp_{s}").alias("tp"), F.col(f"fp_{s}").alias("fp"), F.col(f"fn_{s}").alias("fn"))
        for s in K.SENTIMENTS
    ])
    out = pairs.agg(*aggs).select("n_pairs", "correct", F.explode(rows).alias("r")).select("n_pairs", "correct", "r.*")
    scores = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return out.select(
        "sentiment", "n_pairs", round_up(safe_div(F.col("correct"), F.col("n_pairs"))).alias("accuracy"),
        *[c.alias(name) for name, c in scores.items()],
    )


def _kappa(observed: Column, expected: Column) -> Column:
    return F.when(expected < 1, round_up((observed - expected) / F.nullif(1 - expected, F.lit(0.0))))


def cohen_kappa(counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Kappa per category, over flattened category/NONE labels, and of sentiments.

    A category counts only if both sides use it. The overall value treats the
    17 codes and NONE as classes. Sentiments need at least five pairs.
    """
    d = {c: F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn", "n")}
    h, m, n = d["tp"] + d["fn"], d["tp"] + d["fp"], F.nullif(d["n"], F.lit(0.0))
    expected = (h * m + (n - h) * (n - m)) / (n * n)
    per = counts.select(
        F.lit("category").alias("scope"), F.col("category").alias("name"),
        F.when((h > 0) & (m > 0), _kappa((d["tp"] + d["tn"]) / n, expected)).alias("kappa"),
    )
    sums = counts.agg(
        F.sum("n").cast("double").alias("cells"), F.sum(d["tp"] + d["tn"]).alias("same"), F.sum(h * m).alias("named"),
        F.sum(d["n"] - h).alias("h_none"), F.sum(d["n"] - m).alias("m_none"),
    )
    cells = F.nullif(F.col("cells"), F.lit(0.0))
    overall = sums.select(
        F.lit("overall").alias("scope"), F.lit("all").alias("name"),
        _kappa(F.col("same") / cells, (F.col("named") + F.col("h_none") * F.col("m_none")) / (cells * cells)).alias("kappa"),
    )
    sides = F.array(
        F.struct(F.col("h_sentiment").alias("s"), F.col("n").alias("hn"), F.lit(0).cast("bigint").alias("mn")),
        F.struct(F.col("m_sentiment").alias("s"), F.lit(0).cast("bigint").alias("hn"), F.col("n").alias("mn")),
    )
    margins = pairs.select(F.explode(sides).alias("x")).groupBy("x.s").agg(F.sum("x.hn").alias("hn"), F.sum("x.mn").alias("mn"))
    chance = margins.agg(F.sum(F.col("hn").cast("double") * F.col("mn")).alias("c")).scalar()
    seen = pairs.agg(F.sum("n").cast("double").alias("n"), F.sum(F.when(F.col("h_sentiment") == F.col("m_sentiment"), F.col("n")).otherwise(0)).alias("same"))
    sentiment = seen.select(
        F.lit("sentiment").alias("scope"), F.lit("all").alias("name"),
        F.when(F.col("n") >= 5, _kappa(F.col("same") / F.col("n"), chance / (F.col("n") * F.col("n")))).alias("kappa"),
    )
    out = per.unionByName(overall).unionByName(sentiment)
    return out.withColumn("meaning", interpret_kappa(F.col("kappa")))


def verdict_distribution(labels: DataFrame) -> DataFrame:
    """Count and percent of each annotator verdict."""
    from opinara.operators.eda import value_distribution

    named = labels.filter(F.coalesce("verdict", F.lit("")) != "")
    return value_distribution(named, "verdict").select(F.col("value").alias("verdict"), "n", "percent")


def confusion_cube(predictions: DataFrame) -> DataFrame:
    """Rows per model, category, true and predicted code.

    Arrays of unequal length are compared up to the shorter one.
    """
    both = F.arrays_zip("y_true", "y_pred")
    cut = F.slice(both, 1, F.least(F.size("y_true"), F.size("y_pred")))
    rows = predictions.select("model", F.posexplode(cut).alias("idx", "p"))
    return rows.groupBy("model", "idx", F.col("p.y_true").alias("t"), F.col("p.y_pred").alias("p")).agg(F.count("*").alias("n"))


def _sum_if(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))


def _detection(cube: DataFrame, keys: list[str]) -> DataFrame:
    t, p = F.col("t") != 0, F.col("p") != 0
    return cube.groupBy(*keys).agg(_sum_if(t & p).alias("tp"), _sum_if(~t & p).alias("fp"), _sum_if(t & ~p).alias("fn"))


def aspect_detection(cube: DataFrame) -> DataFrame:
    """Presence of any label, over all categories together."""
    scores = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return _detection(cube, ["model"]).select("model", *[c.alias(n) for n, c in scores.items()])


def aspect_detection_by_category(cube: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(c) for c in K.CATEGORIES])
    scores = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return _detection(cube, ["model", "idx"]).select(
        "model", F.element_at(names, F.col("idx") + 1).alias("category"), *[c.alias(n) for n, c in scores.items()],
        (F.col("tp") + F.col("fn")).alias("support"),
    )


def _polarity(cube: DataFrame) -> DataFrame:
    """Micro scores over present pairs: predicting none is a miss, not a false positive."""
    t, p = F.col("t"), F.col("p")
    sums = cube.filter(t != 0).groupBy("model").agg(
        _sum_if(t == p).alias("tp"), _sum_if((p != 0) & (t != p)).alias("fp"), _sum_if(t != p).alias("fn")
    )
    # a model with no present pair scores 0
    every = cube.groupBy("model").agg(F.lit(1).alias("one")).select("model")
    return every.join(sums, "model", "left").na.fill(0)


def aspect_polarity(cube: DataFrame) -> DataFrame:
    scores = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return _polarity(cube).select("model", *[c.alias(n) for n, c in scores.items()])


def polarity_by_sentiment(cube: DataFrame) -> DataFrame:
    t, p = F.col("t"), F.col("p")
    aggs = []
    for code, s in enumerate(K.LABEL_NAMES[1:], start=1):
        aggs += [
            _sum_if((t == code) & (p == code)).alias(f"tp_{s}"), _sum_if((t != code) & (p == code)).alias(f"fp_{s}"),
            _sum_if((t == code) & (p != code)).alias(f"fn_{s}"),
        ]
    rows = F.array(*[
        F.struct(F.lit(s).alias("sentiment"), F.col(f"tp_{s}").alias("tp"), F.col(f"fp_{s}").alias("fp"), F.col(f"fn_{s}").alias("fn"))
        for s in K.LABEL_NAMES[1:]
    ])
    out = cube.filter(t != 0).groupBy("model").agg(*aggs).select("model", F.explode(rows).alias("r")).select("model", "r.*")
    return out.select("model", "sentiment", prf(F.col("tp"), F.col("fp"), F.col("fn"))["f1"].alias("f1"), (F.col("tp") + F.col("fn")).alias("support"))


def model_comparison(cube: DataFrame) -> DataFrame:
    """Detection, polarity and mean F1 of each model, the best one marked."""
    def f1(df: DataFrame, name: str) -> DataFrame:
        tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
        return df.select("model", f1_of(safe_div(tp, tp + fp), safe_div(tp, tp + fn)).alias(name))

    both = f1(_detection(cube, ["model"]), "ad").join(f1(_polarity(cube), "ap"), "model")
    both = both.withColumn("avg", (F.col("ad") + F.col("ap")) / 2)
    best = both.agg(F.min_by("model", F.struct(-F.col("avg"), F.col("model"))).alias("m")).scalar()
    return both.select(
        "model", round_up(F.col("ad")).alias("ad_f1"), round_up(F.col("ap")).alias("ap_f1"),
        round_up(F.col("avg")).alias("avg_f1"), (F.col("model") == best).alias("is_best"),
        interpret_f1(F.col("avg")).alias("meaning"),
    )


def category_by_model(by_category: DataFrame, models: list[str]) -> DataFrame:
    """Category rows with one F1 column per model."""
    return by_category.groupBy("category").pivot("model", models).agg(F.max("f1"))
