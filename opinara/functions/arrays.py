"""Array expressions: label vectors, spans, BIO tags, vector maths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opinara import constants as K
from opinara.functions import text as X
from opinara.functions.casts import lookup

SENTIMENT_CODE = {name: code for code, name in enumerate(K.LABEL_NAMES)}


def sentiment_code(sentiment: Column) -> Column:
    """Label code of a sentiment: missing is positive, unknown is 0.

    The codes grow with severity, so the strongest label is the largest code.
    """
    return F.coalesce(lookup(F.lower(F.trim(F.coalesce(sentiment, F.lit("positive")))), SENTIMENT_CODE), F.lit(0))


def label_vector(quads: Column) -> Column:
    """17 label codes of a nested list of quadruples."""
    def slot(code: str) -> Column:
        mine = F.filter(quads, lambda q: F.trim(q["aspect_category"]) == code)
        return F.coalesce(F.array_max(F.transform(mine, lambda q: sentiment_code(q["sentiment"]))), F.lit(0))

    return F.array(*[slot(c) for c in K.CATEGORIES])


def target_string(labels: Column) -> Column:
    """'category:sentiment | ...' in category order, or 'none'."""
    names = F.array(*[F.lit(K.TARGET_CATEGORY[c]) for c in K.CATEGORIES])
    kinds = F.array(*[F.lit(K.TARGET_SENTIMENT[s]) for s in K.SENTIMENTS])
    parts = F.transform(
        labels, lambda v, i: F.when(v != 0, F.concat(F.element_at(names, i + 1), F.lit(":"), F.get(kinds, v - 1)))
    )
    return F.coalesce(F.nullif(F.array_join(parts, " | "), F.lit("")), F.lit("none"))


def find_span(tokens: Column, term: Column) -> Column:
    """0-based start of the first run of tokens equal to ``term``, or NULL."""
    n = F.size(tokens) - F.size(term)
    starts = F.when(n >= 0, F.sequence(F.lit(1), n + 1)).otherwise(F.array().cast("array<int>"))
    run = F.get(F.filter(starts, lambda i: F.slice(tokens, i, F.size(term)) == term), 0)
    # most terms are one token, which needs no slices
    one = F.nullif(F.array_position(tokens, F.get(term, 0)), F.lit(0)).cast("int")
    return F.when(F.size(term) == 1, one).otherwise(run) - 1


def bio_tags(tokens: Column, quads: Column) -> Column:
    """BIO tags of the aspect terms, in quadruple order, without overlaps."""
    # each step is bound once per quadruple, as lambda bodies are not shared
    terms = F.transform(
        quads,
        lambda q: F.struct(
            F.trim(F.coalesce(q["aspect_term"], F.lit(""))).alias("term"),
            F.lower(F.trim(F.coalesce(q["sentiment"], F.lit("positive")))).alias("s"),
        ),
    )
    terms = F.filter(terms, lambda t: (t["term"] != "") & t["s"].isin(K.SENTIMENTS))
    # a term that comes again finds its place taken, so only its first sentiment counts
    firsts = X.let(terms, lambda ts: F.transform(
        F.array_distinct(F.transform(ts, lambda t: t["term"])),
        lambda w: F.struct(w.alias("term"), F.get(F.filter(ts, lambda t: t["term"] == w), 0)["s"].alias("s")),
    ))
    split = F.transform(firsts, lambda t: F.struct(X.tokens(t["term"]).alias("w"), t["s"].alias("s")))
    spans = F.transform(
        split, lambda t: F.struct(find_span(tokens, t["w"]).alias("start"), F.size(t["w"]).alias("n"), t["s"].alias("s"))
    )
    spans = F.filter(spans, lambda x: x["start"].isNotNull())

    def place(tags: Column, x: Column) -> Column:
        taken = F.exists(F.slice(tags, x["start"] + 1, x["n"]), lambda t: t != "O")
        tagged = F.transform(
            tags,
            lambda t, i: F.when(i == x["start"], F.concat(F.lit("B-"), x["s"]))
            .when((i > x["start"]) & (i < x["start"] + x["n"]), F.concat(F.lit("I-"), x["s"]))
            .otherwise(t),
        )
        return F.when(taken, tags).otherwise(tagged)

    blank = F.transform(tokens, lambda t: F.lit("O"))
    return F.coalesce(F.aggregate(spans, blank, place), blank)


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)


def argmax(values: Column) -> Column:
    """0-based position of the first largest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """Unit vector; the zero vector stays itself."""
    def by(norm: Column) -> Column:
        return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / F.nullif(norm, F.lit(0.0))).otherwise(x.cast("double")))

    # the norm is bound once: within the inner lambda it would be summed up anew for every element
    return F.get(F.transform(F.array(F.sqrt(dot(v, v))), by), 0)
