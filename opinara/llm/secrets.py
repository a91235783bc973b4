"""Secret scans: fixed patterns, and character Markov models for strings that no pattern names.

Two first-order models, of random strings and of ordinary identifiers, are
trained from labelled samples. A candidate is a long run of key characters
with a letter and a digit; it is a secret if the ratio of its likelihoods is
large, in all and per character. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.llm.common import fresh

#: The base patterns, one per kind, and the least length of the group that counts.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]{12,}", r"[0-9a-f]{32,}"
ASSIGN_LEAST = 8
KINDS = ["assign", "access", "hex", "markov"]

KEY_CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
SAMPLE_DOCS, LONGEST_SAMPLE = 400, 200
#: A secret's log-likelihood ratio is this large in all, and this large per character.
LEAST_TOTAL, LEAST_MEAN = 15.0, 0.4
#: Share of the even distribution in each model's transition chances, so that no unseen transition decides alone.
FLAT = 0.1


SPANS = "array<struct<start:int,rank:int,end:int>>"


def _matches(text: Column) -> list[Column]:
    """What each pattern finds, by rank. The cheap tests only spare texts in which a pattern can't match."""
    every = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<string>")
    return [
        F.when(F.contains(text, F.lit("=")) | F.contains(text, F.lit(":")), every(ASSIGN)).otherwise(none),
        F.when(F.contains(text, F.lit("AKIA")), every(ACCESS)).otherwise(none),
        every(HEX),
        every(CANDIDATE),
    ]


def _spans(text: Column, found: Column, pattern: str, rank: int, passes=None) -> Column:
    """``SPANS`` of the matches ``found`` that pass: the gaps between matches give their places, in code points."""
    gaps = F.split(text, pattern, -1)
    moved = F.aggregate(
        F.arrays_zip(gaps.alias("gap"), found.alias("own")),
        F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out")),
        lambda s, x: F.struct(
            (s["at"] + F.char_length(x["gap"]) + F.coalesce(F.char_length(x["own"]), F.lit(0))).alias("at"),
            F.when(x["own"].isNull() | (~passes(x["own"]) if passes else F.lit(False)), s["out"]).otherwise(
                F.array_append(s["out"], F.struct((s["at"] + F.char_length(x["gap"])).alias("start"), F.lit(rank).alias("rank"), (s["at"] + F.char_length(x["gap"]) + F.char_length(x["own"])).alias("end")))
            ).alias("out"),
        ),
        lambda s: s["out"],
    )
    wanted = F.exists(found, passes) if passes else F.size(found) > 0
    return F.when(wanted, moved).otherwise(F.array().cast(SPANS))


def labelled_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = SAMPLE_DOCS) -> DataFrame:
    """``s, random``: strings of about ``bound`` documents, chosen by a hash of the id.

    Random: what the base patterns find, and digests of the texts in the
    alphabets of keys (hexadecimal, base 64, capitals and digits). Ordinary:
    the texts' other words, and identifiers composed of them (joined by ``_``
    or ``-``, in camel case, with numbers). Words that are candidates themselves
    have no label, and no sample is longer than ``LONGEST_SAMPLE``.
    """
    n = docs.count()
    share = F.pmod(F.xxhash64(docs[id_col], F.lit("secrets")), F.lit(1 << 20)) < F.lit(math.ceil(bound / max(1, n) * (1 << 20)))
    text = docs.filter(share).select(F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("t"))
    digest = F.unhex(F.sha2(F.concat(F.lit("sample"), F.col("t")), 512))
    random = text.select(
        F.explode(
            F.concat(
                F.regexp_extract_all("t", F.lit(ASSIGN), F.lit(2)), F.regexp_extract_all("t", F.lit(ACCESS), F.lit(0)), F.regexp_extract_all("t", F.lit(HEX), F.lit(0)),
                F.array(F.lower(F.hex(digest)), F.base64(digest), F.translate(F.upper(F.base64(digest)), "+/=", ""), F.translate(F.base64(digest), "+/=", "")),
            )
        ).alias("s")
    ).filter(F.length("s").between(16, LONGEST_SAMPLE))
    plain = F.regexp_replace(F.regexp_replace("t", ASSIGN, " "), f"{ACCESS}|{HEX}", " ")
    words = text.select(F.filter(F.regexp_extract_all(plain, F.lit("[A-Za-z0-9+/_=-]+"), F.lit(0)), lambda w: F.length(w).between(3, 19) | (F.length(w).between(20, LONGEST_SAMPLE) & ~w.rlike("[0-9]"))).alias("w"))
    pairs = words.select(F.explode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, 1_000_000_000).alias("b"))).alias("p")).select("p.a", "p.b")
    number = F.pmod(F.hash("a", "b"), F.lit(100)).cast("string")
    b = F.coalesce("b", F.lit(""))
    ordinary = pairs.select(F.explode(F.array("a", F.concat("a", F.lit("_"), b), F.concat("a", F.initcap(b)), F.concat("a", F.lit("-"), b, F.lit("-"), number), F.concat(F.upper("a"), F.lit("_"), F.upper(b), number))).alias("s"))
    return random.select("s", F.lit(True).alias("random")).unionAll(ordinary.select("s", F.lit(False).alias("random")))


def train(samples: DataFrame) -> list[float]:
    """Log ratio of the transition chances, by ``width * first + second``; index 0 is the start or any other character.

    The counts of both models are at most 2 * 68 * 68 numbers, whatever the sample.
    """
    width = len(KEY_CHARACTERS) + 1
    code = lambda c: F.instr(F.lit(KEY_CHARACTERS), c)
    steps = samples.filter(F.length("s") > 0).select("random", F.explode(F.transform(F.sequence(F.lit(1), F.length("s")), lambda i: F.struct(F.when(i > 1, code(F.col("s").substr(i - 1, F.lit(1)))).otherwise(0).alias("a"), code(F.col("s").substr(i, F.lit(1))).alias("b")))).alias("x"))
    counts = {(r.random, r.a, r.b): r.n for r in steps.groupBy("random", "x.a", "x.b").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = []
    for a in range(width):
        total = {k: sum(counts.get((k, a, b), 0) for b in range(width)) for k in (True, False)}
        share = lambda k, b: (1 - FLAT) * counts.get((k, a, b), 0) / total[k] + FLAT / width if total[k] else 1 / width  # noqa: B023, E731
        out += [math.log(share(True, b)) - math.log(share(False, b)) for b in range(width)]
    return out


def log_ratio(s: Column, model: list[float]) -> Column:
    """Sum over the characters of ``s``; the model is a constant array of fixed size."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    codes = F.transform(F.split(s, ""), lambda c: F.instr(F.lit(KEY_CHARACTERS), c))
    step = lambda st, c: F.struct(c.alias("a"), (st["sum"] + F.element_at(table, st["a"] * (len(KEY_CHARACTERS) + 1) + c + 1)).alias("sum"))
    return F.aggregate(codes, F.struct(F.lit(0).alias("a"), F.lit(0.0).alias("sum")), step, lambda st: st["sum"])


def with_spans(docs: DataFrame, model: list[float], column: str, text_col: str = "text") -> DataFrame:
    """``docs`` and an array ``column`` of ``(start, rank, end)``, by start, then rank: base spans, and model spans that touch no base span."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))

    def long_value(m: Column) -> Column:
        return F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_LEAST

    def looks_random(m: Column) -> Column:
        ratio = log_ratio(m, model)
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]") & (ratio >= F.greatest(F.lit(LEAST_TOTAL), LEAST_MEAN * F.char_length(m)))

    found = [f"{column}_{i}" for i in range(4)]
    rows = docs.withColumns(dict(zip(found, _matches(text), strict=True)))
    tests = [(ASSIGN, long_value), (ACCESS, None), (HEX, None), (CANDIDATE, looks_random)]
    rows = rows.withColumns({c: _spans(text, F.col(c), p, i, test) for i, (c, (p, test)) in enumerate(zip(found, tests, strict=True))})
    apart = F.filter(found[3], lambda x: ~F.exists(F.concat(*found[:3]), lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])))
    return rows.withColumn(column, F.array_sort(F.concat(*found[:3], apart))).drop(*found)


def joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["rank"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans`` for each row of ``docs``.

    A null text is empty: no span, and the SHA-256 of the empty string. A model
    of an empty table calls nothing random. Repeated rows get equal results.
    """
    model = train(labelled_samples(docs, id_col, text_col))
    rows = with_spans(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), model, "s").drop("text")
    count = lambda rank: F.size(F.filter("s", lambda x: x["rank"] == rank)).cast("long")
    base = F.filter("s", lambda x: x["rank"] < 3)
    return rows.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"))


def without_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs``, all rows and columns, with every secret in the texts masked and ``chars_col``, if there is one, counted anew for those texts."""
    model, spans = train(labelled_samples(docs, id_col, text_col)), fresh(docs, "secret_spans")
    rows = with_spans(docs, model, spans, text_col)
    rows = rows.withColumn(text_col, F.when(F.size(spans) > 0, masked(F.col(f"`{text_col}`"), F.col(spans))).otherwise(F.col(f"`{text_col}`")))
    if chars_col in docs.columns:
        rows = rows.withColumn(chars_col, F.when(F.size(spans) > 0, F.char_length(text_col).cast(docs.schema[chars_col].dataType)).otherwise(F.col(f"`{chars_col}`")))
    return rows.drop(spans)


def masked(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """``text`` with each span, overlapping ones together, replaced by ``mask``."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(st: Column, x: Column) -> Column:
        gap = F.greatest(x["start"] - st["at"], F.lit(0))
        shown = F.when((x["start"] < st["at"]) & (st["at"] > 0), st["out"]).otherwise(F.concat(st["out"], F.substring(text, st["at"] + 1, gap), F.lit(mask)))
        return F.struct(F.greatest(st["at"], x["end"]).alias("at"), shown.alias("out"))

    rest = lambda st: F.concat(st["out"], F.substring(text, st["at"] + 1, F.char_length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, rest)).otherwise(text)
