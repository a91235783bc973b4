"""Training data: samples, splits, oversampling, vocabulary, exports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara import constants as K
from opinara.functions import arrays as R
from opinara.functions import text as X
from opinara.operators.ranking import number_rows, rank_in_group, seeded_hash, top_rows


def training_samples(annotated: DataFrame) -> DataFrame:
    """Annotated reviews with text of three characters or more, and their labels."""
    out = annotated.withColumn("text", X.strip_ws(F.coalesce("text", F.lit("")))).filter(F.length("text") >= 3)
    return out.select(
        "review_id", "text", R.label_vector(F.col("quadruples")).alias("labels"), "quadruples", F.lit(False).alias("is_augmented")
    )


def quota_sample(annotated: DataFrame, n_samples: int = 200, seed: int = 42, order: Column | None = None) -> DataFrame:
    """10 % conflicting reviews, 20 % with three or more quadruples, the rest plain.

    Each stratum is capped by what there is. The draw is the head of a seeded
    order, so it repeats; ``order`` replaces that order.
    """
    stratum = F.when(F.col("conflict"), "conflict").when(F.size("quadruples") >= 3, "multi").otherwise("normal")
    draw = seeded_hash(seed, "review_id") if order is None else order
    rows = annotated.withColumns({"stratum": stratum, "__draw": draw})
    # no stratum gives more than n_samples, so the cut before the shuffle is small
    head = top_rows(rows, ["stratum"], ["__draw", "review_id"], n_samples, rank="__n").drop("__draw")
    sizes = head.groupBy().agg(
        *[F.count(F.when(F.col("stratum") == s, 1)).alias(s) for s in ("conflict", "multi")]
    ).select(
        F.least(F.lit(int(n_samples * 0.10)), "conflict").alias("conflict"), F.least(F.lit(int(n_samples * 0.20)), "multi").alias("multi")
    )
    conflict, multi = sizes.select("conflict").scalar(), sizes.select("multi").scalar()
    quota = F.when(F.col("stratum") == "conflict", conflict).when(F.col("stratum") == "multi", multi).otherwise(n_samples - conflict - multi)
    return head.filter(F.col("__n") <= quota).drop("__n")


def stratified_split(samples: DataFrame, seed: int = 42, draw: Column | None = None) -> DataFrame:
    """70/15/15 split inside strata of the first two present categories.

    Strata under four rows are put together. The rank in a stratum is exact
    even if one stratum holds most rows.
    """
    present = F.filter(F.transform("labels", lambda v, i: F.when(v != 0, i)), lambda i: i.isNotNull())
    key = F.coalesce(F.nullif(F.array_join(F.slice(present, 1, 2), "_"), F.lit("")), F.lit("empty"))
    rows = samples.withColumn("stratum", key)
    sizes = rows.groupBy("stratum").agg(F.count("*").alias("__rows"))
    rows = rows.join(sizes, "stratum").withColumn("stratum", F.when(F.col("__rows") >= K.MIN_STRATUM, F.col("stratum")).otherwise("other"))
    rows = rows.drop("__rows").withColumn("__draw", seeded_hash(seed, "review_id") if draw is None else draw)
    ranked = rank_in_group(rows, ["stratum"], "__draw", ["review_id"], "__n", total="__total")
    share = (F.col("__n") - 0.5) / F.col("__total")
    train, val, _ = K.SPLIT_SHARES
    split = F.when(share <= train, "train").when(share <= train + val, "val").otherwise("test")
    return ranked.withColumn("split", split).drop("__n", "__total", "__draw")


def unit_number(seed: int, *cols: Column | str) -> Column:
    """Repeatable number in [0, 1) from a hash."""
    return F.pmod(seeded_hash(seed, *cols), F.lit(1_000_003)) / F.lit(1_000_003.0)


def digest_number(seed: int, *cols: Column | str) -> Column:
    """The same from an md5, which other engines have too."""
    text = F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") if isinstance(c, Column) else c for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def word_dropout(text: Column, rate: float, seed: int, key: Column, number: Callable[..., Column] = unit_number) -> Column:
    """Drop words at the given rate; short texts and results stay whole. ``number`` draws from seed, key and place."""
    def joined(words: Column) -> Column:
        kept = F.filter(words, lambda w, i: number(seed, key, i) > rate)
        return F.when(F.size(words) <= 4, text).otherwise(X.let(kept, lambda k: F.when(F.size(k) < 3, text).otherwise(F.array_join(k, " "))))

    return X.let(X.words(text), joined)


def _swapped(words: Column, places: Column) -> Column:
    """``words`` with the pairs that begin at ``places`` swapped, in order of their rounds.

    Pairs that share no word are swapped in any order. So the places, structs
    of ``p`` and ``r`` sorted by ``p``, fall into runs of neighbours, each of
    which is swapped by itself: every word is copied a few times, however many
    rounds there are.
    """
    at = lambda j: F.get(places, j)["p"]
    starts = F.filter(F.sequence(F.lit(0), F.size(places) - 1), lambda j: (j == 0) | (at(j) - at(j - 1) > 1))

    def swap(acc: Column, q: Column) -> Column:
        return F.concat(F.slice(acc, 1, q), F.slice(acc, q + 2, 1), F.slice(acc, q + 1, 1), F.slice(acc, q + 3, F.size(acc)))

    def pieces(starts: Column) -> Column:
        def piece(first: Column, k: Column) -> Column:
            until = F.coalesce(F.get(starts, k + 1), F.size(places))
            before = F.when(first == 0, 0).otherwise(at(first - 1) + 2)
            own = F.slice(words, at(first) + 1, at(until - 1) + 2 - at(first))
            rounds = F.array_sort(F.transform(F.slice(places, first + 1, until - first), lambda s: F.struct(s["r"], s["p"])))
            return F.concat(F.slice(words, before + 1, at(first) - before), F.aggregate(rounds, own, lambda acc, s: swap(acc, s["p"] - at(first))))

        return F.concat(F.flatten(F.transform(starts, piece)), F.slice(words, at(F.size(places) - 1) + 3, F.size(words)))

    return X.let(starts, pieces)


def word_swap(text: Column, seed: int, key: Column, number: Callable[..., Column] = unit_number) -> Column:
    """Swap max(1, n // 20) pairs of neighbours; under four words nothing. ``number`` draws from seed, key and round."""
    def joined(words: Column) -> Column:
        n = F.size(words)
        rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(n / 20)).cast("int"))
        place = lambda r: F.struct(F.floor(number(seed, key, r) * (n - 1)).cast("int").alias("p"), r.alias("r"))
        places = F.array_sort(F.transform(rounds, place))
        return F.when(n < 4, text).otherwise(F.array_join(X.let(places, lambda p: _swapped(words, p)), " "))

    return X.let(X.words(text), joined)


def oversample(train: DataFrame, seed: int = 42, number: Callable[..., Column] = unit_number) -> DataFrame:
    """Five changed copies of rows with a neutral label, one of rows with a negative one.

    A row can be in both groups. Copies are made in place, without a shuffle.
    """
    has = lambda code: F.array_contains("labels", F.lit(code))
    five = F.sequence(F.lit(1), F.lit(5))
    none = F.array().cast("array<int>")
    copies = F.concat(F.array(F.lit(0)), F.when(has(2), five).otherwise(none), F.when(has(3), F.array(F.lit(6))).otherwise(none))
    rows = train.withColumn("copy", F.explode(copies)).withColumn("__key", F.concat_ws("#", "review_id", F.col("copy").cast("string")))
    text, key, c = F.col("text"), F.col("__key"), F.col("copy")
    drop = lambda t, rate: word_dropout(t, rate, seed, key, number)
    swapped = word_swap(text, seed, key, number)
    changed = (
        F.when(c == 1, drop(text, 0.10)).when(c == 2, drop(text, 0.08)).when(c == 3, swapped)
        .when(c == 4, drop(swapped, 0.06)).when(c == 5, drop(text, 0.12)).when(c == 6, drop(text, 0.08)).otherwise(text)
    )
    return rows.withColumns({"text": changed, "is_augmented": c > 0}).drop("__key")


def vocabulary(samples: DataFrame, text: str = "text", min_freq: int = 2, max_size: int | None = None) -> DataFrame:
    """Token ids from 2 in order of frequency, with PAD 0 and UNK 1.

    The ``max_size`` leading tokens, or all. Words are numbered inside ranges
    and shifted by the sizes of the ranges before, so no task orders them all.
    """
    counts = samples.select(F.explode_outer(X.tokens(text)).alias("word")).groupBy("word").agg(F.count("*").alias("freq"))
    counts = counts.filter(F.col("word").isNotNull() & (F.col("freq") >= min_freq))
    numbered = number_rows(counts, [F.desc("freq"), "word"], "id")
    if max_size is not None:
        numbered = numbered.filter(F.col("id") <= max_size)
    numbered = numbered.select("word", (F.col("id") + 1).cast("int").alias("id"), "freq")
    spark = samples.sparkSession
    special = spark.range(1).select(
        F.explode(F.array(
            F.struct(F.lit("<PAD>").alias("word"), F.lit(0).alias("id")), F.struct(F.lit("<UNK>").alias("word"), F.lit(1).alias("id"))
        )).alias("s")
    ).select("s.word", "s.id", F.lit(0).cast("bigint").alias("freq"))
    return special.unionByName(numbered)


def bio_blocks(samples: DataFrame) -> DataFrame:
    """BIO text block of each sample."""
    rows = samples.withColumn("tokens", X.tokens("text")).withColumn("tags", R.bio_tags(F.col("tokens"), F.col("quadruples")))
    head = F.concat(F.lit("# labels: "), F.array_join(F.transform("labels", lambda v: v.cast("string")), " "))
    body = F.array_join(F.zip_with("tokens", "tags", lambda t, g: F.concat(t, F.lit("\t"), g)), "\n")
    return rows.select("review_id", F.concat(head, F.lit("\n"), body, F.lit("\n")).alias("block"))


def label_columns(samples: DataFrame) -> DataFrame:
    """Text with one column per label."""
    return samples.select("text", *[F.get("labels", i).alias(f"label_{i}") for i in range(len(K.CATEGORIES))])


def target_rows(samples: DataFrame) -> DataFrame:
    return samples.select("text", R.target_string(F.col("labels")).alias("target"))


def split_report(samples: DataFrame) -> DataFrame:
    """Samples, multi-aspect share and label counts of each split, as long rows."""
    from opinara.functions.numbers import round_up

    present = F.size(F.filter("labels", lambda v: v != 0))
    head = samples.groupBy("split").agg(F.count("*").alias("samples"), F.count(F.when(present > 1, 1)).alias("multi"))
    facts = head.select("split", F.explode(F.array(
        F.struct(F.lit("samples").alias("kind"), F.lit("all").alias("name"), F.col("samples").cast("double").alias("value")),
        F.struct(F.lit("multi_aspect").alias("kind"), F.lit("count").alias("name"), F.col("multi").cast("double").alias("value")),
        F.struct(F.lit("multi_aspect").alias("kind"), F.lit("percent").alias("name"),
                 round_up(F.col("multi") * 100 / F.col("samples"), 1).alias("value")),
    )).alias("f")).select("split", "f.*")
    flat = samples.select("split", F.posexplode("labels").alias("i", "v")).filter(F.col("v") != 0)
    names, kinds = F.array(*[F.lit(c) for c in K.CATEGORIES]), F.array(*[F.lit(s) for s in K.LABEL_NAMES])
    counts = flat.groupBy("split", "i", "v").agg(F.count("*").alias("n"))
    both = counts.select("split", "n", F.explode(F.array(
        F.struct(F.lit("category").alias("kind"), F.element_at(names, F.col("i") + 1).alias("name")),
        F.struct(F.lit("sentiment").alias("kind"), F.element_at(kinds, F.col("v") + 1).alias("name")),
    )).alias("k"))
    return facts.unionByName(both.groupBy("split", "k.kind", "k.name").agg(F.sum("n").cast("double").alias("value")))
