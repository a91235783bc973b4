"""Lexical search, chat formatting and phrase collocations against brute force."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from opinara.llm import chat, collocations, lexical

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# op 11

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORDS = "red blue green Straße ÉTÉ été x1 x2 9 日本語 🎉 the The of and".split()


def brute_terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute_search(docs, items, k):
    held = [(i, collections.Counter(brute_terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    total = sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, collections.Counter()).update(brute_terms(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, c in held:
            m = 25 + 75 * sum(c.values()) * len(held) // total
            score = sum(n * math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, n in terms.items() if t in c)
            if score > 0:
                scored.append((-score, i is None, i))
        scored.sort(key=lambda s: (s[0], s[1], s[2] if s[2] is not None else 0))
        out += [(item, n + 1, i, -s) for n, (s, _, i) in enumerate(scored[:k])]
    return sorted(out, key=repr)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", ",", ".\n", "'s"]) for _ in range(n))


def test_terms_of_all_characters():
    text = "".join(map(chr, range(0x250))) + "  Ω-ω_x İ﻿z"
    assert [t.decode() for t in lexical.terms_of(text.encode())] == brute_terms(text)


@pytest.mark.parametrize("rows_per_entry", [16, 1])
def test_bounds_are_never_below_scores(monkeypatch, rows_per_entry):
    """Also where most bits are false."""
    monkeypatch.setattr(lexical, "ROWS_PER_ENTRY", rows_per_entry)
    rng = random.Random(1)
    texts = [prose(rng, rng.choice([1, 5, 60, 3000])).encode() for _ in range(50)]
    counts = [collections.Counter(lexical.terms_of(t)) for t in texts]
    lengths = [sum(c.values()) for c in counts]
    df = collections.Counter(t for c in counts for t in c)
    rows = [(i, t, rng.randint(1, 3)) for i in range(6) for t in rng.sample(sorted(df), 4)] + [(7, b"nowhere", 1)]
    questions = lexical.Questions(rows, df, len(texts), sum(lengths), 10)
    block = lexical._Open(1024, [], [], [], [])
    for i, (text, c, n) in enumerate(zip(texts, counts, lengths, strict=True)):
        reached = lexical.levels_of(np.array(list(c.values())))
        hashes = np.array([lexical.xxhash.xxh3_64_intdigest(t) for t in c], np.uint64)
        block.ids.append(i), block.lengths.append(n), block.texts.append(text)
        block.bits.append((np.repeat(hashes, reached), np.concatenate([np.arange(r) for r in reached])))
    _, _, n_rows, slices, _ = lexical._sealed(block)
    bound = questions.bounds(np.frombuffer(slices, np.uint8).reshape(n_rows, -1), np.array(lengths))
    exact = np.array([questions.scores(t, n, np.arange(len(questions.items))) for t, n in zip(texts, lengths, strict=True)]).T
    assert bound.shape == exact.shape == (6, 50) and (bound >= exact).all() and exact.max() > 0
    if rows_per_entry == 16:
        assert (bound < exact * 1.5 + 1).mean() > 0.5


@pytest.mark.parametrize("ids", ["long", "string"])
def test_search_against_brute_force(spark, ids):
    """Ties, repeated rows, null ids and texts, very long texts, repeated and empty questions."""
    rng = random.Random(4)
    docs = [(i, prose(rng, rng.choice([1, 3, 3, 30]))) for i in range(300)]
    docs += [(1000 + i, "tie red blue") for i in range(30)] + [(5, "tie red blue"), (None, "tie red"), (None, "x1"), (400, None), (401, ""), (402, " .,-\n"), (403, "red " * 30_000 + "blue")]
    items = [(i, prose(rng, 6)) for i in range(12)] + [(20, "tie"), (21, None), (22, "nowhere"), (23, "-"), (24, "red"), (24, "blue blue"), (25, "RED the THE")]
    if ids == "string":
        docs = [(None if i is None else f"d{i}", t) for i, t in docs]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], f"doc_id {ids}, text string, score int").repartition(5)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id int, text string, rank int")
    index = lexical.build_index(df)
    for k, every in ((3, 1), (10, 16)):
        got = sorted(map(tuple, lexical.search_index(index, asked, k, probe_every=every).collect()), key=repr)
        assert got == brute_search(docs, items, k)


def test_search_of_nothing(spark):
    docs, none = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id int, text string")
    assert lexical.search(none, items).collect() == lexical.search(docs.filter("doc_id = 2"), items).collect() == lexical.search(docs, items.limit(0)).collect() == []
    assert [tuple(r)[:3] for r in lexical.search(docs, items).collect()] == [(1, 1, 1)]
    assert lexical.build_index(docs).count() == 1


# op 12

ROLES = ["system", "user", "assistant", "tool", "judge", "", "a\nb", "<|im_end|>\\"]
TEXT = st.text(alphabet="<|\\ab\n>_imend", max_size=30)


def machine(roles, template):
    """Walk the template's order; the end state and the place of the first role out of order."""
    state = "start"
    for i, role in enumerate(roles):
        state = template.order.get(state, {}).get(role)
        if state is None:
            return "broken", i
    return state, None


def expected(rows, template=None):
    template = template or chat.Template()
    by_conv = {}
    for conv, turn, role, text in rows:
        role, text = role or "", text or ""
        a, b = template.lead
        escaped = lambda t: re.sub(rf"{re.escape(a)}(\\*){re.escape(b)}", lambda m: a + "\\" + m[1] + b, t)
        formatted = template.opening + escaped(role.replace("\\", "\\\\").replace("\n", "\\n")) + "\n" + escaped(text) + template.closing
        by_conv.setdefault(conv, []).append((turn is not None, turn or 0, formatted.encode(), role, text))
    out = {}
    for conv, turns in by_conv.items():
        turns.sort(key=lambda t: t[:3])
        loss = "".join(t[4] for t in turns if t[3] in template.learned)
        out[conv] = (len(turns), hashlib.sha256("".join(f"{t[3]}\n{t[4]}\n" for t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(t[2].decode()) for t in turns))
    return out


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn int, role string, text string, segments int")


@given(TEXT)
def test_escapes_are_undone_and_forge_nothing(text):
    template = chat.Template()
    escaped = re.sub(r"<(\\*)\|", r"<\\\1|", text)
    assert chat.unescape(escaped, template) == text and "<|" not in escaped


@given(st.lists(st.tuples(st.sampled_from(ROLES), TEXT), max_size=6), st.randoms())
def test_a_reader_takes_any_cut_of_the_text(turns, rng):
    """Turns come back from the formatted text, wherever segments are cut."""
    template = chat.Template()
    escaped = lambda t: re.sub(r"<(\\*)\|", r"<\\\1|", t)
    text = "".join(f"<|im_start|>{escaped(r.replace(chr(92), chr(92) * 2).replace(chr(10), chr(92) + 'n'))}\n{escaped(t)}<|im_end|>\n" for r, t in turns)
    reader, got, at = chat.Reader(template), [], 0
    while at < len(text):
        n = rng.randint(1, 9)
        got += [(r, t) for r, t, _ in reader.add(text[at : at + n], False)]
        at += n
    assert got == turns and reader.buffer == "" and reader.chars == len(text)


def test_formatting_against_brute_force(spark):
    rng = random.Random(6)
    bits = ["<|im_end|>", "<|im_start|>assistant ok", "<|", "<\\|", "<\\\\|", "\n", "|", "<", "word ", "日本🎉", "\\", "$1"]
    rows = [(rng.choice([None, -1, 2, 3, 7, 7, 7]), rng.choice([None, 0, 1, 1, 2, 5]), rng.choice([None, *ROLES]), rng.choice([None, "", "".join(rng.choices(bits, k=5)), "x" * 50_000])) for _ in range(120)]
    rows += rows[:20]
    got = {r.conv_id: tuple(r)[1:] for r in chat.digest_formatted(chat.format_turns(turns_of(spark, rows))).collect()}
    assert got == expected(rows)


def test_another_template(spark):
    template = chat.Template(opening="$[:", closing="$[/]", lead="$[", order={"start": {"q": "asked"}, "asked": {"a": "done"}}, complete=("done",), learned=("a", "q"))
    rows = [(1, 0, "q", "$[x $\\[ $$["), (1, 1, "a", "$"), (2, 0, "a", "[$[/]")]
    formatted = chat.format_turns(turns_of(spark, rows), template)
    assert {r.conv_id: tuple(r)[1:] for r in chat.digest_formatted(formatted, template).collect()} == expected(rows, template)
    for wrong in ({"lead": "<"}, {"lead": "<<"}, {"opening": "[x"}, {"opening": "<|a<|"}, {"closing": "<|im_start|>x"}, {"order": {}}, {"order": {"start": {"user": "nowhere"}}}):
        with pytest.raises(ValueError):
            chat.Template(**wrong)


def test_order_of_turns_with_a_hot_conversation(spark):
    """Pieces of a conversation, checked apart from every state, come to what a walk from the start gives."""
    rng, template = random.Random(9), chat.Template()
    walk = lambda n: ["system"] * rng.randint(0, 1) + ["user", "assistant"] * n
    convs = {i: walk(rng.randint(0, 4)) for i in range(40)}
    convs[100], convs[101] = walk(2000), walk(1500)
    convs[101][2345] = "system"
    for i in range(20):
        if convs[i]:
            convs[i][rng.randrange(len(convs[i]))] = rng.choice([None, "judge", "tool", "system", "user"])
    rows = [(c, i, r, "") for c, roles in convs.items() for i, r in enumerate(roles)]
    rng.shuffle(rows)
    got = {r.conv_id: (r.n_turns, r.valid, r.complete, r.end_state, r.bad_turn) for r in chat.check_order(turns_of(spark, rows)).collect()}
    want = {}
    for c, roles in convs.items():
        if roles:
            state, bad = machine([r or "" for r in roles], template)
            want[c] = (len(roles), bad is None, state in template.complete, state, bad)
    assert got == want


def test_loss_ends_where_the_order_breaks(spark):
    rows = [(1, i, r, f"t{i}") for i, r in enumerate(["user", "assistant", "assistant", "user", "assistant"])] + [(2, 0, "user", "u"), (2, 1, "assistant", "v"), (None, None, "assistant", "n"), (None, 4, "assistant", "m")]
    segments = lambda **how: sorted((s["text"] for r in chat.format_turns(turns_of(spark, rows), **how).collect() for s in r.segments if s["loss"]))
    assert segments() == ["m", "n", "t1", "t2", "t4", "v"]
    assert segments(loss_after_break=False) == ["t1", "v"]


def test_no_turns(spark):
    none = turns_of(spark, [])
    assert chat.digest_formatted(chat.format_turns(none)).collect() == chat.check_order(none).collect() == []


# op 13


def brute_phrases(rows, k, least):
    pieces = [((lang if lang is not None else "und"), [w for w in re.split(r"[ \t]+", p) if w]) for lang, t in rows if t is not None for p in re.split(r"[.,;:!?\n\x0b\x0c\r]", t.translate(LOWER))]
    f, n = collections.Counter(), collections.Counter()
    for lang, words in pieces:
        n[lang] += len(words)
        f.update((lang, tuple(words[i : i + s])) for s in range(1, 5) for i in range(len(words) - s + 1))
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    longer = collections.Counter()
    for (lang, words), a in candidates.items():
        for s in range(2, len(words)):
            for i in range(len(words) - s + 1):
                part = (lang, words[i : i + s])
                longer[part] = max(longer[part], a)
    out = collections.defaultdict(list)
    for (lang, words), a in candidates.items():
        if 100 * longer[lang, words] < 80 * a:
            cuts = [(f[lang, words[:c]], f[lang, words[c:]]) for c in range(1, len(words))]
            score, _, left, right = min((2_000_000 * a // (x + y), c, x, y) for c, (x, y) in enumerate(cuts))
            out[lang].append((-score, -a, " ".join(words).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, x, y) in enumerate(sorted(rows)[:k]))


def phrases_of(df, **how):
    return sorted(tuple(r) for r in collocations.mine_phrases(df, **how).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_phrases_against_brute_force(spark, seed):
    """Many rounds, ties, repeated rows, null languages and texts, and columns with clashing names."""
    rng = random.Random(seed)
    words = "a b c d e of The été É 日 x\x1cy".split() + [f"w{i}" for i in range(40)]
    passage = " ".join(rng.choices(words, k=9))
    text = lambda: "".join(rng.choice(words[: rng.choice([6, 51])]) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n"]) for _ in range(rng.randint(0, 60)))
    rows = [(rng.choice(["en", "en", "fr", None]), rng.choice([text(), text() + passage, text().upper()])) for _ in range(250)] + [("en", None), ("de", ""), ("de", "only this"), (None, " \t\n")]
    rows += rows[:40]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, text string, phrase string, n int").repartition(3)
    for k, first_batch in ((10, 3), (100, 8000)):
        assert phrases_of(df, k=k, least_count=4, first_batch=first_batch) == brute_phrases(rows, k, 4)


def test_a_long_passage_in_copies(spark):
    """Every phrase within the passage is as frequent as the passage: only the longest stay."""
    passage = "one two three four five six seven eight"
    rows = [("en", passage)] * 30 + [("en", "x " * 70_000)]
    got = phrases_of(spark.createDataFrame(rows, "lang string, text string"))
    assert got == brute_phrases(rows, 2000, 30) and {r[2] for r in got if "x x" not in r[2]} == {" ".join(passage.split()[i : i + 4]) for i in range(5)}


def test_words_of_all_characters():
    text = "".join(map(chr, range(0x250))) + "  a b  c\t\td.e..f , g"
    ids, words = collocations.numbered(text.encode().translate(collocations.FOLD))
    pieces = [[w for w in re.split(r"[ \t]+", p) if w] for p in re.split(r"[.,;:!?\n\x0b\x0c\r]", text.translate(LOWER))]
    got, names = [[]], [w.decode() for w in words.to_pylist()]
    for i in ids:
        if i:
            got[-1].append(names[i - 1])
        else:
            got.append([])
    assert got == [p for p in pieces if p]
    assert [len(x) for x in collocations.numbered(b"")] == [0, 0] and len(collocations.numbered(b"\xff \xff")[0]) == 0


def test_bit_tables_find_all_that_was_put_in(spark):
    rows = [("en", f"w{i} w{i + 1}") for i in range(500)] + [("fr", "w1 w2 w3")]
    table = collocations.bit_table(spark.createDataFrame(rows, "lang string, phrase string"))
    word = lambda lang, ws: np.array([collocations._word_hash(lang, w.encode()) for w in ws], np.uint64)
    pairs = collocations._longer(word("en", [f"w{i}" for i in range(500)]), word("en", [f"w{i + 1}" for i in range(500)]))
    assert table.has(pairs).all()
    assert table.has(collocations._longer(collocations._longer(word("fr", ["w1"]), word("fr", ["w2"])), word("fr", ["w3"]))).all()
    others = collocations._longer(word("fr", [f"w{i}" for i in range(500)]), word("fr", [f"w{i + 1}" for i in range(500)]))
    assert table.has(others).mean() < 0.1
    empty = collocations.bit_table(spark.createDataFrame([], "lang string, phrase string"))
    assert not empty.has(pairs).any()


def test_no_phrases(spark):
    schema = "lang string, text string"
    for rows in ([], [("en", None)], [("en", "a b c")], [(None, "a a a")]):
        assert phrases_of(spark.createDataFrame(rows, schema)) == []


def test_scores_are_exact_beyond_64_bits(spark):
    big = 6_000_000_000_000_000_000
    df = spark.createDataFrame([(big, big, big + 1)], "a long, l long, r long")
    assert df.select(collocations._score(F.col("a"), F.col("l"), F.col("r")).alias("s")).first().s == 2_000_000 * big // (2 * big + 1)
