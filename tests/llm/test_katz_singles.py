"""Bigrams counted once have their own discounted chance, as the registered query computes it."""

from __future__ import annotations

import collections
import math
import random
import re
import zlib

import pytest

from opinara.llm import katz, queries


def brute(rows: list[tuple]) -> dict[int, float]:
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", t), None] for i, t in rows}
    learned = [i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    one = collections.Counter(w for i in learned for w in tokens[i])
    two = collections.Counter(g for i in learned for g in zip(["<start>", *tokens[i]], tokens[i], strict=False))
    few = lambda c: {r: sum(x == r for x in c.values()) for r in range(1, 7)}
    d1, d2 = katz.discounts(few(one), 1), katz.discounts(few(two), 1)
    p1 = {w: c * d1.get(c, 1) / one.total() for w, c in one.items()}
    unknown = 1 - sum(p1.values())
    after = collections.defaultdict(dict)
    for (u, w), c in two.items():
        after[u][w] = c
    alpha, room = {}, {}
    for u, s in after.items():
        kept, count = sum(c * d2.get(c, 1) for c in s.values()), sum(s.values())
        room[u] = count + all(c > 5 for c in s.values())
        alpha[u] = (1 - kept / room[u]) / (1 - sum(p1[w] for w in s))

    def chance(u, w):
        c = after.get(u, {}).get(w)
        return c * d2.get(c, 1) / room[u] if c else alpha.get(u, 1) * p1.get(w, unknown)

    for u in after:
        assert sum(chance(u, w) for w in one) + alpha[u] * unknown == pytest.approx(1)
    return {i: sum(math.log10(chance(u, w)) for u, w in zip(["<start>", *t], t, strict=False)) for i, t in tokens.items()}


@pytest.mark.parametrize("frequent, flush", [(1 << 17, 4_000_000), (5, 200), (0, 1)])
def test_op7_keeps_bigrams_counted_once(docs_of, tmp_path, spark, monkeypatch, frequent, flush):
    monkeypatch.setattr(katz, "FREQUENT", frequent)
    monkeypatch.setattr(katz, "FLUSH", flush)
    rng, words = random.Random(4), [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, [1 / (k + 1) for k in range(60)], k=rng.randint(0, 40))) + f" rare{rng.randrange(60)} new{i}" for i in range(120)]
    rows = [*enumerate(texts), *((200 + i, texts[i]) for i in range(12)), (300, ""), (301, "always next"), *((400 + i, "always next") for i in range(9))]
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = brute(rows)
    got = {r.doc_id: r for r in queries.op7_katz_scores(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and any(r.held_out for r in got.values())
    for i, r in got.items():
        assert r.score == pytest.approx(want[i]), i
