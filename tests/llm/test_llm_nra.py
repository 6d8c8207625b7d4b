"""NRA search against a plain ranking of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from cases import documents, frame, words

from lodestone.llm import nra

ITEMS = "item_id long, text string"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, k):
    found = [Counter(terms(r[1])) for r in rows]
    n = [sum(f.values()) for f in found]
    docs, length = sum(x > 0 for x in n), sum(n)
    df = Counter(t for f in found for t in f)
    out = []
    for item_id, text in dict.fromkeys(items):
        scores = []
        for r, f, size in zip(rows, found, n):
            s = 0
            for t, c in Counter(terms(text)).items():
                if f[t]:
                    w = math.floor(1000 * math.log((2 * docs + 2) / (2 * df[t] + 1)))
                    s += c * w * (1000000000 * f[t] // (1000 * f[t] + 12 * (75 + 25 * size * docs // length)))
            if s > 0:
                scores.append((-s, r[0] is None, r[0] or 0))
        out += [(item_id, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def got(spark, rows, items, k=20, **more):
    return sorted((tuple(r) for r in nra.ranked(frame(spark, rows), frame(spark, items, ITEMS, 3), k, **more).collect()), key=repr)


@pytest.mark.parametrize("k,shard,block", [(20, nra.SHARD, nra.BLOCK), (3, 8, 30)])
def test_nra_ranks_like_a_plain_scan(spark, monkeypatch, k, shard, block):
    monkeypatch.setattr(nra, "SHARD", shard)
    monkeypatch.setattr(nra, "FIRST", 2)
    rng = random.Random(k)
    rows = documents(seed=k, n=80) + [(200 + i, " ".join(rng.choices(["the", "of", "a", *"bcdefghijklmnop"], weights=[30, 20, 10, *range(1, 16)], k=rng.randint(1, 60))), "en", "s", 0)
                                      for i in range(150)]
    items = [(1, "the of a"), (2, rows[3][1]), (3, "b c the The THE"), (4, None), (5, "zzz notthere"), (6, "!!"), (7, "k"), (7, "k"), (8, words(rng, 40)), (None, "of d")]
    assert got(spark, rows, items, k, block=block) == brute(rows, items, k)


def test_intervals_resolve_like_full_sums_and_stop_early():
    rng = np.random.default_rng(5)
    saved = 0
    for trial in range(200):
        size, k = int(rng.integers(1, 400)), int(rng.integers(1, 12))
        lists = []
        for _ in range(rng.integers(1, 8)):
            docs = rng.permutation(size)[: rng.integers(1, size + 1)].astype(np.uint32)
            gain = np.sort(rng.integers(1, 10 ** rng.integers(1, 9), len(docs)))[::-1].astype(np.int64)
            lists.append((docs, gain, int(rng.integers(1, 4))))
        full = np.zeros(size, np.int64)
        for docs, gain, c in lists:
            full[docs] += gain * c
        kth = max(1, np.sort(full)[::-1][k - 1] if size >= k else 1)
        floor = int(rng.choice([0, kth, kth // 2]))
        docs, score, read = nra.nra(lists, size, k, floor)
        want = np.flatnonzero(full >= kth)
        assert set(want) <= set(docs.tolist()) and (score == full[docs]).all()
        assert (np.sort(score)[::-1][:k] == np.sort(full[full > 0])[::-1][:k]).all()
        saved += sum(len(g) for _, g, _ in lists) - read
    assert saved > 0


def test_ties_copies_and_clashing_columns(spark):
    rows = [(i % 7 if i % 11 else None, "same words here", "", "", 0) for i in range(60)] + [(i, "x" * 30, "", "", 0) for i in range(30)]
    items = [(1, "same words"), (2, "words")]
    assert got(spark, rows, items) == brute(rows, items, 20)
    clash = frame(spark, rows).selectExpr("doc_id", "text", "1 AS row", "2 AS n", "'t' AS term", "0 AS impact")
    more = frame(spark, items, ITEMS).selectExpr("*", "1 AS item", "2 AS c", "3 AS hash")
    assert sorted((tuple(r) for r in nra.ranked(clash, more).collect()), key=repr) == brute(rows, items, 20)


def test_empty_tables_and_long_texts(spark):
    rng = random.Random(9)
    rows = [(1, words(rng, 60_000), "", "", 0), (2, "a " * 200_000, "", "", 0), (3, "b", "", "", 0)]
    items = [(1, rows[0][1]), (2, "a b")]
    assert got(spark, rows, items) == brute(rows, items, 20)
    assert got(spark, [], items) == got(spark, rows, []) == got(spark, [(1, None, "", "", 0)], items) == []
