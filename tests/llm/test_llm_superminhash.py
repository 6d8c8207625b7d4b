"""SuperMinHash near copies against brute force over all pairs."""

import random
import re

import numpy as np
from cases import documents, frame, words

from lodestone.llm import superminhash as sm


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    """doc_id -> (size, component), by all pairs."""
    sets = []
    for _, text, *_ in rows:
        found = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
        sets.append({tuple(found[i:i + 4]) for i in range(max(1, len(found) - 3))} if found else set())
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[top(i)] = top(j)
    ids = {}
    for i, r in enumerate(rows):
        ids.setdefault(top(i), []).append(r[0])
    least = {k: min((i for i in v if i is not None), default=None) for k, v in ids.items()}
    return sorted(((r[0], len(sets[i]), least[top(i)]) for i, r in enumerate(rows)), key=repr)


def edited(rng, text, share):
    found = text.split()
    for _ in range(int(len(found) * share)):
        found[rng.randrange(len(found))] = "".join(rng.choices("abcde", k=5))
    return " ".join(found)


def family(rng, first, n, size, share):
    base = words(rng, size)
    return [(first + i, base if i == 0 else edited(rng, base, share), "en", "s", 0) for i in range(n)]


def classes(spark, rows):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in sm.op13_superminhash(frame(spark, rows)).collect()), key=repr)


def test_all_links_are_found(spark):
    rng = random.Random(5)
    rows = documents(n=60)
    for i, (size, share) in enumerate([(300, 0.01), (300, 0.03), (200, 0.04), (120, 0.05), (60, 0.02), (9, 0.1), (5, 0.2)]):
        rows += family(rng, 1000 * (i + 1), 25, size, share)
    rng.shuffle(rows)
    assert classes(spark, rows) == brute(rows)


def test_crowded_buckets_give_the_same_links(spark, monkeypatch):
    monkeypatch.setattr(sm, "BUCKET", 5)
    monkeypatch.setattr(sm.near_links, "__defaults__", (sm.WORDS, 5))
    rng = random.Random(6)
    rows = family(rng, 0, 60, 100, 0.04)[1:] + family(rng, 500, 40, 80, 0.05)[1:]
    assert classes(spark, rows) == brute(rows)


def test_kept_is_one_of_each_class_and_other_columns_are_ignored(spark):
    rows = documents()
    out = sm.op13_superminhash(frame(spark, rows).selectExpr("doc_id", "text", "1 AS n", "'x' AS node", "2 AS `group`", "3 AS bands")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=repr) == brute(rows)
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in out)
    assert sm.op13_superminhash(frame(spark, [])).count() == 0
    assert classes(spark, [(None, "a b", "", "", 0), (None, "A  b", "", "", 0)]) == [(None, 1, None)] * 2


def one_signature(members, size):
    """The published loop, one member after the other, with the same draws."""
    least = [1 << 64] * size
    for e in members.tolist():
        seed = sm.mixed(np.array([e], np.uint64) ^ sm._FIRST)
        p = list(range(size))
        for j in range(size):
            drawn = int(sm.mixed(seed + np.uint64((2 * j + 1) * int(sm._STEP) % (1 << 64)))[0]) >> 12
            k = j + (((int(sm.mixed(seed * sm._PLACE + np.uint64(j))[0]) >> 32) * (size - j)) >> 32)
            p[j], p[k] = p[k], p[j]
            least[p[j]] = min(least[p[j]], (j << 52) | drawn)
    return least


def test_signatures_equal_the_loop_without_early_stopping():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (1, 2, 7, 40, 300)]
    made = sm.signatures(np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets]), len(sets), 32)
    assert [row.tolist() for row in made] == [one_signature(s, 32) for s in sets]


def test_estimates_are_close():
    rng = np.random.default_rng(3)
    for n in (20, 400):
        errors = []
        for _ in range(60):
            pool = np.unique(rng.integers(0, 1 << 63, n * 10 // 9 + 1).astype(np.uint64))
            a, b = pool[: len(pool) * 9 // 10], pool[len(pool) // 10:]
            made = sm.bands(sm.signatures(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2)).view(np.uint16)
            errors.append((made[0] == made[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < (0.8 * 0.2 / sm.SIZE) ** 0.5 * 1.2


def test_very_long_and_repeated_texts(spark):
    rng = random.Random(8)
    long = words(rng, 150_000)
    rows = [(1, long, "", "", 0), (2, long + " end", "", "", 0), (3, "z " * 500_000, "", "", 0), (4, "Z z z z", "", "", 0), (5, "z z z", "", "", 0)]
    out = {r.doc_id: r for r in sm.op13_superminhash(frame(spark, rows)).collect()}
    assert [out[i].component_id for i in range(1, 6)] == [1, 1, 3, 3, 5] and out[3].n_shingles == 1


def test_sketches_never_differ_in_more_cells_than_the_sets_in_members():
    rng = np.random.default_rng(4)
    for n, m, both in [(1, 1, 0), (5, 5, 4), (300, 280, 250), (3000, 3000, 100)]:
        pool = np.unique(rng.integers(0, 1 << 63, 2 * (n + m)).astype(np.uint64))[:n + m - both]
        a, b = pool[:n], pool[n - both:]
        x, y = sm.sketches(np.concatenate([a, b]), np.repeat([0, 1], [n, m]), 2)
        assert int(np.bitwise_count(x ^ y).sum()) <= n + m - 2 * both
        if 100 * both >= 80 * (n + m - both):
            assert sm.may_be_alike(np.array(n), np.array(m), np.bitwise_count(x ^ y).sum(dtype=np.int64))
