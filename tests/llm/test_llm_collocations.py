"""SETM collocations against counts by plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
from cases import documents, frame
from pyspark.sql import functions as F

from lodestone.llm import collocations as co


def brute(rows, least, top):
    counts, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            found = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(found)
            for k in range(1, 5):
                counts[lang].update(tuple(found[i:i + k]) for i in range(len(found) - k + 1))
    out = []
    for lang, f in counts.items():
        cands = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in cands.items():
            score, _, left, right = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            if not any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in cands.items()):
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, r, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def sample(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "New", "york", "city", "é", "a", "b", "c", "-", "state|"]
    rows = documents(seed=seed)
    for i in range(120):
        text = "".join(rng.choice(["new York city", "the state of", rng.choice(vocabulary)]) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " - "]) for _ in range(rng.randint(1, 50)))
        rows.append((1000 + i, text, rng.choice(["en", "de", None, "und"]), "", 0))
    return rows


def got(spark, rows, **more):
    return sorted(tuple(r) for r in co.collocations(frame(spark, rows), **more).collect())


def test_phrases_scores_and_order(spark):
    rows = sample(1)
    assert got(spark, rows, least=5, top=12) == brute(rows, 5, 12)


def test_many_groups_a_task_and_a_sieve_that_lets_all_through(spark, monkeypatch):
    rows = sample(2)
    monkeypatch.setattr(co, "HELD", 8)
    monkeypatch.setattr(co.Sieve, "passes", lambda self, hashes: np.ones(len(hashes), bool))
    out = co.collocations(frame(spark, rows, parts=2), 4).collect()
    assert sorted(tuple(r) for r in out) == brute(rows, 4, 2000)


def test_another_hash_is_taken_when_two_words_share_one(spark):
    """The second family of hashes is used and gives the same rows."""
    rows, seen = sample(3), []
    first = co.occurrences

    def clashing(documents, family=0):
        seen.append(family)
        whole = first(documents, family)
        return whole if family else whole.union(whole.where("word = 'the'").limit(1).withColumn("word", F.lit("other")))

    co.occurrences = clashing
    try:
        assert got(spark, rows, least=5) == brute(rows, 5, 2000)
    finally:
        co.occurrences = first
    assert seen == [0, 1]


def test_long_empty_and_clashing(spark):
    rows = [(1, "x y z w " * 60_000, "en", "", 0), (2, None, None, "", 0), (3, "", "en", "", 0), (4, ". ;", "de", "", 0), *[(5, "A b", "fr", "", 0)] * 40]
    assert got(spark, rows) == brute(rows, 30, 2000)
    assert got(spark, []) == []
    clash = frame(spark, rows).selectExpr("text", "lang", "1 AS word", "2 AS id", "3 AS n", "'x' AS ids")
    assert sorted(tuple(r) for r in co.collocations(clash).collect()) == brute(rows, 30, 2000)


def test_rare_words_are_not_written(spark, monkeypatch):
    """Words under the threshold, most of a vocabulary, are neither in the first relation nor among the words; phrases stop at them."""
    rows = [(i, f"new york city w{i} x{i}a new york y{i}. state{i} of", "en", "", 0) for i in range(400)]
    rows += [(400 + i, f"q{i} " * 29, "de", "", 0) for i in range(3)]
    written, keep = [], co.cut_lineage

    def cut(df):
        out = keep(df)
        if {"word", "ids"} <= set(out.columns):
            written.extend(out.select("word", F.length("ids")).collect())
        return out

    monkeypatch.setattr(co, "cut_lineage", cut)
    assert got(spark, rows) == brute(rows, 30, 2000)
    assert sum(n for _, n in written if n) < 8 * 400 * 6.5      # six frequent words a document, and what the sieve lets through
    assert len({w for w, _ in written if w}) < 200
