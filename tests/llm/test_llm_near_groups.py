"""The near-duplicate stage keeps exactly one document of each group, against all pairs."""

import random
from collections import Counter

from cases import frame, words
from test_llm_setjoin import families, linked, runs

import corpus_pipeline
from lodestone.llm import simhash


def siblings(rng, n, size=60, edits=3):
    """Texts of one template with some words changed, 0.6 to 0.7 alike in most pairs."""
    base = words(rng, size).split()
    out = []
    for _ in range(n):
        copy = list(base)
        for at in rng.sample(range(size), edits):
            copy[at] = f"w{rng.randrange(10 ** 6)}"
        out.append(" ".join(copy))
    return out


def near_zero(rng, n):
    """Texts of six words whose fingerprint is close to that of the empty text."""
    out = []
    while len(out) < n:
        text = " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(6))
        if simhash.fingerprint(text, corpus_pipeline.NEAR_WORDS).bit_count() <= corpus_pipeline.NEAR_BITS:
            out.append(text)
    return out


def test_exactly_one_document_of_each_group_stays(spark):
    rng = random.Random(6)
    shared = [" ".join([*words(rng, 2000).split(), *"one two three four five six".split()])]
    long = [shared[0].replace("three", f"w{i}") for i in range(3)]
    texts = [*siblings(rng, 300), *near_zero(rng, 4), *families(11, 8), *long, "", "a b", "a c", "A  B", "one two three four", "one two three five"]
    texts = list(dict.fromkeys(texts))
    docs = frame(spark, [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)])
    kept = corpus_pipeline.drop_near_copies(spark, docs, "/root/testdata/sf0.001").collect()
    root = linked(texts)
    short = {}
    for i, t in enumerate(texts):
        if not runs(t):
            root[i] = short.setdefault(tuple(t.lower().split()), i)
    assert Counter(root[r.doc_id] for r in kept) == Counter(set(root))
    assert {r.doc_id for r in kept} == set(root)
