"""The prefix-filtered set join against all pairs, and what it adds to the near-duplicate stage."""

import random

import numpy as np
import pytest
import corpus_pipeline
from cases import column, documents, frame, words

from lodestone.llm import setjoin


def runs(text, size=5):
    low = (text or "").encode().lower().split()
    return {tuple(low[i:i + size]) for i in range(len(low) - size + 1)}


def linked(texts, share=0.8):
    """The smallest text reachable from each, by all pairs."""
    sets, root = [runs(t) for t in texts], list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j]:
                common = len(a & sets[j])
                if common >= share * (len(a) + len(sets[j]) - common) - 1e-6:
                    low, high = sorted((top(i), top(j)))
                    root[high] = low
    return [top(i) for i in range(len(texts))]


def families(seed=4, parents=25):
    """Texts and copies of them with some words changed, from far to near the limit, with a frequent passage in many."""
    rng = random.Random(seed)
    passage, out = words(rng, 30), []
    for i in range(parents):
        base = words(rng, rng.choice([5, 9, 40, 120, 400])).split()
        for _ in range(6):
            copy = list(base)
            for at in rng.sample(range(len(copy)), rng.randint(0, max(1, len(copy) // 25))):
                copy[at] = rng.choice(["", words(rng, 1), copy[at].upper()])
            out.append(" ".join(copy) + (f" {passage}" if i % 3 == 0 else ""))
    return out


@pytest.mark.parametrize("texts", [
    families(), [t for _, t, *_ in documents()], column("text", "documents")], ids=["families", "odd", "table"])
def test_all_links_are_found(spark, texts):
    texts = list(dict.fromkeys(texts))
    rows = frame(spark, [(t, i, i) for i, t in enumerate(texts)], "text string, digest long, group long")
    found = {r.group: r.joined for r in setjoin.join_groups(rows, rows).collect()}
    expected = linked(texts)
    assert [found.get(i, i) for i in range(len(texts))] == expected
    # groups that are known already are only joined with others
    half = [root if i % 2 else i for i, root in enumerate(expected)]
    rows = frame(spark, [(t, i, g) for i, (t, g) in enumerate(zip(texts, half))], "text string, digest long, group long")
    found = {r.group: r.joined for r in setjoin.join_groups(rows, rows).collect()}
    assert [found.get(g, g) for g in half] == expected


def test_nothing_to_join(spark):
    schema = "text string, digest long, group long"
    for rows in ([], [(None, 1, 1), ("", 2, 2), ("one two", 3, 3), ("one two", 3, 3)]):
        assert setjoin.join_groups(*[frame(spark, rows, schema)] * 2).count() == 0


def test_stage_leaves_no_pair_of_similarity(spark):
    texts = families(9)
    docs = frame(spark, [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)])
    kept = corpus_pipeline.drop_near_copies(spark, docs, "/root/testdata/sf0.001").collect()
    left = [r.text for r in kept]
    assert linked(left) == list(range(len(left)))
    assert {linked(texts)[r.doc_id] for r in kept} <= {i for i, root in enumerate(linked(texts)) if i == root}
    assert len(left) <= len(set(linked(texts)))


def test_parities_bound_what_sets_share():
    rng = np.random.default_rng(5)
    for _ in range(300):
        pool = rng.integers(0, 1 << 63, 600, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 600), replace=False)) for _ in "ab")
        most = setjoin.most_common(setjoin.parities(a), setjoin.parities(b), len(a) + len(b))
        assert len(np.intersect1d(a, b)) <= most <= (len(a) + len(b)) // 2
        assert setjoin.most_common(setjoin.parities(a), setjoin.parities(a), 2 * len(a)) == len(a)


def test_only_sets_of_pairs_that_can_be_similar_are_moved(spark, monkeypatch):
    """Texts that share a passage and little else are turned away by their parities: their whole sets are not written."""
    rng = random.Random(8)
    common = [words(rng, 50) for _ in range(10)]
    texts = [f"{passage} {common[(i + by) % 10]}" for i in range(30) for passage in [words(rng, 16)] for by in (0, 3)]
    texts += [f"{texts[0]} one", f"{texts[2]} two"]
    digests = [random.Random(i).randrange(-1 << 63, 1 << 63) for i in range(len(texts))]
    rows = frame(spark, [(t, d, i) for i, (t, d) in enumerate(zip(texts, digests))], "text string, digest long, group long")
    moved, keep = [], setjoin.cut_lineage

    def cut(df):
        out = keep(df)
        if "members" in out.columns:
            moved.extend(r.digest for r in out.select("digest").collect())
        return out

    monkeypatch.setattr(setjoin, "cut_lineage", cut)
    found = {r.group: r.joined for r in setjoin.join_groups(rows, rows).collect()}
    assert found == {60: 0, 61: 2}
    assert {digests[i] for i in (0, 2, 60, 61)} <= set(moved) and len(moved) < 20
