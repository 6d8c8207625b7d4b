"""The tables of fingerprints at the pipeline's radius."""

import numpy as np
import pytest
from cases import frame

import corpus_pipeline
from lodestone.llm import simhash


@pytest.mark.parametrize("radius", [4, corpus_pipeline.NEAR_BITS])
def test_masks_are_wide_and_cover_every_pattern(radius):
    rng = np.random.default_rng(1)
    patterns = [sum(1 << int(b) for b in rng.choice(64, radius, replace=False)) for _ in range(2000)]
    for family in range(simhash.FAMILIES):
        masks = [m % (1 << 64) for m in simhash.masks(radius, family)]
        assert len(set(masks)) == (2 << radius) - 1
        assert all(24 <= m.bit_count() <= 44 for m in masks)
        assert all(any(m & p == 0 for m in masks) for p in patterns)


def test_random_fingerprints_share_no_large_bucket(spark):
    prints = np.random.default_rng(3).integers(-(1 << 63), (1 << 63) - 1, 3000).tolist()
    rows = frame(spark, [(p, 0) for p in prints], "fp long, bucket long")
    for family in range(2):
        assert simhash.dealt(rows, corpus_pipeline.NEAR_BITS, family).groupBy("bucket").count().agg({"count": "max"}).first()[0] < 30


def test_a_crowd_is_dealt_until_its_buckets_are_small(spark):
    # all patterns of 7 bits: linked throughout, in buckets beyond the limit by the first families
    rng = np.random.default_rng(5)
    at = rng.choice(63, 7, replace=False).tolist()
    prints = [sum(1 << b for k, b in enumerate(at) if i >> k & 1) for i in range(128)]
    links = [(r.a, r.b) for r in simhash.near_links(frame(spark, [(p,) for p in prints], "fp long"), 4, 50).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    reached, more = {0}, True
    while more:
        more = {y for a, b in links for x, y in ((a, b), (b, a)) if x in reached and y not in reached}
        reached |= more
    assert reached == set(prints)
