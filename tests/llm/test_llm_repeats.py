"""What op10 leaves on disk, and which texts it moves."""

import time
from collections import Counter

import numpy as np

from cases import frame
from lodestone import session
from lodestone.llm import repeats
from test_llm_fixed_results import brute_removed, rows_of


def texts(seed, n, size=3000):
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz    ", np.uint8)
    return [letters[np.random.default_rng([seed, i]).integers(0, len(letters), size)].tobytes().decode() for i in range(n)]


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    sizes = {f.getName(): f.length() for f in (files.apply(i) for i in range(files.size()))}
    return {name: size for name, size in sizes.items() if name.startswith("shuffle_")}


def left_behind(spark, before):
    """Bytes of new shuffle files; they go within moments."""
    for _ in range(20):
        left = sum(size for name, size in shuffle_files(spark).items() if name not in before)
        if not left:
            break
        time.sleep(0.25)
    return left


def test_a_kept_table_leaves_no_shuffle_files(spark):
    before, conf = shuffle_files(spark), spark.conf.get(session.CLEANUP)
    kept = session.cut_lineage(spark.range(200_000).selectExpr("xxhash64(id) AS h").repartition(4, "h"))
    assert left_behind(spark, before) == 0
    assert kept.count() == 200_000 and spark.conf.get(session.CLEANUP) == conf


def test_passages_are_found_without_leftovers(spark):
    some = texts(1, 120)
    data = [(i, t, "", "", 0) for i, t in enumerate(some)]
    data += [(500 + i, t[:900] + "!" + t[1000:2500], "", "", 0) for i, t in enumerate(some[:20])]
    before, tables = shuffle_files(spark), len(session._kept)
    result = repeats.op10_repeated_passages(frame(spark, data))
    size = sum(len(t) for _, t, *_ in data)
    assert left_behind(spark, before) < size / 10          # counts of ids and words of bit tables at most, no segments and no texts
    assert len(session._kept) == tables + 1                # what is to be cut out, one row for each text
    assert Counter(rows_of(result)) == brute_removed(data)


def test_only_texts_that_may_have_ranges_are_moved(spark):
    rows = spark.range(20_000).selectExpr("id AS doc", "0L AS version")
    given = rows.where("doc % 50 = 0")
    passed = {r.doc for r in rows.where(repeats.may_be_among(repeats.known_documents(given))).collect()}
    assert passed >= set(range(0, 20_000, 50)) and len(passed) < 4_000
    nothing = rows.where("doc < 0")
    assert rows.where(repeats.may_be_among(repeats.known_documents(nothing))).count() == 0


def test_a_null_id_is_not_the_least_id(spark):
    text = texts(2, 1)[0]
    for ids in ((None, 3), (None, -(1 << 63), 3)):
        data = [(i, text + str(i), "", "", 0) for i in ids]
        got = {r[0]: r[2] for r in rows_of(repeats.op10_repeated_passages(frame(spark, data)))}
        assert got[None] == 0 and got[3] == len(text)
