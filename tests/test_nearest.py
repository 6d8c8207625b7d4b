import numpy as np
import pytest
from pyspark.sql import types as T

from lodestone.operators.nearest import nearest

CHUNKS = T.StructType([T.StructField("issue_key", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])


def brute(questions, chunks, k):
    out = set()
    for qid, q in questions:
        best = {}
        for key, v in chunks:
            if v is None or not np.linalg.norm(v):
                d = np.inf
            else:
                v = np.array(v, dtype=np.float64)
                a, b = np.array(q) / np.linalg.norm(q), v / np.linalg.norm(v)
                d = 1 - (a * b).sum()
            best[key] = min(best.get(key, np.inf), d)
        ranked = sorted(best.items(), key=lambda kv: (kv[1], kv[0]))[:k]
        out |= {(qid, r, key, None if np.isinf(d) else int(d * 1e5 + 0.3)) for r, (key, d) in enumerate(ranked)}
    return out


def data(seed=1, copies=0, n=400, dim=8, nq=7):
    rng = np.random.default_rng(seed)
    questions = [(i, rng.normal(size=dim).tolist()) for i in range(nq)]
    vectors = rng.normal(size=(n, dim)).astype(np.float32)
    vectors[:copies] = vectors[0]
    chunks = [(f"K-{i}", [float(x) for x in v]) for i, v in enumerate(vectors)]
    return questions, chunks


def got(df):
    return {(r.qid, r.rank, r.issue_key, None if r.distance is None else int(r.distance * 1e5 + 0.3)) for r in df.collect()}


def frames(spark, questions, chunks):
    return (spark.createDataFrame(questions, "qid long, qvec array<double>"),
            spark.createDataFrame(chunks, CHUNKS).repartition(5))


@pytest.mark.parametrize("copies", [0, 150])
@pytest.mark.parametrize("k", [3, 10, 1000])
def test_matches_brute_force(spark, copies, k):
    questions, chunks = data(copies=copies)
    assert got(nearest(*frames(spark, questions, chunks), k)) == brute(questions, chunks, k)


def test_many_blocks_give_the_same_rows(spark):
    questions, chunks = data(copies=150)
    q, c = frames(spark, questions, chunks)
    assert got(nearest(q, c, 10, block_bytes=3 * 8 * 8)) == brute(questions, chunks, 10)


def test_neighbours_closer_than_a_product_keep_their_order(spark):
    rng = np.random.default_rng(3)
    base, other = np.eye(64)[0], np.eye(64)[1]
    # distances of about 2e-10 (A), 5e-11 (B) and 1e-3 (all others)
    turned = {"A": 2e-5, "B": 1e-5} | {f"C-{i:03}": 0.05 for i in range(300)}
    schema = T.StructType([T.StructField("issue_key", T.StringType()), T.StructField("embedding", T.ArrayType(T.DoubleType()))])
    rows = [(key, (np.cos(t) * base + np.sin(t) * other).tolist()) for key, t in turned.items()]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    c = spark.createDataFrame(rows, schema).repartition(4)
    q = spark.createDataFrame([(1, base.tolist())], "qid long, qvec array<double>")
    hits = nearest(q, c, 4).orderBy("rank").collect()
    assert [r.issue_key for r in hits] == ["B", "A", "C-000", "C-001"]       # copies tie by key
    assert 0 < hits[0].distance < 1e-10 < hits[1].distance < 3e-10
    assert hits[2].distance == hits[3].distance


def test_a_bad_question_leaves_the_others_alone(spark):
    questions, chunks = data(n=30)
    more = [(90, None), (91, [1.0, 2.0]), (92, [0.0] * 8)]
    q, c = frames(spark, [*questions, *more], chunks)
    first = sorted(key for key, _ in chunks)[:3]
    want = brute(questions, chunks, 3) | {(i, r, key, None) for i, _ in more for r, key in enumerate(first)}
    assert got(nearest(q, c, 3)) == want
    assert got(nearest(q, c, 3, block_bytes=3 * 8 * 8)) == want
    alone = nearest(*frames(spark, more[:1], chunks), 3)
    assert got(alone) == {(90, r, key, None) for r, key in enumerate(first)}


def test_one_question_over_a_corpus_of_copies(spark):
    questions, chunks = data(n=3000, copies=2900, nq=1)
    assert got(nearest(*frames(spark, questions, chunks), 20)) == brute(questions, chunks, 20)


def test_unusable_vectors_come_last(spark):
    questions, chunks = data(n=5)
    chunks += [("A-1", None), ("A-0", [0.0] * 8)]
    assert got(nearest(*frames(spark, questions, chunks), 7)) == brute(questions, chunks, 7)
    assert got(nearest(*frames(spark, questions, chunks), 5)) == brute(questions, chunks, 5)


def test_a_key_with_many_chunks_counts_once(spark):
    questions, chunks = data(n=60)
    chunks = [(f"K-{i % 20}", v) for i, (_, v) in enumerate(chunks)]
    assert got(nearest(*frames(spark, questions, chunks), 12)) == brute(questions, chunks, 12)


def test_form_ids_restrict_rows(spark):
    questions, chunks = data()
    q = spark.createDataFrame([(i, v, i % 3) for i, v in questions], "qid long, qvec array<double>, form_id long")
    schema = T.StructType([*CHUNKS.fields, T.StructField("form_ids", T.ArrayType(T.LongType()))])
    rows = [(key, v, [f for f in range(3) if (i + f) % (f + 2) == 0]) for i, (key, v) in enumerate(chunks)]
    hits = got(nearest(q, spark.createDataFrame(rows, schema).repartition(4), 10))
    want = set()
    for i, v in questions:
        want |= brute([(i, v)], [(key, e) for key, e, forms in rows if i % 3 in forms], 10)
    assert hits == want
    assert got(nearest(q, spark.createDataFrame(rows, schema), 10, block_bytes=100)) == want


def test_no_questions(spark):
    questions, chunks = data(n=5)
    q, c = frames(spark, questions, chunks)
    assert nearest(q.where("qid < 0"), c, 5).collect() == []


def test_a_stored_vector_of_another_length_comes_last(spark):
    questions, chunks = data(n=5)
    assert got(nearest(*frames(spark, questions, [*chunks, ("A", [1.0, 2.0])]), 6)) == brute(questions, [*chunks, ("A", None)], 6)


def test_corpus_is_not_shuffled(spark):
    plan = nearest(*frames(spark, *data(n=20)), 5)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("MapInArrow"):]
    assert below.count("Repartition") == 1      # only the one this test made itself
