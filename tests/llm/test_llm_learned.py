"""Operators that learn, on rows they have not learnt from, and the pipeline."""

import random
from collections import Counter

import numpy as np
import pytest
from cases import documents, frame
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import quality, secrets, toxicity

SF = "/root/testdata/sf0.01"


def read(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def area(score, label):
    rank = np.argsort(np.argsort(score, kind="stable")) + 1
    return (rank[label].sum() - label.sum() * (label.sum() + 1) / 2) / (label.sum() * (~label).sum())


def test_quality_on_held_out_rows(spark):
    out = quality.op6_quality(read(spark, "documents", "/root/testdata/sf0.1"), read(spark, "labels", "/root/testdata/sf0.1"))
    known = out.where("held_out").join(read(spark, "labels", "/root/testdata/sf0.1"), "doc_id").toPandas()
    label = known.quality.to_numpy() == 1
    assert area(known.score.to_numpy(), label) > 0.98 and (known.predicted == label).mean() > 0.97
    assert known.score.between(0, 1).all() and (known.predicted == (known.score >= 0.3)).all()


def test_quality_of_odd_tables(spark):
    data = documents()
    labels = frame(spark, [(i, i % 2) for i in range(40)] + [(None, 1), (3, None)], "doc_id long, quality int")
    out = quality.op6_quality(frame(spark, data), labels).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in data) and all(0 <= r.score <= 1 for r in out)
    none = frame(spark, [], "doc_id long, quality int")
    assert {r.score for r in quality.op6_quality(frame(spark, data), none).collect()} == {0.5}
    assert quality.op6_quality(frame(spark, []), labels).count() == 0


def test_dual_coordinate_descent_meets_its_optimum():
    rng = np.random.default_rng(2)
    x = (rng.random((60, 8)) < 0.5).astype(float)
    y = np.where(x[:, 0] + x[:, 1] > x[:, 2] + 0.5, 1.0, -1.0)
    cost = np.full(60, 0.3)
    w = quality.svm([np.flatnonzero(r) for r in x], np.ones(8), y, cost, epochs=400)
    design = np.column_stack([x, np.ones(60)])
    loss = lambda v: 0.5 * v @ v + (cost * np.maximum(0, 1 - y * (design @ v))).sum()
    assert all(loss(w) <= loss(w + rng.normal(0, 0.05, 9)) + 1e-6 for _ in range(200))


def test_toxicity_finds_marked_texts_and_leaves_clean_ones(spark):
    sf = "/root/testdata/sf0.1"
    out = toxicity.op2_toxicity(read(spark, "documents", sf), read(spark, "labels", sf))
    known = out.join(read(spark, "labels", sf).select("doc_id", F.col("toxic").alias("label")), "doc_id").toPandas()
    label = known.label.to_numpy() == 1
    assert known.toxic[label].mean() > 0.9 and known.toxic[~label].mean() < 0.005
    assert known.severity.between(0, 2).all()


def test_ordinal_grades_of_unseen_texts_are_ordered(spark):
    rng = random.Random(1)
    rows = []
    for i in range(900):
        grade = i % 3
        said = rng.choices("the a of and to in is on by it".split(), k=rng.randint(10, 80)) + ["vile"] * (grade and 1) + ["wicked"] * (3 * (grade == 2))
        rng.shuffle(said)
        rows.append((i, " ".join(said), grade))
    df = frame(spark, rows, "doc_id long, text string, label int")
    model = toxicity.trained(df.where("doc_id < 600"), from_labels=False)
    out = toxicity.severity(df.where("doc_id >= 600"), model, ["doc_id", "label"]).groupBy("label").agg(F.avg("severity"), F.avg((F.col("grade") == F.col("label")).cast("int"))).collect()
    means = {r[0]: r[1] for r in out}
    assert means[0] < 0.2 < 0.7 < means[1] < 1.3 < 1.7 < means[2] and all(r[2] > 0.9 for r in out)
    assert (np.diff(model.thresholds) > 0).all()


def test_toxicity_of_odd_tables(spark):
    data = documents()
    labels = frame(spark, [(i, i % 2) for i in range(40)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    out = toxicity.op2_toxicity(frame(spark, data), labels).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in data)
    assert not any(r.toxic for r in toxicity.op2_toxicity(frame(spark, data), frame(spark, [], "doc_id long, toxic int")).collect())
    assert toxicity.op2_toxicity(frame(spark, []), labels).count() == 0


# the pipeline

@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = read(spark, "documents"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stages_keep_the_columns_and_take_effect(spark, stages):
    docs = read(spark, "documents")
    assert all(s.dtypes == docs.dtypes for s in stages[:-1])
    counts = [docs.count(), *(s.count() for s in stages)]
    assert counts[0] > counts[1] > counts[2] > counts[3] == counts[4] == counts[5] > 0.6 * counts[0]
    known = stages[0].join(read(spark, "labels"), "doc_id")
    assert known.where("toxic = 1").count() < 0.4 * read(spark, "labels").where("toxic = 1").count()
    assert read(spark, "labels").where("toxic = 0").count() - known.where("toxic = 0").count() <= 7
    assert stages[1].select(F.lower("text")).distinct().count() == stages[1].count()
    ratio = secrets.trained(stages[3])
    assert secrets.redact(stages[3], ratio).where("_spans > 0").count() == 0
    assert stages[3].where("n_chars <> char_length(text)").count() == 0
    assert stages[4].where("NOT round_trip").count() == 0


def test_stages_of_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, severity double, `a.b` int, fp string, spans int"
    rows = [(i, t, "en", 1.0, 2, "x", 3) for i, t, *_ in documents()]
    for name, data in (("odd", rows), ("none", [])):
        docs = frame(spark, data, schema)
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}{i}")
            docs = spark.read.parquet(f"{tmp_path}/{name}{i}")
            assert docs.columns[:7] == ["doc_id", "text", "lang", "severity", "a.b", "fp", "spans"]
        left = [r.text for r in docs.collect()]
        assert len(left) == len(set(left)) and (name == "none") == (not left)


def test_run_gives_the_last_stage(spark, stages):
    out = corpus_pipeline.run(spark, SF)
    assert Counter(map(tuple, out.select("doc_id", "n_tokens").collect())) == Counter(map(tuple, stages[4].select("doc_id", "n_tokens").collect()))


def test_texts_with_several_labels_count_once_by_majority(spark):
    from lodestone.llm.quality import one_label

    rows = [("a", 1), ("a", 0), ("a", 1), ("b", 1), ("b", 0), ("c", 0), ("", 2), ("", 2), ("", 1)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "text string, label int").repartition(3)
        assert {r.text: r.label for r in one_label(df).collect()} == {"a": 1, "b": 0, "c": 0, "": 2}
