"""Documents with what operators have to cope with, and small tables of the test data."""

import random

import pyarrow.parquet as pq

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choices("abcdeéñ", k=rng.randint(1, 6))) for _ in range(n))


def documents(seed=1, n=40):
    """Nulls, empty and long texts, copies, near copies, shared passages, repeated rows."""
    rng = random.Random(seed)
    passage = words(rng, 80)
    texts = [words(rng, rng.randint(0, 60)) for _ in range(n)]
    texts += [None, "", "", "\n\n", " \t ", "x", "ab " * 400, passage, passage, f"{words(rng, 30)} {passage} {words(rng, 30)}", f"{passage}!", passage.upper()]
    texts += [texts[3], f"{texts[3]} end", "é" * 700, "a" * 450, words(rng, 9000), "\n".join(words(rng, 8) for _ in range(60))]
    rows = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [(None, passage, None, None, None), rows[7], rows[7]]
    rng.shuffle(rows)
    return rows


def frame(spark, rows, schema=DOCUMENTS, parts=5):
    return spark.createDataFrame(rows, schema).repartition(parts)


def column(name, table, sf="sf0.001"):
    return pq.read_table(f"/root/testdata/{sf}/{table}.parquet").column(name).to_pylist()
