"""Every registered query against its SQL oracle on the smallest scale."""

import pathlib

import duckdb
import pytest

import __spark_entry__ as entry
from lodestone.suite import registry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    base = duckdb.connect()
    for path in pathlib.Path(SF).glob("*.parquet"):
        base.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return base


def canon(value):
    if isinstance(value, float):
        return repr(round(value, 7) + 0.0)
    return str(value)


def table(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
    assert set(registry.REGISTRY) <= set(ORACLES)     # the training-data queries have tests of their own


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, db, name):
    frame = QUERIES[name](spark, SF)
    cursor = db.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(frame.columns) == sorted(columns)
    assert table(frame.collect(), frame.columns) == table(cursor.fetchall(), columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
