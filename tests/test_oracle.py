"""Every query with SQL gives what DuckDB gives on the same tables; the rest run and keep a stable schema."""

import math
from pathlib import Path

import duckdb
import pytest

from mnemo.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{SF}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool) or isinstance(value, str):
        return value
    return round(float(value), 5) + 0.0


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_duckdb(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cursor = duck.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    got, want = rows(df.columns, [tuple(r) for r in df.collect()]), rows(columns, cursor.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, abs=2e-5) if all(not isinstance(x, str) for x in a) else all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) < 2e-5) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_gives_the_same_rows_again(spark, name):
    """What SQL cannot express gives rows, no column of nulls alone, and the same rows when run again."""
    first, again = (queries.QUERIES[name](spark, SF) for _ in range(2))
    got = [tuple(r) for r in first.collect()]
    assert got and first.schema == again.schema
    assert all(any(r[k] is not None for r in got) for k in range(len(first.columns)))
    assert rows(first.columns, got) == rows(again.columns, [tuple(r) for r in again.collect()])


def test_entry_without_corpus_operators(spark):
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
