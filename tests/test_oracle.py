"""Every registered query against its SQL in DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry

BASE = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{BASE}/{t}.parquet'")
    return c


def normal(rows):
    return sorted(repr(tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, duck, name):
    made = entry.queries()[name](spark, BASE)
    want = duck.sql(entry.oracle_sql()[name])
    columns = sorted(made.columns)
    assert columns == sorted(want.columns)
    kinds = dict(zip(want.columns, map(str, want.types), strict=True))
    assert {c: KINDS[t] for c, t in made.dtypes} == kinds
    assert normal(made.select(*columns).collect()) == normal(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
