"""The driver's contract: the entry runs, queries and SQL agree on names, and some queries equal their SQL."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["concept_year_series", "decline_year", "fractional_projection", "k3_regions", "attach_hypergeom", "c_value", "yoy_quarter_accel"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    frame = entry.queries()[name](spark, DATA)
    relation = con.sql(entry.oracle_sql()[name])
    columns = sorted(frame.columns)
    assert columns == sorted(relation.columns)
    tidy = lambda row: tuple(round(v, 5) if isinstance(v, float) else v for v in row)
    at = [relation.columns.index(c) for c in columns]
    expected = sorted((tidy(tuple(r[i] for i in at)) for r in relation.fetchall()), key=repr)
    assert sorted((tidy(tuple(r[c] for c in columns)) for r in frame.collect()), key=repr) == expected
