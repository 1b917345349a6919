"""The driver's contract: names, columns and values of queries against their SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from candor.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"same_listing_dedupe", "review_model_metrics", "leave_one_source_out"}


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, list):
        return tuple(plain(x) for x in v)
    return round(float(v), 6) if hasattr(v, "as_integer_ratio") and not isinstance(v, (int, bool)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_query_has_a_name_and_most_have_sql():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert len(catalogue.ORACLE_SQL) >= 0.9 * len(catalogue.QUERIES) - 2


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - SLOW))
def test_query_equals_its_sql(spark, duck, name):
    found = catalogue.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=str)
    if name not in catalogue.ORACLE_SQL:
        assert rows
        return
    other = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(other.columns) == columns
    at = [other.columns.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[k]) for k in at) for r in other.fetchall()), key=str)


def test_partitioning_changes_nothing(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    name = "topk_per_store"
    a = sorted(map(tuple, catalogue.QUERIES[name](spark, SF).collect()))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        assert sorted(map(tuple, catalogue.QUERIES[name](spark, SF).collect())) == a
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
