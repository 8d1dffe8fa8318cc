"""Every query of the core against its SQL on the small test tables, where they are present."""

import math
import os

import duckdb
import pytest

from dialoom.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_equals_sql(spark, oracle, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = oracle.execute(catalogue.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_range_joins_make_no_nested_loops(spark):
    for name in ("overlap_dominant", "word_assign", "label_at", "near_duplicates_in_time", "nearest_interval", "as_of_join", "gap_words", "consensus_labels"):
        plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_scans_read_only_what_they_need(spark):
    plan = catalogue.QUERIES["duplicate_keys"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int>" in plan
