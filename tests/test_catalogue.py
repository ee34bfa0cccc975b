"""Every query runs; those with SQL agree with DuckDB; the pages' invariants hold."""

import duckdb
import pytest
from pyspark.sql import functions as F

from spanloom import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(columns, tuples):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(t[i] for i in order)) for t in tuples)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_agrees_with_sql(spark, sf, duck, name):
    got = catalogue.QUERIES[name](spark, sf)
    want = duck.sql(catalogue.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall() if hasattr(want, "fetchall") else [tuple(r.values()) for r in want.arrow().read_all().to_pylist()])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_runs(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_pages_keep_their_invariants(spark, sf):
    q = {n: catalogue.QUERIES[n](spark, sf) for n in ("coverage_check", "html_roundtrip", "structure_equal", "excluded_unchanged", "recovery", "html_translate")}
    assert q["coverage_check"].filter("NOT covered OR NOT gapless").isEmpty()
    assert q["html_roundtrip"].filter("NOT stable").isEmpty()
    assert q["structure_equal"].filter("NOT same OR same_with_more").isEmpty()
    assert q["excluded_unchanged"].filter("NOT same").isEmpty()
    sums = q["recovery"].agg(F.sum("segments"), F.sum("right"), F.sum("retries"), F.sum("fallbacks")).first()
    assert sums[0] == sums[1] and sums[2] > 0
    assert q["html_translate"].filter("error IS NOT NULL").isEmpty()


def test_plans_prune_columns_and_push_filters(spark, sf):
    plan = catalogue.QUERIES["lang_kind"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "doc_id" in plan and "n_chars" not in plan and "lang#" not in plan.split("Scan parquet")[-1]
