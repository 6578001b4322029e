"""Every registered query against its SQL on the smallest tables."""

import hashlib
import itertools
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace import plans

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SMALL}/{f}'")
    return con


def plain(frame):
    def value(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return None
        return float(f"{x:.9g}") if isinstance(x, float) else x

    columns = sorted(frame.columns)
    return columns, sorted((tuple(map(value, r)) for r in frame[columns].astype(object).itertuples(index=False, name=None)), key=repr)


def test_every_query_has_sql():
    assert set(plans.ORACLE_SQL) == set(plans.QUERIES)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, oracle, name):
    assert plain(plans.QUERIES[name](spark, SMALL).toPandas()) == plain(oracle.sql(plans.ORACLE_SQL[name]).df())


def test_no_python_in_plans(spark):
    for name, f in plans.QUERIES.items():
        plan = f(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin")), name


def test_filters_reach_the_scan(spark):
    plan = plans.QUERIES["audit_filter"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "In(event_type" in plan and "GreaterThanOrEqual(ts" in plan and "props" not in plan


@pytest.mark.parametrize("name", ["mrz_repair", "passport_warnings", "cross_field_issues", "mrz_best_parse", "zone_lineage", "validated_fields", "document_readiness", "field_fixes"])
def test_one_row_group_is_many_tasks(spark, name):
    """A table's file has one row group, which one task reads; the dear work on its rows must not stay there."""
    places = plans.QUERIES[name](spark, SMALL).groupBy(F.spark_partition_id().alias("place")).count().collect()
    assert len(places) > 1


def test_substitutions_of_whole_numbers(spark):
    names = {r["doc_id"]: r for r in plans.QUERIES["mrz_all_substitutions_whole"](spark, SMALL).collect()}
    swap = dict(zip("OIBSZ01852", "01852OIBSZ", strict=True))
    for doc, r in names.items():
        made = sorted("".join(p) for p in itertools.product(*[sorted({c, swap.get(c, c)}) for c in f"P{doc:08d}"]))
        assert (r["n_candidates"], r["candidates_sha256"]) == (len(made), hashlib.sha256(",".join(made).encode()).hexdigest())
