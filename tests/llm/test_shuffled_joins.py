"""Sides over the broadcast limit are shuffled instead, with the same results."""

import os

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from millrace.llm import queries, tables  # noqa: E402

SMALL = "/root/testdata/sf0.001"
has_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@has_data
@pytest.mark.parametrize("name", ["op1_packing", "op5_vectors", "op7_simhash", "op9_token_file", "op10_exact_dedup"])
def test_shuffled_joins_give_the_same(spark, monkeypatch, name):
    def rows():
        df = queries.QUERIES[name](spark, SMALL)
        return sorted(map(tuple, df.collect())), df._jdf.queryExecution().optimizedPlan().toString()

    near, _ = rows()
    monkeypatch.setattr(tables.small, "__defaults__", (-1,))
    monkeypatch.setattr(tables, "BROADCAST_BYTES", -1)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        far, plan = rows()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "strategy=broadcast" not in plan
    assert far == near and near
