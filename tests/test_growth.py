"""Queries over the links where line items are many: each task joins a bounded number of them, with the same results."""

from __future__ import annotations

import pytest
from oracle import same

from millrace.plans import QUERIES, SQL
from millrace.sources import relations

LINES = 500


@pytest.fixture
def many(spark, monkeypatch):
    """The line items of the small folder count as many; joins merge partitions as on large tables."""
    monkeypatch.setattr(relations, "LINES", LINES, raising=False)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def joins(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join Inner")


def test_links_are_joined_by_bounded_tasks(spark, sf_dir, many):
    bought = relations.Tables(spark, sf_dir).links.filter("type = 'bought'").select("source_slug", "target_slug")
    sizes = bought.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert max(sizes) < 2 * LINES


@pytest.mark.parametrize("name, times", [("union_all_edges", 1), ("experts_by_degree", 1), ("union_distinct_pages", 1), ("anomalous_degrees", 3)])  # the degrees twice, for the mean too, and their join with it
def test_links_are_made_once_for_both_ends(spark, sf_dir, many, name, times):
    df = QUERIES[name](spark, sf_dir)
    assert joins(df) == times
    same(df, SQL[name], sf_dir)


def test_connecting_paths_deals_its_edges(spark, sf_dir, many, monkeypatch):
    from millrace.operators import graph

    made, settled = [], graph.settled
    monkeypatch.setattr(graph, "settled", lambda df: made.append(df) or settled(df))
    df = QUERIES["connecting_paths"](spark, sf_dir)
    assert joins(made[0]) == 1
    assert made[0].rdd.getNumPartitions() == 2 * relations.Tables(spark, sf_dir).parts
    same(df, SQL["connecting_paths"], sf_dir)
