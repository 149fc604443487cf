"""Consolidation, audit and code-symbol operators on small tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.operators import graph as G
from millrace.operators import maintenance as M
from millrace.sources import connectors as C


def test_leader_clusters_are_greedy(spark):
    rows = [("a", 1, [1.0, 0.0]), ("a", 2, [0.9, 0.1]), ("a", 3, [0.0, 1.0]), ("b", 4, [1.0, 0.0]), ("a", 5, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "k string, id long, e array<double>")
    assert {r.id: r.leader for r in M.leader_clusters(df, "k", "id", "e").collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_leader_clusters_of_large_buckets(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    middle = rng.normal(size=(12, 6))
    rows = [("hot" if i % 10 else f"b{i % 3}", int(i), (middle[i % 12] + 0.5 * rng.normal(size=6)).tolist()) for i in rng.permutation(300)]
    df = spark.createDataFrame(rows, "k string, id long, e array<double>")
    want = {}
    for b in {r[0] for r in rows}:
        leaders = []
        for _, i, e in sorted(r for r in rows if r[0] == b):
            v = np.array(e) / np.linalg.norm(e)
            want[i] = next((j for j, u in leaders if u @ v >= 0.7), i)
            if want[i] == i:
                leaders.append((i, v))
    assert {r.id: r.leader for r in M.leader_clusters(df, "k", "id", "e", 0.7).collect()} == want
    assert {r.id: r.leader for r in M.leader_clusters(df, "k", "id", "e", 0.7, block=64).collect()} == want
    assert M.leader_clusters(df.limit(0), "k", "id", "e").count() == 0


def test_embedding_is_deterministic_and_unit(spark):
    df = spark.createDataFrame([("a b a",), ("",)], "t string")
    v = [r.e for r in M.embed(df, F.col("t"), "e", 8).collect()]
    assert sum(x * x for x in v[0]) == pytest.approx(1) and v[1] == [0.0] * 8


def test_closure_of_a_long_chain_with_a_cycle(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(9, 0)], "from_slug long, to_slug long")
    got = M.closure(spark.createDataFrame([(0,)], "slug long"), edges)
    assert {r.slug: r.depth for r in got.collect()} == {i: i for i in range(10)}


def test_deep_traversal(spark):
    links = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "t") for i in range(8)], "source_slug string, target_slug string, type string")
    assert G.traverse(links, ["n0"], 6).count() == 7


def test_divergence_and_quotes(spark):
    df = spark.createDataFrame([("costs 5", "costs 6", False), ("is open", "is not open", True), ("pays 5 now", "5 is paid", False)], "a string, b string, neg boolean")
    assert [r[0] for r in df.select(M.divergent(F.col("a"), F.col("b"))).collect()] == [True, True, False]
    q = spark.createDataFrame([('he said "the quick  brown fox" and "never said this"', "The Quick brown fox ran")], "a string, e string")
    assert q.select(M.quote_found(F.col("a"), F.col("e"))).first()[0] == ["never said this"]


def test_page_merge_and_upsert(spark):
    t = spark.createDataFrame([("a", "b"), ("c", "a")], "source_slug string, target_slug string")
    m = spark.createDataFrame([("a", "z")], "old string, new string")
    assert {tuple(r) for r in M.repointed(t, m, ["source_slug", "target_slug"]).select("source_slug", "target_slug").collect()} == {("z", "b"), ("c", "z")}
    base = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    new = spark.createDataFrame([(2, "n"), (3, "m")], "k long, v string")
    assert {tuple(r) for r in C.replace_by_key(base, new, ["k"]).collect()} == {(1, "x"), (2, "n"), (3, "m")}
