"""Connecting paths against breadth-first search, rollups against exact figures, resampling against the driver's."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import context as X
from millrace.operators import evaluation as E
from millrace.operators import graph as G
from millrace.operators import rollups as R
from millrace.operators import search as S


def distances(edges, start):
    near = {}
    for a, b, _ in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    seen, front = {start: 0}, [start]
    while front:
        front = [y for x in front for y in near.get(x, ()) if y not in seen and not seen.update({y: seen[x] + 1})]
    return seen


def test_connecting_paths_are_shortest(spark):
    rng = random.Random(5)
    edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}", rng.choice("xyz")) for _ in range(75)] + [("hub", f"n{i}", "h") for i in range(0, 60, 7)] + [("n0", "n0", "self"), ("far1", "far2", "x")]
    links = spark.createDataFrame(edges, "source_slug string, target_slug string, type string").cache()
    known = {(a, b, t) for a, b, t in edges}
    for start, goal in [("n1", "n2"), ("n3", "n50"), ("n7", "hub"), ("n0", "n59"), ("n4", "n4"), ("n1", "far1"), ("nowhere", "n1")]:
        want = distances(edges, start).get(goal)
        rows = G.connecting(links, start, goal, most=8).collect()
        if want is None:
            assert rows == []
            continue
        assert rows and all(r.length == want for r in rows)
        for r in rows:
            path = [x.slug for x in r.path]
            assert path[0] == start and path[-1] == goal and len(set(path)) == len(path) and r.middle in path
            for x, y in zip(r.path, r.path[1:], strict=False):
                assert ((x.slug, y.slug, y.type) if y.out else (y.slug, x.slug, y.type)) in known
    assert G.connecting(links, "n1", "far1", most=2).collect() == []


def test_rollups_merge(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(int(i % 4), float(rng.gamma(2, 50)), int(rng.integers(0, 3000))) for i in range(40_000)], "day int, value double, user long")
    days = rows.withColumn("at", F.date_add(F.lit("2024-01-01").cast("date"), F.col("day")))
    path = f"{tmp_path}/r"
    R.write_late(spark, path, days.filter("user % 3 > 0"), F.col("at"), "value", "user")
    R.write_late(spark, path, days.filter("user % 3 = 0 and day < 2"), F.col("at"), "value", "user")  # late for two days
    stored = spark.read.parquet(path)
    assert stored.count() == 6
    got = {str(r.day): r for r in R.figures(R.merged(stored, ["day"]), ["day"], (0.5, 0.95, 0.99)).collect()}
    exact = {str(r["at"]): r for r in days.filter("user % 3 > 0 or day < 2").groupBy("at").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.collect_list("value").alias("v"), F.count_distinct("user").alias("u")).collect()}
    assert set(got) == set(exact)
    for day, e in exact.items():
        g, v = got[day], np.array(e.v)
        assert g.n == e.n and g["mean"] == pytest.approx(e["mean"]) and g.least == v.min() and g.most == v.max()
        assert all(abs((v <= x).mean() - q) <= 0.03 for q, x in ((0.5, g.p50), (0.95, g.p95), (0.99, g.p99)))
        assert abs(g.different - e.u) <= 0.06 * e.u
    whole = R.figures(R.merged(stored.withColumn("all", F.lit(1)), ["all"]), ["all"]).first()
    assert whole.n == sum(e.n for e in exact.values())


def test_intervals_by_resampling(spark):
    rng = np.random.default_rng(8)
    values = rng.beta(2, 3, 400)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(values)], "query_id long, value double").repartition(5)
    got = E.poisson_interval(df, rounds=2000).first()
    mean, low, high = E.bootstrap_mean(values.tolist())
    assert got.n == 400 and got["mean"] == pytest.approx(mean) and abs(got.low - low) < 0.1 * (high - low) and abs(got.high - high) < 0.1 * (high - low)
    assert tuple(E.poisson_interval(df.repartition(2), rounds=2000).first()) == pytest.approx(tuple(got))
    # Rows of one cluster go together: the interval of twice the same rows is no narrower.
    twice = E.poisson_interval(df.unionByName(df), rounds=2000).first()
    assert twice.low == pytest.approx(got.low) and twice.high == pytest.approx(got.high)
    shifted = df.withColumn("value", F.col("value") + 0.25)
    d = E.paired_interval(df, shifted, "value").first()
    assert (d["mean"], d.low, d.high) == pytest.approx((0.25, 0.25, 0.25))
    assert E.poisson_interval(df.limit(0)).first()["mean"] is None
    w = spark.range(20_000).select(E.poisson_weight(1, F.lit(3), F.col("id")).alias("w")).agg(F.avg("w"), F.variance("w")).first()
    assert w[0] == pytest.approx(1, abs=0.03) and w[1] == pytest.approx(1, abs=0.05)


def test_deletions_are_held_through_an_outage(spark, tmp_path):
    from millrace.streaming import jobs as J

    def at(hour):
        return F.timestamp_add("MINUTE", F.lit(int(hour * 60)), F.lit("2024-01-01 00:00:00").cast("timestamp"))

    def put(folder, rows, column):
        one = [spark.range(1).select(F.lit(s).alias("source"), F.lit(i).cast("long").alias("id"), at(h).alias(column)) for s, i, h in rows]
        df = one[0]
        for x in one[1:]:
            df = df.unionByName(x)
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / folder))

    def run():
        streams = [J.file_stream(spark, str(tmp_path / f), f"source string, id long, {c} timestamp", files=1) for f, c in (("gone", "deleted_at"), ("seen", "seen_at"))]
        out = J.released_deletions(*streams).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append")
        J.drain(out)
        return sorted((r.source, r.id) for r in spark.read.schema("source string, id long, deleted_at timestamp").parquet(str(tmp_path / "out")).collect())

    # Source a is out at hour 1 and seems to have deleted 1, 2 and 3; b really deletes 7. One report comes twice.
    put("gone", [("a", 1, 1), ("a", 2, 1), ("a", 3, 1), ("b", 7, 1), ("b", 7, 1)], "deleted_at")
    put("seen", [("a", 9, 0.5), ("b", 7, 0.9)], "seen_at")  # seen before its deletion: no contradiction
    assert run() == []
    # a is back: 1 and 2 are seen again, 2 out of order; 3 is not, or only long after the hold.
    put("seen", [("a", 1, 2.5), ("a", 1, 2.5), ("b", 8, 3.2)], "seen_at")
    put("seen", [("a", 2, 2.6), ("a", 3, 3.6)], "seen_at")
    put("gone", [("b", 8, 3.1)], "deleted_at")
    assert run() == []
    put("seen", [("z", 0, 9)], "seen_at")
    put("gone", [("z", 1, 9)], "deleted_at")
    run()
    put("seen", [("z", 0, 9.5)], "seen_at")
    put("gone", [("z", 2, 9.5)], "deleted_at")
    assert run() == [("a", 3), ("b", 7)]


def test_classes_give_what_their_pairs_give(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(size=4).tolist(), int(min(i % 7, 4)) if i != 20 else 99) for i in range(400)]
    v = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int").repartition(3)
    m = np.array([r[1] for r in vectors])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = S.knn_blocks(v, v.filter("vec_id % 2 = 0"), 6, block=150).select(F.col("query").alias("query_id"), "id", "rank")
    want = {(q, k + 1): int(i) for q in range(0, 400, 2) for k, i in enumerate([x for x in np.argsort(-(m @ m[q]), kind="stable") if x != q][:6])}
    assert {(r.query_id, r["rank"]): r.id for r in near.collect()} == want
    queries, rows = v.filter("vec_id % 2 = 0").select(F.col("vec_id").alias("query_id"), "label"), v.select(F.col("vec_id").alias("id"), "label")
    gold = queries.join(rows, "label").filter("query_id <> id").select("query_id", "id", F.lit(1.0).alias("grade"))
    plain = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    assert plain(E.class_metrics(near, queries, rows, 5)) == plain(E.metrics(near, gold, 5))
    assert plain(X.class_recall(near, queries, rows, (2, 5))) == plain(X.session_recall(near, gold, (2, 5)))
    assert plain(X.decoys_passed(near, E.class_hits(near, queries, rows), 3)) == plain(X.decoys_passed(near, gold, 3))
    assert 20 not in {r.query_id for r in E.class_metrics(near, queries, rows, 5).collect()}
