"""SimHash near-duplicates against comparison of all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

HEX = {i: i + 32 for i in range(65, 91)}


def fingerprint(text, k=3):
    w = re.findall("[^ \t-\r]+", (text or "").translate(HEX))
    grams = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def brute(rows, radius=2):
    """{index: (fingerprint, least id of the component)} of (id, text) rows."""
    fps = [fingerprint(t) for _, t in rows]
    kinds = sorted(set(fps))
    up = {f: f for f in kinds}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    a = np.array(kinds, np.uint64)
    for i, f in enumerate(kinds):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= radius):
            x, y = sorted((root(f), root(kinds[i + 1 + j])))
            up[y] = x
    least = {}
    for (i, _), f in zip(rows, fps, strict=True):
        if i is not None:
            least[root(f)] = min(i, least.get(root(f), i))
    return [(i, f"{f:016x}", least.get(root(f))) for (i, _), f in zip(rows, fps, strict=True)]


def order(rows):
    return sorted(rows, key=str)


def test_query_equals_brute_force(spark, sf_dir):
    from millrace.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert order(map(tuple, QUERIES["op12_simhash"](spark, sf_dir).collect())) == order(brute(rows))


def test_odd_rows(spark):
    from millrace.llm.simhash import simhash_duplicates

    rng = random.Random(1)
    base = [f"w{i}" for i in range(300)]
    near = []
    for i in range(80):
        w = list(base)
        w[rng.randrange(300)] = f"x{i}"
        near.append((100 + i, " ".join(w)))
    rows = [(1, None), (2, ""), (None, " \n\t"), (3, "One"), (4, "one two"), (4, "one two"), (None, "one two"), (None, "é 日本 \U0001f600 a"), (5, "é  日本\n\U0001f600\ta"), (6, " ".join(f"v{i % 977}x{i}" for i in range(70_000))), (7, "x" * 5000 + " y z"), *near]
    docs = spark.createDataFrame([(i, t, 1, "f", 2) for i, t in rows], "doc_id long, text string, fp int, least string, label int").repartition(4)
    assert order(map(tuple, simhash_duplicates(docs).collect())) == order(brute(rows))
    assert simhash_duplicates(docs.limit(0)).collect() == []


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
@pytest.mark.parametrize("parts", [1, 2, 4, 8, 16, None])
def test_links_join_what_all_pairs_join(spark, monkeypatch, parts, radius):
    from millrace.llm import simhash as m

    monkeypatch.setattr(m, "TILE", 16)
    rng = np.random.default_rng(radius)
    seeds = rng.integers(0, 2**64, 60, dtype=np.uint64)
    fps = np.concatenate([seeds, *(seeds ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) for _ in range(3)), np.array([0, 1, 3, 2**64 - 1, 2**64 - 2], np.uint64)])
    fps = np.unique(np.concatenate([fps, fps[:100] ^ (np.uint64(5) << rng.integers(0, 61, 100, dtype=np.uint64))]))
    got = m.links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"), radius, parts).collect()
    at = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    joined = m.forest(np.array([at[r.a] for r in got], np.int64), np.array([at[r.b] for r in got], np.int64), len(fps))
    x, y = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius, 1))
    want = m.forest(x, y, len(fps))
    assert [list(map(int, k)) for k in joined] == [list(map(int, k)) for k in want]
    assert all(np.bitwise_count(fps[at[r.a]] ^ fps[at[r.b]]) <= 64 for r in got) and len(got) < 40 * len(fps)


def test_majority_counts_beyond_a_byte():
    from millrace.llm.simhash import majority

    rng = np.random.default_rng(0)
    sizes = [1, 2, 254, 255, 256, 1000, 0, 511]
    row = np.repeat(np.arange(8), sizes)
    h = rng.integers(0, 2**64, len(row), dtype=np.uint64) | np.uint64(1 << 63)
    got = majority(h, row, 8)
    for i, n in enumerate(sizes):
        bits = [(int(x) >> j) & 1 for j in range(64) for x in h[row == i]]
        assert int(got[i]) == sum(1 << j for j in range(64) if 2 * sum(bits[j * n : (j + 1) * n]) > n)
