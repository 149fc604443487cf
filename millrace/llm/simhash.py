"""SimHash near-duplicates: fingerprints, and an exact tiled comparison of all different ones.

A fingerprint has a bit for each bit of the shingles' hashes: 1, if more than half of them have it set. Equal fingerprints are one
node. Nodes are dealt to tiles by the population counts of `parts` equal pieces of the fingerprint; a tile holds about TILE nodes of one such
class, larger classes have several. Every pair of tiles is compared with numpy exclusive-or and bit counts, except pairs whose population counts
differ by more than the radius in sum, in which no two fingerprints can be near enough. So all pairs within the radius are found, at
any size; `parts` (by default the least of 1, 2, 4, 8, 16 that brings classes down to a tile each, were the bits even) only changes the
number of pairs of tiles. A pair of tiles hands on a spanning forest of its links, never more rows than it has nodes.

Edge cases: a null or wordless text has fingerprint 0 and is linked like any other; fewer words than `shingle` are one shingle; rows
without an id get the least id of their component, null if it has none; repeated rows all get their row; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.bytewords import SPACED, U, Words, words
from millrace.llm.components import components
from millrace.llm.stash import stash

#: Nodes of a tile.
TILE = 2048
#: Shingles that are hashed, and rows of a tile that are compared, at once.
RUN, STRIP = 1 << 16, 256


def _hashed(w: Words, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of a chunk, joined by single spaces, repeats included; and its row. Sorted by row."""
    size = w.end - w.start
    at = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size + 1, out=at[1:])
    line = np.full(at[-1], 32, np.uint8)
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    line[np.repeat(at[:-1], size) + within] = w.low[np.repeat(w.start, size) + within]
    line = line.tobytes()
    full = np.flatnonzero(w.row[: max(0, len(size) - k + 1)] == w.row[k - 1 :])
    few = np.flatnonzero((w.count > 0) & (w.count < k))
    row = np.concatenate([w.row[full], few])
    start = np.concatenate([at[full], at[w.head[few]]])
    end = np.concatenate([at[full + k], at[w.head[few + 1]]]) - 1
    order = np.argsort(row, kind="stable")
    start, end, out = start[order], end[order], np.empty(len(row), U)
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(row), RUN):
        out[i : i + RUN] = [digest(line[a:b], seed) for a, b in zip(start[i : i + RUN].tolist(), end[i : i + RUN].tolist(), strict=True)]
    return out, row[order]


def majority(h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Of each row, the bits that more than half of its hashes have; row is sorted. Eight counters of a byte share a word, for up to 255 hashes."""
    out = np.zeros(rows, U)
    if not len(h):
        return out
    head = np.searchsorted(row, np.arange(rows + 1))
    segment = np.flatnonzero((np.arange(len(h)) - head[row]) % 255 == 0)
    counts = np.empty((len(segment), 8, 8), np.int64)  # byte of the word, bit of the byte
    for k in range(8):
        lanes = np.add.reduceat((h >> U(k)) & U(0x0101010101010101), segment)
        counts[:, :, k] = lanes.astype("<u8").view(np.uint8).reshape(-1, 8)
    full = np.flatnonzero(np.diff(head))
    first = np.searchsorted(segment, head[full])
    total = np.add.reduceat(counts.reshape(-1, 64), first, axis=0)
    bits = (2 * total > np.diff(head)[full][:, None]).astype(U)
    out[full] = np.bitwise_or.reduce(bits << np.arange(64, dtype=U), axis=1)
    return out


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): each row's fingerprint, as a long."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for b in batches:
            fp = np.zeros(b.num_rows, U)
            for w in words(b.column(1), SPACED, hashes=False):
                fp[w.first : w.last] = majority(*_hashed(w, shingle, seed), w.last - w.first)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def _class(fp: str, parts: int, radius: int) -> Column:
    """The population counts of `parts` pieces as one number, whose digits leave room for `radius` on both sides."""
    bits = 64 // parts
    mask = -1 if parts == 1 else (1 << bits) - 1
    digits = [f"(bit_count(shiftrightunsigned({fp}, {i * bits}) & {mask}L) + {radius}L) * {_base(parts, radius) ** i}L" for i in range(parts)]
    return F.expr(" + ".join(digits))


def _base(parts: int, radius: int) -> int:
    return 64 // parts + 1 + 2 * radius


def steps(parts: int, radius: int) -> list[int]:
    """Differences of class numbers whose population counts differ by at most radius in sum; of a step and its opposite only the one above 0."""
    out = {0}
    for n in range(1, min(parts, radius) + 1):
        for at in itertools.combinations(range(parts), n):
            for by in itertools.product(range(-radius, radius + 1), repeat=n):
                if 0 not in by and sum(map(abs, by)) <= radius:
                    out.add(sum(d * _base(parts, radius) ** i for i, d in zip(at, by, strict=True)))
    return sorted(x for x in out if x >= 0)


def _parts(n: int) -> int:
    """Pieces for n nodes: the fewest that give about n / TILE classes, going by the spread of even bits' counts."""
    return next((p for p in (1, 2, 4, 8) if n <= TILE * max(1.0, math.sqrt(2 * math.pi * math.e * 16 / p)) ** p), 16)


def near(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indexes of the pairs of a and b (of one tile, if same) within the radius."""
    for i in range(0, len(a), STRIP):
        x, y = np.nonzero(np.bitwise_count(a[i : i + STRIP, None] ^ b[None, i if same else 0 :]) <= radius)
        x, y = x + i, y + (i if same else 0)
        yield (x[x < y], y[x < y]) if same else (x, y)


def forest(x: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A link from each of n nodes to the least node that the links (x, y) reach, if it is another."""
    to = np.arange(n)
    while True:
        low = np.minimum(to[x], to[y])
        if (to[x] == low).all() and (to[y] == low).all():
            some = np.flatnonzero(to != np.arange(n))
            return some, to[some]
        np.minimum.at(to, to[x], low)
        np.minimum.at(to, to[y], low)
        to = to[to]


def links(nodes: DataFrame, radius: int = 2, parts: int | None = None) -> DataFrame:
    """(a, b): links of a column fp of different longs, that join what pairs within the radius join."""
    parts = parts or _parts(nodes.count())
    nodes = nodes.select("fp", _class("fp", parts, radius).alias("class"))
    classes = stash(nodes.groupBy("class").agg(F.ceil(F.count("*") / TILE).alias("tiles")))
    nodes = nodes.join(classes, "class").withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")))
    tiles = stash(nodes.groupBy("class", "tile").agg(F.collect_list("fp").alias("fps")))
    beside = classes.withColumn("step", F.explode(F.array(*map(F.lit, steps(parts, radius)))))
    beside = beside.select("class", "tiles", (F.col("class") + F.col("step")).alias("class2"))
    beside = beside.join(classes.select(F.col("class").alias("class2"), F.col("tiles").alias("tiles2")), "class2")
    beside = beside.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    first = F.when(F.col("class") == F.col("class2"), F.col("tile")).otherwise(0)
    beside = beside.withColumn("tile2", F.explode(F.sequence(first, F.col("tiles2") - 1)))
    named = lambda i: tiles.select(F.col("class").alias(f"class{i}"), F.col("tile").alias(f"tile{i}"), F.col("fps").alias(f"fps{i}"))
    pairs = beside.join(tiles, ["class", "tile"]).join(named(2), ["class2", "tile2"])
    pairs = pairs.select(((F.col("class") == F.col("class2")) & (F.col("tile") == F.col("tile2"))).alias("same"), "fps", "fps2")

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                x, y = (b.column(k).slice(i, 1).flatten().to_numpy() for k in (1, 2))
                same = b.column(0)[i].as_py()
                found = list(near(x.view(U), y.view(U), radius, same))
                p, q = (np.concatenate([f[k] for f in found]) for k in (0, 1))
                if len(p):
                    both = x if same else np.concatenate([x, y])
                    p, q = forest(p, q if same else q + len(x), len(both))
                    yield pa.RecordBatch.from_arrays([pa.array(both[p]), pa.array(both[q])], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def simhash_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2, seed: int = 42, parts: int | None = None) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hexadecimal digits), component_id (least doc_id reachable over links of at most radius bits)."""
    rows = stash(fingerprints(docs, doc_id, text, shingle, seed))
    nodes = stash(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = components(stash(links(nodes, radius, parts)))
    of = stash(nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label")))
    of = of.select("fp", "label").join(of.groupBy("label").agg(F.min("least").alias("component_id")), "label").drop("label")
    return rows.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
