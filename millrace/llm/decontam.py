"""Benchmark decontamination by winnowing.

Every run of `gram` words gets a hash; of each `span - gram + 1` neighbouring hashes the least one is kept
(the rightmost of equal ones). Two texts that share `span` words share all hashes of that run, so they keep the
same one: a shared span of that length is never missed. Kept hashes of documents and items are joined, and each
hit is extended word by word, which also removes chance collisions.

A benchmark item shorter than `span` is one window; it is found by the hash of all its words, for which
documents keep each run of that length.

Scale: documents send only fingerprints that a bitmap of the benchmark's fingerprints lets through (its size is
fixed by `max_bits`, whatever the benchmark's size: a larger benchmark lets more chance hits into the exact join).
The join is a shuffle join on the hash, which adaptive execution splits where one passage is in very many documents.

Edge cases: a null or wordless text has no words, no hits and is not contaminated; a wordless item never occurs;
equal items each count; repeated document rows each get their own result row; an empty table on either side works;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.bytewords import ALNUM, U, Words, bitmap, grams, marked, words
from millrace.llm.stash import stash

HIT = "hash long, pos long, lead int, ctx string, short int"
HITS = pa.list_(pa.struct([("hash", pa.int64()), ("pos", pa.int64()), ("lead", pa.int32()), ("ctx", pa.string()), ("short", pa.int32())]))


def winnowed(w: Words, gram: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Start words of the kept runs, in order, and the hash of each run of the chunk."""
    g, _ = grams(w, gram)
    wide = span - gram + 1
    n = len(w.hash) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64), g
    best, at = g[:n].copy(), np.arange(n)
    for j in range(1, wide):
        less = g[j : j + n] <= best
        np.copyto(best, g[j : j + n], where=less)
        at[less] = np.flatnonzero(less) + j
    keep = np.zeros(len(g), bool)
    keep[at[w.row[:n] == w.row[span - 1 : span - 1 + n]]] = True
    return np.flatnonzero(keep), g


def _context(w: Words, p: int, before: int, after: int) -> tuple[int, str]:
    a = max(int(w.head[w.row[p]]), p - before)
    b = min(int(w.head[w.row[p] + 1]), p + after)
    return p - a, w.text(a, b)


def _hits(w: Words, gram: int, span: int, shorts: tuple[int, ...], passes) -> Iterator[tuple[int, dict]]:
    """(row, fingerprint) for the kept runs that pass, and all runs of the lengths in `shorts`."""
    at, g = winnowed(w, gram, span)
    for p in at[passes(g[at])].tolist():
        lead, ctx = _context(w, p, span - gram, span)
        yield int(w.row[p]), {"hash": int(g[p].view(np.int64)), "pos": p - int(w.head[w.row[p]]), "lead": lead, "ctx": ctx, "short": 0}
    for m in shorts:
        g, whole = grams(w, m)
        g = g ^ U(m)
        for p in np.flatnonzero(passes(g) & whole).tolist():
            yield int(w.row[p]), {"hash": int(g[p].view(np.int64)), "pos": p - int(w.head[w.row[p]]), "lead": 0, "ctx": w.text(p, p + m), "short": m}


def fingerprint_items(items: DataFrame, item_id: str, text: str, gram: int, span: int) -> DataFrame:
    """Fingerprints of all items: item_id string, n_words, hash, pos, lead, ctx, short (0, or the words of a short item)."""

    def run(batches):
        for b in batches:
            ids, rows = b.column(0).to_pylist(), []
            for w in words(b.column(1), ALNUM):
                for r, hit in _hits(w, gram, span, (), lambda g: np.ones(len(g), bool)):
                    rows.append({"item_id": ids[w.first + r], **hit})
                for r in np.flatnonzero((w.count > 0) & (w.count < span)).tolist():
                    one = Words(0, 1, w.low, w.start[w.head[r] : w.head[r + 1]], w.end[w.head[r] : w.head[r + 1]], np.zeros(w.count[r], int), np.array([0, w.count[r]]), w.hash[w.head[r] : w.head[r + 1]])
                    g, _ = grams(one, len(one.hash))
                    rows.append({"item_id": ids[w.first + r], "hash": int((g ^ U(len(one.hash))).view(np.int64)[0]), "pos": 0, "lead": 0, "ctx": one.text(0, len(one.hash)), "short": len(one.hash)})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("item_id", pa.string()), *HITS.value_type]))

    return items.select(F.col(item_id).cast("string"), F.col(text).cast("string")).mapInArrow(run, f"item_id string, {HIT}")


def _probe(docs: DataFrame, doc_id: str, text: str, marks: np.ndarray, shorts: tuple[int, ...], gram: int, span: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(marks)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        def passes(g: np.ndarray) -> np.ndarray:
            return marked(shared.value, g)

        for b in batches:
            count, hits = np.zeros(b.num_rows, np.int64), [[] for _ in range(b.num_rows)]
            for w in words(b.column(1), ALNUM):
                count[w.first : w.last] = w.count
                for r, hit in _hits(w, gram, span, shorts, passes):
                    hits[w.first + r].append(hit)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(count), pa.array(hits, HITS)], ["doc_id", "rid", "n_words", "hits"])

    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.monotonically_increasing_id().alias("rid"))
    return src.mapInArrow(run, f"doc_id {kind}, rid long, n_words long, hits array<struct<{HIT.replace(' ', ':').replace(',:', ', ')}>>")


def extend(pos: int, lead: int, ctx: str, short: int, item_lead: int, item_ctx: str, gram: int, span: int) -> tuple[int, int] | None:
    """The run of equal words through a hit as document word numbers (end exclusive); None if it is too short."""
    a, b, k = ctx.split(" "), item_ctx.split(" "), short or gram
    if a[lead : lead + k] != b[item_lead : item_lead + k]:
        return None
    left = right = 0
    while left < min(lead, item_lead) and a[lead - left - 1] == b[item_lead - left - 1]:
        left += 1
    while right < min(len(a) - lead, len(b) - item_lead) - k and a[lead + k + right] == b[item_lead + k + right]:
        right += 1
    return (pos - left, pos + k + right) if left + k + right >= (short or span) else None


def matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", gram: int = 5, span: int = 10, max_bits: int = 27) -> tuple[DataFrame, DataFrame]:
    """(each document row: doc_id, rid, n_words), (each hit: rid, item_id, from_word, to_word)."""
    marks = stash(fingerprint_items(items, item_id, item_text, gram, span))
    shorts = tuple(r[0] for r in marks.filter("short > 0").select("short").distinct().collect())  # fewer than span values
    seen = stash(_probe(docs, doc_id, text, bitmap(marks, "hash", max_bits), shorts, gram, span))
    hits = seen.filter(F.size("hits") > 0).select("rid", F.inline("hits"))
    both = hits.join(marks.select("item_id", "hash", "short", F.col("lead").alias("item_lead"), F.col("ctx").alias("item_ctx")), ["hash", "short"])

    def grown(batches):
        for b in batches:
            got = [(r["rid"], r["item_id"], *x) for r in b.to_pylist() if (x := extend(r["pos"], r["lead"], r["ctx"], r["short"], r["item_lead"], r["item_ctx"], gram, span))]
            yield pa.RecordBatch.from_pydict(dict(zip(("rid", "item_id", "from_word", "to_word"), zip(*got, strict=True) if got else ([],) * 4, strict=True)), schema=pa.schema([("rid", pa.int64()), ("item_id", pa.string()), ("from_word", pa.int64()), ("to_word", pa.int64())]))

    return seen.select("doc_id", "rid", "n_words"), both.mapInArrow(grown, "rid long, item_id string, from_word long, to_word long")


def contamination(docs: DataFrame, items: DataFrame, **params) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items (sorted item ids), spans (hit word ranges), contaminated."""
    base, hits = matches(docs, items, **params)
    one = (
        hits.groupBy("rid")
        .agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.sort_array(F.collect_set(F.struct("from_word", "to_word"))).alias("runs"))
        # Sorted runs, merged where they overlap or touch.
        .withColumn(
            "spans",
            F.expr("""aggregate(runs, cast(array() as array<struct<from_word:bigint,to_word:bigint>>), (s, x) ->
                if(size(s) > 0 and element_at(s, -1).to_word >= x.from_word,
                   concat(slice(s, 1, size(s) - 1), array(struct(element_at(s, -1).from_word as from_word, greatest(element_at(s, -1).to_word, x.to_word) as to_word))),
                   concat(s, array(x))))"""),
        )
    )
    none = F.expr("cast(array() as array<string>)")
    return (
        base.join(one, "rid", "left")
        .select("doc_id", "n_words", F.expr("coalesce(aggregate(spans, 0L, (n, x) -> n + x.to_word - x.from_word), 0L)").alias("n_hit"), F.coalesce("items", none).alias("items"), "spans")
        .select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "spans", (F.col("n_hit") > 0).alias("contaminated"))
    )
