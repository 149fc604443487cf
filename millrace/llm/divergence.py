"""How the sources of a language differ in their words: an audit by in-mapper stripes.

A stripe is a term with its document frequency and its count in each source. Tasks fold whole documents into stripes in hash order and
hand them on whenever FOLD cells are held; Spark sorts them by language and term, spilling as it needs, and one pass over the sorted rows
merges the stripes of a term, however many there are. Merged stripes travel in blocks of BLOCK terms. Each block, joined with its
language's totals, emits the divergences of its terms and its share of the divergence of every pair of sources.

A pair's sum runs over all kept terms, but only terms that both sources have are visited per pair: a term that one of them lacks has a
value that depends on its count in the other alone, so counts of counts give those sums, and the number of terms that neither has does
the rest. All arithmetic is on 64-bit integers and exact for totals up to 9 * 10^15 (shares by long division).

A language's sources, 24 bytes each, are one row: the result has a row for each pair of them. Inside one fold of a task terms are
told apart by 64-bit hashes, everywhere else by their text; sources of a language by hashes that are shown to differ (else hashed anew).

Edge cases: null text, language or source count as empty; every source of every language gets its pairs, even without terms; a language
without kept terms has pairs of value 0; ties go to the item of smaller bytes; repeated rows count as often as they occur; a language of
one source has no pairs; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.bytewords import U, words
from millrace.llm.stash import stash
from millrace.llm.terms import codes, grouped, texts, totals

#: Cells that a task holds before it hands stripes on.
FOLD = 1 << 20
#: Terms of a block of merged stripes.
BLOCK = 4096
#: Bytes of text that are split at once.
PART = 4 << 20
#: Entries of a table of pairs, and pairs that are made at once.
TILE, PAIRS = 1 << 22, 1 << 21
LETTERS = np.zeros(256, bool)
LETTERS[97:123] = LETTERS[128:] = True
STRIPE = "lang string, term string, df long, src array<long>, cnt array<long>"
BLOCKS = "lang string, terms array<string>, total array<long>, sizes array<long>, src array<long>, cnt array<long>"


def _lists(values, sizes: np.ndarray) -> pa.Array:
    at = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, and the rows' lengths."""
    return column.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)


def stripes(source: DataFrame) -> DataFrame:
    """(lang, term, df, src, cnt): stripes as tasks fold them, of (text, lang, h)."""

    def run(batches):
        langs: dict[str, int] = {}
        held: list[tuple] = []

        def flush():
            lang, term, src, c, d = (np.concatenate([h[i] for h in held]) for i in range(5))
            text = pa.concat_arrays([h[5] for h in held])
            held.clear()
            order, at = grouped([lang, term, src])
            cell = order[at]
            c, d = totals(c, order, at), totals(d, order, at)
            new = np.ones(len(cell), bool)
            new[1:] = (lang[cell[1:]] != lang[cell[:-1]]) | (term[cell[1:]] != term[cell[:-1]])
            head = np.flatnonzero(new)
            size, one, d = np.diff(np.append(head, len(cell))), cell[head], np.add.reduceat(d, head)
            of = pa.array(list(langs), pa.string())
            for i in range(0, len(head), 1 << 15):
                j = min(len(head), i + (1 << 15))
                cells = slice(head[i], head[j] if j < len(head) else len(cell))
                yield pa.RecordBatch.from_arrays([of.take(pa.array(lang[one[i:j]])), text.take(pa.array(one[i:j])).cast(pa.string()), pa.array(d[i:j]), _lists(src[cell][cells].view(np.int64), size[i:j]), _lists(c[cells], size[i:j])], ["lang", "term", "df", "src", "cnt"])

        for b in batches:
            code, h = codes(b.column(1), langs), b.column(2).to_numpy(zero_copy_only=False)
            for w in words(b.column(0), LETTERS, PART):
                if not len(w.start):
                    continue
                order, at = grouped([w.hash, w.row])  # a term of a document
                one, c = order[at], np.diff(np.append(at, len(order)))
                row = w.row[one] + w.first
                order, at = grouped([code[row], w.hash[one], h[row]])
                first = one[order[at]]
                held.append((code[row][order[at]], w.hash[first], h[row][order[at]], totals(c, order, at), np.diff(np.append(at, len(order))), texts(w.low, w.start[first], w.end[first])))
                if sum(len(x[0]) for x in held) >= FOLD:
                    yield from flush()
        if held:
            yield from flush()

    return source.mapInArrow(run, STRIPE)


def merged(parts: DataFrame, least: int) -> DataFrame:
    """Blocks of the merged stripes of at least `least` documents."""

    def fold(rows: pa.RecordBatch):
        """The rows' stripes, merged where neighbours are of one term: (index of a row of each, df, cells per stripe, src, cnt)."""
        n = rows.num_rows
        new = np.ones(n, bool)
        for i in (0, 1):
            x = rows.column(i)
            differs = pc.not_equal(x.slice(1), x.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            new[1:] = differs if not i else new[1:] | differs
        (src, size), (cnt, _) = _flat(rows.column(3)), _flat(rows.column(4))
        of = np.repeat(np.cumsum(new) - 1, size)
        order, at = grouped([of, src])
        cell = order[at]
        df = np.add.reduceat(rows.column(2).to_numpy(zero_copy_only=False), np.flatnonzero(new))
        return np.flatnonzero(new), df, np.bincount(of[cell], minlength=len(df)), src[cell], totals(cnt, order, at)

    def blocks(rows: pa.RecordBatch, one, df, size, src, cnt):
        keep = df >= least
        cells = np.repeat(keep, size)
        one, size, src, cnt = one[keep], size[keep], src[cells], cnt[cells]
        lang, term = rows.column(0).take(pa.array(one)), rows.column(1).take(pa.array(one))
        head = np.append(0, np.cumsum(size))
        total = np.add.reduceat(cnt, head[:-1]) if len(one) else cnt
        new = np.ones(len(one), bool)
        new[1:] = pc.not_equal(lang.slice(1), lang.slice(0, max(0, len(one) - 1))).to_numpy(zero_copy_only=False)
        starts = np.append(np.flatnonzero(new), len(one))
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            for i in range(a, b, BLOCK):
                j = min(b, i + BLOCK)
                row = [pa.array([lang[i].as_py()]), _lists(term.slice(i, j - i), np.array([j - i])), _lists(total[i:j], np.array([j - i])), _lists(size[i:j], np.array([j - i]))]
                yield pa.RecordBatch.from_arrays([*row, *(_lists(x[head[i] : head[j]], np.array([head[j] - head[i]])) for x in (src, cnt))], ["lang", "terms", "total", "sizes", "src", "cnt"])

    def run(batches):
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            rows = pa.Table.from_batches([last, b] if last is not None else [b]).combine_chunks().to_batches()[0]
            one, df, size, src, cnt = fold(rows)
            at = len(src) - size[-1]
            # The last term may go on in the next batch.
            last = pa.RecordBatch.from_arrays([rows.column(0).slice(one[-1], 1), rows.column(1).slice(one[-1], 1), pa.array(df[-1:]), _lists(src[at:], size[-1:]), _lists(cnt[at:], size[-1:])], schema=rows.schema)
            yield from blocks(rows, one[:-1], df[:-1], size[:-1], src[:at], cnt[:at])
        if last is not None:
            yield from blocks(last, *fold(last))

    return parts.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(run, BLOCKS)


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * (count + 1) / total), by long division; count < total < 9 * 10^15."""
    rest, out = count + 1, np.zeros(np.broadcast(count, total).shape, np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def parted(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _counts(blocks: DataFrame) -> DataFrame:
    """(lang, h, cnt, n): of each source, how many kept terms have each count."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                src, cnt = (b.column(k).slice(i, 1).flatten().to_numpy() for k in (1, 2))
                order, at = grouped([src, cnt])
                one = order[at]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.full(len(at), i))), pa.array(src[one]), pa.array(cnt[one]), pa.array(np.diff(np.append(at, len(order))))], ["lang", "h", "cnt", "n"])

    return blocks.select("lang", "src", "cnt").mapInArrow(run, "lang string, h long, cnt long, n long").groupBy("lang", "h", "cnt").agg(F.sum("n").alias("n"))


def _best(rows: pa.Table, top: int | None) -> pa.Table:
    """The first `top` rows of each (lang, h)."""
    rows = rows.take(pc.sort_indices(rows, [("lang", "ascending"), ("h", "ascending"), ("value", "descending"), ("term", "ascending")]))
    if top is None or not rows.num_rows:
        return rows
    h, lang = rows.column("h").to_numpy(), rows.column("lang").combine_chunks()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | pc.not_equal(lang.slice(1), lang.slice(0, len(h) - 1)).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(new)
    return rows.filter(pa.array(np.arange(len(h)) - np.repeat(at, np.diff(np.append(at, len(h)))) < top))


def _pair_rows(term: np.ndarray, s: np.ndarray, p: np.ndarray, p0: np.ndarray):
    """(s, o, value): for each pair of sources that share terms, what those add to the sum as if one of the two lacked them."""
    order = np.lexsort((s, term))
    term, s, p = term[order], s[order], p[order]
    size = np.bincount(term)[term]
    start = np.searchsorted(term, term)
    present, at = np.unique(s, return_inverse=True)
    n = len(present)
    step = max(1, TILE // n)
    for low in range(0, n, step):
        high = min(n, low + step)
        sums = np.zeros((high - low) * n, np.int64)
        mine = np.flatnonzero((at >= low) & (at < high))
        ends = np.cumsum(size[mine])
        i = 0
        while i < len(mine):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, "right")))
            a = np.repeat(mine[i:j], size[mine[i:j]])
            b = start[a] + np.arange(len(a)) - np.repeat(np.append(0, np.cumsum(size[mine[i:j]])[:-1]), size[mine[i:j]])
            pa_, pb, a0, b0 = p[a], p[b], p0[s[a]], p0[s[b]]
            np.add.at(sums, (at[a] - low) * n + at[b], parted(pa_, pb) - parted(pa_, b0) - parted(a0, pb) + parted(a0, b0))
            i = j
        some = np.flatnonzero(sums)
        yield present[low + some // n], present[some % n], sums[some]


SHARE = "lang string, h long, h2 long, term string, value long"


def _emitted(rows: DataFrame, top: int | None) -> DataFrame:
    """Of blocks with their language's sources: best terms (term not null) and parts of the sums of pairs (h2 not null)."""

    def run(batches):
        held: list[pa.Table] = []
        for b in batches:
            for i in range(b.num_rows):
                lang = b.column(0)[i].as_py()
                total, sizes, src, cnt, hs, ns = (b.column(k).slice(i, 1).flatten().to_numpy() for k in (2, 3, 4, 5, 6, 7))
                v, n = b.column(8)[i].as_py(), int(ns.sum())
                s, term = np.searchsorted(hs, src), np.repeat(np.arange(len(sizes)), sizes)
                p, q, p0 = shares(cnt, ns[s] + v), shares(total, np.int64(n + v)), shares(np.zeros_like(ns), ns + v)
                more = np.flatnonzero(p > q[term])
                names = b.column(1).slice(i, 1).flatten().take(pa.array(term[more]))
                held.append(pa.table({"lang": pa.array([lang] * len(more), pa.string()), "h": src[more], "h2": pa.nulls(len(more), pa.int64()), "term": names, "value": parted(p[more], q[term[more]])}))
                if sum(x.num_rows for x in held) > FOLD:
                    best = _best(pa.concat_tables(held), top)
                    held = [best]
                    if best.num_rows > FOLD // 2:
                        yield from best.to_batches()
                        held = []
                for one, other, value in _pair_rows(term, s, p, p0):
                    k = len(value)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * k, pa.string()), pa.array(hs[one]), pa.array(hs[other]), pa.nulls(k, pa.string()), pa.array(value)], ["lang", "h", "h2", "term", "value"])
        if held:
            yield from _best(pa.concat_tables(held), top).combine_chunks().to_batches()

    return rows.mapInArrow(run, SHARE)


def _alone(rows: DataFrame) -> DataFrame:
    """Of each source's counts of counts: its sums with every other source as if they shared no term."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                lang, h, v = (b.column(k)[i].as_py() for k in (0, 1, 7))
                cnt, n, hs, ns, terms = (b.column(k).slice(i, 1).flatten().to_numpy() for k in (2, 3, 4, 5, 6))
                s = int(np.searchsorted(hs, h))
                there, back = np.zeros(len(hs), np.int64), np.zeros(len(hs), np.int64)
                if v:
                    p0 = shares(np.zeros_like(ns), ns + v)
                    there += (v - terms - terms[s]) * parted(p0[s], p0)
                    step = max(1, TILE // len(hs))
                    for k in range(0, len(cnt), step):
                        p, w = shares(cnt[k : k + step], ns[s] + v)[:, None], n[k : k + step, None]
                        there += (w * parted(p, p0)).sum(axis=0)
                        back += (w * parted(p0, p)).sum(axis=0)
                other, k = hs != h, len(hs) - 1
                lang = pa.array([lang] * k, pa.string())
                yield pa.RecordBatch.from_arrays([lang, pa.array(np.full(k, h)), pa.array(hs[other]), pa.nulls(k, pa.string()), pa.array(there[other])], ["lang", "h", "h2", "term", "value"])
                yield pa.RecordBatch.from_arrays([lang, pa.array(hs[other]), pa.array(np.full(k, h)), pa.nulls(k, pa.string()), pa.array(back[other])], ["lang", "h", "h2", "term", "value"])

    return rows.mapInArrow(run, SHARE)


def _groups(docs: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """docs with h, a hash of the source; and (lang, source, h) of every source of every language, all h of a language different."""
    docs = docs.withColumn("h", F.xxhash64("source", F.lit(seed)))
    groups = stash(docs.select("lang", "source", "h").distinct())
    if not groups.groupBy("lang", "h").count().filter("count > 1").isEmpty():
        return _groups(docs, seed + 1)
    return docs.select("text", "lang", "h"), groups


def divergences(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = 3, top: int | None = 200) -> DataFrame:
    """Per language and source: lang, source, part, item, value, rank.

    p is the share of a term in a source, q its share in another source or in the language, in billionths, with one occurrence of each
    kept term (in `least` documents of the language) added; a term's divergence is floor((p - q)^2 / q). Part `pair`: item is each
    other source of the language, value the sum over all kept terms. Part `term`: item is a term that the source has more of than the
    language, the first `top` (all, if None).
    """
    plain = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    docs, groups = _groups(docs.select(plain(text, "text"), plain(lang, "lang"), plain(source, "source")))
    blocks = stash(merged(stripes(docs), least))
    counts = stash(_counts(blocks))
    per = counts.groupBy("lang", "h").agg(F.sum(F.col("cnt") * F.col("n")).alias("size"), F.sum("n").alias("terms"), F.collect_list("cnt").alias("cnt"), F.collect_list("n").alias("n"))
    per = stash(groups.select("lang", "h").join(per, ["lang", "h"], "left").fillna(0, ["size", "terms"]))
    kept = blocks.groupBy("lang").agg(F.sum(F.size("terms")).alias("v"))
    of = per.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("h", "size", "terms"))).alias("all"))
    of = of.join(kept, "lang", "left").select("lang", F.col("all.h").alias("hs"), F.col("all.size").alias("ns"), F.col("all.terms").alias("ts"), F.coalesce("v", F.lit(0)).cast("long").alias("v"))
    of = stash(of)
    emitted = stash(_emitted(blocks.join(of.drop("ts"), "lang").select("lang", "terms", "total", "sizes", "src", "cnt", "hs", "ns", "v"), top))
    none = F.array().cast("array<long>")
    alone = _alone(per.join(of, "lang").select("lang", "h", F.coalesce("cnt", none).alias("cnt"), F.coalesce("n", none).alias("n"), "hs", "ns", "ts", "v"))
    pairs = emitted.filter("h2 is not null and h <> h2").unionByName(alone).groupBy("lang", "h", "h2").agg(F.sum("value").alias("value"))
    pairs = pairs.join(groups.withColumnRenamed("source", "item").withColumnRenamed("h", "h2"), ["lang", "h2"])
    rows = pairs.select("lang", "h", F.lit("pair").alias("part"), "item", "value")
    found = emitted.filter("h2 is null").select("lang", "h", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    rank = F.row_number().over(Window.partitionBy("lang", "h").orderBy(F.desc("value"), "item"))
    found = found.withColumn("rank", rank) if top is None else found.withColumn("rank", rank).filter(F.col("rank") <= top)
    rows = rows.withColumn("rank", rank).unionByName(found).join(groups, ["lang", "h"])
    return rows.select("lang", "source", "part", "item", "value", "rank")
