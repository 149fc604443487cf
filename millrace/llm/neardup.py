"""MinHash near-duplicates by a signature-coordinate inverted join.

A document's set is its distinct runs of `shingle` words. Documents with equal sets form a class with one
representative (node). A node's signature has COORDS minima; it is posted under its (coordinate, value) pairs. Two sets of
Jaccard similarity 0.8 agree in 51 of 64 coordinates on average, and in fewer than AGREE = 36 about once in 10^5 pairs.
Sets that agree in AGREE coordinates share one of the COORDS - AGREE + 1 rarest values of either, so only these
prefixes are merged, and the long lists of frequent values are skipped; agreement is then counted on the signatures
themselves, and every pair that reaches AGREE is confirmed on full sets.

No list is expanded into all its pairs. First each list is compared with its most central member alone, which joins groups
of near copies; long lists that still span several components are compared with one more member at a time, while that
helps. Then only lists that span components are left, and only pairs across components are looked at: members outside the
list's largest component against all members, and a pair that meets in several lists is made in one of them: each post carries
the FEW least tokens of its node, and where two nodes share some of these, the least of them alone makes the pair. Members of long
lists of that kind (a passage that makes up most of many short documents, outliers of a large group) are compared by their
full sets instead, which is exact. Each has a hub, a member of its largest group: whoever is like the hub is linked to it, and two that are alike without that differ from
the hub in the same shingles for the most part, by which they meet (see _hub_pairs). Members with different hubs go through a prefix join: similar sets share one of the
rarest fifth of their shingles, and what a set shares with no other bounds its similarity to any. Nothing is capped or left out. Whether a list is
long changes only the cost: signatures miss a pair about once in 10^5, full sets never.

Edge cases: a null or wordless text has an empty set and is linked with nothing; fewer words than `shingle` are one
shingle; rows with one doc_id count as one document, rows without one as a document each, after those with one; equal rows all get their row; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.bytewords import SPACED, U, Words, bitmap, grams, marked, mix, words
from millrace.llm.components import components
from millrace.llm.dropping import keyed
from millrace.llm.stash import stash

COORDS, AGREE = 64, 36
#: Lists of more members that still span components after the first pass are joined on full sets.
LONG_LIST = 64
#: Least tokens of a node that each of its posts carries.
FEW = 8
#: Bits of a set that are compared before a pair of such a join is taken on.
BITS = 512
#: Ratio of the bounds of a band of set sizes in such a join.
BAND = 1.05
_rng = np.random.default_rng(64)
_MUL = _rng.integers(1, 2**63, COORDS, dtype=np.uint64) | U(1)
_ADD = _rng.integers(0, 2**63, COORDS, dtype=np.uint64)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's distinct shingles, sorted within the row, and each row's bounds in them."""
    g, ok = grams(w, k)
    hashes, rows = [g[ok]], [w.row[: len(g)][ok]]
    for m in range(1, k):
        r = np.flatnonzero(w.count == m)
        if len(r):
            hashes.append(grams(w, m)[0][w.head[r]] ^ U(m))
            rows.append(r)
    h, r = np.concatenate(hashes), np.concatenate(rows)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[new], r[new]
    return h, np.searchsorted(r, np.arange(w.last - w.first + 1))


def _lists(values: np.ndarray, head: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(head.astype(np.int32)), pa.array(values, kind))


def signatures(docs: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """Per row: doc_id, rid, n, h1, h2 (of the set), sig (COORDS ints), pack (6 bits of each coordinate, 8 longs)."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for b in batches:
            n = np.zeros(b.num_rows, np.int64)
            h1, h2 = np.zeros(b.num_rows, U), np.zeros(b.num_rows, U)
            sig = np.zeros((b.num_rows, COORDS), U)
            for w in words(b.column(1), SPACED):
                h, head = shingles(w, shingle)
                size = np.diff(head)
                full = np.flatnonzero(size)
                n[w.first : w.last] = size
                if not len(full):
                    continue
                at = head[full]
                h1[w.first + full] = np.add.reduceat(mix(h), at)
                h2[w.first + full] = np.add.reduceat(mix(h ^ U(0x5851F42D4C957F2D)), at)
                for j in range(COORDS):
                    sig[w.first + full, j] = np.minimum.reduceat((h * _MUL[j] + _ADD[j]) >> U(32), at)
            six = (sig & U(63)).reshape(-1, 8, 8) << (np.arange(8, dtype=U) * U(8))
            pack = np.bitwise_or.reduce(six, axis=2).astype(np.int64)
            rows = np.arange(b.num_rows + 1)
            cols = [b.column(0), b.column(2), pa.array(n), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), _lists(sig.astype(np.uint32).view(np.int32).ravel(), rows * COORDS, pa.int32()), _lists(pack.ravel(), rows * 8, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "rid", "n", "h1", "h2", "sig", "pack"])

    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.monotonically_increasing_id().alias("rid"))
    return src.mapInArrow(run, f"doc_id {kind}, rid long, n long, h1 long, h2 long, sig array<int>, pack array<long>")


def _sets(docs: DataFrame, doc_id: str, text: str, nodes: DataFrame, shingle: int) -> DataFrame:
    """(node, set): the sorted shingle hashes of the documents in nodes, and of a few more.

    A bit table of the nodes' ids picks the documents where they are read, so no text is shuffled.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(nodes.select(F.xxhash64("node").alias("h")), "h"))

    def run(batches):
        cells = shared.value
        for b in batches:
            b = b.filter(pa.array(marked(cells, b.column(2).to_numpy(zero_copy_only=False).view(U))))
            ids = b.column(0)
            for w in words(b.column(1), SPACED):
                h, head = shingles(w, shingle)
                yield pa.RecordBatch.from_arrays([ids.slice(w.first, w.last - w.first), _lists(h.view(np.int64), head, pa.int64())], ["node", "set"])

    mine = docs.select(F.col(doc_id).alias("node"), F.col(text).cast("string").alias("text"), F.xxhash64(doc_id).alias("h"))
    return mine.mapInArrow(run, f"node {kind}, set array<long>")


def _agree(a: str, b: str) -> Column:
    """Coordinates in which two packed signatures agree; by 6 bits of each, so at least as many as truly agree."""
    differ = [f"bit_count(((element_at({a}, {i}) ^ element_at({b}, {i})) + {0x3F3F3F3F3F3F3F3F}L) & {0x4040404040404040}L)" for i in range(1, 9)]
    return F.expr(f"{COORDS} - ({' + '.join(differ)})")


def _few(tokens: Column) -> Column:
    return F.slice(F.sort_array(tokens), 1, FEW).alias("few")


def _sized(a: str, b: str, percent: int) -> Column:
    return F.expr(f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})")


def _spanning(post: DataFrame, labels: DataFrame) -> DataFrame:
    """The posts of lists that span components, with comp, members (of the list), top (its largest component) and major (whether comp is that)."""
    own = post.drop("comp", "members", "major", "top").join(labels, "node", "left").withColumn("comp", F.coalesce("label", "node")).drop("label")
    per = own.groupBy("tok", "comp").agg(F.count("*").alias("c"))
    lists = stash(per.groupBy("tok").agg(F.count("*").alias("comps"), F.sum("c").alias("members"), F.max(F.struct("c", "comp"))["comp"].alias("top")).filter("comps > 1"))
    return stash(own.join(lists, "tok").withColumn("major", F.col("comp") == F.col("top")).drop("comps"))


def _leads(post: DataFrame) -> DataFrame:
    """Per list, its most central member that has not led it yet: the one whose values are the most common ones."""
    lead = post.filter(~F.col("seen")).groupBy("tok").agg(F.max(F.struct("weight", "node", "n", "pack", "comp")).alias("lead"))
    return stash(lead.select("tok", F.col("lead.node").alias("lead"), F.col("lead.n").alias("n2"), F.col("lead.pack").alias("pack2"), F.col("lead.comp").alias("comp2")))


def _led(post: DataFrame, lead: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of a list's leader with its members of other components."""
    pairs = post.join(lead, "tok").filter((F.col("comp") != F.col("comp2")) & _sized("n", "n2", percent) & (_agree("pack", "pack2") >= AGREE))
    return pairs.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()


def _across(post: DataFrame, percent: int, sets: bool) -> DataFrame:
    """Pairs (node, node2) of different components in one list, that sizes and signatures allow; for posts of sets, that sizes and
    `least` allow (see _set_posts). A pair of many common lists is made in one, or in few if both carry none of them."""
    cols = ["tok", "node", "n", "comp", "major", "seen", "few", *(["shared", "bits", "hub"] if sets else ["pack"])]
    y = post.select(*[F.col(c).alias(f"{c}2") for c in cols])
    x = post.select(*cols).filter(~F.col("major"))
    cond = (F.col("comp") != F.col("comp2")) & (F.col("major2") | (F.col("node") < F.col("node2"))) & ~F.col("seen") & ~F.col("seen2") & _sized("n", "n2", percent)
    if sets:
        # In common: at most what a set shares with any other, less one for each bit that it has and the other lacks.
        cond = (F.col("hub") != F.col("hub2")) & cond
        for most in ("least(shared, shared2)", f"shared - {_lacks('', '2')}", f"shared2 - {_lacks('2', '')}"):
            cond = cond & F.expr(f"{100 + percent} * ({most}) >= {percent} * (n + n2)")
    else:
        cond = cond & (_agree("pack", "pack2") >= AGREE)
    here = F.col("tok") == F.coalesce(F.array_min(F.array_intersect("few", "few2")), "tok")
    return x.join(y, (F.col("tok") == F.col("tok2")) & cond & here).select("node", "node2")


def _pairs_across(post: DataFrame, percent: int, sets: bool = False) -> DataFrame:
    """Distinct pairs (a, b), a < b, of _across."""
    return _across(post, percent, sets).select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()


def _confirmed(pairs: DataFrame, docs: DataFrame, doc_id: str, text: str, shingle: int, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough.

    No aggregation follows the joins in their stages, so adaptive execution can split a node of very many pairs.
    """
    pairs = stash(pairs)
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = stash(_sets(docs, doc_id, text, nodes, shingle))
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
    both = both.withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return stash(both.filter(F.expr(f"100 * common >= {percent} * (size(sa) + size(sb) - common)")).select("a", "b"))


def _bits() -> Column:
    """Of toks (c, tok): a bit table of BITS bits."""
    return F.expr(f"transform(sequence(0, {BITS // 64 - 1}), w -> aggregate(filter(toks, t -> shiftright(t.tok & {BITS - 1}, 6) = w), 0L, (b, t) -> b | shiftleft(1L, cast(t.tok & 63 as int))))")


def _lacks(a: str, b: str) -> str:
    """Bits that one set has and the other lacks, to be subtracted."""
    return " - ".join(f"bit_count(element_at(bits{a}, {i}) & ~element_at(bits{b}, {i}))" for i in range(1, BITS // 64 + 1))


def _apart(sets: DataFrame, long: DataFrame) -> DataFrame:
    """(node, hub, at, n, nh, d, apart): what each set of the nodes in `long` (node, hub) has and its hub lacks, or the other way round."""
    hubs = stash(sets.join(long.select(F.col("hub").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("hub"), F.col("set").alias("hset")).dropDuplicates(["hub"]))
    both = sets.join(long.select("node", "hub"), "node").join(hubs, "hub")
    apart = F.concat(F.array_except("set", "hset"), F.array_except("hset", "set"))
    return stash(both.select("node", "hub", F.monotonically_increasing_id().alias("at"), F.size("set").alias("n"), F.size("hset").alias("nh"), apart.alias("apart")).withColumn("d", F.size("apart")))


def _like_hub(percent: int) -> Column:
    return F.expr(f"{100 + percent} * d <= {100 - percent} * (n + nh)")


def _hub_pairs(apart: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b), a < b, of nodes with one hub that may be alike, in different components and not both like the hub.

    Sets x and y that are d(x) and d(y) elements apart from their hub are d(x) + d(y) - 2 c apart from each other, if c elements of the two differences
    are the same; alike are those of at most q (n(x) + n(y)) apart, q = (100 - percent) / (100 + percent). With c = 0 both are like the hub (q < 1, and the sizes of set and
    hub differ by d at most). For any other pair c is at least 1, and where x is unlike the hub, so that d(x) > q (n(x) + nh), more than
    (d(y) + q (nh - n(y))) / 2: over half of y's difference, of which most is y's own. So few elements, the rarest, are posted: all but those c, less one.
    Two that are unlike the hub meet in lists of their own (`out`), where this holds for either; where only x is unlike it, its c is over (d(x) - q (n(x) + nh)) / 2 or equal.
    """
    q = (100 - percent) / (100 + percent)
    one = apart.select("hub", "at", F.explode("apart").alias("tok"))
    freq = stash(one.groupBy("hub", "tok").agg(F.count("*").alias("c")).filter("c > 1"))
    toks = one.join(freq, ["hub", "tok"]).groupBy("at").agg(F.sort_array(F.collect_list(F.struct("c", "tok"))).alias("toks"))
    mine = apart.drop("apart").join(toks, "at").join(comps, "node").withColumns({"like": _like_hub(percent), "shared": F.size("toks"), "bits": _bits()})
    # A hair below, so that rounding costs no pair.
    far = F.floor(F.expr(f"(d + {q}D * (nh - n)) / 2 - 1e-6")) + 1
    near = F.ceil(F.expr(f"(d - {q}D * (n + nh)) / 2 - 1e-6"))
    lists = F.when(F.col("like"), F.array(F.struct(F.lit(False).alias("out"), far.alias("c")))).otherwise(F.array(F.struct(F.lit(False).alias("out"), near.alias("c")), F.struct(F.lit(True).alias("out"), far.alias("c"))))
    mine = mine.withColumn("list", F.explode(lists)).withColumn("take", (F.col("shared") - F.greatest("list.c", F.lit(1)) + 1).cast("int")).filter("take > 0")
    post = mine.select(F.col("list.out").alias("out"), "node", "n", "d", "comp", "like", "shared", "bits", F.explode(F.transform(F.slice("toks", F.lit(1), "take"), lambda t: F.xxhash64(t["tok"], "hub", "list.out"))).alias("tok"))
    post = stash(post)
    x = post.filter("not like")
    y = post.filter("like or out").select(*[F.col(c).alias(f"{c}2") for c in post.columns])
    cond = (F.col("tok") == F.col("tok2")) & (F.col("comp") != F.col("comp2")) & (~F.col("out") | (F.col("node") < F.col("node2"))) & _sized("n", "n2", percent)
    for most in ("least(shared, shared2)", f"shared - {_lacks('', '2')}", f"shared2 - {_lacks('2', '')}"):
        cond = cond & F.expr(f"{100 + percent} * (d + d2 - 2 * ({most})) <= {100 - percent} * (n + n2)")
    return x.join(y, cond).select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()


def _set_posts(sets: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Posts of each set under the rarest of its shingles, as many as it and a similar set can't both miss.

    How many that are depends on both sizes, so a list belongs to a shingle and to two bands of sizes, BAND apart. Shingles
    that no other set has are in no list; a set with many of them is in few lists or none. `shared` counts the others; `bits`
    has a bit for each of them, modulo BITS: where one set's bit is missing in another, so is at least one shingle.
    """
    one = sets.select("node", F.explode("set").alias("tok"))
    freq = stash(one.groupBy("tok").agg(F.count("*").alias("c")).filter("c > 1"))
    mine = one.join(freq, "tok").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("c", "tok"))).alias("toks")).join(sizes, "node")
    mine = mine.withColumns({"shared": F.size("toks"), "bits": _bits()})
    band = lambda n: F.floor(F.log(n) / F.log(F.lit(BAND)))
    low, high = F.ceil(F.col("n") * percent / 100), F.floor(F.col("n") * 100 / percent)
    mine = mine.withColumn("own", band(F.col("n"))).withColumn("other", F.explode(F.sequence(band(low), band(high))))
    # The least size in the other band, or one less.
    floor = F.greatest(low, F.ceil(F.pow(F.lit(BAND), F.col("other"))) - 1)
    take = F.col("shared") - F.ceil((F.col("n") + floor) * percent / (100 + percent)) + 1
    mine = mine.withColumn("take", take.cast("int")).filter("take > 0")
    keys = F.transform(F.slice("toks", F.lit(1), F.greatest("take", F.lit(0))), lambda t: F.xxhash64(t["tok"], F.least("own", "other"), F.greatest("own", "other")))
    posts = mine.withColumn("keys", keys)
    return posts.select(F.explode("keys").alias("tok"), "node", "n", "shared", "bits", _few(F.col("keys")), F.lit(False).alias("seen"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (least doc_id reachable over links; null if no document there has one), kept
    (the document is the component's first, by doc_id), and first_copy (kept, and the first row of its document: one row per
    component)."""
    docs, key, anon = keyed(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    out = _near_duplicates(docs, key, "text", shingle, percent)
    return out.withColumns({c: F.col(c)["id"] for c in ("doc_id", "component_id")}) if anon else out


def _near_duplicates(docs: DataFrame, doc_id: str, text: str, shingle: int, percent: int) -> DataFrame:
    """near_duplicates for ids that are not null."""
    rows = stash(signatures(docs, doc_id, text, shingle))
    copies = stash(rows.filter("n > 0").groupBy("h1", "h2", "n").agg(F.min(F.struct("doc_id", "rid")).alias("lead"), F.count("*").alias("c")).filter("c > 1").drop("c"))
    own = rows.join(copies, ["h1", "h2", "n"], "left").withColumn("lead", F.coalesce("lead", F.struct("doc_id", "rid")))
    is_lead = F.col("lead.rid") == F.col("rid")
    rows = stash(own.select("doc_id", "rid", "n", F.col("lead.doc_id").alias("node"), is_lead.alias("leads"), *[F.when(is_lead & (F.col("n") > 0), F.col(c)).alias(c) for c in ("sig", "pack")]))
    nodes = rows.filter("sig is not null")

    # Values that several nodes have; each node's rarest ones among them, within its prefix.
    tok = F.expr("transform(sig, (v, i) -> shiftleft(cast(i as bigint), 32) + (cast(v as bigint) & 4294967295L))")
    coords = nodes.select("node", F.explode(tok).alias("tok"))
    freq = stash(coords.groupBy("tok").agg(F.count("*").alias("c")).filter("c > 1"))
    rare = coords.join(freq, "tok").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("c", "tok"))).alias("toks"))
    take = F.expr(f"{COORDS - AGREE + 1} - ({COORDS} - size(toks))")
    weight = F.aggregate("toks", F.lit(0).cast("long"), lambda x, t: x + t["c"])
    post = rare.filter(take > 0).select("node", weight.alias("weight"), F.transform(F.slice("toks", F.lit(1), F.greatest(take, F.lit(0))), lambda t: t["tok"]).alias("keys")).join(nodes.select("node", "n", "pack"), "node")
    post = post.select("node", "n", "pack", "weight", _few(F.col("keys")), F.explode("keys").alias("tok"))
    post = stash(post.withColumn("seen", F.lit(False)).withColumn("comp", F.col("node")))

    def confirm(pairs: DataFrame) -> DataFrame:
        return _confirmed(pairs, docs, doc_id, text, shingle, percent)

    # Each list against its leader; then long lists that still span components against further ones, while that joins some.
    lead = _leads(post)
    edges = confirm(_led(post, lead, percent))
    labels = components(edges)
    after = lambda p, lead: p.join(lead.select("tok", "lead"), "tok", "left").withColumn("seen", F.col("seen") | F.coalesce(F.col("node") == F.col("lead"), F.lit(False))).drop("lead")
    mixed = _spanning(after(post, lead), labels)
    outside = F.sum((~F.col("major")).cast("int"))
    last, left = None, mixed.filter(f"members > {LONG_LIST}").agg(outside).first()[0]
    while left and (last is None or left < 0.9 * last):
        long = mixed.filter(f"members > {LONG_LIST}")
        lead = _leads(long)
        edges = edges.unionByName(confirm(_led(long, lead, percent)))
        labels = components(edges)
        mixed = _spanning(after(mixed, lead), labels)
        last, left = left, mixed.filter(f"members > {LONG_LIST}").agg(outside).first()[0]

    # What still spans components: pairs across them, in long lists by way of full sets.
    edges = edges.unionByName(confirm(_pairs_across(mixed.filter(f"members <= {LONG_LIST}"), percent)))
    labels = components(edges)
    if left:
        long = stash(mixed.filter(f"members > {LONG_LIST}").groupBy("node", "n").agg(F.max(F.struct("members", "top"))["top"].alias("hub")))
        of = stash(long.groupBy("node").agg(F.max("hub").alias("hub")))
        both = of.select("node").unionByName(of.select(F.col("hub").alias("node"))).distinct()
        sets = stash(_sets(docs, doc_id, text, both, shingle).join(both, "node", "left_semi"))
        # One hub: by what sets and hub don't have in common. Different hubs: lists that span them.
        apart = _apart(sets, of)
        comps = of.select("node").join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("comp"))
        found = _hub_pairs(apart, comps, percent)
        posts = stash(_set_posts(sets.join(of, "node", "left_semi"), long.drop("hub"), percent).join(of, "node"))
        several = posts.groupBy("tok").agg(F.min("hub").alias("low"), F.max("hub").alias("high")).filter("low <> high")
        found = found.unionByName(_pairs_across(_spanning(posts.join(several, "tok", "left_semi"), labels), percent, True)).distinct()
        like = apart.filter(_like_hub(percent) & (F.col("node") != F.col("hub"))).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
        labels = components(edges.unionByName(like).unionByName(confirm(found)))
    out = rows.join(labels, "node", "left").withColumn("component_id", F.coalesce("label", "node"))
    kept = F.col("doc_id") == F.col("component_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"), (kept & F.col("leads")).alias("first_copy"))
