"""Mentions of known names in prose: a dictionary of any size, met by a bit table of fixed size and matched by joins on whole phrases.

Text and names are read as atoms, words of letters, digits and `_` or single other characters, each with the white space before it as one
space; a name is matched where its atoms follow each other in the text with the same spaces, whatever their case.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.entities import junk_name
from millrace.functions.unicode import alias_key, nfkc
from millrace.sources.shared import settled

#: Names that are common words (fixed values).
STOP_NAMES = ("mark", "will", "summer", "april", "june", "apple", "next", "square", "amber", "hope", "grace", "rose", "ray", "art", "max", "sky", "dawn", "story", "field", "river", "stone", "frank", "drew", "major", "case")
ATOM = r"(?U)\s*(?:[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])"
WORD = r"[\p{L}\p{N}_]"
#: The bit table of names has 32 bits a name, between these powers of two; with more names it passes more places on to the join.
LEAST_BITS, MOST_BITS = 16, 27
#: Atoms that a task walks at a time.
AT_ONCE = 1 << 19


def atoms(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(ATOM), F.lit(0)), lambda a: F.regexp_replace(a, r"(?U)^\s+", " "))


def entries(pages: DataFrame, aliases: DataFrame | None = None, types: tuple[str, ...] = ("person", "company")) -> DataFrame:
    """(phrase, slug): titles and aliases of live pages of some types, as they are looked up. Names of under 4 or over 200 characters,
    placeholders, numbers and common words are left out, and so is a name that two pages claim."""
    live = pages.filter(F.col("type").isin(*types) & ~F.coalesce(F.col("deleted"), F.lit(False)))
    names = live.select("slug", F.col("title").alias("name"))
    if aliases is not None:
        names = names.unionByName(aliases.join(live.select("slug"), "slug", "left_semi").select("slug", F.col("alias").alias("name")))
    phrase = names.select("slug", alias_key(F.col("name")).alias("phrase"))
    usable = F.length("phrase").between(4, 200) & ~F.col("phrase").isin(*STOP_NAMES) & ~junk_name(F.col("phrase"))
    one = phrase.filter(usable).groupBy("phrase").agg(F.min("slug").alias("slug"), F.max("slug").alias("other"))
    return one.filter("slug = other").select("phrase", "slug")


def _hashes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each atom, without and with the space before it, whatever its case. A sigma at an end counts as any other, since how it is
    lower-cased depends on what stands around it."""
    coded = values.dictionary_encode()
    texts = [(x or "").lower().replace("ς", "σ") for x in coded.dictionary.to_pylist()]
    number = lambda x: int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest())
    at = coded.indices.to_numpy(zero_copy_only=False)
    return tuple(np.array([number(x) for x in t], np.uint64)[at] for t in ([x.lstrip(" ") for x in texts], texts))


def _runs(values: pa.Array, most: int):
    """(n, hash of the n atoms from each place on) for n from 1 to `most`; places near the end have what is left."""
    first, rest = _hashes(values)
    for n in range(1, min(most, len(values)) + 1):
        if n > 1:
            first[: len(first) - n + 1] = first[: len(first) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + rest[n - 1 :]
        yield n, first


def _two(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed >> np.uint64(64 - bits), ((mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - bits)


def _places(rows: DataFrame, low: DataFrame) -> DataFrame:
    """(.., at, n, before, next) for texts (.., t): places where n atoms may be a name, with the atom before and the n and one more."""
    lengths = low.groupBy("n").count().collect()  # as many rows as names have different lengths
    sizes, count = {r.n for r in lengths}, sum(r["count"] for r in lengths)
    bits = min(MOST_BITS, max(LEAST_BITS, (32 * count).bit_length()))
    most, names = max(sizes, default=0), [*rows.columns[:-1], "at", "n", "before", "next"]

    def marks(batches):
        for b in batches:
            lists = b.column(0)
            at, n = lists.offsets.to_numpy()[:-1], np.diff(lists.offsets.to_numpy())
            found = [h[at[n == k]] for k, h in _runs(lists.values, int(n.max(initial=0)))]
            spots = np.concatenate([x for h in found for x in _two(h, bits)]) if found else np.zeros(0, np.uint64)
            words, own = np.unique(spots >> np.uint64(6), return_inverse=True)
            marked = np.zeros(len(words), np.uint64)
            np.bitwise_or.at(marked, own, np.uint64(1) << (spots & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int32)), pa.array(marked.view(np.int64))], ["word", "bits"])

    got = low.select("a").mapInArrow(marks, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    shared = rows.sparkSession.sparkContext.broadcast(table)
    marked = lambda s, x: (s[x >> np.uint64(6)] >> (x & np.uint64(63))) & np.uint64(1)

    def walked(b: pa.RecordBatch) -> pa.RecordBatch:
        lists, bound = b.column(b.num_columns - 1), b.column(b.num_columns - 1).offsets.to_numpy()
        values, bound = lists.values.slice(bound[0], bound[-1] - bound[0]), bound - bound[0]
        row = np.repeat(np.arange(b.num_rows), np.diff(bound))
        end, place = bound[1:][row], np.arange(len(row))
        hits = [np.zeros((0, 2), np.int64)]
        for n, h in _runs(values, most):
            if n in sizes:
                x, y = _two(h, bits)
                may = np.flatnonzero((place + n <= end) & (marked(shared.value, x) & marked(shared.value, y)).astype(bool))
                hits.append(np.stack([may, np.full(len(may), n)], axis=1))
        at, n = np.concatenate(hits).T
        size = np.minimum(n + 1, end[at] - at)
        stops = np.concatenate([[0], np.cumsum(size)])
        nexts = values.take(pa.array(np.repeat(at - stops[:-1], size) + np.arange(stops[-1])))
        inner = at - bound[:-1][row[at]]
        before = values.take(pa.array(np.maximum(at - 1, 0), mask=inner == 0))
        kept = [b.column(i).take(pa.array(row[at])) for i in range(b.num_columns - 1)]
        return pa.RecordBatch.from_arrays([*kept, pa.array(inner.astype(np.int32)), pa.array(n.astype(np.int32)), before, pa.ListArray.from_arrays(pa.array(stops.astype(np.int32)), nexts)], names)

    def run(batches):
        for b in batches:
            bound, i = b.column(b.num_columns - 1).offsets.to_numpy(), 0
            while i < b.num_rows:
                j = max(i + 1, int(np.searchsorted(bound, bound[i] + AT_ONCE, "right")) - 1)
                yield walked(b.slice(i, j - i))
                i = j

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}, at int, n int, before string, next array<string>")


def mentions(docs: DataFrame, names: DataFrame, doc_id: str = "doc_id", text: str = "text", own: str | None = None) -> DataFrame:
    """(id, slug, at): the pages that each text names, with the atom of the first mention; names as `entries` gives them.

    Of names that begin at one place the longest counts, and the next is looked for behind it. A match that begins with a small letter is
    the common word: it isn't one, though its place is taken. Code and [[links]] are passed over as white space. `own` is a column with
    the page that the text is, which it can't name.

    Tasks walk the texts and hand on the places where a name can stand by a bit table of all names; every one of them is then joined
    with the names by its whole phrase, so what is shuffled grows with the mentions and not with the texts.
    """
    low = settled(names.withColumn("a", atoms(F.col("phrase"))).select("phrase", "slug", "a", F.size("a").alias("n")).filter("n > 0"))
    prose = F.regexp_replace(nfkc(F.col(text).cast("string")), r"(?s)```.*?```|`[^`\n]*`|(?<!\[)\[\[[^\]\n]{0,769}\]\]", " ")
    rows = docs.select(F.col(doc_id).alias("id"), *([F.col(own).alias("own")] if own else []), atoms(prose).alias("t"))
    starts = _places(rows.filter(F.size("t") > 0), low)
    is_word = lambda a: a.rlike(rf"^{WORD}")
    # `tied`: the atom stands right behind a word.
    tied = is_word(F.ltrim(F.coalesce("before", F.lit("")))) & ~F.get("next", F.lit(0)).startswith(" ")
    last, after = F.get("next", F.col("n") - 1), F.coalesce(F.get("next", F.col("n")), F.lit(""))
    # No word character may stand on either side of a match.
    tried = starts.filter(~tied & (is_word(F.ltrim(last)) | ~is_word(after)))
    tried = tried.withColumn("phrase", F.ltrim(F.lower(F.array_join(F.slice("next", F.lit(1), F.col("n")), ""))))
    small = F.ltrim(F.get("next", F.lit(0))).rlike(r"^\p{Ll}").alias("small")
    hits = tried.select(*rows.columns[:-1], "at", "n", "phrase", small).join(low.select("phrase", "slug"), "phrase").select(*rows.columns[:-1], "at", "n", "slug", "small")
    best = hits.groupBy(*rows.columns[:-1], "at").agg(F.max(F.struct("n", "slug", "small")).alias("b")).select(*rows.columns[:-1], F.struct("at", "b.n", "b.slug", "b.small").alias("hit"))
    kind = "struct<at:int,n:int,slug:string,small:boolean>"
    zero = F.struct(F.lit(0).alias("end"), F.array().cast(f"array<{kind}>").alias("taken"))
    take = lambda s, h: F.when(h["at"] >= s["end"], F.struct((h["at"] + h["n"]).alias("end"), F.concat(s["taken"], F.array(h)).alias("taken"))).otherwise(s)
    kept = best.groupBy(*rows.columns[:-1]).agg(F.sort_array(F.collect_list("hit")).alias("hits")).withColumn("hit", F.explode(F.aggregate("hits", zero, take)["taken"]))
    found = kept.filter("not hit.small")
    if own:
        found = found.filter(F.col("hit.slug") != F.coalesce(F.col("own"), F.lit("")))
    return found.groupBy("id", F.col("hit.slug").alias("slug")).agg(F.min("hit.at").alias("at"))
