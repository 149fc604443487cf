"""Phrase collocations by top-order marginalisation.

Only the longest windows are counted: each word of a piece opens one window of `words` lead columns (itself and the words after
it), padded with nulls where its piece ends. Every occurrence of a shorter phrase opens exactly one window, so the counts of all shorter
phrases are sums over prefixes of windows, and one Spark ROLLUP over the lead columns makes them all; nothing is exploded per length.

Most windows of a corpus occur once. A screen comes first: counts by hash of words and of neighbouring words, of which a bit
table of bounded size keeps those that occur `least` times. A word or a pair that the table lacks can't be inside a candidate, so it ends
a window as a piece's end does. Hashes that share a bit only let more windows through; all counts come from the windows. Tasks fold
their windows before Spark adds them up. A window travels as one string, its words and its language between line feeds (which no word
holds), and gets its columns back for the ROLLUP.

Inside one fold of a task (FOLD rows) words are told apart by 64-bit hashes, everywhere else by their text. Scores are exact:
floor(1000000 * a * a / (l * r)) in 38-digit decimals, for a up to 10^15. Parts and longer phrases are found by joins, which adaptive
execution splits where a word is part of very many phrases; a language's best are taken from SLICES slices first.

Edge cases: a null text is empty; a null lang is `und`; texts and pieces without words give nothing; a piece shorter than a window is
padded; equal scores are ranked by a, then by the phrase's bytes; repeated rows count as often as they occur; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.bytewords import U, Words, marked, mix, words
from millrace.llm.stash import stash
from millrace.llm.terms import bit_table, codes, grouped, texts, totals

#: Rows that a task holds before it folds them.
FOLD = 1 << 19
#: Bytes of text that are split at once.
PART = 1 << 20
#: Slices of a language's phrases that are ranked on their own first.
SLICES = 64
BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?\n\x0b\x0c\r"]] = True
WORD = ~BREAK
WORD[[32, 9]] = False


def _source(docs: DataFrame, text: str, lang: str) -> DataFrame:
    lang = F.coalesce(F.col(lang).cast("string"), F.lit("und"))
    return docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), lang.alias("lang"), F.xxhash64(lang).alias("h"))


def _keys(w: Words, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each word and of each word with the next one, in its language; and whether the next word is in the same piece."""
    one = mix(w.hash ^ lang[w.row + w.first])
    after = np.append(w.hash[1:], U(0))[: len(one)]
    breaks = np.cumsum(BREAK[w.low], dtype=np.int32)
    joined = np.zeros(len(one), bool)
    joined[:-1] = (w.row[1:] == w.row[:-1]) & (breaks[w.start[1:]] == breaks[w.end[:-1] - 1])
    return one, mix(one * U(0xD1342543DE82EF95) + after), joined


def screen(source: DataFrame, least: int) -> np.ndarray:
    """A bit table of the hashes of words and pairs that occur at least `least` times in a language."""

    def run(batches):
        held: list[np.ndarray] = []

        def flush():
            keys, c = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            for i in range(0, len(c), FOLD):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + FOLD].view(np.int64)), pa.array(c[i : i + FOLD])], ["h", "c"])

        for b in batches:
            lang = b.column(2).to_numpy(zero_copy_only=False).view(U)
            for w in words(b.column(0), WORD, PART):
                one, two, joined = _keys(w, lang)
                held += [one, two[joined]]
                if sum(map(len, held)) >= 4 * FOLD:
                    yield from flush()
        if held:
            yield from flush()

    found = source.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    return bit_table(stash(found.filter(F.col("c") >= least).select("h")), "h")


def windows(source: DataFrame, n: int, cells: np.ndarray) -> DataFrame:
    """(window, c): counted windows, each perhaps in several rows: n words, empty where padded, and the language, between line feeds.
    The first word is empty too if the screen lacks it."""
    shared = source.sparkSession.sparkContext.broadcast(cells)

    def fold(rows: list[tuple[list[np.ndarray], list[pa.Array], np.ndarray]]):
        keys = [np.concatenate(k) for k in zip(*(r[0] for r in rows), strict=True)]
        order, at = grouped(keys)
        one = pa.array(order[at])
        columns = [pa.concat_arrays([r[1][i] for r in rows]).take(one) for i in range(n)]
        return [k[order[at]] for k in keys], columns, totals(np.concatenate([r[2] for r in rows]), order, at)

    def counted(w: Words, lang: np.ndarray, code: np.ndarray):
        one, two, joined = _keys(w, lang)
        known = marked(shared.value, one)
        joined &= known & marked(shared.value, two)
        joined[:-1] &= known[1:]
        keys, goes_on = [code[w.row + w.first], np.where(known, w.hash, U(0))], known
        for i in range(1, n):
            goes_on = goes_on & np.append(joined[i - 1 :], np.zeros(i - 1, bool))[: len(joined)]
            keys.append(np.where(goes_on, np.append(w.hash[i:], np.zeros(i, U))[: len(joined)], U(0)))
        order, at = grouped(keys)
        first = order[at]
        columns = []
        for i in range(n):
            there = keys[i + 1][first] != 0
            at_word = np.where(there, np.minimum(first + i, len(w.start) - 1), 0)
            size = np.where(there, w.end[at_word] - w.start[at_word], 0)
            columns.append(texts(w.low, w.start[at_word], w.start[at_word] + size))
        return [k[first] for k in keys], columns, np.diff(np.append(at, len(order)))

    def run(batches):
        langs: dict[str, int] = {}
        held: list[tuple] = []

        def flush():
            keys, columns, c = fold(held)
            held.clear()
            of = pa.array(list(langs), pa.large_string())
            for i in range(0, len(c), 1 << 16):
                window = pc.binary_join_element_wise(*(x.slice(i, 1 << 16) for x in columns), of.take(pa.array(keys[0][i : i + (1 << 16)])), pa.scalar("\n", pa.large_string()))
                yield pa.RecordBatch.from_arrays([window.cast(pa.string()), pa.array(c[i : i + (1 << 16)])], ["window", "c"])

        for b in batches:
            code, lang = codes(b.column(1), langs), b.column(2).to_numpy(zero_copy_only=False).view(U)
            for w in words(b.column(0), WORD, PART):
                if len(w.start):
                    held.append(counted(w, lang, code))
                if sum(len(h[2]) for h in held) >= FOLD:
                    yield from flush()
        if held:
            yield from flush()

    return source.mapInArrow(run, "window string, c long")


def levels(counted: DataFrame, n: int, least: int) -> DataFrame:
    """(lang, p, f): counts of phrases p (arrays) of 1 to n words, at least `least`; and with p empty, of all words of a language."""
    part = lambda i: F.get(F.col("part"), F.lit(i))
    names = [f"w{i}" for i in range(1, n + 1)]
    top = counted.groupBy("window").agg(F.sum("c").alias("f")).withColumn("part", F.split("window", "\n", n + 1))
    top = top.select(part(n).alias("lang"), *[F.nullif(part(i), F.lit("")).alias(x) for i, x in enumerate(names)], "f")
    # One condition on count and word: the word's part alone would go below the counting, which both branches then couldn't share.
    longest = top.filter(F.when(F.col("f") >= least, F.length(names[-1])) > 0).select("lang", F.array(*names).alias("p"), "f")
    rolled = top.rollup("lang", *names[:-1]).agg(F.sum("f").alias("f"), F.grouping_id().alias("level"))
    phrase = F.filter(F.array(*names[:-1]), lambda x: x.isNotNull())
    # A phrase of a level has a word in each of the level's columns; where one is null, the window was padded. Level 0 has all columns.
    rolled = rolled.select("lang", phrase.alias("p"), "f", (F.lit(n - 1) - F.expr("bit_count(level)")).alias("size")).filter("size >= 0 and size(p) = size")
    return rolled.filter((F.col("size") == 0) | (F.col("f") >= least)).select("lang", "p", "f").unionByName(longest)


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (l * r)), exactly."""
    big = lambda x: x.cast("decimal(16,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * big(a) * big(a), big(left) * big(right)).cast("long")


def candidates(counts: DataFrame, within: int) -> DataFrame:
    """(lang, p, a, l, r, score) of the phrases of two words or more that no longer phrase explains by `within` percent of a or more."""
    phrases = counts.filter(F.size("p") > 0)
    many = phrases.filter(F.size("p") > 1).withColumnRenamed("f", "a")
    part = lambda f: phrases.select("lang", F.col("p").alias(f"p_{f}"), F.col("f").alias(f))
    cuts = many.select("lang", "p", "a", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"))
    cuts = cuts.withColumns({"p_l": F.slice("p", F.lit(1), F.col("k")), "p_r": F.slice("p", F.col("k") + 1, F.size("p"))})
    cuts = cuts.join(part("l"), ["lang", "p_l"]).join(part("r"), ["lang", "p_r"])
    cuts = cuts.withColumn("score", score(F.col("a"), F.col("l"), F.col("r")))
    best = cuts.groupBy("lang", "p").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = F.expr("flatten(transform(sequence(2, size(p) - 1), m -> transform(sequence(1, size(p) - m + 1), i -> slice(p, i, m))))")
    longer = many.filter(F.size("p") > 2).select("lang", F.explode(inner).alias("p"), "a").groupBy("lang", "p").agg(F.max("a").alias("longer"))
    kept = best.join(longer, ["lang", "p"], "left").filter(F.coalesce(100 * F.col("longer"), F.lit(-1)) < within * F.col("a"))
    return kept.select("lang", "p", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", words: int = 3, least: int = 10, within: int = 50, top: int | None = 2000) -> DataFrame:
    """Per language, its `top` phrases (all, if None) by score descending, a descending, phrase: lang, rank, phrase, a, l, r, n, score.

    Candidates have 2 to `words` words and occur at least `least` times. l and r count the two parts of the cut that scores lowest, n
    all words of the language. A candidate inside a longer one that has `within` percent of its count or more is dropped.
    """
    if words < 2 or least < 1:
        raise ValueError("phrases have two words or more, and occur")
    source = _source(docs, text, lang)
    counts = stash(levels(windows(source, words, screen(source, least)), words, least))
    found = candidates(counts, within).withColumn("phrase", F.array_join("p", " ")).drop("p")
    by = [F.desc("score"), F.desc("a"), "phrase"]
    if top is not None:
        slices = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SLICES))).orderBy(*by)
        found = found.withColumn("rank", F.row_number().over(slices)).filter(F.col("rank") <= top).drop("rank")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by)).cast("long"))
    found = found if top is None else found.filter(F.col("rank") <= top)
    total = counts.filter(F.size("p") == 0).select("lang", F.col("f").alias("n"))
    return found.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
