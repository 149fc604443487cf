"""Secret scan with DataFrame functions only.

Base spans are regular-expression matches of three kinds. The method adds `entropy` spans: a candidate (a run of
base64 characters) belongs to the narrowest class that holds all its characters (hex, letters of one case, letters,
letters of one case and digits, mixed); a window of WINDOW characters slides over it, and its Shannon entropy is kept
up to date from the counts of the one character that leaves and the one that enters. The span reaches from the first to
the last window whose entropy is at least the class's threshold: what about 98 of 100 windows of random characters of
its alphabet reach. Digits only and UUIDs are allowed as whole candidates. Placeholders, plain runs of the alphabet, and
in a path of words its words of fewer than WINDOW letters are passed over: the windows hold what is left of the
candidate, on both sides of them. Base spans are never suppressed.

Offsets count code points, end exclusive. Spans are sorted by start, then kind in the order assign, access, hex,
entropy. Every character of every text is scanned, in one pass over the table with no shuffle.

Edge cases: a null or empty text has no spans; a match whose value is too short is dropped and its text is not
searched again; spans of different kinds may overlap; rows repeat as they come; other columns of the input are kept
by `redact` and dropped by `scan`, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.columns import free

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run that is too short fails as a whole, and so do its ends: the bound can be in the pattern.
ACCESS, HEX = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"
CANDIDATE = "[A-Za-z0-9+/_-]{20,}"
LONG_RUN = "[A-Za-z0-9+/_=-]{20,}"  # holds every access, hex and candidate match
WINDOW = 20
THRESHOLD = {"hex": 2.85, "single": 3.28, "letters": 3.62, "plain": 3.4, "mixed": 3.65}
CLASSES = {"hex": "^[0-9A-Fa-f]+$", "single": "^([a-z]+|[A-Z]+)$", "letters": "^[A-Za-z]+$", "plain": "^([a-z0-9]+|[A-Z0-9]+)$"}
ALLOW = (
    "^[0-9]+$",
    "^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    "(?i)example|sample|placeholder|changeme|dummy|lorem",
    "(?i)abcdefghij|0123456789|qwertyuiop",
    "^[-_/+]*[A-Za-z]+([-_/][A-Za-z]+){2,}[-_/+]*$",
)
DIGITS, UUID, PATH = ALLOW[0], ALLOW[1], ALLOW[4]
#: What is passed over inside a candidate; the alphabet as far as it goes on.
PART = f"example|sample|placeholder|changeme|dummy|lorem|0123456789|qwertyuiop(asdfghjkl(zxcvbnm)?)?|abcdefghij{''.join(f'({c}' for c in 'klmnopqrstuvwxyz')}{')?' * 16}"
WORDS = f"(?<![a-z])[a-z]{{1,{WINDOW - 1}}}(?![a-z])|[-_/+]"
KINDS = ("assign", "access", "hex", "entropy")
#: Matches, or characters, that are worked on at once.
PART_SIZE = 128
SPAN = "array<struct<start:bigint,rank:int,stop:bigint,kind:string>>"


def _none(kind: str = SPAN) -> Column:
    return F.array().cast(kind)


def _let(value: Column, body) -> Column:
    """body of value, which is worked out once however often body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def _appended(items: Column, first: Column, kind: str, step) -> Column:
    """An array with an item for each of items; step gives (next state, item) from (state, item of items)."""

    def one(s: Column, x: Column) -> Column:
        state, item = step(s["at"], x)
        return F.struct(state.alias("at"), F.concat(s["out"], F.array(item)).alias("out"))

    return F.aggregate(items, F.struct(first.alias("at"), _none(f"array<{kind}>").alias("out")), one)["out"]


def _running(items: Column, kind: str, value, plus, make) -> Column:
    """make(state before it, item) of each item, where the state is what `plus` makes of all values before, from 0.

    Appending to an array copies it, so states run over parts of PART_SIZE items, and over what parts come to.
    """
    zero = F.lit(0).cast("long")

    def part(some: Column, first: Column) -> Column:
        return _appended(some, first, kind, lambda at, x: (plus(at, value(x)), make(at, x)))

    def placed(parts: Column) -> Column:
        sums = F.transform(parts, lambda p: F.aggregate(p, zero, lambda n, x: plus(n, value(x))))
        return F.flatten(F.zip_with(parts, _appended(sums, zero, "bigint", lambda at, n: (plus(at, n), at)), part))

    cut = lambda xs: F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / PART_SIZE).cast("int")), lambda i: F.slice(xs, i * PART_SIZE + 1, F.lit(PART_SIZE)))
    return _let(items, lambda xs: F.when(F.size(xs) > 0, _let(cut(xs), placed)).otherwise(_none(f"array<{kind}>")))


def located(text: Column, pattern: str | Column, found: Column) -> Column:
    """(start, match) of each of `found`, all matches of pattern in text, from the lengths of what lies between."""
    between = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    pairs = F.zip_with(between, found, lambda g, h: F.struct(F.length(g).alias("gap"), h.alias("hit")))
    kind = "struct<start:bigint,hit:string>"
    places = _running(pairs, kind, lambda x: x["gap"] + F.length(x["hit"]), lambda a, b: a + b, lambda at, x: F.struct((at + x["gap"]).alias("start"), x["hit"].alias("hit")))
    return F.when(F.size(found) > 0, places).otherwise(_none(f"array<{kind}>"))


def _span(start: Column, stop: Column, kind: str) -> Column:
    return F.struct(start.cast("long").alias("start"), F.lit(KINDS.index(kind)).alias("rank"), stop.cast("long").alias("stop"), F.lit(kind).alias("kind"))


def left_over(cand: Column) -> Column:
    """A candidate (start, hit) as struct(start, bar, left): left are the code and place of each character that isn't passed over."""
    hit = cand["hit"]
    skip = F.when(hit.rlike(PATH), f"(?i){WORDS}|{PART}").otherwise(f"(?i){PART}")
    ends = F.transform(located(hit, skip, F.regexp_extract_all(hit, skip, F.lit(0))), lambda x: x["start"] + F.length(x["hit"]))
    chars = lambda at, gap: F.when(gap != "", F.transform(F.split(gap, ""), lambda c, i: F.struct(F.ascii(c).alias("code"), (at + i).alias("at")))).otherwise(_none("array<struct<code:int,at:bigint>>"))
    left = F.flatten(F.zip_with(F.concat(F.array(F.lit(0).cast("long")), ends), F.split(hit, skip, -1), chars))
    rest, bar = F.regexp_replace(hit, skip, F.lit("")), F.lit(THRESHOLD["mixed"])
    for name in reversed(CLASSES):
        bar = F.when(rest.rlike(CLASSES[name]), THRESHOLD[name]).otherwise(bar)
    allowed = hit.rlike(UUID) | rest.rlike(DIGITS)
    return F.struct(cand["start"].alias("start"), bar.alias("bar"), F.when(allowed, _none("array<struct<code:int,at:bigint>>")).otherwise(left).alias("left"))


def hot_window(bar: Column, left: Column) -> Column:
    """struct(first, last) around the windows over the bar, end exclusive; both -1 if there is none.

    The counts of a window are the characters of a string, by code, from "0" on: a step reads and writes two of them.
    """
    part = F.lit([n * math.log2(n) if n else 0.0 for n in range(WINDOW + 1)])  # n log2 n
    count = lambda counts, code: F.ascii(F.substring(counts, code + 1, 1)) - ord("0")
    put = lambda counts, code, n: F.overlay(counts, F.char(n + ord("0")), code + 1, F.lit(1))

    def step(s: Column, x: Column) -> Column:
        comes, goes, i = x["comes"], x["goes"], x["i"]
        moves = comes != goes
        n, m = count(s["counts"], comes), count(s["counts"], goes)
        less = F.when(goes < 0, 0.0).otherwise(F.get(part, m - 1) - F.get(part, m))
        total = F.when(moves, s["total"] + F.get(part, n + 1) - F.get(part, n) + less).otherwise(s["total"])
        fewer = F.when(goes < 0, s["counts"]).otherwise(put(s["counts"], goes, m - 1))
        over = (i >= WINDOW - 1) & (F.lit(math.log2(WINDOW)) - total / WINDOW >= s["bar"])
        return F.struct(
            F.when(moves, put(fewer, comes, n + 1)).otherwise(s["counts"]).alias("counts"),
            total.alias("total"),
            s["bar"].alias("bar"),
            F.when(over & (s["first"] < 0), x["from"]).otherwise(s["first"]).alias("first"),
            F.when(over, x["at"] + 1).otherwise(s["last"]).alias("last"),
        )

    steps = F.transform(left, lambda c, i: F.struct(c["code"].alias("comes"), F.coalesce(F.get(left, i - WINDOW)["code"], F.lit(-1)).alias("goes"), F.get(left, i - (WINDOW - 1))["at"].alias("from"), c["at"].alias("at"), i.alias("i")))
    none = F.lit(-1).cast("long")
    zero = F.struct(F.lit("0" * 128).alias("counts"), F.lit(0.0).alias("total"), bar.alias("bar"), none.alias("first"), none.alias("last"))
    return F.aggregate(steps, zero, step)


def with_spans(df: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """df with one more column: array of (start, rank, stop, kind), sorted."""
    t, assign, long, access, hexes, cand, warmed = names = free(df, "text", "assign", "long", "access", "hex", "cand", "warm")
    runs = lambda p: F.when(F.col(long), F.regexp_extract_all(t, F.lit(p), F.lit(0))).otherwise(_none("array<string>"))
    seen = (
        df.withColumn(t, F.coalesce(F.col(text).cast("string"), F.lit("")))
        .withColumn(assign, F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(0)))
        .withColumn(long, F.col(t).rlike(LONG_RUN))
        .withColumns({access: runs(ACCESS), hexes: runs(HEX), cand: runs(CANDIDATE)})
        .withColumns({c: located(F.col(t), p, F.col(c)) for c, p in ((assign, ASSIGN), (access, ACCESS), (hexes, HEX), (cand, CANDIDATE))})
    )
    whole = lambda c, k: F.transform(c, lambda x: _span(x["start"], x["start"] + F.length(x["hit"]), k))
    kept = F.filter(assign, lambda x: F.length(F.regexp_extract(x["hit"], ASSIGN, 2)) >= 6)
    warm = F.transform(F.transform(cand, left_over), lambda x: F.struct(x["start"].alias("start"), hot_window(x["bar"], x["left"]).alias("w")))
    added = F.transform(F.filter(warmed, lambda x: x["w"]["first"] >= 0), lambda x: _span(x["start"] + x["w"]["first"], x["start"] + x["w"]["last"], "entropy"))
    return (
        seen.withColumn(assign, kept)
        .withColumn(warmed, warm)
        .withColumn(out, F.array_sort(F.concat(whole(assign, "assign"), whole(access, "access"), whole(hexes, "hex"), added)))
        .drop(*names)
    )


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, spans, and secrets: each span's own text."""
    one = df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    cut = F.transform("spans", lambda s: F.substr(F.col("text"), s["start"].cast("int") + 1, (s["stop"] - s["start"]).cast("int")))
    return with_spans(one).select("doc_id", "spans", cut.alias("secrets"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """df with each span of its text replaced by mark; overlapping spans become one. Texts without spans, null included, stay.

    A text with spans is cut as code points of four bytes each, whose places need no search from the text's start.
    """
    (spans,) = free(df, "spans")

    def clean(points: Column) -> Column:
        piece = lambda a, b: F.decode(F.substr(points, (a * 4 + 1).cast("int"), ((b - a) * 4).cast("int")), "UTF-32")
        kind = "struct<before:bigint,start:bigint,stop:bigint>"
        seen = _running(F.col(spans), kind, lambda x: x["stop"], F.greatest, lambda at, x: F.struct(at.alias("before"), x["start"].alias("start"), x["stop"].alias("stop")))
        heads = lambda xs: F.transform(F.filter(xs, lambda x: x["start"] >= x["before"]), lambda x: F.concat(piece(x["before"], x["start"]), F.lit(mark)))
        last = F.aggregate(F.col(spans), F.lit(0).cast("long"), lambda n, x: F.greatest(n, x["stop"]))
        return F.concat(F.array_join(_let(seen, heads), ""), piece(last, F.floor(F.octet_length(points) / 4)))

    cut = _let(F.encode(F.col(text).cast("string"), "UTF-32"), clean)
    return with_spans(df, text, spans).withColumn(text, F.when(F.size(spans) > 0, cut).otherwise(F.col(text))).drop(spans)
