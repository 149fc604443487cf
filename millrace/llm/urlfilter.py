"""URL rules by a Bloom filter cascade, with DataFrame functions only.

Each URL yields the keys that a rule could have: every suffix of its host of as many labels as some rule's host has, joined with
every prefix of its path of a length that occurs among the rules. The distinct keys of the whole corpus are the universe.
Level 1 of a cascade encodes the listed keys; level 2 the universe's other keys that level 1 lets through; level 3
the listed keys that level 2 lets through; and so on until none is left. A key of the universe is then listed exactly
if the first level that rejects it is an even one (or none does and the depth is odd): membership without a join.

A level's size depends on the number of keys that it encodes: the first level's false-positive rate is set so that
level 2 encodes about as many keys as the list has, so all levels are a few bits times log2(universe / list) for each
listed key. A level's bits travel in the plan as one binary literal, put together on the executors; MAX_BITS bounds it, which is
enough for some millions of listed keys. For longer lists the keys are looked up by a join, with the same answer.

A list of exact keys (host + whole path) can stand beside the rules: a third cascade, over the distinct keys of all pages,
blocks the pages that it lists where no rule fits.

Edge cases: a null URL, or one without ://, has an empty host and path and fits no rule; hosts keep other than A-Z as
they are; of rules for one key, block wins; of rules that fit, the longest host + path wins, then the longer host;
an empty page, rule or list table works; null keys of a list count for nothing; repeated rows each get a row; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.stash import stash

MAX_BITS = 1 << 25
#: Keys of a level beyond which what is left is written; this only saves time.
SETTLED = 10_000
#: Words of 64 bits that an executor puts together.
RANGE = 1 << 12
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the registered query.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
SPAM = "ads|adult|bets|casino|pills|spam"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_path(url: Column) -> tuple[Column, Column]:
    part = lambda n: F.coalesce(F.regexp_extract(url, URL, n), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def rule_keys(host: Column, path: Column, lengths: list[int], labels: list[int]) -> Column:
    """Array of (size, host_size, key): each host suffix of one of the numbers of labels with each path prefix of one of the lengths."""
    n = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    suffixes = F.filter(F.array(*[F.when(n >= k, F.substring_index(host, ".", -k)) for k in labels or [1]]), lambda s: s.isNotNull())
    prefixes = F.filter(F.lit(lengths or [0]), lambda n: F.length(path) >= n)
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda n: F.struct((F.length(s) + n).alias("size"), F.length(s).alias("host_size"), F.concat(s, F.substr(path, F.lit(1), n)).alias("key")))))


@dataclass
class Level:
    number: int
    hashes: int
    bits: int
    words: bytes  # 64 bits each, the high byte first

    def passes(self, key: Column) -> Column:
        cells = F.lit(self.words)
        byte = lambda s: F.conv(F.hex(F.substring(cells, (F.shiftright(s, 6) * 8 + 8 - F.shiftright(s % 64, 3)).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.forall(F.array(*slots(key, self.number, self.hashes, self.bits)), lambda s: F.getbit(byte(s), (s % 8).cast("int")) == 1)


def slots(key: Column, level: int, hashes: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level * 64 + j)), F.lit(bits)) for j in range(hashes)]


def encode(keys: DataFrame, level: int, n: int, rate: float) -> Level | None:
    """A level for the n keys; None if it would exceed MAX_BITS. At most MAX_BITS / 8 bytes come to the driver."""
    hashes = max(1, round(math.log2(1 / rate)))
    words = max(1, math.ceil(n * hashes / math.log(2) / 64))
    if words * 64 > MAX_BITS:
        return None
    slot = F.explode(F.array(*slots(F.col("key"), level, hashes, words * 64))).alias("slot")
    cells = keys.select(slot).groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits"))
    parts = cells.groupBy(F.floor(F.col("at") / RANGE).alias("part")).agg(F.sort_array(F.collect_list(F.struct((F.col("at") % RANGE).alias("at"), "bits"))).alias("own"))
    # Each word as 16 digits behind the zeros of the words that are missing before it.
    digits = F.transform("own", lambda x, i: F.concat(F.repeat(F.lit("0"), (16 * (x["at"] - F.when(i > 0, F.get("own", i - 1)["at"]).otherwise(-1) - 1)).cast("int")), F.lpad(F.hex(x["bits"]), 16, "0")))
    rows = parts.select("part", F.unhex(F.rpad(F.array_join(digits, ""), 16 * RANGE, "0")).alias("bytes")).collect()
    out = bytearray(8 * RANGE * (words // RANGE + 1))
    for r in rows:
        out[8 * RANGE * r.part : 8 * RANGE * (r.part + 1)] = r.bytes
    return Level(level, hashes, words * 64, bytes(out[: 8 * words]))


def cascade(universe: DataFrame) -> list[Level] | None:
    """Levels for (key, listed); None if one would be too large."""
    r, s = universe.agg(F.count_if("listed"), F.count_if(~F.col("listed"))).first()
    levels: list[Level] = []
    left, n = universe, r
    while n:
        want_listed = len(levels) % 2 == 0
        rate = min(0.5, max(1e-6, r * math.sqrt(0.5) / max(s, 1))) if not levels else 0.5
        level = encode(left.filter(F.col("listed") == want_listed), len(levels) + 1, n, rate)
        if level is None:
            return None
        levels.append(level)
        # What this level wrongly lets through, beside the keys that it encodes, which all pass.
        left = left.filter((F.col("listed") == want_listed) | level.passes(F.col("key")))
        # Written while it is large, so that no level tests a key again that an earlier one has settled.
        left = stash(left) if n > SETTLED else left
        n = left.filter(F.col("listed") != want_listed).count()
    return levels


def listed(key: Column, levels: list[Level]) -> Column:
    """Whether a key of the universe is listed: the parity of the first level that rejects it."""
    out = F.lit(len(levels) % 2 == 1)
    for level in reversed(levels):
        out = F.when(~level.passes(key), level.number % 2 == 0).otherwise(out)
    return out


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    row = lambda r: F.struct(*[F.lit(v).alias(c) for c, v in zip(("host", "path", "action"), r, strict=True)])
    return spark.range(1).select(F.inline(F.array(*map(row, rules))))


def spam_list(pages: DataFrame, url: str = "url", words: str = SPAM) -> DataFrame:
    """A keyed list: host + path of every page whose host has one of the words between its dots and hyphens."""
    host, path = host_path(F.col(url).cast("string"))
    return pages.filter(host.rlike(f"(^|[.-])({words})([.-]|$)")).select(F.concat(host, path).alias("key")).distinct()


def judge(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", blocked: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule (host + path; null where none fits), verdict (the rule's; where none fits, block if host + path is a
    key of `blocked`, else allow)."""
    # Lengths of rule paths and numbers of labels of rule hosts, not rules.
    lengths = [r[0] for r in rules.select(F.length("path")).distinct().collect()]
    labels = [r[0] for r in rules.select(F.size(F.split("host", r"\.", -1))).distinct().collect()]
    host, path = host_path(F.col(url).cast("string"))
    cut = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    keys = lambda df: df.withColumn("keys", rule_keys(F.col("host"), F.col("path"), lengths, labels))
    own = rules.groupBy(F.concat("host", "path").alias("key")).agg(F.max(F.col("action") == "block").alias("block"))
    # The distinct (host, path prefix) pairs first: far fewer than URLs.
    corpus = keys(cut.select("host", F.substr("path", F.lit(1), F.lit(max(lengths, default=0))).alias("path")).distinct()).select(F.explode("keys.key").alias("key"))
    universe = stash(corpus.distinct().withColumn("block", F.lit(None).cast("boolean")).unionByName(own).groupBy("key").agg(F.max("block").alias("block")))
    block = cascade(universe.select("key", F.coalesce("block", F.lit(False)).alias("listed")))
    allow = cascade(universe.select("key", F.coalesce(~F.col("block"), F.lit(False)).alias("listed")))
    whole = F.concat("host", "path")
    if block is None or allow is None:
        best = _joined(keys(cut), own)
    else:
        fits = F.filter("keys", lambda k: listed(k["key"], block) | listed(k["key"], allow))
        best = keys(cut).select("page_id", "host", "path", F.array_max(fits)["key"].alias("rule"))
        best = best.withColumn("verdict", F.when(F.col("rule").isNotNull(), F.when(listed(F.col("rule"), block), "block").otherwise("allow")))
    if blocked is None:
        return best.withColumn("verdict", F.coalesce("verdict", F.lit("allow")))
    flagged = blocked.select(F.col("key").cast("string").alias("key")).filter("key is not null").distinct().withColumn("listed", F.lit(True))
    urls = stash(cut.select(whole.alias("key")).distinct().join(flagged, "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed")))
    levels = cascade(urls)
    if levels is None:
        best = best.join(urls.filter("listed"), whole == F.col("key"), "left").drop("key")
    else:
        best = best.withColumn("listed", listed(whole, levels))
    return best.withColumn("verdict", F.coalesce("verdict", F.when(F.col("listed"), "block"), F.lit("allow"))).drop("listed")


def _joined(keyed: DataFrame, own: DataFrame) -> DataFrame:
    """For lists too large for a plan: the same answer from a join of keys and rules. The verdict is null where no rule fits."""
    rows = stash(keyed.withColumn("row", F.monotonically_increasing_id()))
    best = rows.select("row", F.inline("keys")).join(own, "key").groupBy("row").agg(F.max(F.struct("size", "host_size", "key", "block")).alias("best"))
    verdict = F.when(F.col("best").isNotNull(), F.when(F.col("best.block"), "block").otherwise("allow"))
    return rows.join(best, "row", "left").select("page_id", "host", "path", F.col("best.key").alias("rule"), verdict.alias("verdict"))
