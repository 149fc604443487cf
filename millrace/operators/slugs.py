"""Mentions to pages in bulk: a similarity join on trigrams, person names and their variants, and the cascade that resolves a mention."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import jaccard, trigrams
from millrace.functions.unicode import alias_key, link_target, nfkc
from millrace.sources.shared import settled

#: Short given names and the names they stand for (fixed values).
DIMINUTIVES = {
    "саша": ["александр", "александра"], "шура": ["александр", "александра"], "женя": ["евгений", "евгения"], "миша": ["михаил"], "дима": ["дмитрий"], "леша": ["алексей"], "алеша": ["алексей"],
    "коля": ["николай"], "петя": ["петр"], "ваня": ["иван"], "сережа": ["сергей"], "андрюша": ["андрей"], "володя": ["владимир"], "вова": ["владимир"], "костя": ["константин"], "катя": ["екатерина"],
    "наташа": ["наталья", "наталия"], "лена": ["елена"], "оля": ["ольга"], "маша": ["мария"], "таня": ["татьяна"], "слава": ["вячеслав", "владислав", "святослав", "ярослав"],
}


#: Keys that a text is posted under at most for a choice of several rare trigrams (see similar).
_MOST_KEYS = 100
#: Slots that trigrams are counted in by hash, and longs of a set's bit table.
_SLOTS, _LONGS = 1 << 16, 2
#: Texts that a task posts, where that gives more than eight tasks.
_TEXTS = 1 << 15


def _need(n: Column, threshold: float) -> Column:
    """Trigrams that a set of n has in common with any that is alike. A hair below the threshold, so that rounding costs no pair."""
    return F.ceil(F.lit(threshold - 1e-9) * n).cast("int")


def _several(m: Column, threshold: float) -> Column:
    """How many rare trigrams two sets meet under, whose larger one has m: 3, 2 or 1, as many as they must share and as give few keys."""
    need = _need(m, threshold)
    p = m - need + 1
    return F.when((need >= 3) & ((p + 2) * (p + 1) * p <= 6 * _MOST_KEYS), 3).when((need >= 2) & ((p + 1) * p <= 2 * _MOST_KEYS), 2).otherwise(1)


def _choices(a: Column, k: int, chosen: tuple = (), at: Column | int = 0) -> Column:
    """All choices of k elements of a, in a's order: a hash of each (h), and the place of its last element (last)."""
    rest = F.slice(a, F.lit(1) + at, F.size(a))
    if len(chosen) == k - 1:
        return F.transform(rest, lambda x, i: F.struct(F.xxhash64(F.lit(k), *chosen, x).alias("h"), (i + 1 + at).alias("last")))
    return F.flatten(F.transform(rest, lambda x, i: _choices(a, k, (*chosen, x), i + 1 + at)))


def _slot(t: Column) -> Column:
    return F.pmod(F.xxhash64(t), F.lit(_SLOTS)).cast("int")


def _rarity(sets: DataFrame) -> bytes:
    """A byte for each slot, the higher the more pairs its trigrams would make; 255 where one side has none of them."""
    of = lambda side: F.count(F.when(F.col("side") == side, 1)).alias(side)
    counts = sets.select("side", F.explode("set").alias("t")).groupBy(_slot(F.col("t")).alias("slot")).agg(of("l"), of("r")).filter("l > 0 and r > 0")
    out = bytearray(b"\xff" * _SLOTS)
    for slot, most_l, most_r in counts.collect():
        out[slot] = min(254, int(5 * math.log(most_l * most_r)))
    return bytes(out)


def _posts(sets: DataFrame, side: str, threshold: float, rarity: Column, s: str) -> DataFrame:
    """(h, id, n, u, most, bits of the set) of each choice that a text of this side is posted under; most: trigrams that a pair may
    have to share to meet there for certain."""
    n, u = F.col("n"), F.size("ts")
    ranked = F.sort_array(F.transform("set", lambda t: F.struct(F.substring(rarity, _slot(t) + 1, F.lit(1)).alias("c"), t.alias("t"))))
    ranked = sets.filter(F.col("side") == side).select("id", F.size("set").alias("n"), F.transform(F.filter(ranked, lambda x: x["c"] != F.lit(b"\xff")), lambda x: x["t"]).alias("ts"))
    # Sizes that the larger set of a pair can have; from `far` on, k is 1.
    far = int(15 / (1 - threshold)) + 2 if threshold < 1 else 0
    larger = F.sequence(n, F.greatest(n, F.least(F.floor(n / (threshold - 1e-9)).cast("int"), F.lit(far))))
    bits = [F.expr(f"aggregate(transform(ts, t -> cast(pmod(xxhash64(t), {64 * _LONGS}) as int)), 0L, (b, x) -> if(shiftright(x, 6) = {i}, b | shiftleft(1L, x & 63), b))").alias(f"bits{i}") for i in range(_LONGS)]
    ks = F.when(u >= _need(n, threshold), F.array_distinct(F.transform(larger, lambda m: _several(m, threshold))))
    ranked = ranked.select("*", *bits, F.explode(ks).alias("k"))
    head = F.slice("ts", F.lit(1), u - _need(n, threshold) + F.col("k"))
    ranked = ranked.select("id", "n", u.alias("u"), "k", *[f"bits{i}" for i in range(_LONGS)], F.explode(F.when(F.col("k") == 3, _choices(head, 3)).when(F.col("k") == 2, _choices(head, 2)).otherwise(_choices(head, 1))).alias("c"))
    out = {"h": F.col("c.h"), "id": F.col("id"), "n": n, "u": F.col("u"), "most": F.col("u") + F.col("k") - F.col("c.last"), "k": F.col("k")} | {f"bits{i}": F.col(f"bits{i}") for i in range(_LONGS)}
    return ranked.select(*[c.cast("short" if x in ("n", "u", "most", "k") else "long").alias(x + s) for x, c in out.items()])


def similar(left: DataFrame, right: DataFrame, threshold: float, key: str = "key", text: str = "text") -> DataFrame:
    """Pairs (left, right, similarity) of two tables (key, text) whose trigrams are alike by `threshold` (over 0) or more.

    Sets of n1 and n2 trigrams with a Jaccard similarity of t share t (n1 + n2) / (1 + t) at least. Only trigrams that both tables have can be shared;
    all sets have them in one order, rarest first, by counts in a table of fixed size. Behind the first k shared ones are all other shared ones, so these k
    are among the first u - shared + k of the u that a set has. Each text is posted under all choices of k = 3 of its first ones, or of 2 or 1 where 3
    give too many; the larger size of a pair says which k holds for it: a trigram that hundreds of titles have in common makes no pair unless two more are shared.

    Posts hold numbers only, a bit table of the set among them, by which most pairs that can't be alike go where they meet. What is left, once each, is
    compared by its texts.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    texts = lambda df, side: df.select(F.lit(side).alias("side"), F.col(key).cast("string").alias("key"), F.col(text).alias("text")).filter("text <> ''")
    # Written, as the counts, both sides and the comparison read it, and for the ids.
    both = settled(texts(left, "l").unionByName(texts(right, "r")).withColumn("id", F.monotonically_increasing_id()))
    parts = -(-both.count() // _TEXTS)
    dealt = lambda df, by: df.repartition(parts, by) if parts > 8 else df
    sets = dealt(both, "id").select("side", "id", trigrams(F.col("text")).alias("set"))
    rarity = F.lit(_rarity(sets))
    shared = F.ceil(F.lit((threshold - 1e-9) / (1 + threshold)) * (F.col("n1") + F.col("n2")))
    lacks = lambda a, b: F.expr(f"u{a} - " + " - ".join(f"bit_count(bits{i}{a} & ~bits{i}{b})" for i in range(_LONGS)))
    # Small files hold many posts: a plan by their size would send these through the driver.
    met = _posts(sets, "l", threshold, rarity, "1").hint("merge").join(_posts(sets, "r", threshold, rarity, "2"), (F.col("h1") == F.col("h2")) & (F.least("most1", "most2", lacks(1, 2), lacks(2, 1)) >= shared) & (_several(F.greatest("n1", "n2"), threshold) == F.col("k1")) & (F.col("k1") == F.col("k2")))
    met = met.select("id1", "id2").distinct()
    of = lambda side, s: both.filter(F.col("side") == side).select(*[F.col(c).alias(f"{c}{s}") for c in ("id", "key", "text")])
    met = settled(dealt(dealt(met, "id1").join(of("l", "1"), "id1"), "id2").join(of("r", "2"), "id2").select("key1", "key2", trigrams(F.col("text1")).alias("set1"), trigrams(F.col("text2")).alias("set2")))
    found = met.select(F.col("key1").alias("left"), F.col("key2").alias("right"), jaccard(F.col("set1"), F.col("set2")).alias("similarity"))
    return found.filter(F.col("similarity") >= threshold)


def name_words(name: Column) -> Column:
    """A person's name in lower-case words, without titles, commas and full stops; names over 200 characters have none."""
    low = F.replace(F.lower(nfkc(name)), F.lit("ё"), F.lit("е"))
    bare = F.regexp_replace(low, r"(?U)^(?:(?:mr|mrs|ms|dr|prof|г-н|г-жа|доктор)\.?\s+)+", "")
    words = F.filter(F.split(F.regexp_replace(bare, "[.,]", " "), r"(?U)\s+"), lambda w: w != "")
    return F.when(F.length(name) <= 200, words).otherwise(F.array().cast("array<string>"))


def _long_forms(word: Column) -> Column:
    table = F.create_map(*[x for k, v in DIMINUTIVES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.element_at(table, word), F.array(word))


def given_match(a: Column, b: Column) -> Column:
    """Whether two given names can be one person's: equal, an initial of the other, forms of one name, or one edit apart from five letters on."""
    initial = ((F.length(a) == 1) | (F.length(b) == 1)) & (F.substring(a, 1, 1) == F.substring(b, 1, 1))
    edit = (F.least(F.length(a), F.length(b)) >= 5) & (F.levenshtein(a, b) <= 1)
    return (a == b) | initial | F.arrays_overlap(_long_forms(a), _long_forms(b)) | edit


def variant(a: Column, b: Column) -> Column:
    """How a mention's words a fit a person's words b (see name_words): `strong` with the surname, `weak` for a short given name alone, or null.

    b has two or three words. The surname is b's last word and a's first or last; the other end of a must match b's given name, and so
    must middle names where both have one.
    """
    lettered = F.forall(F.concat(a, b), lambda w: w.rlike(r"^[\p{L}-]+$"))
    ends = lambda given, last: (F.length(last) > 1) & (last == F.element_at(b, -1)) & given_match(given, F.get(b, F.lit(0)))
    first, last = F.get(a, F.lit(0)), F.try_element_at(a, F.lit(-1))
    middle = (F.size(a) < 3) | (F.size(b) < 3) | given_match(F.get(a, F.lit(1)), F.get(b, F.lit(1)))
    strong = F.size(a).between(2, 3) & lettered & middle & (ends(first, last) | ends(last, first))
    weak = (F.size(a) == 1) & first.isin(*DIMINUTIVES) & F.arrays_overlap(_long_forms(first), _long_forms(F.get(b, F.lit(0))))
    return F.when(F.size(b).between(2, 3), F.when(strong, "strong").when(weak, "weak"))


def _given_keys(word: Column) -> Column:
    """What two given names that match have in common: a form, an initial, or the name with a character less."""
    less = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substr(word, i + 1)))
    return F.concat(_long_forms(word), F.array(word, F.concat(F.lit("^"), F.substring(word, 1, 1))), F.when(F.length(word) >= 5, less).otherwise(F.array().cast("array<string>")))


def name_variants(mentions: DataFrame, people: DataFrame, name: str = "name", title: str = "title") -> DataFrame:
    """(name, slug, title, fit) of each mention and person that fit (see variant); mentions are taken once each.

    Strong fits share the surname and a form, the initial or all characters but one of the given name, weak ones a form of the given
    name: mentions and people meet under these keys, so a frequent surname alone makes no pairs.
    """
    m = mentions.select(F.col(name).alias("name")).distinct().withColumn("a", name_words(F.col("name"))).filter(F.size("a").between(1, 3))
    p = people.select("slug", F.col(title).alias("title")).withColumn("b", name_words(F.col("title"))).filter(F.size("b").between(2, 3))
    under = lambda surname, given: F.transform(_given_keys(given), lambda k: F.concat_ws("|", surname, k))
    first, last = F.get("a", F.lit(0)), F.element_at("a", -1)
    alone = F.transform(_long_forms(first), lambda w: F.concat(F.lit("|"), w))
    m = m.withColumn("k", F.explode(F.array_distinct(F.when(F.size("a") == 1, alone).otherwise(F.concat(under(last, first), under(first, last))))))
    given = F.get("b", F.lit(0))
    p = p.withColumn("k", F.explode(F.array_distinct(F.concat(under(F.element_at("b", -1), given), F.transform(_long_forms(given), lambda w: F.concat(F.lit("|"), w))))))
    short = (F.length(first) == 1) | (F.length(last) == 1) | (F.length(given) == 1)
    met = m.join(p, "k").filter(~F.contains("k", F.lit("|^")) | short)
    fit = met.withColumn("fit", variant(F.col("a"), F.col("b"))).filter("fit is not null")
    return fit.select("name", "slug", "title", "fit").distinct()


def _only(found: DataFrame, at: str) -> DataFrame:
    """(at, n, low, high): how many pages each key has, and the first and last of them."""
    return found.groupBy(at).agg(F.count_distinct("slug").alias("n"), F.min("slug").alias("low"), F.max("slug").alias("high"))


def _best(mentions: DataFrame, live: DataFrame, near: float) -> DataFrame:
    """(name, source_slug, page, top, second): the page most like each mention by title or last part of its slug, other than the mention's own,
    how much, and how much the next; of pages alike by `near`."""
    names = mentions.filter("target <> 'unknown'").select("name", "target").distinct()
    by_title = similar(names.select(F.col("name").alias("key"), F.col("name").alias("text")), live.select(F.col("slug").alias("key"), F.col("title").alias("text")), near)
    by_slug = similar(names.select(F.col("name").alias("key"), F.col("target").alias("text")), live.select(F.col("slug").alias("key"), F.regexp_extract("slug", "([^/]*)$", 1).alias("text")), near)
    best = by_title.unionByName(by_slug).groupBy(F.col("left").alias("name"), F.col("right").alias("page")).agg(F.max("similarity").alias("similarity"))
    # Of three, two are left where one is the mention's own page: names meet their sources with no more than these.
    first = lambda df, most, *by: df.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("similarity"), "page"))).filter(F.col("k") <= most)
    best = first(best, 3, "name").drop("k").join(mentions.select("name", "source_slug"), "name").filter(F.col("page") != F.col("source_slug"))
    return first(best, 2, "name", "source_slug").groupBy("name", "source_slug").agg(F.max_by("page", -F.col("k")).alias("page"), F.max("similarity").alias("top"), F.max(F.when(F.col("k") == 2, F.col("similarity"))).alias("second"))


def _alike(mentions: DataFrame, live: DataFrame, threshold: float, margin: float) -> DataFrame:
    """_best for the pages that matter: those alike by `threshold`, and by `margin` less, as they make a best page ambiguous.

    Most mentions have a page far above the threshold, and what is less like them by the margin doesn't matter: they are compared for close pages
    alone, which makes few pairs, and only the others for all.
    """
    close = threshold + margin / 2
    if close + margin >= 1:
        return _best(mentions, live, max(threshold - margin, 0.01))
    known = settled(_best(mentions, live, close).filter(F.col("top") - margin - 1e-9 >= close))
    rest = settled(mentions.join(known, ["name", "source_slug"], "left_anti"))
    return known.unionByName(_best(rest, live, max(threshold - margin, 0.01)))


def canonical(mentions: DataFrame, pages: DataFrame, aliases: DataFrame | None = None, redirects: DataFrame | None = None, threshold: float = 0.7, margin: float = 0.1, fuzzy: bool = True) -> DataFrame:
    """The page that each mention means: (name, source_slug, slug, stage), one row for each different (name, source_slug).

    mentions (name, source_slug) come from pages; pages (slug, title, type, deleted); aliases (slug, alias); redirects (slug, target). The
    stages, in order: redirect of the mention's slug; exact slug; alias; exact_tail, the last part of a page's slug; name_variant of a
    person; prefix of a last part; trgm, title or last part alike by `threshold`, and by `margin` more than any other page; else
    slugify, the mention as a slug. A stage counts only if it finds one page, and never the page that the mention stands on;
    what two pages fit stays open. All stages are joins over all mentions at once. Not fuzzy: without the stage trgm, before which no
    other stage's result depends on it, and whose similarity join costs most. It is asked only for mentions that the stages before it leave open.
    """
    live = pages.filter(~F.coalesce(F.col("deleted"), F.lit(False))).select("slug", "title", "type").dropDuplicates(["slug"])
    parts = live.filter(F.contains("slug", F.lit("/"))).select("slug", F.regexp_extract("slug", "([^/]*)$", 1).alias("tail"))
    m = mentions.select(F.trim(F.coalesce(F.col("name"), F.lit(""))).alias("name"), F.coalesce(F.col("source_slug"), F.lit("")).alias("source_slug")).distinct()
    m = m.withColumn("target", link_target(F.col("name"))).withColumn("bare", ~F.contains("target", F.lit("/")) & (F.length("target") >= 2) & (F.col("target") != "unknown"))
    # Written, as every stage starts from it.
    every = m = settled(m)
    # The one page of a key other than the mention's own: all of its pages but perhaps that one.
    rest = lambda x: F.when(F.col(f"{x}.n") == 1, F.nullif(F.col(f"{x}.low"), F.col("source_slug"))).when((F.col(f"{x}.n") == 2) & (F.col(f"{x}.low") == F.col("source_slug")), F.col(f"{x}.high")).when((F.col(f"{x}.n") == 2) & (F.col(f"{x}.high") == F.col("source_slug")), F.col(f"{x}.low"))
    as_struct = lambda df, at, x: df.select(at, F.struct("n", "low", "high").alias(x))

    m = m.join(live.select(F.col("slug").alias("target"), F.col("slug").alias("exact")), "target", "left")
    if redirects is not None:
        to = redirects.join(live.select(F.col("slug").alias("target")), "target", "left_semi").groupBy(F.col("slug").alias("of")).agg(F.min("target").alias("redirect"))
        m = m.join(to, F.col("target") == F.col("of"), "left").drop("of")
    else:
        m = m.withColumn("redirect", F.lit(None).cast("string"))
    if aliases is not None:
        named = aliases.join(live.select("slug"), "slug", "left_semi").select("slug", alias_key(F.col("alias")).alias("k")).filter("k <> '' and length(k) <= 200")
        m = m.withColumn("k", alias_key(F.col("name"))).join(as_struct(_only(named, "k"), "k", "by_alias"), "k", "left").drop("k")
        alias = rest("by_alias")
    else:
        alias = F.lit(None).cast("string")
    m = m.join(as_struct(_only(parts, "tail"), "tail", "by_tail").withColumnRenamed("tail", "target"), "target", "left")
    # Strict prefixes of last parts that are some mention.
    starts = parts.withColumn("size", F.explode(F.sequence(F.lit(2), F.greatest(F.lit(2), F.length("tail") - 1)))).filter("size < length(tail)")
    starts = starts.select("slug", F.substr("tail", F.lit(1), F.col("size")).alias("start"))
    starts = starts.join(every.filter("bare").select(F.col("target").alias("start")).distinct(), "start", "left_semi")
    m = m.join(as_struct(_only(starts, "start"), "start", "by_start").withColumnRenamed("start", "target"), "target", "left")

    people = live.filter((F.lower(F.trim("type")) == "person") & F.col("title").isNotNull() & ~F.col("slug").startswith("life/diary/"))
    fits = name_variants(every, people).groupBy("name").agg(F.count("*").alias("people"), F.min(F.struct("slug", "fit")).alias("fit"))
    m = m.join(fits, "name", "left")

    other = lambda c: F.when(c != F.col("source_slug"), c)
    variant_page = F.when((F.col("people") == 1) & (F.col("fit.fit") == "strong"), other(F.col("fit.slug")))
    # A mention that fits some person, but not one alone, isn't guessed at.
    open_ = F.coalesce(F.col("people"), F.lit(0)) == 0
    stages = [("redirect", other(F.col("redirect"))), ("exact", other(F.col("exact"))), ("alias", alias), ("exact_tail", F.when(F.col("bare"), rest("by_tail"))), ("name_variant", variant_page), ("prefix", F.when(F.col("bare") & open_, rest("by_start")))]
    known = F.col("target") != "unknown"
    found = [F.when(known & page.isNotNull(), F.struct(page.alias("slug"), F.lit(stage).alias("stage"))) for stage, page in stages]
    m = m.select("name", "source_slug", "target", F.coalesce(*found).alias("to"), (known & open_).alias("ask"))
    if fuzzy:
        m = settled(m)
        m = m.join(_alike(m.filter("ask and to is null").select("name", "source_slug", "target"), live, threshold, margin), ["name", "source_slug"], "left")
        alike = (F.col("top") >= threshold) & (F.col("second").isNull() | (F.col("top") - F.col("second") >= margin))
        m = m.withColumn("to", F.coalesce("to", F.when(alike, F.struct(F.col("page").alias("slug"), F.lit("trgm").alias("stage")))))
    return m.select("name", "source_slug", F.coalesce("to", F.struct(F.col("target").alias("slug"), F.lit("slugify").alias("stage"))).alias("to")).select("name", "source_slug", "to.slug", "to.stage")
