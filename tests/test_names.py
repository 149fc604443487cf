"""Trigram joins, name variants, mentions to pages, gazetteer: each against brute force."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.functions.unicode import alias_key, link_target, target
from millrace.operators import gazetteer, slugs


def grams(text):
    return {f"  {w} "[i : i + 3] for w in re.findall(r"[^\W_]+", (text or "").lower()) for i in range(len(w) + 1)}


def like(a, b):
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x and y else 0.0


@pytest.mark.parametrize("threshold", [0.1, 0.3, 0.6, 0.7, 1.0])
def test_similar_equals_all_pairs(spark, threshold):
    rng = random.Random(1)
    base = ["alice smith", "Bob Jones", "acme corp", "Müller & Söhne", "the", "a", "x1 y2", "", "...", None, "日本 東京"]
    change = lambda s: s if not s else "".join(c for c in s if rng.random() > 0.1) + rng.choice(["", "s", " inc"])
    left = [(f"l{i}", change(rng.choice(base))) for i in range(120)]
    right = [(f"r{i}", change(rng.choice(base))) for i in range(100)]
    df = lambda rows: spark.createDataFrame(rows, "key string, text string").repartition(3)
    got = {(r.left, r.right): round(r.similarity, 9) for r in slugs.similar(df(left), df(right), threshold).collect()}
    assert got == {(a, b): round(like(x, y), 9) for a, x in left for b, y in right if like(x, y) >= threshold}
    assert slugs.similar(df(left).limit(0), df(right), threshold).collect() == []


def test_similar_makes_no_cross_join(spark):
    df = spark.createDataFrame([("a", "b")], "key string, text string")
    plan = slugs.similar(df, df, 0.6)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize(
    ("a", "b", "fit"),
    [
        ("Alice Smith", "Alice Smith", "strong"), ("A. Smith", "Alice Smith", "strong"), ("Smith Alice", "Alice Smith", "strong"), ("Alicia Smith", "Alicja Smith", "strong"), ("Bob Smith", "Rob Smith", None),
        ("Саша Иванов", "Александр Иванов", "strong"), ("Саша", "Александра Иванова", "weak"), ("Серёжа Петров", "Сергей Петров", "strong"), ("Alice", "Alice Smith", None), ("Alice Smith", "Alice", None),
        ("Dr. Alice Smith", "Alice Smith", "strong"), ("Alice B Smith", "Alice Carol Smith", None), ("Alice C Smith", "Alice Carol Smith", "strong"), ("Alice Smith", "Alice Carol Smith", "strong"), ("Alice S", "Alice S", None), ("Al1ce Smith", "Alice Smith", None), ("", "Alice Smith", None),
    ],
)
def test_variants(spark, a, b, fit):
    people = spark.createDataFrame([("p", b)], "slug string, title string")
    got = slugs.name_variants(spark.createDataFrame([(a,), (a,)], "name string"), people).collect()
    assert [r.fit for r in got] == ([fit] if fit else [])


@pytest.mark.parametrize(("name", "slug"), [("Alice Smith", "alice-smith"), ("people/Alice  Smith!", "people/alice-smith"), ("Café Zoë", "cafe-zoe"), ("", "unknown"), ("!!!", "unknown"), ("Иван Петров", "иван-петров"), ("people/Иван/Zoë", "people/иван/zoe"), ("東京️", "東京"), ("-/a-/-b/-", "a-/-b"), ("ﬁne", "fine"), ("x" * 400, "x" * 256)])
def test_link_targets(spark, name, slug):
    assert target(name) == slug
    assert spark.createDataFrame([(name,), (None,)], "n string").select(link_target("n").alias("s")).collect() == [(slug,), (None,)]


def test_alias_keys(spark):
    assert [r.k for r in spark.createDataFrame([("  Ａcme  Corp ",), (None,)], "n string").select(alias_key(F.col("n")).alias("k")).collect()] == ["acme corp", None]


PAGES = [
    ("people/alice-smith", "Alice Smith", "person", False), ("companies/acme", "Acme Inc", "company", False), ("people/bob-jones", "Bob Jones", "person", False), ("people/bob-brown", "Bob Brown", "person", False), ("acme-report", "Acme report", "note", False),
    ("places/acme-hall", "Hall", "place", False), ("old/gone", "Gone", "note", True), ("projects/quarterly-planning-review", "Quarterly planning review", "note", False), ("x/twin", "Twin", "note", False), ("y/twin", "Twin too", "note", False), ("people/иван-петров", "Иван Петров", "person", False), ("a/solo-page", "Solo", None, None),
]


@pytest.mark.parametrize(
    ("name", "source", "slug", "stage"),
    [
        ("people/alice-smith", "n", "people/alice-smith", "exact"), ("Old name", "n", "companies/acme", "redirect"), ("Bobby", "n", "people/bob-jones", "alias"), ("Both", "n", "both", "slugify"), ("Acme", "n", "companies/acme", "exact_tail"), ("twin", "n", "twin", "slugify"), ("twin", "x/twin", "y/twin", "exact_tail"),
        ("A. Smith", "n", "people/alice-smith", "name_variant"), ("Ваня Петров", "n", "people/иван-петров", "name_variant"), ("solo", "n", "a/solo-page", "prefix"), ("bob", "n", "bob", "slugify"), ("bob", "people/bob-brown", "people/bob-jones", "prefix"), ("Quarterly planing review", "n", "projects/quarterly-planning-review", "trgm"),
        ("Quarterly planing review", "projects/quarterly-planning-review", "quarterly-planing-review", "slugify"), ("gone", "n", "gone", "slugify"), ("", "n", "unknown", "slugify"), (None, "n", "unknown", "slugify"), ("acme-report", "acme-report", "acme-report", "slugify"),
    ],
)
def test_canonical(spark, canonicals, name, source, slug, stage):
    assert canonicals[(name or "").strip(), source] == (slug, stage)


@pytest.fixture(scope="module")
def canonicals(spark):
    marks = next(m for m in test_canonical.pytestmark if m.name == "parametrize")
    mentions = spark.createDataFrame([(c[0], c[1]) for c in marks.args[1]], "name string, source_slug string")
    pages = spark.createDataFrame(PAGES, "slug string, title string, type string, deleted boolean")
    aliases = spark.createDataFrame([("people/bob-jones", "Bobby"), ("people/bob-brown", "BOTH"), ("people/alice-smith", "both"), ("old/gone", "gone")], "slug string, alias string")
    redirects = spark.createDataFrame([("old-name", "companies/acme"), ("solo", "old/gone")], "slug string, target string")
    got = slugs.canonical(mentions, pages, aliases, redirects)
    rows = got.collect()
    assert len(rows) == mentions.select(F.trim(F.coalesce("name", F.lit("")))).distinct().count() + 2 + 1  # twin, bob and the review stand on two pages each
    return {(r.name, r.source_slug): (r.slug, r.stage) for r in rows}


def test_only_mentions_left_open_are_compared_with_far_pages(spark, monkeypatch):
    """Mentions that another stage settles are compared with no page, those with a page far above the threshold with close ones only."""
    asked, real = [], slugs.similar

    def similar(left, right, threshold, *more):
        asked.append((threshold, sorted(r.key for r in left.select("key").collect())))
        return real(left, right, threshold, *more)

    monkeypatch.setattr(slugs, "similar", similar)
    mentions = [("people/alice-smith", "n"), ("A. Smith", "n"), ("Quarterly planning review a", "n"), ("Quarterly planning review a", "projects/quarterly-planning-review"), ("Quarterly plan rev", "n"), ("Other", "n"), ("!!!", "n")]
    pages = spark.createDataFrame([*PAGES, ("z/1", "Long report 1", "note", False), ("z/2", "Long report 2", "note", False)], "slug string, title string, type string, deleted boolean")
    got = {(r.name, r.source_slug): (r.slug, r.stage) for r in slugs.canonical(spark.createDataFrame([*mentions, ("Long report", "n")], "name string, source_slug string"), pages).collect()}
    assert got["Quarterly planning review a", "n"] == ("projects/quarterly-planning-review", "trgm") and got["Long report", "n"] == ("long-report", "slugify")
    assert got["Quarterly planning review a", "projects/quarterly-planning-review"][1] == got["Other", "n"][1] == "slugify"
    (high, first), _, (low, rest), _ = asked
    assert high > low and first == ["Long report", "Other", "Quarterly plan rev", "Quarterly planning review a"]
    # Two close pages settle it too; a mention whose close page is its own is asked for again.
    assert rest == ["Other", "Quarterly plan rev", "Quarterly planning review a"]
    asked.clear()
    assert slugs.canonical(spark.createDataFrame([("Quarterly planning review a", "n"), ("Other", "n")], "name string, source_slug string"), pages).count() == 2
    assert asked[0][1] == ["Other", "Quarterly planning review a"] and asked[2][1] == ["Other"]


@pytest.mark.parametrize(("threshold", "margin"), [(0.7, 0.1), (0.5, 0.2), (0.4, 0.0), (0.9, 0.1), (0.3, 0.3)])
def test_alike_equals_all_pairs(spark, threshold, margin):
    rng = random.Random(5)
    base = ["alice smith", "acme corporation", "quarterly planning review", "red bolt 1212", "new anvil 7"]
    change = lambda s: "".join(c for c in s if rng.random() > 0.06) + rng.choice(["", "", "s", " a"])
    pages = [(f"p/{i}", change(rng.choice(base))) for i in range(40)]
    names = sorted({change(rng.choice(base)) for _ in range(60)})
    mentions = [(n, s, target(n)) for n in names for s in ("n", f"p/{rng.randrange(40)}")]
    got = {(r.name, r.source_slug): r.page for r in slugs._alike(spark.createDataFrame(mentions, "name string, source_slug string, target string"), spark.createDataFrame(pages, "slug string, title string"), threshold, margin).collect() if r.top >= threshold and (r.second is None or r.top - r.second >= margin)}
    want = {}
    for n, s, t in mentions:
        best = sorted((-max(like(n, title), like(t, p.rpartition("/")[2])), p) for p, title in pages if p != s)
        if -best[0][0] >= threshold and (best[1][0] - best[0][0] >= margin or -best[1][0] < max(threshold - margin, 0.01)):
            want[n, s] = best[0][1]
    assert got == want and want


def brute_mentions(text, names, own=None):
    pattern = "|".join(r"\s+".join(map(re.escape, n.split(" "))) for n in sorted(names, key=lambda n: (-len(n), n)))
    blank = lambda m: " " * len(m[0])
    masked = re.sub(r"(?<!\[)\[\[[^\]\n]{0,769}\]\]", blank, re.sub(r"(?s)```.*?```|`[^`\n]*`", blank, text or ""))
    out = []
    for m in re.finditer(rf"(?<!\w)(?:{pattern})(?!\w)", masked, re.IGNORECASE):
        slug = names[" ".join(m[0].lower().split())]
        if not m[0][0].islower() and slug != own and slug not in out:
            out.append(slug)
    return out


def test_mentions_equal_the_pattern(spark):
    rng = random.Random(7)
    names = {n: f"p/{i}" for i, n in enumerate(["alice smith", "alice", "alice smith junior", "acme corp.", "o'neil & sons", "big apple", "apple store", "müller", "new york city", "york", "c++ users", "(the) club", "ab-cd"])}
    parts = [*names, "Alice", "Smith", "Alice  Smith", "ALICE\nSMITH", "Acme Corp.", "Acme Corp.x", "O'Neil & Sons", "Müller", "New York", "New York City", "big Apple Store", "Apple Store", "xAlice", "Alice_", "[[Alice]]", "`Alice`", "C++ users", "C++ Users", "c++", "(The) Club", "The", "Ab-Cd", ",", ".", "and", "Z(The) Club"]
    texts = [(i, f"p/{i % 13}", rng.choice(["", " "]).join([""]) + " ".join(rng.choice(parts) + rng.choice(["", "", ",", ".", "x"]) for _ in range(rng.randrange(30)))) for i in range(400)] + [(1000, "q", None), (1001, "q", ""), (1002, "q", "Alice " * 30_000)]
    docs = spark.createDataFrame(texts, "doc_id long, own string, text string").repartition(4)
    entries = spark.createDataFrame(list(names.items()), "phrase string, slug string")
    got = {}
    for r in gazetteer.mentions(docs, entries, own="own").orderBy("id", "at").collect():
        got.setdefault(r.id, []).append(r.slug)
    assert got == {i: m for i, own, t in texts if (m := brute_mentions(t, names, own))}
    assert gazetteer.mentions(docs, entries.limit(0)).collect() == []


def test_entries(spark):
    pages = spark.createDataFrame([("p/1", "Alice Smith", "person", False), ("p/2", "ALICE  smith", "person", False), ("p/3", "Bob", "person", False), ("p/4", "April", "person", False), ("p/5", "Acme Corp", "company", None), ("p/6", "Acme Park", "place", False), ("p/7", "Dead Corp", "company", True), ("p/8", "12345", "company", False), ("p/9", None, "person", False)], "slug string, title string, type string, deleted boolean")
    aliases = spark.createDataFrame([("p/3", "Bobby Tables"), ("p/7", "Deadly"), ("p/5", "acme corp")], "slug string, alias string")
    assert {(r.phrase, r.slug) for r in gazetteer.entries(pages, aliases).collect()} == {("acme corp", "p/5"), ("bobby tables", "p/3")}


@pytest.mark.parametrize("threshold", [0.05, 0.34, 0.5, 0.6, 0.8, 0.99, 1.0])
def test_similar_pairs_meet_under_several_trigrams(spark, threshold):
    """Short and long texts, for which one, two or three rare trigrams make a key, against all pairs."""
    from millrace.functions.text import jaccard, trigrams

    r = random.Random(7)
    words = ["red", "bolt", "a", "12", "121", "5", "anvil", "éa", "zzz", "new"]
    rows = [(i, " ".join(r.choice(words) + r.choice(["", "", "1", str(r.randrange(30))]) for _ in range(r.choice([0, 1, 1, 2, 3, 5, 12])))) for i in range(120)]
    df = spark.createDataFrame(rows, "key int, text string")
    got = sorted(map(tuple, slugs.similar(df, df, threshold).collect()))
    sets = df.select(F.col("key").cast("string").alias("key"), trigrams(F.col("text")).alias("s")).filter("size(s) > 0")
    every = sets.toDF("k1", "s1").crossJoin(sets.toDF("k2", "s2")).select("k1", "k2", jaccard(F.col("s1"), F.col("s2")).alias("j")).filter(F.col("j") >= threshold)
    assert got == sorted(map(tuple, every.collect()))
    assert got


def test_titles_that_differ_in_a_number_meet_seldom(spark):
    """2,000 titles share every trigram of their words and hundreds each of their numbers: few pairs may be compared."""
    df = spark.range(100_000, 102_000).select(F.col("id").cast("string").alias("key"), F.concat(F.lit("red bolt "), (F.col("id") * 7919 % 900_001 + 99_999).cast("string")).alias("text"))
    seen = spark.sparkContext.accumulator(0)
    real = slugs.jaccard

    def counting(a, b):
        def one(x):
            seen.add(1)
            return 0

        return real(a, b) + F.udf(one, "int")(a)

    slugs.jaccard = counting
    try:
        assert slugs.similar(df, df, 0.8).count() >= 2000
    finally:
        slugs.jaccard = real
    assert seen.value < 100_000


def test_titles_are_compared_with_few_others(spark, monkeypatch):
    """A letter added to titles that differ in a number: few pairs besides those that are alike leave the task in which they meet."""
    name = F.element_at(F.array(*map(F.lit, ["red bolt ", "hot plate ", "small widget "])), (F.col("id") % 3 + 1).cast("int"))
    right = spark.range(4000).select(F.col("id").cast("string").alias("key"), F.concat(name, F.col("id") + 100_000).alias("text"))
    seen, real = spark.sparkContext.accumulator(0), slugs.jaccard

    def counting(a, b):
        def one(x):
            seen.add(1)
            return 0

        return real(a, b) + F.udf(one, "int")(a)

    monkeypatch.setattr(slugs, "jaccard", counting)
    assert slugs.similar(right.withColumn("text", F.concat("text", F.lit(" a"))), right, 0.8).count() >= 4000
    assert seen.value < 3 * 4000


def test_only_places_of_whole_names_leave_a_task(spark):
    names = spark.createDataFrame([("alpha beta gamma", "p/1"), ("οδοσ.α", "p/2"), ("delta", "p/3")], "phrase string, slug string")
    docs = spark.createDataFrame([(1, "Alpha beta " * 2000), (2, "Alpha beta gamma. ΟΔΟΣ.Α Delta"), (3, ""), (4, None)], "doc_id long, text string")
    low = names.withColumn("a", gazetteer.atoms(F.col("phrase"))).select("phrase", "slug", "a", F.size("a").alias("n"))
    places = gazetteer._places(docs.filter("text <> ''").select("doc_id", gazetteer.atoms(F.col("text")).alias("t")), low)
    assert places.filter("doc_id = 1").count() < 200
    assert {(r.at, r.n) for r in places.filter("doc_id = 2").collect()} >= {(0, 3), (4, 3), (7, 1)}
    assert sorted((r.id, r.slug, r.at) for r in gazetteer.mentions(docs, names).collect()) == [(2, "p/1", 0), (2, "p/2", 4), (2, "p/3", 7)]
    assert gazetteer.mentions(docs, names.limit(0)).collect() == []
