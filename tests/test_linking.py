"""Links added, removed, derived and kept in step; lint rules."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from millrace.functions.lint import lint, repaired
from millrace.operators import linking as L

D = datetime.date


def keyed(df, *cols):
    return {(r.source_slug, r.target_slug, r.type): tuple(r[c] for c in cols) for r in df.collect()}


def test_added_links(spark):
    schema = "source_slug string, target_slug string, type string, confidence double, valid_from date, valid_until date"
    have = [("a", "b", "knows", 0.5, None, None), ("a", "acme", "works_at", 1.0, D(2020, 1, 1), None), ("c", "acme", "works_at", 1.0, D(2020, 1, 1), D(2021, 1, 1)), ("d", "acme", "works_at", 1.0, None, None), ("e", "acme", "works_at", 1.0, D(2022, 1, 1), None)]
    new = [
        ("a", "B", "knows", 0.9, D(2024, 1, 1), None), ("a", "New Page", "knows", None, None, None), ("a", "Other Co", "works_at", 1.0, D(2023, 1, 1), None), ("c", "other", "works_at", 1.0, D(2020, 6, 1), None), ("d", "other", "works_at", 1.0, D(2020, 6, 1), None),
        ("e", "other", "works_at", 1.0, D(2021, 1, 1), None), ("f", "x", "knows", 1.0, D(2022, 1, 1), D(2021, 1, 1)), ("g", "x", "knows", 0.1, None, None), ("g", "X", "knows", 0.2, None, None), ("e", "acme", "works_at", 1.0, D(2020, 1, 1), None),
    ]
    links, refused = L.added(spark.createDataFrame(have, schema), spark.createDataFrame(new[:-1], schema), ("works_at",))
    got = keyed(links, "confidence", "valid_from", "valid_until")
    assert got["a", "b", "knows"] == (0.9, D(2024, 1, 1), None) and got["a", "new-page", "knows"] == (1.0, None, None)
    assert got["a", "acme", "works_at"] == (1.0, D(2020, 1, 1), D(2023, 1, 1)) and got["a", "other-co", "works_at"] == (1.0, D(2023, 1, 1), None)
    assert got["d", "acme", "works_at"] == (1.0, None, D(2020, 6, 1)) and ("c", "other", "works_at") not in got and ("e", "other", "works_at") not in got and got["g", "x", "knows"][0] == 0.2
    assert {k: v[0] for k, v in keyed(refused, "why").items()} == {("c", "other", "works_at"): "overlap", ("e", "other", "works_at"): "overlap", ("f", "x", "knows"): "order", ("g", "x", "knows"): "repeated"}
    _, refused = L.added(spark.createDataFrame(have, schema), spark.createDataFrame(new[-1:], schema), ("works_at",))
    assert keyed(refused, "why") == {("e", "acme", "works_at"): ("recorded",)}
    assert L.added(spark.createDataFrame([], schema), spark.createDataFrame([], schema))[0].collect() == []


def test_removed_links(spark):
    links = spark.createDataFrame([("a", "b-c", "knows", "manual"), ("a", "b-c", "knows", "frontmatter"), ("a", "d", "knows", "manual"), ("a", "b-c", "owns", "manual")], "source_slug string, target_slug string, type string, link_source string")
    after, report = L.removed(links, spark.createDataFrame([("a", "B C", "knows"), ("a", "b-c", "knows"), ("x", "y", "z")], "source_slug string, target_slug string, type string"))
    assert sorted(map(tuple, after.collect())) == [("a", "b-c", "knows", "frontmatter"), ("a", "b-c", "owns", "manual"), ("a", "d", "knows", "manual")]
    assert keyed(report, "removed", "derived") == {("a", "b-c", "knows"): (1, ["frontmatter"]), ("x", "y", "z"): (0, [])}


def test_typed_links_and_their_upkeep(spark):
    vault = spark.createDataFrame([("people/ann-lee", "Ann Lee", "person", False), ("companies/acme", "Acme", "company", False), ("companies/beta", "Beta", "company", False), ("people/bob", "Bob", "person", False), ("m/1", "Kickoff", "meeting", False)], "slug string, title string, type string, deleted boolean")
    pages = spark.createDataFrame(
        [("people/ann-lee", "person", '{"Company": "Acme", "founded": ["beta", "Acme", "", "unknown", "people/ann-lee"], "attendees": ["bob"], "see_also": "nobody-here"}'), ("m/1", "meeting", '{"attendees": ["people/ann-lee", "Bob", "bob"], "related": "companies/acme"}'), ("people/bob", "person", "not json"), ("companies/beta", "company", None)],
        "slug string, type string, frontmatter string",
    )
    made = L.typed_links(pages, vault)
    want = {("people/ann-lee", "companies/acme", "works_at"), ("people/ann-lee", "companies/beta", "founded"), ("people/ann-lee", "companies/acme", "founded"), ("people/ann-lee", "m/1", "attended"), ("people/bob", "m/1", "attended"), ("m/1", "companies/acme", "related_to")}
    assert set(keyed(made, "origin_slug")) == want and keyed(made, "origin_slug", "origin_field")["people/bob", "m/1", "attended"] == ("m/1", "attendees")
    links = spark.createDataFrame([("people/ann-lee", "old/job", "works_at", 0.8, "people/ann-lee", "company", "frontmatter"), ("people/ann-lee", "companies/acme", "works_at", 1.0, None, None, "manual"), ("z", "y", "knows", 0.8, "z", "knows", "frontmatter")], "source_slug string, target_slug string, type string, confidence double, origin_slug string, origin_field string, link_source string")
    after = L.synced(links, made, pages, "frontmatter")
    rows = {(r.source_slug, r.target_slug, r.type, r.link_source) for r in after.collect()}
    assert rows == {(*k, "frontmatter") for k in want} | {("people/ann-lee", "companies/acme", "works_at", "manual"), ("z", "y", "knows", "frontmatter")}
    assert {tuple(r) for r in L.synced(after, made, pages, "frontmatter").collect()} == {tuple(r) for r in after.collect()}


HEAD = "---\ntitle: T\ntype: note\ncreated: 2024-01-01\n---\n"


@pytest.mark.parametrize(
    ("body", "issues"),
    [
        (HEAD + "fine\n", []), ("no head", [(1, "no-frontmatter")]), ("---\ntitle: x\n---\n", [(1, "missing-type"), (1, "missing-created")]), (HEAD + "Of course! Here is a detailed page about it.\n", [(1, "llm-preamble")]), (HEAD + "Sure, here are facts.\n\nCertainly. Here is x", [(1, "llm-preamble"), (1, "llm-preamble")]),
        (HEAD + "```markdown\nx\n```\n", [(1, "code-fence-wrap")]), (HEAD + "on YYYY-MM-DD\nand 2024-XX-XX", [(6, "placeholder-date"), (7, "placeholder-date")]), (HEAD + "a [Source: x\nb\n[Source: y\nz] c [Source: w]", [(6, "broken-citation")]),
        (HEAD + "## One\n\n## Two\ntext\n## Three\n[No data yet]\n## Four", [(6, "empty-section"), (10, "empty-section"), (12, "empty-section")]), ("", [(1, "no-frontmatter")]), (None, None),
    ],
)
def test_lint(spark, body, issues):
    got = spark.createDataFrame([(body,)], "b string").select(lint(F.col("b")).alias("i")).first().i
    assert got == issues if issues is None else [tuple(x) for x in got] == issues


def test_repairs(spark):
    fix = lambda t: spark.createDataFrame([(t,)], "b string").select(repaired(F.col("b"))).first()[0]
    assert fix("Certainly! Here is it.\n\n\n\nText\n\n\nmore  ") == "Text\n\nmore\n" and fix("```md\n# T\n```\n") == "# T\n" and fix("a\n```md\nx\n```") == "a\n```md\nx\n```\n"


def test_repaired_pages_equals_its_sql_on_the_letter_v(spark, tmp_path):
    from oracle import same

    from millrace.plans import QUERIES, SQL

    texts = ["vieau\u00ea at", " v vat\n", "a lev", "lev \nv ", "v", " vv\tv", "", None, "avva", "a\nv\nb", " plain\n\n", "\n\nv\n\nx\n\nv\n\n"]
    spark.createDataFrame([(5 * i + 3, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/written")
    next((tmp_path / "written").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    same(QUERIES["repaired_pages"](spark, str(tmp_path)), SQL["repaired_pages"], str(tmp_path))
    # The repair takes no letter.
    assert spark.range(1).select(repaired(F.lit(" \x0bvat lev\f\n"))).first()[0] == "vat lev\n"


@pytest.mark.parametrize(
    ("context", "kind", "target", "body", "want"),
    [
        ("She co-founded [[Acme]]", "person", None, None, "founded"), ("He is a non-executive director of it", "person", None, None, "advises"), ("led a small Series A of", "note", None, None, "invested_in"), ("spent nine years at", "note", None, None, "works_at"), ("VP Engineering, Acme", "note", None, None, "works_at"),
        ("no longer works at", "note", None, None, "mentions"), ("previously at Acme", "note", None, None, "mentions"), ("previously worked at Acme", "note", None, None, "mentions"), ("left the town where I grew up in the hills. She works at Acme", "note", None, None, "works_at"), ("left it. She works at Acme", "note", None, None, "mentions"),
        ("formerly a nurse, now and for good, for all of the years to come, works at Acme", "note", None, None, "works_at"), ("formerly invested in", "note", None, None, "invested_in"), ("works at", "note", "people/ann", None, "mentions"), ("works at", "note", "acme", None, "works_at"), ("advises", "note", "people/ann", None, "advises"),
        ("works at", "media", None, None, "mentions"), ("works at", "meeting", None, None, "mentions"), ("saw", "person", "companies/acme", "She is a seed investor.", "invested_in"), ("saw", "person", "companies/acme", "She is a staff engineer at a firm", "works_at"), ("saw", "person", "people/x", "seed investor", "mentions"), ("saw", "note", "companies/acme", "seed investor", "mentions"), ("no longer works at", "person", "companies/acme", "seed investor", "mentions"),
    ],
)
def test_verbs(spark, context, kind, target, body, want):
    from millrace.functions.entities import verb_link

    df = spark.createDataFrame([(context, kind, target, body)], "c string, k string, t string, b string")
    got = verb_link(F.col("c"), F.col("k"), *([F.col("t"), F.coalesce("b", F.lit(""))] if target else []))
    assert df.select(got).first()[0] == want


def test_typed_links_make_no_similarity_join(spark, monkeypatch):
    """The fuzzy stage is none of the precise ones, and no precise one depends on it."""
    from millrace.operators import slugs

    def never(*_, **__):
        raise AssertionError("compared")

    monkeypatch.setattr(slugs, "similar", never)
    vault = spark.createDataFrame([("companies/acme", "Acme", "company", False)], "slug string, title string, type string, deleted boolean")
    pages = spark.createDataFrame([("people/a", "person", '{"company": "Acme", "see_also": ["Acmee"]}')], "slug string, type string, frontmatter string")
    assert [(r.target_slug, r.type) for r in L.typed_links(pages, vault).collect()] == [("companies/acme", "works_at")]
