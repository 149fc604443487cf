"""What a knowledge store does to facts, pages, tags and loops, as functions from tables to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import trigram_similarity
from millrace.operators.facts import decayed_confidence


def live(facts: DataFrame) -> DataFrame:
    return facts.filter("forgotten_at is null")


def pending(facts: DataFrame, consolidated: str = "consolidated") -> DataFrame:
    """One row: live facts that no consolidation has taken up."""
    return live(facts).filter(~F.col(consolidated)).agg(F.count("*").alias("n"))


def entity_recall(slug: str, pages: DataFrame, facts: DataFrame, timeline: DataFrame, now: str, n: int = 25) -> DataFrame:
    """What is known of an entity: its page, its n surest facts and n newest events, as rows (part, place, ref, detail)."""
    page = pages.filter(F.col("slug") == slug).select(F.lit("page").alias("part"), F.lit(1).alias("place"), F.col("slug").alias("ref"), F.col("title").alias("detail"))

    def ranked(df: DataFrame, part: str, order: list[Column], detail: str) -> DataFrame:
        top = df.orderBy(*order).limit(n)
        return top.select(F.lit(part).alias("part"), F.row_number().over(Window.orderBy(*order)).alias("place"), F.col("id").cast("string").alias("ref"), F.col(detail).alias("detail"))  # n rows

    known = live(facts).filter(F.col("entity_slug") == slug).withColumn("sure", decayed_confidence(now))
    events = timeline.filter(F.col("slug") == slug)
    return page.unionByName(ranked(known, "fact", [F.desc("sure"), F.asc("id")], "fact")).unionByName(ranked(events, "event", [F.desc("occurred_at"), F.asc("id")], "kind"))


def forgotten(facts: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """Facts with those of `ids` (id) marked as forgotten; a mark that is there stays."""
    gone = ids.select("id").distinct().withColumn("gone", F.lit(True))
    return facts.join(gone, "id", "left").withColumn("forgotten_at", F.coalesce("forgotten_at", F.when(F.col("gone"), at))).drop("gone")


def recalled(facts: DataFrame, ids: DataFrame) -> DataFrame:
    """Facts with those of `ids` no longer forgotten, unless another fact has taken their place."""
    back = ids.select("id").distinct().withColumn("back", F.lit(True))
    keep = F.coalesce("back", F.lit(False)) & F.col("superseded_by").isNull()
    return facts.join(back, "id", "left").withColumn("forgotten_at", F.when(~keep, F.col("forgotten_at"))).drop("back")


def replaced(facts: DataFrame, by: DataFrame, at: Column) -> DataFrame:
    """Facts with each of `by` (id, new_id) forgotten and pointing to the fact in its place."""
    out = forgotten(facts, by, at).join(by.select("id", "new_id").dropDuplicates(["id"]), "id", "left")
    return out.withColumn("superseded_by", F.coalesce("new_id", "superseded_by")).drop("new_id")


#: Kinds of facts in a table of a body; the last one stands for an unknown kind (fixed values).
KINDS = ("event", "preference", "commitment", "belief", "fact")
ROW = "array<struct<row:int,claim:string,kind:string,confidence:double,valid_from:string,valid_until:string,source:string,active:boolean>>"


def fence_rows(body: Column, begin: str, end: str) -> Column:
    """Facts of a body's Markdown table between two marks: array of ROW. Struck-out claims aren't active."""
    block = F.regexp_extract(body, rf"(?s)\Q{begin}\E\n(.*?)\n\Q{end}\E", 1)
    lines = F.filter(F.split(block, r"\r?\n"), lambda x: x.rlike(r"^\s*\|\s*\d+\s*\|"))

    def row(line: Column) -> Column:
        cells = F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"(?<!\\)\|"), lambda c: F.replace(F.trim(c), F.lit("\\|"), F.lit("|")))
        cell = lambda i: F.coalesce(F.get(cells, i), F.lit(""))
        struck = cell(1).rlike("^~~.*~~$")
        sure = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(cell(3).try_cast("double"), F.lit(1.0))))
        day = lambda i: F.when(cell(i).rlike(r"^\d{4}-\d{2}-\d{2}$"), cell(i))
        return F.struct(
            cell(0).cast("int").alias("row"), F.when(struck, F.regexp_extract(cell(1), "^~~(.*)~~$", 1)).otherwise(cell(1)).alias("claim"),
            F.when(F.lower(cell(2)).isin(*KINDS), F.lower(cell(2))).otherwise(KINDS[-1]).alias("kind"), sure.alias("confidence"),
            day(5).alias("valid_from"), day(6).alias("valid_until"), F.nullif(cell(7), F.lit("")).alias("source"), (~struck).alias("active"),
        )

    return F.transform(lines, row).cast(ROW)


def fence(facts: DataFrame, key: str, begin: str, end: str) -> DataFrame:
    """Per key its facts (row, claim, kind, confidence, valid_from, valid_until, source, active) as a Markdown table between marks, in
    the order of the rows' numbers."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    claim = F.when(F.col("active"), cell("claim")).otherwise(F.concat(F.lit("~~"), cell("claim"), F.lit("~~")))
    line = F.concat(F.lit("| "), F.array_join(F.array(cell("row"), claim, cell("kind"), cell("confidence"), F.lit(""), cell("valid_from"), cell("valid_until"), cell("source")), " | "), F.lit(" |"))
    first = facts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("row", "claim", line.alias("line")))).alias("l"))
    head = "| # | claim | kind | confidence | notability | valid_from | valid_until | source |\n|---|-------|------|------------|------------|------------|-------------|--------|"
    return first.select(key, F.concat(F.lit(f"{begin}\n{head}\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit(f"\n{end}")).alias("body"))


def unordered_links(links: DataFrame, pages: DataFrame, kind: str) -> DataFrame:
    """Links of a type between live pages, once for each pair whatever their direction: a, b, n."""
    alive = pages.filter("not deleted").select("slug")
    pairs = links.filter((F.col("type") == kind) & (F.col("source_slug") != F.col("target_slug")))
    pairs = pairs.groupBy(F.least("source_slug", "target_slug").alias("a"), F.greatest("source_slug", "target_slug").alias("b")).agg(F.count("*").alias("n"))
    return pairs.join(alive.withColumnRenamed("slug", "a"), "a", "left_semi").join(alive.withColumnRenamed("slug", "b"), "b", "left_semi")


SEVERITY = {"high": 0, "medium": 1, "low": 2}


def by_severity(rows: DataFrame, severity: str, at: str, n: int) -> DataFrame:
    """The n worst rows, the newest first among equals."""
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv]), F.col(severity)), F.lit(len(SEVERITY)))
    return rows.orderBy(rank, F.desc(at), "id").limit(n)


def calibration_profile(takes: DataFrame, source: str) -> DataFrame:
    """Per source of takes: resolved, hit rate (correct and half of partial), mean weight, and the gap between the two."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    resolved = n("correct") + n("incorrect") + n("partial")
    rate = (n("correct") + 0.5 * n("partial")) / resolved
    mean = F.avg(F.when(F.col("verdict").isin("correct", "incorrect", "partial"), F.col("weight")))
    out = takes.groupBy(source).agg(resolved.alias("resolved"), rate.alias("rate"), mean.alias("stated")).filter("resolved > 0")
    return out.withColumn("gap", F.col("stated") - F.col("rate"))


def unknown_citations(answer: Column, gathered: Column) -> Column:
    """Numbers in square brackets of an answer that no gathered source has."""
    cited = F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,6})\]"), F.lit(1)), lambda x: x.cast("long"))
    return F.array_sort(F.array_distinct(F.array_except(cited, gathered)))


def invitation_state(response: Column, status: Column, starts: Column, mine: Column, now: Column) -> Column:
    """Of a calendar event: open (an answer is owed), or why none is: none, cancelled, expired, reply, own."""
    return (
        F.when(response.isNull(), "none").when(status == "cancelled", "cancelled").when(starts <= now, "expired").when(F.lower(response) != "needsaction", "reply").when(mine, "own").otherwise("open")
    )


def retagged(tags: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """Tags (slug, tag) after some were added, in normal form and once each, and some removed."""
    from millrace.functions.entities import normalized_tag

    norm = lambda df: df.select("slug", normalized_tag(F.col("tag")).alias("tag")).filter("tag is not null")
    return norm(tags).unionByName(norm(added)).distinct().join(norm(removed).distinct(), ["slug", "tag"], "left_anti")


def behind(docs: DataFrame, version: str, current: int) -> DataFrame:
    """Documents that an older version of the chunker has cut, the oldest first in a plan: all but those of the current one."""
    return docs.filter(F.coalesce(F.col(version), F.lit(0)) < current)


def anchored(events: DataFrame, pages: DataFrame) -> DataFrame:
    """Events with an empty anchor filled by the page of their slug, where there is one."""
    own = pages.filter("not deleted").select("slug", F.col("slug").alias("page"))
    return events.join(own, "slug", "left").withColumn("anchor", F.coalesce("anchor", "page")).drop("page")


def slug_suggestions(pages: DataFrame, slug: str, folder: str, n: int = 3, least: float = 0.3) -> DataFrame:
    """Slugs close to one that no page has: with the folder put before it or taken off first, then the n most similar."""
    affixes = {slug.removeprefix(f"{folder}/"), f"{folder}/{slug}"} - {slug}
    sim = trigram_similarity(F.col("slug"), F.lit(slug))
    rows = pages.filter((F.col("slug") != slug) & ~F.col("deleted")).select("slug", F.col("slug").isin(*affixes).alias("affix"), F.round(sim, 9).alias("similarity")).filter(F.col("affix") | (F.col("similarity") >= least))
    near = rows.filter("not affix").orderBy(F.desc("similarity"), "slug").limit(n)
    return rows.filter("affix").unionByName(near)


def renamed(pages: DataFrame, mapping: DataFrame) -> DataFrame:
    """Pages under new slugs (mapping: old, new); a new slug that a page has already leaves its page as it was."""
    free = mapping.select("old", "new").dropDuplicates(["old"]).join(pages.select(F.col("slug").alias("new")), "new", "left_anti")
    return pages.join(free.withColumnRenamed("old", "slug"), "slug", "left").withColumn("slug", F.coalesce("new", "slug")).drop("new")


def marked_deleted(pages: DataFrame, slugs: DataFrame, deleted: bool = True) -> DataFrame:
    """Pages with those of `slugs` deleted, or restored."""
    one = slugs.select("slug").distinct().withColumn("hit", F.lit(True))
    return pages.join(one, "slug", "left").withColumn("deleted", F.when(F.col("hit"), F.lit(deleted)).otherwise(F.col("deleted"))).drop("hit")


def appended(pages: DataFrame, more: DataFrame, body: str = "body") -> DataFrame:
    """Pages with a text (slug, text) behind their body, a blank line between them."""
    one = more.groupBy("slug").agg(F.array_join(F.sort_array(F.collect_list("text")), "\n\n").alias("text"))
    return pages.join(one, "slug", "left").withColumn(body, F.when(F.col("text").isNull(), F.col(body)).when(F.coalesce(F.col(body), F.lit("")) == "", F.col("text")).otherwise(F.concat(F.col(body), F.lit("\n\n"), F.col("text")))).drop("text")


def reverted(versions: DataFrame, to: DataFrame) -> DataFrame:
    """New versions of pages that bring back an earlier one (to: slug, back): slug, version, digest, body."""
    last = versions.groupBy("slug").agg(F.max("version").alias("last"))
    back = versions.join(to.select("slug", F.col("back").alias("version")), ["slug", "version"]).drop("version")
    return back.join(last, "slug").select("slug", (F.col("last") + 1).alias("version"), "digest", "body")


def without_hidden(facts: DataFrame, lineage: DataFrame, hidden: DataFrame) -> DataFrame:
    """Facts that no hidden page has given (lineage: id, slug; hidden: slug)."""
    bad = lineage.join(hidden.select("slug").distinct(), "slug", "left_semi").select("id").distinct()
    return facts.join(bad, "id", "left_anti")
