"""Links of pages: added and removed by hand, derived from frontmatter, and kept in step with what they are derived from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.entities import junk_name
from millrace.functions.unicode import link_target
from millrace.operators.slugs import canonical
from millrace.sources.shared import settled

#: Fields of a page's frontmatter that name other pages, by the page's type: link type, and whether it leads from the page (fixed values).
FIELDS = {
    "person": {"company": ("works_at", True), "companies": ("works_at", True), "founded": ("founded", True), "advises": ("advises", True), "invested_in": ("invested_in", True), "knows": ("knows", True)},
    "meeting": {"attendees": ("attended", False), "attended_by": ("attended", False), "location": ("located_at", True)},
    "": {"related": ("related_to", True), "see_also": ("related_to", True)},
}
#: Stages of a resolved mention that are sure enough for a link (fixed values).
PRECISE = ("exact", "alias", "exact_tail", "prefix")
CONFIDENCE = 0.8
KEY = ["source_slug", "target_slug", "type"]


def typed_links(pages: DataFrame, vault: DataFrame, aliases: DataFrame | None = None, redirects: DataFrame | None = None) -> DataFrame:
    """(source_slug, target_slug, type, confidence, origin_slug, origin_field) of the pages that frontmatter fields name.

    pages (slug, type, frontmatter: a JSON object). A field holds a name or a list of names; each is resolved among the vault's pages
    (see slugs.canonical) and counts only if a precise stage finds one. Junk names and links to the page itself are left out, and a link that
    several fields give counts once, with the first of them.
    """
    rules = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(f).alias("field"), F.lit(k).alias("type"), F.lit(out).alias("out"), F.lit(i).alias("nth")) for i, (t, f, k, out) in enumerate((t, f, k, out) for t in ("", "person", "meeting") for f, (k, out) in FIELDS[t].items())])
    whole = F.from_json("frontmatter", "map<string,string>")
    rows = pages.select("slug", F.coalesce("type", F.lit("")).alias("kind"), F.explode(F.map_entries(whole)).alias("e"), rules.alias("rules"))
    rows = rows.select("slug", "kind", F.lower("e.key").alias("field"), F.col("e.value").alias("raw"), F.inline("rules").alias("t", "wanted", "type", "out", "nth")).filter("field = wanted and (t = '' or t = kind)")
    several = F.when(F.col("raw").startswith("["), F.coalesce(F.from_json("raw", "array<string>"), F.array().cast("array<string>"))).otherwise(F.array("raw"))
    named = rows.withColumn("name", F.explode(several)).withColumn("name", F.trim("name")).filter(F.col("name").isNotNull() & (F.col("name") != "") & ~junk_name(F.col("name")))
    named = settled(named)
    to = settled(canonical(named.select("name", F.col("slug").alias("source_slug")), vault, aliases, redirects, fuzzy=False).filter(F.col("stage").isin(*PRECISE)))
    hit = named.join(to.select("name", F.col("source_slug").alias("slug"), F.col("slug").alias("other")), ["name", "slug"]).filter("other <> slug").filter(~junk_name(F.col("other")))
    ends = hit.select(F.when(F.col("out"), F.col("slug")).otherwise(F.col("other")).alias("source_slug"), F.when(F.col("out"), F.col("other")).otherwise(F.col("slug")).alias("target_slug"), "type", F.col("slug").alias("origin_slug"), "field", "nth")
    return ends.groupBy(*KEY, "origin_slug").agg(F.min_by("field", "nth").alias("origin_field")).withColumn("confidence", F.lit(CONFIDENCE)).select(*KEY, "confidence", "origin_slug", "origin_field")


def synced(links: DataFrame, derived: DataFrame, origins: DataFrame, link_source: str) -> DataFrame:
    """links (KEY, confidence, origin_slug, origin_field, link_source) with what one deriver made of the origins (slug) replaced by `derived`.
    Links of other pages and other link sources stay as they are; of equal ones in `derived`, the one of least origin stays."""
    mine = links.filter(F.col("link_source") == link_source).join(origins.select(F.col("slug").alias("origin_slug")).distinct(), "origin_slug", "left_semi")
    keep = links.join(mine.select(*KEY, "link_source"), [*KEY, "link_source"], "left_anti")
    one = derived.groupBy(*KEY).agg(F.min(F.struct("origin_slug", "origin_field", "confidence")).alias("d")).select(*KEY, "d.confidence", "d.origin_slug", "d.origin_field", F.lit(link_source).alias("link_source"))
    return keep.select(*one.columns).unionByName(one.join(keep.select(*KEY, "link_source"), [*KEY, "link_source"], "left_anti"))


def added(links: DataFrame, new: DataFrame, single: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(links after, refused): links put in by hand. links and new: KEY, confidence, valid_from, valid_until (dates or null).

    A new link's target becomes a slug. A link that is there gets the new confidence and the dates that it lacks; a date that it has can't be
    changed. Of types in `single` a source holds one target at a time: an open one of another target is closed where the new one begins; any
    other overlap is refused, and so is an undated one beside dated ones. refused: KEY and why (order, repeated, recorded, overlap).
    Of several new links for one key, or for one source of a single type, the first by target counts and the others are `repeated`.
    """
    n = new.select("source_slug", link_target("target_slug").alias("target_slug"), "type", F.coalesce("confidence", F.lit(1.0)).alias("confidence"), "valid_from", "valid_until")
    slot = F.when(F.col("type").isin(*single), F.lit("")).otherwise(F.col("target_slug")) if single else F.col("target_slug")
    w = Window.partitionBy("source_slug", "type", slot).orderBy("target_slug", "valid_from", "valid_until", F.desc("confidence"))
    n = n.withColumn("k", F.row_number().over(w))
    was = links.select(*KEY, F.col("confidence").alias("c0"), F.col("valid_from").alias("f0"), F.col("valid_until").alias("u0"), F.lit(True).alias("there"))
    n = n.join(was, KEY, "left")
    n = n.withColumns({"f": F.coalesce("f0", "valid_from"), "u": F.coalesce("u0", "valid_until")})
    changed = lambda new, old: F.col(new).isNotNull() & F.col(old).isNotNull() & (F.col(new) != F.col(old))
    why = F.when((F.col("valid_from") >= F.col("valid_until")) | (F.col("f") >= F.col("u")), "order").when(F.col("k") > 1, "repeated").when(changed("valid_from", "f0") | changed("valid_until", "u0"), "recorded")
    n = n.withColumn("why", why)
    if single:
        others = links.filter(F.col("type").isin(*single)).select("source_slug", "type", F.col("target_slug").alias("t"), F.col("valid_from").alias("of"), F.col("valid_until").alias("ou"))
        wanted = n.filter(F.col("type").isin(*single) & F.col("why").isNull()).select("source_slug", "type", "target_slug", "f", "u", "there")
        met = wanted.join(others, ["source_slug", "type"]).filter("t <> target_slug")
        far, past = F.lit("9999-12-31").cast("date"), F.lit("0001-01-01").cast("date")
        over = (F.coalesce("of", past) < F.coalesce("u", far)) & (F.coalesce("f", past) < F.coalesce("ou", far))
        closes = over & F.col("ou").isNull() & F.col("f").isNotNull() & (F.coalesce("of", past) < F.col("f")) & F.col("there").isNull()
        bare = F.col("f").isNull() & (F.col("of").isNotNull() | F.col("ou").isNotNull())
        undated = F.col("f").isNull() & F.col("u").isNull() & F.col("of").isNull() & F.col("ou").isNull()
        met = met.withColumn("closes", closes).withColumn("bad", (over & ~closes & ~undated) | bare)
        verdict = met.groupBy(*KEY).agg(F.bool_or("bad").alias("bad"))
        n = n.join(verdict, KEY, "left").withColumn("why", F.coalesce("why", F.when(F.col("bad"), "overlap"))).drop("bad")
        ended = met.join(verdict.filter("not bad").select(*KEY), KEY, "left_semi").filter("closes").groupBy("source_slug", "type", F.col("t").alias("target_slug")).agg(F.min("f").alias("end"))
    good = n.filter("why is null")
    put = good.select(*KEY, "confidence", F.col("f").alias("valid_from"), F.col("u").alias("valid_until"))
    rest = links.select(*KEY, "confidence", "valid_from", "valid_until").join(put.select(*KEY), KEY, "left_anti")
    if single:
        rest = rest.join(ended, KEY, "left").withColumn("valid_until", F.coalesce("valid_until", "end")).drop("end")
    return rest.unionByName(put), n.filter("why is not null").select(*KEY, "why")


def removed(links: DataFrame, which: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links after, report): links by hand taken out. links (KEY, link_source, ...); which (KEY, the target a loose name). report: KEY,
    removed (how many), derived (link sources that still make the link; their text must be edited)."""
    w = which.select("source_slug", link_target("target_slug").alias("target_slug"), "type").distinct()
    gone = F.col("link_source") == "manual"
    after = links.filter(~gone).unionByName(links.filter(gone).join(w, KEY, "left_anti").select(links.columns))
    found = w.join(links.select(*KEY, "link_source"), KEY, "left").groupBy(*KEY).agg(F.count_if(gone).alias("removed"), F.sort_array(F.collect_set(F.when(~gone, F.col("link_source")))).alias("derived"))
    return after, found
