"""Facts, pages, tags, names and predicates of a knowledge store."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import entities as N
from millrace.operators import knowledge as K
from millrace.operators import slugs
from millrace.plans.registry import query
from millrace.plans.search_queries import _likeness, _trigrams
from millrace.sources.relations import Tables, moment


@query("pending_count", "SELECT count(*) AS n FROM facts WHERE forgotten_at IS NULL AND NOT confidence > 0.8", "facts")
def _(spark, d):
    return K.pending(Tables(spark, d).facts.withColumn("consolidated", F.col("confidence") > 0.8))


@query("entity_recall", """WITH f AS (SELECT id, fact, CASE WHEN valid_until < DATE '2000-01-01' THEN 0 ELSE confidence * exp(-greatest(0, epoch(TIMESTAMP '2000-01-01') - epoch(written_at)) / 86400 / CASE kind WHEN 'event' THEN 7 WHEN 'commitment' THEN 90 WHEN 'preference' THEN 90 ELSE 365 END) END AS sure FROM facts WHERE entity_slug = 'customer/7' AND forgotten_at IS NULL)
SELECT 'page' AS part, 1 AS place, slug AS ref, title AS detail FROM vault WHERE slug = 'customer/7'
UNION ALL SELECT 'fact', row_number() OVER (ORDER BY sure DESC, id), CAST(id AS VARCHAR), fact FROM (SELECT * FROM f ORDER BY sure DESC, id LIMIT 25)
UNION ALL SELECT 'event', row_number() OVER (ORDER BY occurred_at DESC, id), CAST(id AS VARCHAR), kind FROM (SELECT * FROM timeline WHERE slug = 'customer/7' ORDER BY occurred_at DESC, id LIMIT 25)""", "facts vault timeline")
def _(spark, d):
    t = Tables(spark, d)
    return K.entity_recall("customer/7", t.vault, t.facts, t.timeline, "2000-01-01 00:00:00")


@query("forget_recall_replace", "SELECT id, CASE WHEN slot = 'P' AND superseded_by IS NULL THEN NULL WHEN kind = 'event' OR kind = 'belief' THEN coalesce(forgotten_at, TIMESTAMP '2024-01-01') ELSE forgotten_at END AS forgotten_at, CASE WHEN kind = 'belief' AND NOT (slot = 'P' AND superseded_by IS NULL AND false) THEN id + 1 ELSE superseded_by END AS superseded_by FROM (SELECT id, kind, slot, forgotten_at, CASE WHEN kind = 'belief' THEN id + 1 ELSE superseded_by END AS superseded_by FROM facts)", "facts")
def _(spark, d):
    f = Tables(spark, d).facts.select("id", "kind", "slot", "forgotten_at", "superseded_by")
    at = moment("2024-01-01")
    gone = K.forgotten(f, f.filter("kind = 'event'"), at)
    new = K.replaced(gone, f.filter("kind = 'belief'").select("id", (F.col("id") + 1).alias("new_id")), at)
    return K.recalled(new, f.filter("slot = 'P'")).select("id", "forgotten_at", "superseded_by")


@query("facts_fence", "SELECT entity_slug, CAST(i AS INTEGER) AS row, fact AS claim, kind, round(confidence, 2) AS confidence, CAST(valid_from AS VARCHAR) AS valid_from, forgotten_at IS NULL AS active FROM (SELECT *, row_number() OVER (PARTITION BY entity_slug ORDER BY id) AS i FROM facts)", "facts")
def _(spark, d):
    """Each entity's facts written as a table of its body, and read back."""
    from pyspark.sql import Window

    f = Tables(spark, d).facts.select("entity_slug", F.row_number().over(Window.partitionBy("entity_slug").orderBy("id")).alias("row"), F.col("fact").alias("claim"), "kind", F.round("confidence", 2).alias("confidence"), "valid_from", "valid_until", F.col("source_id").alias("source"), F.col("forgotten_at").isNull().alias("active"))
    body = K.fence(f, "entity_slug", "<!-- facts -->", "<!-- /facts -->")
    back = body.select("entity_slug", F.inline(K.fence_rows(F.concat(F.lit("# Page\n\n"), "body", F.lit("\n\nmore | text\n")), "<!-- facts -->", "<!-- /facts -->")))
    return back.select("entity_slug", "row", "claim", "kind", "confidence", "valid_from", "active")


@query("contradiction_links", "SELECT least(source_slug, target_slug) AS a, greatest(source_slug, target_slug) AS b, count(*) AS n FROM links WHERE type = 'supplies' AND source_slug IN (SELECT slug FROM vault WHERE NOT deleted) AND target_slug IN (SELECT slug FROM vault WHERE NOT deleted) GROUP BY 1, 2", "links vault")
def _(spark, d):
    t = Tables(spark, d)
    return K.unordered_links(t.links, t.vault, "supplies")


@query("probed_contradictions", "SELECT id, severity FROM (SELECT id, occurred_at, CASE WHEN kind = 'error' THEN 'high' WHEN kind = 'signup' THEN 'medium' ELSE 'low' END AS severity FROM timeline) ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, occurred_at DESC, id LIMIT 40", "timeline")
def _(spark, d):
    t = Tables(spark, d).timeline.withColumn("severity", F.when(F.col("kind") == "error", "high").when(F.col("kind") == "signup", "medium").otherwise("low"))
    return K.by_severity(t, "severity", "occurred_at", 40).select("id", "severity")


@query("calibration_profile", "SELECT source_ref, count(*) FILTER (verdict IN ('correct', 'incorrect', 'partial')) AS resolved, round((count(*) FILTER (verdict = 'correct') + 0.5 * count(*) FILTER (verdict = 'partial')) / count(*) FILTER (verdict IN ('correct', 'incorrect', 'partial')), 9) AS rate, round(avg(weight) FILTER (verdict IN ('correct', 'incorrect', 'partial')), 9) AS stated FROM takes GROUP BY 1 HAVING count(*) FILTER (verdict IN ('correct', 'incorrect', 'partial')) > 0", "takes")
def _(spark, d):
    p = K.calibration_profile(Tables(spark, d).takes, "source_ref")
    return p.select("source_ref", "resolved", F.round("rate", 9).alias("rate"), F.round("stated", 9).alias("stated"))


@query("citation_check", "SELECT event_id, list_sort(list_distinct(list_filter([user_id % 7, event_id % 5], lambda x: NOT list_contains([0, 1, 2], x)))) AS unknown FROM events")
def _(spark, d):
    answer = F.concat(F.lit("So it was ["), F.col("user_id") % 7, F.lit("], as in [x] and ["), F.col("event_id") % 5, F.lit("]."))
    gathered = F.lit([0, 1, 2]).cast("array<bigint>")
    return Tables(spark, d).events.select("event_id", K.unknown_citations(answer, gathered).alias("unknown"))


@query("calendar_loops", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'none' WHEN event_type = 'error' THEN 'cancelled' WHEN ts <= TIMESTAMP '2024-01-10' THEN 'expired' WHEN event_id % 4 <> 1 THEN 'reply' WHEN user_id % 2 = 0 THEN 'own' ELSE 'open' END AS state FROM events")
def _(spark, d):
    e, n = Tables(spark, d).events, F.col("event_id") % 4
    response = F.when(n == 1, "needsAction").when(n == 2, "accepted").when(n == 3, "declined")
    state = K.invitation_state(response, F.when(F.col("event_type") == "error", "cancelled").otherwise("confirmed"), F.col("ts"), F.col("user_id") % 2 == 0, moment("2024-01-10"))
    return e.select("event_id", state.alias("state"))


@query("tags", "SELECT slug, tag FROM (SELECT DISTINCT 'part/' || p_partkey AS slug, lower(p_brand) AS tag FROM part UNION SELECT 'part/' || p_partkey, 'new tag' FROM part WHERE p_size > 10) WHERE NOT (tag = 'new tag' AND slug LIKE '%1')")
def _(spark, d):
    p = Tables(spark, d).part.select(F.concat(F.lit("part/"), "p_partkey").alias("slug"), F.col("p_brand").alias("tag"), "p_size")
    added = p.filter("p_size > 10").select("slug", F.lit("  New   Tag ").alias("tag"))
    return K.retagged(p.select("slug", "tag").unionByName(p.select("slug", F.upper("tag").alias("tag"))), added, added.filter("slug like '%1'"))


@query("rechunk_plan", "SELECT doc_id FROM documents WHERE coalesce(CASE WHEN lang <> 'de' THEN len(lang) END, 0) < 2 OR lang IS NULL")
def _(spark, d):
    v = F.when(F.col("lang") != "de", F.length("lang"))
    return K.behind(Tables(spark, d).documents.withColumn("version", v), "version", 2).select("doc_id")


@query("timeline_anchor", "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'kept' WHEN slug IS NOT NULL THEN slug END AS anchor FROM orders LEFT JOIN (SELECT slug FROM vault WHERE NOT deleted) ON slug = 'customer/' || o_custkey", "vault")
def _(spark, d):
    t = Tables(spark, d)
    e = t.orders.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("customer/"), "o_custkey").alias("slug"), F.when(F.col("o_orderstatus") == "P", "kept").alias("anchor"))
    return K.anchored(e, t.vault).select("id", "anchor")


@query("body_timeline", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS date, event_type || ' of ' || user_id AS event FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, strftime(ts, '%Y-%m-%d'), 'Heading ' || user_id FROM events WHERE event_id % 2 = 1")
def _(spark, d):
    day = F.date_format("ts", "yyyy-MM-dd")
    bullet = F.concat(F.lit("Text.\n- **"), day, F.lit("** — "), "event_type", F.lit(" of "), "user_id", F.lit("\n- 2024-02-31 no such day\n"))
    heading = F.concat(F.lit("### "), day, F.lit(": Heading "), "user_id", F.lit("\n#### 2024-01-01 deeper\n"))
    return Tables(spark, d).events.select("event_id", F.inline(N.dated_bullets(F.when(F.col("event_id") % 2 == 0, bullet).otherwise(heading))))


@query("slug_suggest", f"""WITH t AS (SELECT slug, {_trigrams('slug')} AS t, {_trigrams("'17'")} AS q FROM vault WHERE NOT deleted), s AS (SELECT slug, slug = 'part/17' AS affix, round({_likeness('t', 'q')}, 9) AS similarity FROM t),
n AS (SELECT * FROM s WHERE NOT affix AND similarity >= 0.3 ORDER BY similarity DESC, slug LIMIT 3) SELECT * FROM s WHERE affix UNION ALL SELECT * FROM n""", "vault")
def _(spark, d):
    return K.slug_suggestions(Tables(spark, d).vault, "17", "part").select("slug", "affix", "similarity")


@query("name_variants", """WITH n AS (SELECT DISTINCT w, string_split(w, ' ') AS p FROM (SELECT lower(p_name) AS w FROM part UNION ALL SELECT left(lower(p_name), 1) || ' ' || split_part(lower(p_name), ' ', 2) FROM part UNION ALL SELECT left(lower(p_name), length(split_part(p_name, ' ', 1)) - 1) || ' ' || split_part(lower(p_name), ' ', 2) FROM part UNION ALL SELECT split_part(lower(p_name), ' ', 2) || ' ' || split_part(lower(p_name), ' ', 1) FROM part)),
o AS (SELECT w, p[1] AS g, p[len(p)] AS s FROM n WHERE len(p) = 2 AND p[1] <> '' AND regexp_full_match(w, '[a-z]+ [a-z]+')),
m AS (SELECT a.w AS a, b.w AS b, unnest([a.g, a.s]) AS g, unnest([a.s, a.g]) AS s, b.g AS h, b.s AS t FROM o a JOIN o b ON a.s = b.s OR a.g = b.s)
SELECT DISTINCT a AS name, b AS title, 'strong' AS fit FROM m WHERE s = t AND length(s) > 1 AND (g = h OR ((length(g) = 1 OR length(h) = 1) AND left(g, 1) = left(h, 1)) OR (least(length(g), length(h)) >= 5 AND levenshtein(g, h) <= 1))""")
def _(spark, d):
    """Part names as names of people, each also with an initial, with a slip of the pen, and surname first."""
    name, p = F.lower("p_name"), Tables(spark, d).part
    given, rest = F.split_part(name, F.lit(" "), F.lit(1)), F.split_part(name, F.lit(" "), F.lit(2))
    forms = F.array(name, F.concat_ws(" ", F.substring(name, 1, 1), rest), F.concat_ws(" ", F.substr(name, F.lit(1), F.length(given) - 1), rest), F.concat_ws(" ", rest, given))
    every = p.select(F.explode(forms).alias("name")).filter("name not like ' %'").distinct()
    return slugs.name_variants(every, every.select(F.col("name").alias("slug"), F.col("name").alias("title"))).select("name", "title", "fit")


@query("pages_renamed", "SELECT CASE WHEN type = 'place' THEN 'country/' || split_part(slug, '/', 2) ELSE slug END AS slug, deleted AND type <> 'person' AS deleted FROM vault", "vault")
def _(spark, d):
    """Nations moved to another folder, deleted people restored."""
    v = Tables(spark, d).vault
    m = v.filter("type = 'place'").select(F.col("slug").alias("old"), F.concat(F.lit("country/"), F.split_part("slug", F.lit("/"), F.lit(2))).alias("new"))
    return K.marked_deleted(K.renamed(v, m), v.filter("type = 'person'"), False).select("slug", "deleted")


@query("page_append", "SELECT slug, CASE WHEN slug LIKE '%3' THEN title || chr(10) || chr(10) || 'first' || chr(10) || chr(10) || 'second' ELSE title END AS body FROM vault", "vault")
def _(spark, d):
    v = Tables(spark, d).vault.select("slug", F.col("title").alias("body"))
    more = v.filter("slug like '%3'").select("slug", F.explode(F.lit(["second", "first"])).alias("text"))
    return K.appended(v, more)


@query("page_revert", "SELECT slug, 3 AS version, sha256(title) AS digest, title AS body FROM vault WHERE slug LIKE '%13'", "vault")
def _(spark, d):
    from millrace.sources import connectors as C

    v = Tables(spark, d).vault.filter("slug like '%3'").select("slug", F.col("title").alias("body"))
    none = spark.createDataFrame([], "slug string, version int, digest string, previous string, body string")
    first = C.append_versions(none, v)
    second = C.append_versions(first, v.filter("slug like '%13'").withColumn("body", F.concat("body", F.lit("!"))))
    versions = first.unionByName(second)
    return K.reverted(versions, second.select("slug", F.lit(1).alias("back")))


@query("fact_source_eligible", "SELECT id FROM facts WHERE entity_slug NOT IN (SELECT slug FROM vault WHERE deleted)", "facts vault")
def _(spark, d):
    t = Tables(spark, d)
    return K.without_hidden(t.facts, t.facts.select("id", F.col("entity_slug").alias("slug")), t.vault.filter("deleted")).select("id")


@query("owner_only_lineage", "SELECT id FROM timeline WHERE id NOT IN (SELECT event_id FROM events WHERE user_id % 10 = 0)", "timeline")
def _(spark, d):
    t = Tables(spark, d).timeline
    lineage = t.select("id", "slug")
    return K.without_hidden(t, lineage, lineage.filter("slug like '%0'").select("slug")).select("id")


@query("diary_exclusion", "SELECT doc_id FROM documents WHERE source NOT IN ('src0', 'src1') OR source IS NULL")
def _(spark, d):
    kind = F.when(F.col("source") == "src0", "journal").otherwise("note")
    slug = F.when(F.col("source") == "src1", F.concat(F.lit("life/diary/"), "doc_id")).otherwise(F.concat(F.lit("notes/"), "doc_id"))
    return Tables(spark, d).documents.filter(~N.diary(kind, slug)).select("doc_id")


@query("orphan_policy", "SELECT slug FROM vault WHERE slug NOT IN (SELECT target_slug FROM links WHERE source_slug <> target_slug) AND source_id <> 'vault'", "vault links")
def _(spark, d):
    from millrace.operators.graph import orphans

    t = Tables(spark, d)
    writer = F.when(F.col("source_id") == "vault", "reflection").otherwise("owner")
    return orphans(t.vault.filter(~writer.isin(*N.DERIVED_WRITERS)), t.links).select("slug")


@query("junk_entities", "SELECT name, name IN ('The Team', 'a', '42', 'people/unknown', 'MISC', 'us') AS junk FROM (SELECT DISTINCT p_name AS name FROM part UNION ALL SELECT unnest(['The Team', 'a', '42', 'people/unknown', 'MISC', 'us', 'US', 'IT', 'Team Rocket', 'people/ada']) WHERE (SELECT count(*) FROM part) > 0)")
def _(spark, d):
    p = Tables(spark, d).part
    fixed = F.lit(["The Team", "a", "42", "people/unknown", "MISC", "us", "US", "IT", "Team Rocket", "people/ada"])
    names = p.select(F.col("p_name").alias("name")).distinct().unionByName(p.limit(1).select(F.explode(fixed).alias("name")))
    return names.select("name", N.junk_name(F.col("name")).alias("junk"))


@query("public_projection", "SELECT slug, type, title FROM vault WHERE NOT deleted", "vault")
def _(spark, d):
    v = Tables(spark, d).vault.filter("not deleted").drop("updated_at")
    return v.select(*N.public_fields(*v.columns))


@query("code_refs", "SELECT doc_id, 'src/' || lang || '/main_' || doc_id || '.py' AS path FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL")
def _(spark, d):
    docs = Tables(spark, d).documents.filter("lang is not null and text is not null")
    path = F.concat(F.lit("src/"), "lang", F.lit("/main_"), "doc_id", F.lit(".py"))
    text = F.concat(F.replace(F.replace("text", F.lit("`"), F.lit("'")), F.lit("/"), F.lit(" ")), F.lit("\nsee "), path, F.lit(":12 and "), path, F.lit(", not ```\nsrc/x.py\n``` or foo/bar.py"))
    return docs.select("doc_id", F.explode(N.code_refs(text)).alias("path"))


SAID = (
    ("Ada co-founded it", "founded"), ("Ada is one of the founders", "founded"), ("Ada formerly invested in it", "invested_in"), ("Ada led a small Series A of it", "invested_in"), ("Ada sits on the board", "advises"), ("Ada formerly advises it", "mentions"), ("Ada is CTO of it", "works_at"), ("Ada no longer works at it", "mentions"),
    ("Ada previously worked at it", "mentions"), ("Ada left the town in the hills where she grew up and works at it", "works_at"), ("Ada saw it", "mentions"),
)


@query("verb_links", f"SELECT event_id, CASE WHEN event_type = 'error' THEN 'mentions' ELSE {[k for _, k in SAID]}[event_id % {len(SAID)} + 1] END AS kind FROM events")
def _(spark, d):
    """What events' sentences say of a link; errors stand for media pages."""
    said = F.element_at(F.lit([s for s, _ in SAID]), (F.col("event_id") % len(SAID) + 1).cast("int"))
    kind = N.verb_link(F.concat(said, F.lit(" [[Acme]].")), F.when(F.col("event_type") == "error", "media").otherwise("note"))
    return Tables(spark, d).events.select("event_id", kind.alias("kind"))


@query("like_join", "SELECT t.user_id AS holder, p.slug FROM (SELECT DISTINCT user_id, 'saw widget ' || (user_id % 50) || ' there' AS said FROM events) t JOIN (SELECT slug, split_part(slug, '/', 2) AS last FROM vault WHERE type = 'place') p ON instr(t.said, ' ' || p.last || ' ') > 0", "vault")
def _(spark, d):
    """Texts that hold an entity's last slug segment as words: by the words themselves, so it is an equi-join."""
    from millrace.functions.text import tokens

    t = Tables(spark, d)
    said = t.events.select(F.col("user_id").alias("holder"), F.concat(F.lit("saw widget "), F.col("user_id") % 50, F.lit(" there")).alias("said")).distinct()
    words = said.select("holder", F.explode(F.array_distinct(tokens(F.col("said")))).alias("last"))
    return words.join(t.vault.filter("type = 'place'").select("slug", F.split_part("slug", F.lit("/"), F.lit(2)).alias("last")), "last").select("holder", "slug")


@query("json_array_member", "SELECT event_id FROM events WHERE list_contains(['k' || (event_id % 3), event_type], 'k1')")
def _(spark, d):
    props = F.to_json(F.struct(F.array(F.concat(F.lit("k"), F.col("event_id") % 3), "event_type").alias("who")))
    who = F.from_json(F.get_json_object(props, "$.who"), "array<string>")
    return Tables(spark, d).events.filter(F.array_contains(who, "k1")).select("event_id")


@query("day_in_zone", "SELECT event_id, CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Tokyo' AS DATE) AS day FROM events")
def _(spark, d):
    return Tables(spark, d).events.select("event_id", N.day_in_zone(F.col("ts").cast("timestamp"), "Asia/Tokyo").alias("day"))


@query("embedding_signature", "SELECT DISTINCT 'm' || label || ':' || len(embedding) AS signature FROM embeddings")
def _(spark, d):
    return Tables(spark, d).embeddings.select(N.embedding_signature(F.concat(F.lit("m"), "label"), F.size("embedding")).alias("signature")).distinct()


@query("body_window", "SELECT doc_id, md5(substr(text, 101, 200)) AS digest, CASE WHEN length(text) > 300 THEN 300 END AS next FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    w = Tables(spark, d).documents.filter("text is not null").select("doc_id", N.body_window(F.col("text"), 100, 200).alias("w"))
    return w.select("doc_id", F.md5("w.window").alias("digest"), "w.next")


@query("identifier_probe", "SELECT doc_id AS id FROM documents WHERE list_contains(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), 'mail2')")
def _(spark, d):
    from millrace.operators.search import identifiers, search_all

    return search_all(Tables(spark, d).documents, identifiers("who wrote from mail2, and where?")).select("id")
