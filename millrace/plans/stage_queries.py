"""Stages behind fusion, shapes of a result, and what a question asks of the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.entities import normalized_alias
from millrace.operators import ranking as K
from millrace.operators import stages as G
from millrace.operators.graph import session_of
from millrace.plans.registry import query
from millrace.plans.search_queries import FUSED, PAGE, arms, fused, paths
from millrace.sources.relations import Tables

ROUND = "round(score, 12) AS score"
#: A fused result with the part of its id as a page: slug, title, path.
HITS = FUSED + ", hits AS (SELECT f.id, f.score, 'part/' || p_partkey AS slug, p_name AS title, p_brand AS source, p_size, p_container FROM fused f JOIN (SELECT *, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS p_container FROM part) ON p_partkey = f.id)"


def hits(spark, d):
    p = Tables(spark, d).part.select(F.col("p_partkey").alias("id"), F.concat(F.lit("part/"), "p_partkey").alias("slug"), F.col("p_name").alias("title"), F.col("p_brand").alias("source"), "p_size")
    return fused(spark, d).select("id", "score").join(p, "id")


def out(df, *more):
    return df.select("id", F.round("score", 12).alias("score"), *more)


@query("exact_match_boost", "SELECT slug, CASE WHEN slug = 'part/17' OR title = 'supplier#000000003' THEN 1.25 ELSE 1.0 END AS entity, CASE WHEN slug LIKE '%/17' THEN 1.1 ELSE 1.0 END AS event FROM (SELECT slug, lower(trim(title)) AS title FROM vault)", "vault")
def _(spark, d):
    v = Tables(spark, d).vault
    f = lambda q, k: G.exact_boost(q, k, F.col("slug"), F.col("title"))
    return v.select("slug", F.greatest(f(" Part/17", "entity"), f("Supplier#000000003", "entity")).alias("entity"), f("17", "event").alias("event"))


@query("title_boost", "SELECT slug, CASE WHEN position(' ' || title || ' ' IN ' i saw the red widget 1 and red widget 11 there ') > 0 THEN 1.25 ELSE 1.0 END AS f FROM vault WHERE type = 'product'", "vault")
def _(spark, d):
    v = Tables(spark, d).vault.filter("type = 'product'")
    return v.select("slug", G.title_boost(F.lit("I saw the red widget 1, and Red Widget 11 there"), F.col("title")).alias("f"))


@query("salience_multiplier", "SELECT slug, CASE WHEN slug LIKE '%7' THEN greatest(1.3, least(2, greatest(0.5, salience * 3))) ELSE least(2, greatest(0.5, salience * 3)) END AS f FROM vault", "vault")
def _(spark, d):
    v = Tables(spark, d).vault
    return v.select("slug", G.salience_multiplier(F.col("salience") * 3, F.col("slug").like("%7")).alias("f"))


@query("path_boosts", "SELECT doc_id, CASE WHEN source = 'src0' THEN 1.25 ELSE 1.0 END AS chronicle, CASE WHEN source = 'src1' THEN 2.0 ELSE 1.0 END AS truth FROM documents")
def _(spark, d):
    path = F.when(F.col("source") == "src0", F.concat(F.lit("page://life/diary/"), "doc_id")).when(F.col("source") == "src1", F.concat(F.lit("page-truth://"), "doc_id")).otherwise(F.concat(F.lit("notes/"), "doc_id"))
    return Tables(spark, d).documents.select("doc_id", G.chronicle_boost(path, "strong").alias("chronicle"), G.compiled_truth(path).alias("truth"))


@query("alias_boost", HITS + " SELECT id, round(score * CASE WHEN p_size > 25 THEN 1.05 ELSE 1 END, 12) AS score FROM hits", "cosines")
def _(spark, d):
    aliases = Tables(spark, d).part.filter("p_size > 25").select(F.concat(F.lit("part/"), "p_partkey").alias("slug"))
    return out(G.alias_boost(hits(spark, d), aliases))


@query("alias_hop", HITS + ", n AS (SELECT 'part/' || p_partkey AS slug, p_partkey AS id FROM part WHERE p_name = (SELECT min(p_name) FROM part) ORDER BY 1 LIMIT 3), m AS (SELECT slug, id, row_number() OVER (ORDER BY slug) AS k FROM n WHERE slug NOT IN (SELECT slug FROM hits)) SELECT id, round(score * CASE WHEN slug IN (SELECT slug FROM n) THEN 1.1 ELSE 1 END, 12) AS score, slug IN (SELECT slug FROM n) AS alias_hit FROM hits UNION ALL SELECT id, round((SELECT max(score) FROM hits) + 1e-6 * k, 12), true FROM m", "cosines")
def _(spark, d):
    p = Tables(spark, d).part
    aliases = p.select(F.initcap("p_name").alias("alias"), F.concat(F.lit("part/"), "p_partkey").alias("slug"), F.col("p_partkey").alias("id"))
    first = p.agg(F.min("p_name")).first()[0]
    return out(G.alias_hop(hits(spark, d), aliases, f"  {first.upper()} "), "alias_hit")


@query("exact_lookup", HITS + ", x AS (SELECT id FROM hits WHERE slug = 'part/17' OR slug LIKE '%/17') SELECT id, round(CASE WHEN id IN (SELECT id FROM x) AND score < (SELECT max(score) FROM hits) THEN (SELECT max(score) FROM hits) * (1 + 1e-6) ELSE score END, 12) AS score FROM hits", "cosines")
def _(spark, d):
    return out(G.exact_lookup(hits(spark, d), "17"))


@query("feedback_order", HITS + ", w AS (SELECT slug, p_size / 50.0 AS weight FROM hits WHERE p_size % 2 = 0) SELECT id, round(score, 12) AS score, row_number() OVER (ORDER BY score * (1 + 0.2 * (coalesce(weight, 0.5) - 0.5)) DESC, score DESC, id) AS position FROM hits LEFT JOIN w USING (slug)", "cosines")
def _(spark, d):
    w = Tables(spark, d).part.filter("p_size % 2 = 0").select(F.concat(F.lit("part/"), "p_partkey").alias("slug"), (F.col("p_size") / 50.0).alias("weight"))
    return out(G.feedback_order(hits(spark, d), w), "position")


@query("graph_signal_boosts", HITS + """, head AS (SELECT * FROM hits ORDER BY score DESC, id LIMIT 20), e AS (SELECT DISTINCT 'part/' || a.l_partkey AS s, 'part/' || b.l_partkey AS t FROM lineitem a JOIN lineitem b ON a.l_suppkey = b.l_suppkey AND a.l_partkey <> b.l_partkey),
v AS (SELECT t AS slug, count(DISTINCT s) AS votes, count(DISTINCT CASE WHEN x.source <> y.source THEN x.source END) AS sources FROM e JOIN head x ON x.slug = s JOIN head y ON y.slug = t GROUP BY 1),
f AS (SELECT id, CASE WHEN votes >= 2 THEN 1.05 ELSE 1 END * CASE WHEN sources >= 2 THEN 1.1 ELSE 1 END * CASE WHEN row_number() OVER (PARTITION BY p_size % 3 ORDER BY score DESC, id) > 1 THEN 0.95 ELSE 1 END AS f FROM head LEFT JOIN v USING (slug))
SELECT id, round(score * coalesce(f, 1), 12) AS score FROM hits LEFT JOIN f USING (id)""", "cosines")
def _(spark, d):
    t = Tables(spark, d)
    h = hits(spark, d).withColumn("session", session_of(F.concat(F.lit("chat/sessions/"), F.col("p_size") % 3, F.lit("/x"))))
    near = h.select("slug")
    li = t.lineitem.select("l_suppkey", F.concat(F.lit("part/"), "l_partkey").alias("slug")).join(F.broadcast(near), "slug", "left_semi").distinct()  # hits only
    links = li.withColumnRenamed("slug", "source_slug").join(li.withColumnRenamed("slug", "target_slug"), "l_suppkey").select("source_slug", "target_slug").distinct()
    return out(G.graph_signals(h, links))


LABEL = "CASE WHEN p_size > 40 THEN 'exact_title_match' WHEN l.rank IS NOT NULL AND v.rank IS NOT NULL AND place <= 3 THEN 'high_vector_match' WHEN l.rank IS NOT NULL THEN 'keyword_exact' ELSE 'weak_semantic' END"
LABELLED = HITS + f", labelled AS (SELECT id, place AS rank, {LABEL} AS evidence FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS place FROM hits) h LEFT JOIN lex l USING (id) LEFT JOIN vec v USING (id))"


def labelled(spark, d):
    from pyspark.sql import Window

    lex, vec = (a.select("id", F.lit(True).alias(n)) for a, n in zip(arms(spark, d), ("k", "v"), strict=True))
    h = hits(spark, d).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).join(lex, "id", "left").join(vec, "id", "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    return h.select("id", "rank", G.evidence(F.col("p_size") > 40, no(F.col("k")), no(F.col("v")), F.col("rank")).alias("evidence"))


@query("evidence_labels", LABELLED + " SELECT id, rank, evidence, CASE evidence WHEN 'keyword_exact' THEN 'probable' WHEN 'weak_semantic' THEN 'unknown' ELSE 'exists' END AS safety FROM labelled", "cosines")
def _(spark, d):
    return labelled(spark, d).withColumn("safety", G.safety(F.col("evidence")))


@query("confidence_grade", LABELLED + ", h AS (SELECT (SELECT evidence FROM labelled WHERE rank = 1) AS first, (SELECT evidence FROM labelled WHERE rank IN (2, 3) AND evidence <> 'weak_semantic' ORDER BY rank LIMIT 1) AS later) SELECT CASE WHEN first IS NULL THEN 'weak' WHEN first IN ('exact_title_match', 'high_vector_match') THEN 'strong' WHEN first = 'keyword_exact' OR later IS NOT NULL THEN 'moderate' ELSE 'weak' END AS grade, CASE WHEN first IS NULL THEN 'no hits' WHEN first <> 'weak_semantic' THEN 'top hit: ' || first WHEN later IS NOT NULL THEN 'top hit weak, head holds ' || later ELSE 'head holds only weak_semantic hits' END AS reason FROM h", "cosines")
def _(spark, d):
    return G.confidence(labelled(spark, d))


@query("min_trust", "SELECT doc_id FROM documents WHERE source IN ('src0', 'src1')")
def _(spark, d):
    tier = F.when(F.col("source") == "src0", "owner").when(F.col("source") == "src1", "member").when(F.col("source") == "src2", "agent").otherwise("external")
    return Tables(spark, d).documents.filter(G.trusted(tier, "member")).select("doc_id")


@query("adaptive_return", HITS + ", r AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS k FROM hits) SELECT 'factual' AS intent, id FROM r WHERE k <= 2 UNION ALL SELECT 'topic', id FROM r WHERE k <= 6", "cosines")
def _(spark, d):
    h = hits(spark, d)
    one = lambda i: G.adaptive_return(h, i).select(F.lit(i).alias("intent"), "id")
    return one("factual").unionByName(one("topic"))


@query("zero_result_broaden", "SELECT doc_id AS id FROM documents WHERE instr(text, 'the') > 0")
def _(spark, d):
    docs = Tables(spark, d).documents.select(F.col("doc_id").alias("id"), "text")
    none = docs.filter(F.contains("text", F.lit("no text holds this, surely"))).select("id")
    return G.broadened(none, docs.filter(F.contains("text", F.lit("the"))).select("id"))


@query("starvation_probe", "SELECT count(*) FILTER (cos > 0.3) AS hits, (SELECT count(*) FROM (SELECT 1 FROM cosines LIMIT 1000)) AS eligible, count(*) FILTER (cos > 0.3) < least(50, (SELECT count(*) FROM (SELECT 1 FROM cosines LIMIT 1000))) AS starved FROM cosines", "cosines")
def _(spark, d):
    c = Tables(spark, d).cosines
    return G.starvation(c.filter("cos > 0.3"), c, 50)


@query("structural_expand", FUSED + """, a0 AS (SELECT id, score, 0 AS hop FROM fused ORDER BY score DESC, id LIMIT 5), e AS (SELECT id AS a, id + 1 AS b FROM (SELECT vec_id AS id FROM embeddings) UNION SELECT id + 1, id FROM (SELECT vec_id AS id FROM embeddings)),
a1 AS (SELECT b AS id, max(score) AS score, 1 AS hop FROM a0 JOIN e ON a = id WHERE b NOT IN (SELECT id FROM a0) GROUP BY b ORDER BY score DESC, id LIMIT 50),
a2 AS (SELECT b AS id, max(score) AS score, 2 AS hop FROM a1 JOIN e ON a = id WHERE b NOT IN (SELECT id FROM a0 UNION ALL SELECT id FROM a1) GROUP BY b ORDER BY score DESC, id LIMIT 50)
SELECT id, round(score / (1 + hop), 12) AS score, hop FROM (SELECT * FROM a0 UNION ALL SELECT * FROM a1 UNION ALL SELECT * FROM a2) ORDER BY 2 DESC, 1 LIMIT 200""", "cosines")
def _(spark, d):
    anchors = fused(spark, d).orderBy(F.desc("score"), "id").limit(5)
    edges = Tables(spark, d).embeddings.select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"))
    return out(G.structural_expand(anchors, edges), "hop")


@query("relational_recall", "SELECT source_slug AS slug, max(written_at) AS written_at FROM links WHERE type = 'supplies' AND target_slug = 'part/7' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50", "links")
def _(spark, d):
    return G.relational_recall("supplies", "in", "part/7", Tables(spark, d).links)


@query("explained_stages", HITS + " SELECT id, round(score * 1.2 * CASE WHEN p_size > 40 THEN 2 ELSE 1 END, 12) AS score, 1.2 AS curation, CASE WHEN p_size > 40 THEN 2.0 ELSE 1.0 END AS salience FROM hits", "cosines")
def _(spark, d):
    done = G.explained(hits(spark, d), [("curation", lambda r: F.lit(1.2)), ("salience", lambda r: G.salience_multiplier(F.when(F.col("p_size") > 40, 5.0), F.lit(False)))])
    return out(done, F.col("explain")["curation"].alias("curation"), F.col("explain")["salience"].alias("salience"))


@query("search_modes", "SELECT * FROM (VALUES ('conservative', 5), ('balanced', 10), ('tokenmax', 20)) t(mode, wanted), (SELECT count(*) AS hits FROM cosines WHERE cos > 0) WHERE hits > 0", "cosines")
def _(spark, d):
    n = Tables(spark, d).cosines.filter("cos > 0").agg(F.count("*").alias("hits"))
    rows = F.array(*[F.struct(F.lit(k).alias("mode"), F.lit(m.limit).alias("wanted")) for k, m in G.MODES.items()])
    return n.select("hits", F.inline(rows))


@query("page_take_fusion", "WITH p AS (SELECT 'part/' || id AS ref, row_number() OVER (ORDER BY cos DESC, id) AS rank FROM cosines ORDER BY cos DESC, id LIMIT 30), t AS (SELECT 'part/' || (take_key % 200) AS ref, min(k) AS rank FROM (SELECT take_key, row_number() OVER (ORDER BY weight DESC, take_key) AS k FROM takes ORDER BY weight DESC, take_key LIMIT 30) GROUP BY 1) SELECT ref AS id, round(sum(1 / (60.0 + rank)), 12) AS score FROM (SELECT * FROM p UNION ALL SELECT * FROM t) GROUP BY 1", "cosines takes")
def _(spark, d):
    t = Tables(spark, d)
    pages = K.arm(t.cosines.select("id", "cos"), [F.desc("cos"), F.asc("id")], 30, "pages").withColumn("id", F.concat(F.lit("part/"), "id"))
    takes = K.arm(t.takes.select(F.col("take_key").alias("id"), "weight"), [F.desc("weight"), F.asc("id")], 30, "takes")
    takes = takes.groupBy(F.concat(F.lit("part/"), F.col("id") % 200).alias("id"), "arm").agg(F.min("rank").alias("rank"))
    return out(K.rrf([pages, takes.select("id", "rank", "arm")]))


@query("stage_pipeline", FUSED + f", h AS (SELECT id, score * CASE WHEN starts_with(p, 'media/articles/') THEN 1.1 WHEN starts_with(p, 'media/x/') THEN 0.7 WHEN starts_with(p, 'archive/') THEN 0.5 WHEN starts_with(p, 'people/') THEN 1.2 WHEN starts_with(p, 'daily/') THEN 0.8 ELSE 1.0 END * 0.8 AS score, source FROM fused JOIN (SELECT doc_id AS id, source, {PAGE} AS p FROM documents d) USING (id)) SELECT id, round(score, 12) AS score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, id) AS k FROM h) WHERE k <= 2", "cosines")
def _(spark, d):
    """Curation, source and recency factors over a fused result, capped by source: one plan from a list of stages."""
    from millrace.functions.text import prefix_boost

    docs = paths(Tables(spark, d).documents).select(F.col("doc_id").alias("id"), "path", "source")
    scale = lambda c: lambda r: G.scaled(r, c)
    stages = [lambda r: r.join(docs, "id"), scale(prefix_boost(F.col("path"), K.CURATION)), scale(K.source_boost(F.col("source"))), lambda r: K.cap_per(r, "source", 2)]
    return out(K.run_stages(fused(spark, d), stages))


@query("normalized_aliases", "SELECT DISTINCT trim(regexp_replace(lower('  ' || replace(p_name, ' ', '   ') || ' '), '\\s+', ' ', 'g')) AS alias FROM part")
def _(spark, d):
    return Tables(spark, d).part.select(normalized_alias(F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit("   ")), F.lit(" "))).alias("alias")).distinct()
