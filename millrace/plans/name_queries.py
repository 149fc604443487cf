"""Names: similarity joins, mentions resolved to pages, names found in prose."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import gazetteer, slugs
from millrace.plans.registry import query
from millrace.sources.relations import Tables


def _grams(key: str, text: str, source: str) -> str:
    """(key, g): the distinct trigrams of a text, in SQL."""
    return rf"SELECT DISTINCT {key} AS key, unnest(list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))) AS g FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+')) AS w FROM {source})"


LIKE = "SELECT l.key AS a, r.key AS b, count(*) / (any_value(ln.n) + any_value(rn.n) - count(*)) AS s FROM {l} l JOIN {r} r ON l.g = r.g JOIN (SELECT key, count(*) AS n FROM {l} GROUP BY key) ln ON ln.key = l.key JOIN (SELECT key, count(*) AS n FROM {r} GROUP BY key) rn ON rn.key = r.key GROUP BY ALL"


@query("trigram_join", f"WITH l AS ({_grams('slug', 'title', '''(SELECT slug, title || ' a' AS title FROM vault)''')}), r AS ({_grams('slug', 'title', 'vault')}), s AS ({LIKE.format(l='l', r='r')}) SELECT a AS \"left\", b AS \"right\", round(s, 9) AS similarity FROM s WHERE s >= 0.8 AND split_part(a, '/', 1) = 'part'", "vault")
def _(spark, d):
    """Titles of products with a letter added, to the titles of all pages."""
    v = Tables(spark, d).vault.select(F.col("slug").alias("key"), F.col("title").alias("text"))
    found = slugs.similar(v.filter("key like 'part/%'").withColumn("text", F.concat("text", F.lit(" a"))), v, 0.8)
    return found.select("left", "right", F.round("similarity", 9).alias("similarity"))


RESOLVED = f"""WITH live AS (SELECT * FROM vault WHERE NOT deleted),
m AS (SELECT 'PART/' || p_partkey AS name, 'part/' || p_partkey AS target FROM part UNION ALL SELECT p_name || ' ' || p_partkey || ' a', replace(p_name, ' ', '-') || '-' || p_partkey || '-a' FROM part UNION ALL SELECT DISTINCT n_name, lower(replace(n_name, ' ', '-')) FROM nation),
nt AS ({_grams('name', 'name', 'm')}), ns AS ({_grams('name', 'target', 'm')}),
pt AS ({_grams('slug', 'title', 'live')}), ps AS ({_grams('slug', 'tail', "(SELECT slug, split_part(slug, '/', 2) AS tail FROM live)")}),
s1 AS ({LIKE.format(l='nt', r='pt')}), s2 AS ({LIKE.format(l='ns', r='ps')}),
s AS (SELECT a, b, max(s) AS s FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2) WHERE s >= 0.5 GROUP BY a, b),
k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS k FROM s),
best AS (SELECT a, arg_min(b, k) AS b, max(s) AS top, max(s) FILTER (k = 2) AS second FROM k WHERE k <= 2 GROUP BY a)
SELECT name, 'x' AS source_slug, CASE WHEN l.slug IS NOT NULL THEN l.slug WHEN top >= 0.7 AND (second IS NULL OR top - second >= 0.1) THEN best.b ELSE target END AS slug,
       CASE WHEN l.slug IS NOT NULL THEN 'exact' WHEN top >= 0.7 AND (second IS NULL OR top - second >= 0.1) THEN 'trgm' ELSE 'slugify' END AS stage
FROM m LEFT JOIN live l ON l.slug = target LEFT JOIN best ON best.a = name"""


@query("canonical_mentions", RESOLVED, "vault")
def _(spark, d):
    """Slugs in capitals, titles of products with a letter added, and titles of places, resolved against all pages."""
    t = Tables(spark, d)
    m = t.part.select(F.explode(F.array(F.concat(F.lit("PART/"), "p_partkey"), F.concat_ws(" ", "p_name", "p_partkey", F.lit("a")))).alias("name"))
    m = m.unionByName(t.nation.select(F.col("n_name").alias("name"))).withColumn("source_slug", F.lit("x"))
    return slugs.canonical(m, t.vault)


ATOMS = r"list_transform(regexp_extract_all({}, '\s*(?:[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s])'), lambda a: regexp_replace(a, '^\s+', ' '))"
MENTIONS = rf"""WITH RECURSIVE d AS (SELECT doc_id, {ATOMS.format('text')} AS t FROM documents WHERE text IS NOT NULL),
n AS (SELECT phrase, min(slug) AS slug FROM (SELECT doc_id AS slug, lower(trim(array_to_string(list_slice(t, 1, 1 + doc_id % 5), ''))) AS phrase FROM d) WHERE length(phrase) BETWEEN 4 AND 200 AND regexp_matches(phrase, '\p{{L}}') GROUP BY phrase HAVING count(DISTINCT slug) = 1),
p AS (SELECT phrase, slug, len({ATOMS.format('phrase')}) AS n, ({ATOMS.format('phrase')})[1] AS first FROM n),
a AS (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM d),
h AS (SELECT doc_id, i, max(n) AS n, arg_max(slug, n) AS slug, any_value(regexp_matches(ltrim(t[i]), '^\p{{Ll}}')) AS small FROM a JOIN p ON p.first = ltrim(lower(t[i])) AND i + n - 1 <= len(t) AND lower(ltrim(array_to_string(list_slice(t, i, i + n - 1), ''))) = phrase
      WHERE NOT (i > 1 AND NOT starts_with(t[i], ' ') AND regexp_matches(ltrim(t[i - 1]), '^[\p{{L}}\p{{N}}_]')) AND (regexp_matches(ltrim(t[i + n - 1]), '^[\p{{L}}\p{{N}}_]') OR NOT regexp_matches(coalesce(t[i + n], ''), '^[\p{{L}}\p{{N}}_]')) GROUP BY doc_id, i),
g AS (SELECT doc_id, i, n, slug, small FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM h) WHERE k = 1
      UNION ALL SELECT doc_id, i, n, slug, small FROM (SELECT h.*, row_number() OVER (PARTITION BY h.doc_id ORDER BY h.i) AS k FROM g JOIN h ON h.doc_id = g.doc_id AND h.i >= g.i + g.n) WHERE k = 1)
SELECT doc_id AS id, 'doc/' || slug AS slug, min(i) - 1 AS at FROM g WHERE NOT small AND slug <> doc_id GROUP BY ALL"""


@query("gazetteer_mentions", MENTIONS)
def _(spark, d):
    """The first one to five atoms of each document are a name; every document is searched for the names of the others."""
    docs = Tables(spark, d).documents.withColumn("slug", F.concat(F.lit("doc/"), "doc_id"))
    first = F.slice(gazetteer.atoms(F.col("text")), F.lit(1), (1 + F.col("doc_id") % 5).cast("int"))
    pages = docs.filter("text is not null").select("slug", F.array_join(first, "").alias("title"), F.lit("person").alias("type"), F.lit(False).alias("deleted"))
    return gazetteer.mentions(docs, gazetteer.entries(pages), own="slug")
