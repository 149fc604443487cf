"""Searches over a written index, its changes, end-to-end answers and nearest vectors under a filter."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.operators import nearest
from millrace.operators import search as S
from millrace.operators.answer import Settings, answer
from millrace.operators.postings import Index
from millrace.plans.registry import query
from millrace.plans.search_queries import PAGE, TOKENS, paths
from millrace.plans.written import written
from millrace.sources.relations import Tables
from millrace.sources.shared import shared_folder


def index(spark, d) -> Index:
    """Postings of the documents with their first two words as titles, written once a session."""
    path = written(spark, d, "index", lambda p: Index(spark, p).create(titled(Tables(spark, d).documents), title="title"))
    return Index(spark, path)


def titled(docs):
    return docs.withColumn("title", F.regexp_extract(F.coalesce("text", F.lit("")), r"^(\S+ \S+)", 1))


ALL = f"SELECT doc_id AS id, round(ln(1 + n1) + ln(1 + n2) + CASE WHEN list_contains(h, 'the') THEN 2.5 * ln(1 + len(list_filter(h, lambda x: x = 'the'))) ELSE 0 END + CASE WHEN list_contains(h, 'from') THEN 2.5 * ln(1 + len(list_filter(h, lambda x: x = 'from'))) ELSE 0 END, 9) AS score FROM (SELECT *, len(list_filter(t, lambda x: x = 'the')) AS n1, len(list_filter(t, lambda x: x = 'from')) AS n2 FROM (SELECT doc_id, {TOKENS} AS t, regexp_extract_all(lower(regexp_extract(text, '^(\\S+ \\S+)', 1)), '[\\p{{L}}\\p{{N}}]+') AS h FROM documents)) WHERE n1 > 0 AND n2 > 0"


@query("index_search_all", ALL)
def _(spark, d):
    return index(spark, d).search_all(["the", "from"])


PHRASE = "SELECT doc_id AS id, len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND t[i + 1] = 'the')) AS score FROM (SELECT doc_id, {t} AS t FROM {docs}) WHERE score > 0"


@query("index_search_phrase", PHRASE.format(t=TOKENS, docs="documents"))
def _(spark, d):
    return index(spark, d).search_phrase(["of", "the"])


CHANGED = "(SELECT doc_id, text FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'of the ' || text FROM documents WHERE doc_id % 3 = 1)"


@query("index_after_changes", PHRASE.format(t=TOKENS, docs=CHANGED))
def _(spark, d):
    """All documents, then a third of them replaced and a third deleted, merged at read."""

    def make(path):
        docs = Tables(spark, d).documents
        one = Index(spark, path).create(docs)
        one.replace(docs.filter("doc_id % 3 = 1").withColumn("text", F.concat(F.lit("of the "), "text")))
        one.delete(docs.filter("doc_id % 3 = 2"), "doc_id")

    return Index(spark, written(spark, d, "changed-index", make)).search_phrase(["of", "the"])


@query("index_compacted", f"SELECT term, count(*) AS documents, CAST(sum(tf) AS BIGINT) AS n FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM {CHANGED}) GROUP BY ALL) GROUP BY term")
def _(spark, d):
    """The terms of an index after changes and compaction."""
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    docs = Tables(spark, d).documents
    one = Index(spark, path).create(docs)
    one.replace(docs.filter("doc_id % 3 = 1").withColumn("text", F.concat(F.lit("of the "), "text")))
    one.delete(docs.filter("doc_id % 3 = 2"), "doc_id")
    one.compact()
    return one.postings().groupBy("term").agg(F.count("*").alias("documents"), F.sum("tf").alias("n"))


def vault(spark, d):
    docs = paths(titled(Tables(spark, d).documents))
    return docs.select(F.col("doc_id").alias("id"), F.col("path").alias("slug"), "title", "path", "source", F.col("lang").alias("type"), (F.col("n_chars") / 20000).alias("salience"), F.col("text").alias("content"))


ANSWER = rf"""WITH t AS (SELECT doc_id AS id, {TOKENS} AS t, source, lang, coalesce(n_chars, 0) / 20000 AS salience, {PAGE} AS path, regexp_extract(coalesce(text, ''), '^(\S+ \S+)', 1) AS title FROM documents d),
u AS (SELECT *, regexp_extract_all(lower(title), '[\p{{L}}\p{{N}}]+') AS h FROM t),
f AS (SELECT id, ln(1 + len(list_filter(t, lambda x: x = 'and'))) + ln(1 + len(list_filter(t, lambda x: x = 'the'))) + 2.5 * ln(1 + len(list_filter(h, lambda x: x = 'and'))) + 2.5 * ln(1 + len(list_filter(h, lambda x: x = 'the'))) AS score FROM u WHERE list_contains(t, 'and') AND list_contains(t, 'the')),
arm AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM f ORDER BY round(score, 9) DESC, id LIMIT 60),
ph AS (SELECT id, len(list_filter(range(1, len(t)), lambda i: t[i] = 'and' AND t[i + 1] = 'the')) AS score FROM u WHERE score > 0),
arm2 AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM ph ORDER BY score DESC, id LIMIT 60),
arm3 AS (SELECT id, row_number() OVER (ORDER BY id) AS rank FROM u WHERE h = ['and', 'the'] ORDER BY id LIMIT 60),
arm4 AS (SELECT id, row_number() OVER (ORDER BY cos DESC, id) AS rank FROM cosines ORDER BY cos DESC, id LIMIT 60),
fu AS (SELECT id, sum(1 / (60.0 + rank)) AS score FROM (SELECT * FROM arm UNION ALL SELECT * FROM arm2 UNION ALL SELECT * FROM arm3 UNION ALL SELECT * FROM arm4) GROUP BY id),
st AS (SELECT u.id, path, source, score * CASE WHEN starts_with(path, 'people/') THEN 1.2 WHEN starts_with(path, 'media/x/') THEN 0.7 WHEN starts_with(path, 'media/articles/') THEN 1.1 WHEN starts_with(path, 'daily/') THEN 0.8 WHEN starts_with(path, 'archive/') THEN 0.5 ELSE 1 END
         * (1 + 0.15 * ln(1 + salience)) * CASE WHEN h = ['and', 'the'] THEN 1.25 ELSE 1 END AS score FROM fu JOIN u USING (id)),
capped AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, id) AS k FROM st)
SELECT id, path AS slug, round(score, 9) AS score FROM capped WHERE k <= 2 ORDER BY capped.score DESC, id LIMIT 10"""


@query("answer", ANSWER, "cosines")
def _(spark, d):
    """A quoted question through keyword, phrase, title and vector arms, fused, scaled and capped."""
    t = Tables(spark, d)
    found = answer(index(spark, d), vault(spark, d), '"and the"', vectors=t.embeddings, query=t.query_vector, settings=Settings(per_source=2))
    return found.select("id", "slug", F.round("score", 9).alias("score"))


@query("vector_knn_filtered")
def _(spark, d):
    """The five nearest vectors of one label for the stated query set, and how many cells each query read. Tests measure recall."""
    v = Tables(spark, d).embeddings
    cells = S.centres(v)
    return nearest.nearest_filtered(nearest.cell_index(v, cells, columns=["label"]), v.filter("vec_id % 20 = 0"), cells, 5, F.col("label") == 3).select("query", "id", F.round("score", 9).alias("score"), "rank", "cells")
