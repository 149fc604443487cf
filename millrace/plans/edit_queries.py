"""Edits and diffs of page bodies, and chunks of Markdown."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.chunks import chunked
from millrace.functions.edits import edited, patched, unified_diff
from millrace.plans.registry import query
from millrace.sources.relations import Tables


def neighbours(spark, d):
    """Each document's text and that of the next one."""
    t = Tables(spark, d).documents.select("doc_id", F.coalesce("text", F.lit("")).alias("before"))
    return t.join(t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("before").alias("after")), "doc_id")


@query("diff_round_trip", "SELECT a.doc_id, sha256(coalesce(b.text, '')) AS digest, coalesce(a.text, '') = coalesce(b.text, '') AS empty FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1")
def _(spark, d):
    """Every document patched with its diff to the next one is the next one; equal ones have an empty diff."""
    made = neighbours(spark, d).withColumn("diff", unified_diff("before", "after", F.lit("page.md")))
    return made.select("doc_id", F.sha2(patched("before", "diff"), 256).alias("digest"), (F.col("diff") == "").alias("empty"))


@query("line_diff_counts", r"""WITH t AS (SELECT a.doc_id, a.text AS x, a.text || chr(10) || 'one more line' AS y FROM documents a WHERE text IS NOT NULL AND text <> '')
SELECT doc_id, 1 + CAST(x NOT LIKE '%' || chr(10) AS INTEGER) AS added, CAST(x NOT LIKE '%' || chr(10) AS INTEGER) AS removed FROM t""")
def _(spark, d):
    """Lines that a diff adds and removes where each document gets a line more; a last line without an end gets one, so it changes too."""
    t = Tables(spark, d).documents.filter("text is not null and text <> ''").select("doc_id", "text", F.concat("text", F.lit("\none more line")).alias("more"))
    lines = F.slice(F.split(unified_diff("text", "more", F.lit("p")), "\n"), 3, 1_000_000_000)
    n = lambda c: F.size(F.filter(lines, lambda x: x.startswith(c)))
    return t.select("doc_id", n("+").alias("added"), n("-").alias("removed"))


@query("page_edit", r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS body, coalesce(split_part(text, ' ', 3), '') AS old FROM documents),
n AS (SELECT *, CASE WHEN old = '' THEN -1 ELSE len(list_filter(range(1, length(body) + 1), lambda i: substr(body, i, length(old)) = old)) END AS n FROM t)
SELECT doc_id, CASE WHEN n = -1 THEN 'edit_invalid' WHEN n = 0 THEN 'edit_no_match' WHEN n > 1 THEN 'edit_ambiguous_match' END AS error, CASE WHEN n = 0 OR n > 1 THEN n END AS matches,
       sha256(CASE WHEN n = 1 THEN substr(body, 1, instr(body, old) - 1) || '<' || old || '>' || substr(body, instr(body, old) + length(old)) ELSE body END) AS digest FROM n""")
def _(spark, d):
    """The third word of every document put in brackets, where it occurs once."""
    t = Tables(spark, d).documents.select("doc_id", F.coalesce("text", F.lit("")).alias("body"), F.coalesce(F.split_part("text", F.lit(" "), F.lit(3)), F.lit("")).alias("old"))
    edits = F.array(F.struct("old", F.concat(F.lit("<"), "old", F.lit(">")).alias("new")))
    done = t.select("doc_id", edited(F.col("body"), edits).alias("e"))
    return done.select("doc_id", "e.error", "e.matches", F.sha2("e.body", 256).alias("digest"))


@query("markdown_chunks", r"SELECT doc_id, solid <> '' AS text, md5(solid) AS digest, true AS bounded FROM (SELECT doc_id, regexp_replace(text, '\s', '', 'g') AS solid FROM documents WHERE text IS NOT NULL)")
def _(spark, d):
    """Chunks without overlap: nothing but white space is lost, and none is too long."""
    c = Tables(spark, d).documents.filter("text is not null").select("doc_id", chunked(F.col("text"), 1000, 200, 0).alias("c"))
    solid = F.regexp_replace(F.array_join(F.transform("c", lambda x: x["content"]), ""), r"\s", "")
    return c.select("doc_id", (solid != "").alias("text"), F.md5(solid).alias("digest"), F.forall("c", lambda x: F.length(x["content"]) <= 2000).alias("bounded"))
