"""The written index and its changes, filtered nearest vectors, answers."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import nearest, search
from millrace.operators.answer import Settings, answer, words
from millrace.operators.postings import Index

DOCS = [(1, "the red fox and the hound"), (2, "A red, red hound"), (3, None), (4, ""), (5, "fox hound fox hound"), (6, "Ünïcode fox É"), (7, "the " * 300 + "end")]


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


def everything(index):
    return [rows(index.postings()), rows(index.search_all(["fox", "hound"])), rows(index.search_any(["fox", "end", "the"])), rows(index.search_near(["fox", "hound"])), rows(index.search_phrase(["fox", "hound"]))]


def test_changes_equal_a_fresh_index(spark, docs, tmp_path):
    changed = Index(spark, f"{tmp_path}/a", 4).create(docs)
    new = spark.createDataFrame([(2, "no more of that fox"), (9, "fox hound"), (5, None)], "doc_id long, text string")
    changed.replace(new)
    changed.delete(spark.createDataFrame([(1,), (77,), (None,)], "id long"))
    changed.replace(spark.createDataFrame([(1, "back again, fox")], "doc_id long, text string"))
    changed.replace(spark.createDataFrame([(9, "fox fox")], "doc_id long, text string"))
    after = docs.filter("doc_id not in (1, 2, 5)").unionByName(new.filter("doc_id in (2, 5)")).unionByName(spark.createDataFrame([(1, "back again, fox"), (9, "fox fox")], "doc_id long, text string"))
    fresh = Index(spark, f"{tmp_path}/b", 4).create(after)
    assert len(changed.live()[1]) == 5
    assert everything(changed) == everything(fresh)
    assert changed.compact() and len(changed.live()[1]) == 1 and not changed.compact()
    assert everything(changed) == everything(fresh)


def test_a_lost_change_is_not_read_and_a_taken_version_fails(spark, docs, tmp_path):
    index = Index(spark, f"{tmp_path}/a", 4).create(docs)
    before = everything(index)
    index._segment(index._postings(docs, "doc_id", "text", None), docs.select(F.col("doc_id").alias("id")))  # written, never published
    assert everything(index) == before
    with pytest.raises(Exception, match="(?i)exists"):
        index._publish(1, [])
    empty = Index(spark, f"{tmp_path}/b", 4).create(docs.limit(0))
    assert empty.search_all(["fox"]).collect() == [] and empty.postings().collect() == []


def test_titles_weigh_more(spark, tmp_path):
    pages = spark.createDataFrame([(1, "fox", "body"), (2, "other", "fox"), (3, None, None)], "doc_id long, title string, text string")
    got = Index(spark, f"{tmp_path}/a").create(pages, title="title").search_all(["fox"]).orderBy(F.desc("score")).collect()
    assert [r.id for r in got] == [1, 2] and got[0].score == pytest.approx(2.5 * got[1].score)


def test_a_search_reads_the_folders_and_row_groups_of_its_terms(spark, docs, tmp_path):
    index = Index(spark, f"{tmp_path}/a", 64).create(docs)
    df = index.search_all(["fox"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0] and "EqualTo(term,fox)" in plan
    df.collect()
    files = {f for f in df.inputFiles()}
    assert files


def test_a_hot_term_is_dealt_over_several_files(spark, tmp_path):
    hot = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the only word "), F.col("id")).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = Index(spark, f"{tmp_path}/a", 2).create(hot)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    per = index.spark.read.parquet(f"{tmp_path}/a/postings").filter("term = 'the'").groupBy(F.input_file_name()).count().collect()
    assert len(per) >= 2 and sum(r["count"] for r in per) == 4000


def cloud(n, seed=0, dims=16, kinds=40):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(kinds, dims))
    return [(i, (centres[i % kinds] + rng.normal(size=dims) * 0.9).tolist(), int(rng.integers(0, 100))) for i in range(n)]


def test_filtered_nearest_vectors(spark):
    rows_ = cloud(6000)
    v = spark.createDataFrame(rows_, "vec_id long, embedding array<double>, label int").repartition(4)
    cells = search.centres(v, cells=48)
    index = nearest.cell_index(v, cells, columns=["label"]).cache()
    queries = v.filter("vec_id % 20 = 0")
    got = nearest.nearest_filtered(index, queries, cells, 10, F.col("label") == 7).collect()
    m = np.array([r[1] for r in rows_])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    passed = np.array([r[0] for r in rows_ if r[2] == 7])
    hit = total = 0
    by = {}
    for r in got:
        by.setdefault(r.query, []).append(r)
    for q in range(0, 6000, 20):
        mine = passed[passed != q]
        best = set(mine[np.argsort(-(m[mine] @ m[q]), kind="stable")[:10]].tolist())
        assert len(by[q]) == 10 and sorted(r.rank for r in by[q]) == list(range(1, 11))
        hit += len(best & {r.id for r in by[q]})
        total += 10
    assert hit / total >= 0.9
    read = [r[0].cells for r in by.values()]
    assert min(read) < 48 and max(read) <= 48
    # A filter that all rows pass reads few cells, one that few pass all of them, and one that none passes gives nothing.
    assert max(r.cells for r in nearest.nearest_filtered(index, queries, cells, 10).collect()) <= 8
    few = nearest.nearest_filtered(index, queries, cells, 10, F.col("id") < 5).collect()
    assert {r.cells for r in few} == {48} and {sum(r.query == q for r in few) for q in range(20, 100, 20)} == {5}
    assert nearest.nearest_filtered(index, queries, cells, 10, F.col("label") == 1000).collect() == []
    assert nearest.nearest_filtered(index, queries.limit(0), cells, 10).collect() == []


def test_answers(spark, tmp_path):
    pages = spark.createDataFrame(
        [(1, "people/ann-lee", "Ann Lee", "people/ann-lee", "a", "person", 0.9, "Ann Lee met the board about ticket AB-1234"), (2, "notes/1", "Minutes", "notes/1", "a", "note", 0.0, "Ann spoke, then Lee spoke; the board listened"), (3, "archive/2", "Old", "archive/2", "b", "note", 0.0, "ann lee board board board"), (4, "notes/3", None, "notes/3", "b", "note", None, None)],
        "id long, slug string, title string, path string, source string, type string, salience double, content string",
    )
    index = Index(spark, f"{tmp_path}/a").create(pages, "id", "content", "title")
    links = spark.createDataFrame([("notes/1", "people/ann-lee", "knows", 1.0)], "source_slug string, target_slug string, type string, confidence double")
    found = answer(index, pages, "Ann Lee", links=links).collect()
    assert [r.id for r in found] == [1, 2, 3] and found[0].explain["title"] == 1.25 and found[0].explain["curation"] == 1.2 and found[2].explain["curation"] == 0.5
    assert "title" in found[0].arms and "relaxed" in found[0].arms
    assert [r.id for r in answer(index, pages, '"ann lee"', settings=Settings(title=False)).collect()][0] == 1
    assert "identifier" in answer(index, pages, "what was ticket AB-1234 about").collect()[0].arms
    assert len(answer(index, pages, "board", settings=Settings(per_source=1)).collect()) == 2
    assert answer(index, pages, "...").collect() == [] and answer(index, pages, "zebra").collect() == []
    assert words("The the É-x") == ["the", "é", "x"]


def test_postings_are_made_without_a_shuffle(spark, docs):
    posts = search.document_postings(docs, "doc_id", "text", None)
    assert "Exchange" not in posts._jdf.queryExecution().executedPlan().toString()
    want = []
    for i, text in DOCS:
        t = words_of(text)
        want += [(w, i, "body", t.count(w), [k for k, x in enumerate(t) if x == w]) for w in set(t)]
    assert sorted(map(tuple, posts.collect())) == sorted(want)


def words_of(text):
    import regex

    return regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())


@pytest.mark.parametrize("phrase", [["fox", "hound"], ["red", "red"], ["the"], ["the", "the", "the"], ["hound", "zebra"]])
def test_phrases_meet_within_documents(spark, docs, tmp_path, phrase):
    found = Index(spark, f"{tmp_path}/a", 4).create(docs).search_phrase(phrase)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange") == 1
    n = {i: sum(words_of(t)[k : k + len(phrase)] == phrase for k in range(len(words_of(t)))) for i, t in DOCS}
    assert {r.id: r.score for r in found.collect()} == {i: k for i, k in n.items() if k}


def test_a_bucket_is_dealt_over_several_tasks(spark, tmp_path):
    hot = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the only word "), F.col("id")).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        search.write_index(hot, f"{tmp_path}/a", buckets=1)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(spark.read.parquet(f"{tmp_path}/a").filter("term = 'the'").select(F.input_file_name()).distinct().collect()) >= 2
