"""From raw documents to a training mixture: STAGES in order, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir), is written as Parquet and reread as the next one's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.decontam import contamination
from millrace.llm.dropping import keyed, only_ids, without_ids
from millrace.llm.mixing import Target, mix
from millrace.llm.neardup import near_duplicates
from millrace.llm.quality import keep_good, train
from millrace.llm.secrets import redact
from millrace.llm.stash import small_batches, stash

#: Most passes that the mixture makes over any source.
REPEATS = 2.0


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Each row is judged by its whole text alone: equal texts, repeated rows and rows without an id fare alike; a null, empty or
    wordless text is judged by the bias. An empty table stays empty. Without labels all rows get one score.
    """
    small_batches(spark)
    return keep_good(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of least id, of each group of near-duplicates (five-word shingles, similarity 0.8).

    Rows that repeat an id are one document, of which one row stays; rows without an id are a document each, kept if their group has no
    id (of several, one). Documents without words are in no group and all stay. An empty table stays empty.
    """
    small_batches(spark)
    columns = docs.columns
    docs, key, _ = keyed(docs)
    found = stash(near_duplicates(docs, doc_id=key, shingle=5, percent=80).withColumnRenamed("doc_id", key))
    # Rows that repeat an id: few, so only their texts are shuffled.
    again = stash(found.groupBy(key).agg(F.count("*").alias("n"), F.bool_or("kept").alias("kept")).filter("n > 1"))
    rest = without_ids(docs, stash(found.filter("not kept").select(key).unionByName(again.select(key))), key)
    return rest.unionByName(only_ids(docs, again.filter("kept"), key).dropDuplicates([key])).select(columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Rows that repeat an id go together; rows without an id are judged each on its own. A null, empty or wordless text stays.
    An empty table stays empty, and so does a table beside an empty benchmark stay whole.
    """
    small_batches(spark)
    columns = docs.columns
    docs, key, _ = keyed(docs)
    hit = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), doc_id=key).filter("contaminated")
    return without_ids(docs, stash(hit.select(F.col("doc_id").alias(key))), key).select(columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark, and their lengths afterwards (where docs have n_chars).

    Each row is worked on alone: repeated rows stay, null and empty texts stay as they are (a null text's length is null).
    """
    out = redact(docs)
    return (out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the tempered mixture of sources has it, at least once, and its place in it.

    A null source is a source; a null or empty text counts one token; rows without an id are ordered, and cut, alike; repeated rows
    each get theirs. Columns mix_pass, mix_key and mix_block of an earlier mixture are replaced.
    """
    return mix(docs, Target(repeats=REPEATS))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secrets", secrets), ("mixture", mixture)]

#: Classifier and near-duplicates can't be stated in SQL: tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir))
    return docs
