"""Dropping documents by id without shuffling the texts of those that stay."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.bytewords import U, bitmap, marked
from millrace.llm.columns import free
from millrace.llm.stash import stash


def keyed(docs: DataFrame, doc_id: str = "doc_id") -> tuple[DataFrame, str, bool]:
    """docs with a key column, its name, and whether any id is null. A key is never null and the same each time a row is read.

    Without null ids the key is the id. Else it is a struct (anon, id, row), in which each row without an id has a row number
    of its own and comes after all ids. Only rows without an id are written for that.
    """
    (name,) = free(docs, "key")
    lost = docs.filter(F.col(doc_id).isNull())
    if lost.isEmpty():
        return docs.withColumn(name, F.col(doc_id)), name, False
    key = lambda anon, row: F.struct(F.lit(anon).alias("anon"), F.col(doc_id).alias("id"), row.alias("row"))
    lost = stash(lost.withColumn(name, key(True, F.monotonically_increasing_id())))
    return docs.filter(F.col(doc_id).isNotNull()).withColumn(name, key(False, F.lit(0).cast("long"))).unionByName(lost), name, True


def _picked(docs: DataFrame, ids: DataFrame, key: str, max_bits: int):
    """A function of a flag: the rows of docs whose key a bit table of the ids has (True), or lacks (False)."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(ids.select(F.xxhash64(key).alias("h")), "h", max_bits))
    columns, schema = docs.columns, docs.schema
    (name,) = free(docs, "hash")

    def picked(listed: bool) -> DataFrame:
        def run(batches):
            for b in batches:
                hit = marked(shared.value, b.column(len(columns)).to_numpy(zero_copy_only=False).view(U))
                yield pa.RecordBatch.from_arrays(b.columns[: len(columns)], names=columns).filter(pa.array(hit == listed))

        return docs.withColumn(name, F.xxhash64(key)).mapInArrow(run, schema)

    return picked


def without_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id", max_bits: int = 27) -> DataFrame:
    """The rows of docs whose key isn't in ids (one column, `key`); all columns, whatever their names. A null key stays.

    A bit table of the ids, of bounded size, tells most rows that stay where they are read; only the others are shuffled, to be
    compared with the ids themselves. It reads docs twice. A table fuller than planned (beyond 2**max_bits / 16 ids) lets
    more rows through to that shuffle; the result is the same.
    """
    ids = ids.select(key).filter(F.col(key).isNotNull()).distinct()
    picked = _picked(docs, ids, key, max_bits)
    return picked(False).unionByName(picked(True).join(ids, key, "left_anti").select(docs.columns))


def only_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id", max_bits: int = 27) -> DataFrame:
    """The rows of docs whose key is in ids; all columns. As without_ids, but docs are read once."""
    ids = ids.select(key).filter(F.col(key).isNotNull()).distinct()
    return _picked(docs, ids, key, max_bits)(True).join(ids, key, "left_semi").select(docs.columns)
