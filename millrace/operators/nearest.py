"""Nearest vectors under a filter: cells are read in each query's order until enough rows pass."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.vectors import cosine
from millrace.sources.shared import settled


def cell_index(vectors: DataFrame, cells: Sequence[Sequence[float]], row_id: str = "vec_id", vector: str = "embedding", columns: Sequence[str] = ()) -> DataFrame:
    """(id, e, cell, *columns): every vector in the cell whose centre is most like it, with columns that filters ask for."""
    ordered = cell_order(vectors.select(row_id, vector, *columns), cells, row_id, vector, 1, columns)
    return ordered.select("id", "e", "cell", *columns)


def cell_order(rows: DataFrame, cells: Sequence[Sequence[float]], row_id: str = "vec_id", vector: str = "embedding", most: int | None = None, columns: Sequence[str] = ()) -> DataFrame:
    """(id, e, cell, nth, *columns): the cells of each vector by likeness of their centres, the first `most` or all; nth from 0."""
    c = np.array(cells, np.float64).reshape(len(cells), -1) if len(cells) else np.zeros((0, 0))
    k = len(c) if most is None else min(most, len(c))

    def run(batches):
        for b in batches:
            m = np.array(b.column(1).to_pylist(), float).reshape(b.num_rows, -1)
            top = np.argsort(-(m @ c.T), axis=1, kind="stable")[:, :k] if k and b.num_rows else np.zeros((b.num_rows, 0), int)
            at = pa.array(np.repeat(np.arange(b.num_rows), top.shape[1]))
            nth = np.tile(np.arange(top.shape[1], dtype=np.int32), b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(top.ravel().astype(np.int32)), pa.array(nth), *(b.column(2 + i).take(at) for i in range(len(columns)))], ["id", "e", "cell", "nth", *columns])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    more = "".join(f", {x} {kinds[x]}" for x in columns)
    return rows.select(F.col(row_id).alias("id"), F.col(vector).cast("array<double>").alias("e"), *columns).mapInArrow(run, f"id {kinds[row_id]}, e array<double>, cell int, nth int{more}")


def nearest_filtered(index: DataFrame, queries: DataFrame, cells: Sequence[Sequence[float]], n: int, keep: Column | None = None, first: int = 2, spare: int = 4, row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The n nearest rows that pass a filter, for each query: query, id, score, rank, cells (how many the query read).

    A query reads the `first` cells most like it, then as many again, and so on, until spare * n of the rows it has read pass, or no
    cell is left; so a filter that few rows pass costs more cells instead of rows. A round reads the cells of those queries alone that
    still lack rows, by a join on cells; its best rows are written, so no round is done twice. Fewer than n rows come
    only where fewer pass at all. A query isn't its own neighbour.
    """
    rows = index if keep is None else index.filter(keep)
    order = settled(cell_order(queries, cells, row_id, vector).select(F.col("id").alias("query"), F.col("e").alias("u"), "cell", "nth"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    open_, found, low, high = order.select("query").distinct(), None, 0, first
    done: DataFrame | None = None
    while True:
        mine = order.filter((F.col("nth") >= low) & (F.col("nth") < high)).join(open_, "query")
        met = mine.join(rows.select("id", "e", F.col("cell").alias("at")), F.col("cell") == F.col("at")).filter(F.col("query") != F.col("id"))
        met = met.select("query", "id", cosine("u", "e").alias("score")).withColumn("passed", F.count("*").over(Window.partitionBy("query")))
        best = met.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("query", "id", "score", "passed")
        # What a query has read before counts as well.
        if found is not None:
            before = found.groupBy("query").agg(F.max("passed").alias("before"))
            best = best.join(before, "query", "left").select("query", "id", "score", (F.col("passed") + F.coalesce("before", F.lit(0))).alias("passed"))
            best = found.unionByName(best)
        found = settled(best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).withColumn("passed", F.max("passed").over(Window.partitionBy("query"))).select("query", "id", "score", "passed"))
        last = high >= len(cells)
        enough = found.filter(F.col("passed") >= spare * n).select("query").distinct()
        closed = settled((open_ if last else open_.join(enough, "query")).withColumn("cells", F.lit(min(high, len(cells)))))
        done = closed if done is None else done.unionByName(closed)
        open_ = open_.join(closed.select("query"), "query", "left_anti")
        if last or open_.isEmpty():
            break
        open_, low, high = settled(open_), high, 2 * high
    return found.withColumn("rank", F.row_number().over(w)).join(done, "query").select("query", "id", "score", "rank", "cells")
