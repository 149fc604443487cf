"""Structured Streaming: incremental ingest, windowed roll-ups with late data, deduplication, keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def file_stream(spark: SparkSession, folder: str, schema: str, files: int = 100, format: str = "parquet") -> DataFrame:
    """A folder as a stream: at most `files` new files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(format).load(folder)


def windowed_counts(events: DataFrame, ts: str, size: str, slide: str | None, keys: list[str], late: str) -> DataFrame:
    """Counts and sums of `value` in tumbling or sliding windows; rows later than the watermark are left out."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.withWatermark(ts, late).groupBy(w, *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("window.start", "window.end", *keys, "n", "total")


def sessions(events: DataFrame, ts: str, gap: str, key: str, late: str) -> DataFrame:
    """Sessions of a key that a gap in time ends."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n")).select("session_window.start", "session_window.end", key, "n")


def without_repeats(events: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def upsert_into(path: str, keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: each batch's newest row of a key becomes that key's file of the day, idempotent on a replayed batch."""

    def write(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in batch.columns if c not in keys and c != order])).alias("r")).select(*keys, "r.*")
        newest.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def current(spark: SparkSession, path: str, keys: list[str], order: str) -> DataFrame:
    """The newest row of each key over all batches that upsert_into wrote."""
    rows = spark.read.parquet(path)
    best = rows.groupBy(*keys).agg(F.max(F.struct(order, "batch", *[c for c in rows.columns if c not in keys and c not in (order, "batch")])).alias("r"))
    return best.select(*keys, "r.*")


def ingest(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: str) -> DataStreamWriter:
    return stream.writeStream.foreachBatch(upsert_into(path, keys, order)).option("checkpointLocation", checkpoint)


def loop_states(turns: DataFrame, late: str = "1 hour", wait: str = "1 day") -> DataFrame:
    """Keyed state per thread: open while the last turn is the user's, closed by an answer, expired after `wait` of event time.

    turns: thread, at, role. Gives thread, state, at, each time a thread's state changes.
    """

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        was = state.get[0] if state.exists else "new"
        if state.hasTimedOut:
            state.remove()
            if was == "open":
                yield pd.DataFrame({"thread": [key[0]], "state": ["expired"], "at": [pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")]})
            return
        last = pd.concat(list(rows)).sort_values("at").iloc[-1]
        now = "open" if last["role"] == "user" else "closed"
        state.update((now,))
        state.setTimeoutTimestamp(int(last["at"].timestamp() * 1000) + int(pd.Timedelta(wait).total_seconds() * 1000))
        if now != was:
            yield pd.DataFrame({"thread": [key[0]], "state": [now], "at": [last["at"]]})

    keyed = turns.withWatermark("at", late).groupBy("thread")
    return keyed.applyInPandasWithState(step, "thread long, state string, at timestamp", "state string", "append", GroupStateTimeout.EventTimeTimeout)


def delete_ratio_held(known: DataFrame, listed: DataFrame, key: str, most: float = 0.05) -> bool:
    """Whether a listing lacks more than `most` of the known keys: such a batch's deletions are held back."""
    n = known.count()
    gone = known.select(key).join(listed.select(key), key, "left_anti").count()
    return n > 0 and gone / n > most


def released_deletions(deletions: DataFrame, sightings: DataFrame, hold: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """Deletions that a source reported and that hold: (source, id, deleted_at) that no sighting of the same item contradicts.

    deletions: source, id, deleted_at; sightings: source, id, seen_at. A source that is out lists nothing and so seems to have deleted
    everything, until it is back. Each deletion is held for `hold` of event time in a stream-stream outer join with the sightings: one of the
    item at or after the deletion and within the hold withdraws it, else it is released once the watermarks of both streams have
    passed. Rows up to `late` out of order count, later ones are left out; repeated deletions and sightings count once.
    """
    gone = deletions.withWatermark("deleted_at", late).dropDuplicatesWithinWatermark(["source", "id", "deleted_at"])
    seen = sightings.select(F.col("source").alias("s"), F.col("id").alias("i"), "seen_at").withWatermark("seen_at", late)
    again = (F.col("source") == F.col("s")) & (F.col("id") == F.col("i")) & (F.col("seen_at") >= F.col("deleted_at")) & (F.col("seen_at") <= F.col("deleted_at") + F.expr(f"interval {hold}"))
    return gone.join(seen, again, "leftOuter").filter(F.col("seen_at").isNull()).select("source", "id", "deleted_at")


def drain(writer: DataStreamWriter, seconds: int = 120) -> None:
    """Run a stream over what is there and stop."""
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination(seconds)
    q.stop()
