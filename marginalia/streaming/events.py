"""Event streams: usage tallies, debounced edits, rate limits, and a pruned history.

Streams read a folder of parquet files; every function takes a streaming (or static) DataFrame, so the
batch report and its streaming form share one definition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marginalia.sources.shared import shared_dir

EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet", per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(EVENT)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        source = reader.parquet(f"{folder}/{name}")
    else:  # a stream reads folders; of this one, the one file
        source = reader.option("pathGlobFilter", name).parquet(folder)
    return source.withColumn("ts", F.col("ts").cast("timestamp"))


def tallies(events: DataFrame) -> DataFrame:
    """Running counts by kind of event; late events simply add."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def windowed(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by window and kind; a window closes once the watermark passes it."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def debounced(events: DataFrame, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """The newest event of every burst of one user."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    bursts = marked.groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return bursts.agg(F.count("*").alias("n"), F.max_by("event_id", F.struct("ts", "event_id")).alias("newest")).select("user_id", F.col("w.start").alias("begin"), "n", "newest")


def limited(events: DataFrame, limit: int = 30, seconds: int = 60, late: str = "1 hour") -> DataFrame:
    """Each event with whether its user had at most ``limit`` in the last ``seconds``, itself and events of
    the same instant included.

    A user's events of one micro-batch are put in order as times and ids alone, whatever frames they come
    in; ``per_trigger`` bounds a micro-batch.  State: the event times inside the window, which age out; once
    the watermark is past them the user's state is dropped.
    """

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        found = pd.concat([b[["ts", "event_id"]] for b in batches])
        at = found["ts"].astype("datetime64[us]").astype("int64").to_numpy() / 1e6
        order = np.lexsort((found["event_id"].to_numpy(), at))
        at, ids = at[order], found["event_id"].to_numpy()[order]
        times = np.sort(np.concatenate([np.array(state.get[0] if state.exists else [], np.float64), at]))
        recent = np.searchsorted(times, at, side="right") - np.searchsorted(times, at - seconds, side="left")
        times = times[times >= times[-1] - seconds]
        state.update((times.tolist(),))
        state.setTimeoutTimestamp(max(int((times[-1] + seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": key[0], "event_id": ids, "recent": recent, "allowed": recent <= limit})

    return events.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(decide, "user_id long, event_id long, recent long, allowed boolean", "times array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def newest_into(path: str, keep: int = 1000) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps each user's newest events in a table: merge, rank, write anew under
    the batch's number.  A batch that is repeated writes the same table again."""
    from marginalia.operators.reports import newest_per_key

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        merged = batch
        if number > 0:
            merged = spark.read.parquet(f"{path}/{number - 1}").unionByName(batch).dropDuplicates(["event_id"])
        newest_per_key(merged, "user_id", keep, F.desc("ts"), F.desc("event_id")).drop("n").write.mode("overwrite").parquet(f"{path}/{number}")

    return write


def drained(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Runs a stream over all that is there and gives its result table: in append mode the rows of all
    micro-batches, in complete mode those of the last.  Rows and state are written to the shared folder; a
    repeated micro-batch writes its part anew."""
    spark = stream.sparkSession
    folder = f"{shared_dir(spark)}/{name}"
    parts: list[str] = []

    def write(batch: DataFrame, number: int) -> None:
        part = f"{folder}/rows/{number}"
        batch.write.mode("overwrite").parquet(part)
        if part not in parts:
            parts.append(part)

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    if not parts:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*(parts if mode == "append" else parts[-1:]))
