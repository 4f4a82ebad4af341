"""Keyed state: what to analyse after a burst of edits and whether the result still counts; a history that rewrites
only the parts it touches."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_STATE = "ats array<long>, ids array<long>, closes array<boolean>, changed long, version long, until long"
_OUT = "key long, version long, changed_at timestamp, outcome string"


def analysed_edits(edits: DataFrame, gap: float = 0.6, took: float = 5.0, late: str = "1 hour") -> DataFrame:
    """Outcomes of edits (key, id, ts, close): of each burst the newest version is analysed ``gap`` seconds after it,
    and its result, ``took`` seconds later, is published unless a newer edit or a close came before; then it is
    dropped.  A version that an edit or a close follows within ``gap`` is never analysed and has no row.

    Edits come in any order within ``late``: they wait in the key's state until the watermark has passed them and are
    taken by time, then id, so the outcome does not depend on how they were batched.  Edits older than what has been
    taken are left out.  A timer wakes the key when its next edit or result is due; state without either is dropped.
    """
    gap_us, took_us = int(gap * 1e6), int(took * 1e6)

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ats, ids, closes, changed, version, until = state.get if state.exists else ([], [], [], -1, -1, -1)
        ats, ids, closes = list(ats), list(ids), list(closes)
        if not state.hasTimedOut:
            for b in batches:
                ats += (b["ts"].astype("datetime64[us]").astype("int64")).tolist()
                ids += b["id"].tolist()
                closes += b["close"].tolist()
        now = state.getCurrentWatermarkMs() * 1000
        order = np.lexsort((np.array(ids, np.int64), np.array(ats, np.int64)))
        out, wait = [], []
        for i in order:
            if ats[i] > now:
                wait.append(i)
            elif ats[i] >= until:
                if version >= 0 and ats[i] - changed >= gap_us:
                    out.append((version, changed, "published" if ats[i] - changed >= gap_us + took_us else "dropped"))
                changed, version, until = ats[i], -1 if closes[i] else ids[i], ats[i]
        if version >= 0 and changed + gap_us + took_us <= now:
            out.append((version, changed, "published"))
            version = -1
        ats, ids, closes = ([x[i] for i in wait] for x in (ats, ids, closes))
        due = min([*ats[:1], *([changed + gap_us + took_us] if version >= 0 else [])], default=None)
        if due is None:
            state.remove()
        else:
            state.update((ats, ids, closes, changed, version, until))
            state.setTimeoutTimestamp(max(due // 1000, state.getCurrentWatermarkMs() + 1))
        if out:
            frame = pd.DataFrame(out, columns=["version", "changed_at", "outcome"])
            frame.insert(0, "key", key[0])
            frame["changed_at"] = pd.to_datetime(frame["changed_at"], unit="us")
            yield frame

    marked = edits.select("key", "id", "ts", "close").withWatermark("ts", late).groupBy("key")
    return marked.applyInPandasWithState(decide, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


class History:
    """The newest ``keep`` rows of each key, in a folder of buckets.

    A batch reads and writes only the buckets its keys fall in, under its own number; a list of bucket versions,
    put in place by one rename, then makes it current.  Until that, and after a failure, readers see the batch
    before.  A repeated batch writes the same again.  Versions that neither this list nor the one before names go.
    """

    def __init__(self, path: str, key: str, order: list[str], ident: str, keep: int = 1000, buckets: int = 256):
        self.path, self.key, self.order, self.ident, self.keep, self.buckets = path, key, order, ident, keep, buckets

    def _fs(self, spark: SparkSession):
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path

    def _list(self, spark: SparkSession, below: int | None = None) -> tuple[int, dict[str, int]]:
        """The newest list, or the newest of a batch before ``below``: its number, and versions by bucket."""
        fs, path = self._fs(spark)
        folder = path(f"{self.path}/lists")
        if not fs.exists(folder):
            return -1, {}
        names = [f.getPath().getName() for f in fs.listStatus(folder)]
        numbers = [int(n) for n in names if n.isdigit() and (below is None or int(n) < below)]
        if not numbers:
            return -1, {}
        text = spark.read.text(f"{self.path}/lists/{max(numbers)}", wholetext=True).first()[0]
        return max(numbers), json.loads(text)

    def _paths(self, versions: dict[str, int], some: list[str]) -> list[str]:
        return [f"{self.path}/data/{versions[b]}/bucket={b}" for b in some if b in versions]

    def read(self, spark: SparkSession, schema: str) -> DataFrame:
        _, versions = self._list(spark)
        paths = self._paths(versions, sorted(versions))
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def write(self) -> Callable[[DataFrame, int], None]:
        """A foreachBatch sink."""
        from marginalia.operators.reports import newest_per_key

        def put(batch: DataFrame, number: int) -> None:
            spark = batch.sparkSession
            batch = batch.persist()
            touched = [str(r[0]) for r in batch.select(self.bucket()).distinct().collect()]  # at most ``buckets``
            number_before, versions = self._list(spark, number)
            old = self._paths(versions, touched)
            both = batch if not old else spark.read.schema(batch.schema).parquet(*old).unionByName(batch)
            kept = newest_per_key(both.dropDuplicates([self.ident]), self.key, self.keep, *[F.desc(c) for c in self.order]).drop("n")
            kept = kept.withColumn("bucket", self.bucket()).repartition("bucket")
            kept.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/{number}")
            fs, path = self._fs(spark)
            named = versions | dict.fromkeys(touched, number)
            draft = path(f"{self.path}/drafts/{number}")
            out = fs.create(draft, True)
            out.write(json.dumps(named).encode())
            out.close()
            fs.mkdirs(path(f"{self.path}/lists"))
            fs.delete(path(f"{self.path}/lists/{number}"), False)
            fs.rename(draft, path(f"{self.path}/lists/{number}"))
            _, earlier = self._list(spark, number_before) if number_before >= 0 else (-1, {})
            for b, v in earlier.items():  # named two lists ago and by neither since
                if versions.get(b) != v and named.get(b) != v:
                    fs.delete(path(f"{self.path}/data/{v}/bucket={b}"), True)
            batch.unpersist()

        return put
