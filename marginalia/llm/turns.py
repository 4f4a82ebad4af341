"""Conversations as numbered turns, and hashes of lists that may be long."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.store import cut


def numbered(rows: DataFrame, group: str, order: list[str], name: str = "pos") -> DataFrame:
    """``rows`` with their place (from 1) within ``group`` by ``order`` (nulls first), written to the shared folder.

    Rows are dealt by ranges of group and order, counted within a range, and ranges of one group are added up,
    so a group of a third of all rows is numbered by many tasks.  Rows alike in every column of ``order`` are
    interchangeable.  Null is a group of its own."""
    ranged = cut(rows.repartitionByRange(group, *[F.col(c).asc_nulls_first() for c in order]).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(F.col(group).alias("_g"), F.col("_range").alias("_r"), F.coalesce(before, F.lit(0)).alias("_before")).where("_before > 0")
    local = F.row_number().over(Window.partitionBy(group, "_range").orderBy(*[F.col(c).asc_nulls_first() for c in order]))
    out = ranged.withColumn(name, local).join(starts, F.col("_g").eqNullSafe(F.col(group)) & (F.col("_r") == F.col("_range")), "left")
    out = out.withColumn(name, (F.col(name) + F.coalesce("_before", F.lit(0))).cast("long"))
    return cut(out.drop("_g", "_r", "_before", "_range"))


def _stream(texts: list[str], between: bytes):
    """sha256 of each text column over the rows of a key, in their order; rows come sorted by key."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, hashes, done = None, [], []
        for frame in frames:
            columns = [frame[t].to_list() for t in texts]
            for i, key in enumerate(frame["_key"]):
                if key != now:
                    if now is not None:
                        done.append((now, *[h.hexdigest() for h in hashes]))
                    now, hashes = key, [hashlib.sha256() for _ in texts]
                elif between:
                    for h in hashes:
                        h.update(between)
                for h, c in zip(hashes, columns, strict=True):
                    h.update(c[i].encode())
            if len(done) >= 10_000:
                yield pd.DataFrame(done, columns=["_key", *texts])
                done = []
        if now is not None:
            done.append((now, *[h.hexdigest() for h in hashes]))
        if done:
            yield pd.DataFrame(done, columns=["_key", *texts])

    return run


def streamed_sha256(rows: DataFrame, key: Column, order: str, texts: list[str], between: str = "") -> DataFrame:
    """_key, and for each of ``texts`` the sha256 (hex) of its values of a key, by ``order``, with ``between`` in
    between.  A hash takes its bytes one after another, so one key is read by one task; its rows pass by, sorted
    by Spark, and are never held together.  Keys are strings and not null."""
    schema = ", ".join(f"{c} string" for c in ["_key", *texts])
    dealt = rows.select(key.alias("_key"), order, *texts).repartition("_key").sortWithinPartitions("_key", order)
    return dealt.mapInPandas(_stream(texts, between.encode()), schema)


def _blocks(most: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, part in frame.groupby("_key", sort=False):
                ids = part["_id"].to_numpy()
                out += [(key, int(ids[i]), ",".join(map(str, ids[i : i + most].tolist()))) for i in range(0, len(ids), most)]
            yield pd.DataFrame(out, columns=["_key", "_id", "_ids"])

    return run


def ids_sha256(rows: DataFrame, key: Column, number: str) -> DataFrame:
    """_key, _ids: sha256 of a key's numbers in ascending order, in decimal, comma-joined.  Ranges of (key, number)
    write numbers as short lists first, so a key of a third of all rows is put into text by many tasks, and what
    meets in one task is a few hundred times fewer rows."""
    ranged = rows.select(key.alias("_key"), F.col(number).alias("_id")).repartitionByRange("_key", "_id").sortWithinPartitions("_key", "_id")
    return streamed_sha256(ranged.mapInPandas(_blocks(500), "_key string, _id long, _ids string"), F.col("_key"), "_id", ["_ids"], ",")
