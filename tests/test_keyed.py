"""Keyed state over edits in any order, and a history that rewrites what it touches."""

import datetime as dt
import os
import random

from marginalia.streaming import keyed
from pyspark.sql import functions as F

EDIT = "key long, id long, ts timestamp, close boolean"
T0 = dt.datetime(2024, 1, 1)


def run(spark, folder, rows, batches):
    source, at = f"{folder}/in", 0
    os.makedirs(source)
    for part in batches:
        spark.createDataFrame([rows[i] for i in part], EDIT).coalesce(1).write.mode("append").parquet(source)
        for f in os.listdir(source):  # files are read in the order they came
            if f.endswith(".parquet") and not f.startswith("n"):
                os.rename(f"{source}/{f}", f"{source}/n{at}.parquet")
        os.utime(f"{source}/n{at}.parquet", (1e9 + at, 1e9 + at))
        at += 1
    stream = spark.readStream.schema(EDIT).option("maxFilesPerTrigger", 1).parquet(source)
    out = []
    query = keyed.analysed_edits(stream, 0.6, 5.0, "20 seconds").writeStream.foreachBatch(lambda df, n: out.extend(df.collect())).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted((r.key, r.version, r.outcome) for r in out)


def test_outcomes_do_not_depend_on_the_order(spark, tmp_path):
    r = random.Random(4)
    rows = [(k % 3, k, T0 + dt.timedelta(milliseconds=int(k * 400 + r.randint(0, 3000))), r.random() < 0.15) for k in range(60)]
    rows += [(9, 100, T0 + dt.timedelta(hours=1), True)]  # moves the watermark past all others
    want = []
    for key in range(3):
        own = sorted((x for x in rows if x[0] == key), key=lambda x: (x[2], x[1]))
        for a, b in zip(own, [*own[1:], None]):
            wait = (b[2] - a[2]).total_seconds() if b else 1e9
            if not a[3] and wait >= 0.6:
                want.append((key, a[1], "published" if wait >= 5.6 else "dropped"))
    order = list(range(60))
    mixed = sorted(order, key=lambda i: i // 12 * 12 + r.random() * 12)  # within the delay
    last = [60]
    assert run(spark, f"{tmp_path}/a", rows, [order, last]) == sorted(want)
    assert run(spark, f"{tmp_path}/b", rows, [mixed[:20], mixed[20:25], mixed[25:], last]) == sorted(want)


def test_history_rewrites_what_it_touches(spark, tmp_path):
    schema = "user long, id long, ts timestamp"
    kept = keyed.History(str(tmp_path), "user", ["ts", "id"], "id", keep=3, buckets=64)
    put, r, every = kept.write(), random.Random(2), []
    assert kept.read(spark, schema).count() == 0
    for n in range(4):
        users = range(200) if n == 0 else [7, 8]
        rows = [(u, n * 10_000 + u * 10 + k, T0 + dt.timedelta(seconds=r.randint(0, 999))) for u in users for k in range(2)]
        every += rows
        put(spark.createDataFrame(rows, schema), n)
        if n == 2:
            put(spark.createDataFrame(rows, schema), n)  # a batch that is repeated
        written = [d for d in os.listdir(f"{tmp_path}/data/{n}") if d.startswith("bucket=")]
        assert len(written) <= (64 if n == 0 else 2)
        want = sorted(x for u in range(200) for x in sorted((x for x in every if x[0] == u), key=lambda x: (x[2], x[1]))[-3:])
        assert sorted(tuple(x) for x in kept.read(spark, schema).collect()) == want
    touched = {str(x[0]) for x in spark.createDataFrame([(7,), (8,)], "user long").select(F.pmod(F.xxhash64("user"), F.lit(64))).collect()}
    left = {d.split("=")[1] for d in os.listdir(f"{tmp_path}/data/1") if d.startswith("bucket=")}
    assert not touched & left  # versions no list names are gone
