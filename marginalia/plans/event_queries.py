"""Queries over events and labels: usage, trends, limits, precision, percentiles, streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators import reports
from marginalia.sources.shared import shared_dir
from marginalia.streaming import events as streams, keyed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


#: Events stand for usage: the user is the rule, the kind of event what was done with its flags.
_DONE = {"view": "shown", "click": "accepted", "error": "dismissed", "signup": "muted"}


@query(
    """WITH e AS (SELECT 'R' || user_id % 50 AS rule, event_type FROM events), s AS (SELECT rule, count(*) FILTER (event_type = 'view') AS shown, count(*) FILTER (event_type = 'click') AS accepted,
 count(*) FILTER (event_type = 'error') AS dismissed, count(*) FILTER (event_type = 'signup') AS muted FROM e GROUP BY rule), k AS (SELECT *, greatest(0.0::DOUBLE, (shown - dismissed - muted)::DOUBLE / greatest(shown, 1)) AS keep FROM s)
SELECT rule, shown, accepted, dismissed, muted, round(keep, 3) AS keep_rate, CASE WHEN shown < 10 THEN 'not enough data' WHEN keep < 0.4 THEN 'attenuation candidate' WHEN accepted * 4 >= shown THEN 'earning its keep' ELSE 'tolerated' END AS verdict FROM k"""
)
def telemetry_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.create_map(*[F.lit(x) for p in _DONE.items() for x in p])
    e = _events(spark, sf_dir).select(F.concat(F.lit("R"), (F.col("user_id") % 50).cast("string")).alias("rule"), F.try_element_at(done, F.col("event_type")).alias("event"), F.lit(1).alias("n"))
    return reports.usage_summary(e)


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress rows made of events: one check per user and day, with counts by kind of event."""
    e = _events(spark, sf_dir).select("user_id", F.to_date("ts").alias("day"), "event_type")
    n = e.groupBy("user_id", "day", "event_type").count()
    return n.groupBy("user_id", "day").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "count"))).alias("counts"), (F.sum("count") * 250).alias("words")).select("user_id", F.col("day").alias("created_at"), F.col("day").cast("string").alias("check_id"), "words", "counts")


@query(
    """WITH n AS (SELECT user_id, ts::DATE AS day, event_type AS rule, count(*) AS n FROM events GROUP BY ALL), c AS (SELECT user_id, day, sum(n) * 250 AS words FROM n GROUP BY ALL),
t AS (SELECT user_id, rule, sum(n)::BIGINT AS total FROM n GROUP BY ALL HAVING sum(n) >= 2),
r AS (SELECT t.user_id, t.rule, t.total, c.day, floor(coalesce(n.n, 0) * 10000.0::DOUBLE / c.words + 0.5) / 10 AS rate FROM t JOIN c USING (user_id) LEFT JOIN n USING (user_id, day, rule)),
s AS (SELECT user_id, rule, total, list(rate ORDER BY day) AS rates FROM r GROUP BY ALL)
SELECT user_id, rule, total, len(rates)::BIGINT AS n_checks, rates[1] AS first_rate, rates[-1] AS latest_rate,
 CASE WHEN len(rates) < 2 THEN NULL WHEN rates[-1] - rates[1] > greatest(0.5, list_max(rates) * 0.2) THEN 'up' WHEN rates[1] - rates[-1] > greatest(0.5, list_max(rates) * 0.2) THEN 'down' ELSE 'steady' END AS trend FROM s"""
)
def rule_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.rule_trends(_checks(spark, sf_dir))


@query(
    """WITH l AS (SELECT d.lang AS category, d.source AS rule_id, l.quality = 1 AS ok FROM labels l JOIN documents d USING (doc_id)), s AS (SELECT category, rule_id, grouping(category, rule_id) AS g, count(*) AS n, count(*) FILTER (ok) AS k FROM l GROUP BY GROUPING SETS ((), (category), (rule_id))),
w AS (SELECT *, k::DOUBLE / n AS p, 1.96::DOUBLE AS z FROM s)
SELECT CASE g WHEN 3 THEN 'overall' WHEN 1 THEN 'category' ELSE 'rule' END AS level, coalesce(category, rule_id, 'all') AS key, n, k AS n_right, round(p, 4) AS precision,
 round(greatest(0.0::DOUBLE, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 4) AS low,
 round(least(1.0::DOUBLE, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 4) AS high FROM w"""
)
def precision_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, docs = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "documents"))
    return reports.precision_report(labels.join(docs, "doc_id").select(F.col("lang").alias("category"), F.col("source").alias("rule_id"), (F.col("quality") == 1).alias("right")))


@query("SELECT event_id, user_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 20")
def keep_newest_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.newest_per_key(_events(spark, sf_dir), "user_id", 20, F.desc("ts"), F.desc("event_id")).select("event_id", "user_id", "event_type", "ts")


@query("SELECT user_id, event_type, max_by(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY ALL")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("value"), F.max("event_id").alias("event_id"))


@query("SELECT event_id, user_id, count(*) OVER w AS recent, count(*) OVER w <= 2 AS allowed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 7200000000 PRECEDING AND CURRENT ROW)")
def rate_limit_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.within_rate(_events(spark, sf_dir), 2, 7200).select("event_id", "user_id", "recent", "allowed")


@query(
    """WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 21600000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM g)
SELECT user_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, arg_max(event_id, {'a': ts, 'b': event_id}) AS newest FROM s GROUP BY user_id, burst"""
)
def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sessions(_events(spark, sf_dir), "6 hours")


@query("SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, max(value) AS most FROM events GROUP BY event_type")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return e.groupBy("event_type").agg(F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY value)").alias("p50"), F.expr("percentile_cont(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"), F.max("value").alias("most"))


@query("SELECT event_type, time_bucket(INTERVAL '1 day', ts) AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def daily_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k > 40")
def over_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return _events(spark, sf_dir).withColumn("k", k).where("k > 40").select("user_id", "event_id")


# --- the same reports as streams, drained over the events table ---
@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = streams.tallies(streams.event_stream(spark, sf_dir)).select("event_type", "n")
    return streams.drained(stream, "complete", f"tallies_{uuid.uuid4().hex}")


@query("SELECT event_id, user_id, count(*) OVER w AS recent, count(*) OVER w <= 2 AS allowed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id RANGE BETWEEN INTERVAL '2 hours' PRECEDING AND CURRENT ROW)".replace("ORDER BY ts, event_id", "ORDER BY ts"))
def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = streams.limited(streams.event_stream(spark, sf_dir), 2, 7200)
    return streams.drained(stream, "append", f"limited_{uuid.uuid4().hex}").select("event_id", "user_id", "recent", "allowed")


#: Kinds of events that stand for closing a document; the others are edits.
_CLOSES = ["error"]


@query(
    "WITH e AS (SELECT user_id AS key, event_id AS version, ts AS changed_at, event_type = 'error' AS closes, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_at FROM events), "
    "w AS (SELECT max(date_trunc('milliseconds', ts)) - INTERVAL 1 HOUR AS w FROM events) "
    "SELECT key, version, changed_at, CASE WHEN next_at < changed_at + INTERVAL 9000 SECOND THEN 'dropped' ELSE 'published' END AS outcome FROM e, w "
    "WHERE NOT closes AND coalesce(next_at >= changed_at + INTERVAL 1800 SECOND, TRUE) AND (coalesce(next_at <= w, FALSE) OR changed_at + INTERVAL 9000 SECOND <= w)"
)
def stream_analysed_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = streams.event_stream(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts", F.col("event_type").isin(_CLOSES).alias("close"))
    found = streams.drained(keyed.analysed_edits(edits, 1800, 7200), "append", f"edits_{uuid.uuid4().hex}")
    return found.withColumn("changed_at", F.col("changed_at").cast("timestamp_ntz"))


@query("SELECT event_id, user_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def stream_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = keyed.History(f"{shared_dir(spark)}/history_{uuid.uuid4().hex}", "user_id", ["ts", "event_id"], "event_id", keep=5, buckets=16)
    stream = streams.event_stream(spark, sf_dir).select("event_id", "user_id", "ts")
    run = stream.writeStream.foreachBatch(kept.write()).option("checkpointLocation", f"{kept.path}/state").trigger(availableNow=True).start()
    try:
        run.awaitTermination()
    finally:
        run.stop()
    return kept.read(spark, "event_id long, user_id long, ts timestamp").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
