"""From places in a combined source to file, line and column, through the segments it was put together from.

A file split around its inputs is several segments.  Segments of one reading of a file form a chain (each begins
at or behind the end of the one before; the inputs themselves, without line ends, lie between), and within a chain places of the file count: a line is one more than the line ends
before it, a column the distance from the last.  Places and line ends are points of one running window per chain;
no text is joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import matches


def chained(segments: DataFrame) -> DataFrame:
    """``segments`` (doc_id, path, start, end, source_start) with ``chain``: readings of a file, from 1."""
    order = Window.partitionBy("doc_id", "path").orderBy("start")
    before = F.lag(F.col("source_start") + F.col("end") - F.col("start")).over(order)
    fresh = before.isNull() | (before > F.col("source_start"))
    return segments.withColumn("chain", F.count_if(fresh).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def in_files(points: DataFrame, segments: DataFrame) -> DataFrame:
    """``points`` (doc_id, start, ...) with path, chain and at (the place in that file): as-of, the last segment
    that begins at or before a point.  A point before all segments is in the first file's; without segments path
    and chain are null and at is start."""
    columns = points.columns
    s = F.struct("path", "chain", "start", "source_start")
    begun = chained(segments).select("doc_id", "start", F.lit(0).alias("_k"), s.alias("_s"))
    marked = points.withColumn("_p", F.struct(*columns)).select("doc_id", "start", F.lit(1).alias("_k"), "_p")
    every = marked.unionByName(begun, allowMissingColumns=True)
    order = Window.partitionBy("doc_id").orderBy("start", "_k")
    last = F.last("_s", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first("_s", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    held = every.withColumn("_s", F.coalesce(last, first)).where("_p is not null")
    at = F.coalesce(F.col("start") - F.col("_s.start") + F.col("_s.source_start"), F.col("start"))
    return held.select("_p.*", F.col("_s.path").alias("path"), F.col("_s.chain").alias("chain"), at.cast("int").alias("at"))


def source_positions(points: DataFrame, docs: DataFrame, segments: DataFrame) -> DataFrame:
    """``points`` with path, line and col (from 1) in the file they came from.

    ``docs``: doc_id and the combined text; ``segments``: doc_id, path, start, end, source_start.  Rows of ``points``
    that are alike come back each; a null text or an empty one has no line ends.  Points of documents without
    segments count in the text itself, with a null path."""
    columns = points.columns
    ends = docs.select("doc_id", F.explode(F.transform(matches(F.col("text"), "\n"), lambda m: m["start"])).alias("start"))
    placed = in_files(points.withColumn("_p", F.struct(*columns)).select("doc_id", "start", "_p"), segments)
    ends = in_files(ends, segments).select("doc_id", "path", "chain", "at", F.lit(1).alias("_k"))
    both = placed.select("doc_id", "path", "chain", "at", F.lit(0).alias("_k"), "_p").unionByName(ends, allowMissingColumns=True)
    before = Window.partitionBy("doc_id", "path", "chain").orderBy("at", "_k").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumns({"line": F.count_if(F.col("_k") == 1).over(before) + 1, "_last": F.max(F.when(F.col("_k") == 1, F.col("at"))).over(before)})
    col = F.col("at") - F.coalesce("_last", F.lit(-1))
    return found.where("_k = 0").select("_p.*", "path", F.col("line").cast("int").alias("line"), col.cast("int").alias("col"))


def project_segments(projects: DataFrame, key: str = "doc_id") -> DataFrame:
    """Segments of ``sources.documents.projects`` as rows."""
    return projects.select(key, F.explode("segments").alias("s")).select(key, "s.path", "s.start", "s.end", "s.source_start")
