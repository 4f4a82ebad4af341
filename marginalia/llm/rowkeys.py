"""Keys for rows whose ids may be null or repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.store import cut


def keyed(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` (doc_id, text) as (key, text), and the names of the keys (key, doc_id).

    Where every id is given once, the id is the key and there are no names (None).  Else keys count the
    distinct pairs of id and text in the order of ids, null last, and within an id by a hash of the text: equal
    rows share a key, and texts of one id are told apart.  Ids are ranked by ranges, none of them in one task.
    """
    odd = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").limit(1).count()
    if not odd:
        return rows.select(F.col("doc_id").alias("key"), "text"), None
    marked = rows.select("doc_id", F.sha2(F.coalesce(F.concat(F.lit("="), "text"), F.lit("")), 256).alias("hash"), "text")
    order = [F.col("doc_id").asc_nulls_last(), F.col("hash")]
    pairs = cut(marked.select("doc_id", "hash").distinct().repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    counts = pairs.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select(F.col("part"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    named = pairs.withColumn("own", F.row_number().over(Window.partitionBy("part").orderBy(*order))).join(before, "part")
    named = cut(named.select((F.col("before") + F.col("own")).cast("long").alias("key"), F.col("doc_id").alias("d"), F.col("hash").alias("h")))
    keys = marked.join(named, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("hash") == F.col("h"))).select("key", "text")
    return keys, named.select("key", F.col("d").alias("doc_id"))
