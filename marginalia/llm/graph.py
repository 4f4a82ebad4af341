"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.store import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on edges (a > b).  The minimum is a combinable aggregate and the join back has a
    unique right side, so a node with millions of links neither meets in one task nor multiplies."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        step = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        step = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        step = step.unionByName(least.withColumnRenamed("m", "b"))
    return step.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """links (a, b), both bigint, in any direction -> (node, component), component the least node
    reachable.  Nodes without links are not listed.  Logarithmically many rounds in practice; each
    is written to the shared folder.  An empty table gives an empty table."""
    edges = cut(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    )
    seen = None
    while True:
        edges = cut(_star(_star(edges, True), False))
        mark = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
