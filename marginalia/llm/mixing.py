"""Mixing sources to target weights by capped water-filling (DataFrame functions only).

Targets: every source is due its weight's share of all words.  A source due more than ``epochs`` times
its own words is clamped there and its excess is shared by weight among the others, again and again
until none is above.  Each round is one aggregate over the per-source table.

Sampling: with r = target / source words, every document is taken floor(r) times; the rest is filled with
whole documents in a seeded order for as long as they fit; then
up to ``ROUNDS`` times the document whose size comes nearest to what is missing is added, or to what is
too much removed.  What then is still missing, or too much, is made up in the seeded order by all documents
that fit, longer ones passed over, until none is left that does or the gap is at
most ``SLACK`` of the target.
The place where the order ends is found without sorting a source: documents fall in about sqrt(n) ranges of the seeded order,
and only the range in which the target ends is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.store import cut, unused, word_count

EPOCHS, CYCLE, SEED = 3, 3, "mix-1"
#: Documents added or removed per source, at most, after the seeded order has been followed.
ROUNDS = 6
#: A gap of at most this share of a source's target is not filled further: the SQL that checks the
#: operator ends after ROUNDS, and leaves gaps of a few words that another short document would fit.
SLACK = 0.001


def seeded_order(doc_id: Column, seed: str = SEED) -> Column:
    """A hash of seed and id as a number below 2**32; any engine with md5 can repeat it."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long")


def ranked(keys: DataFrame, key: str) -> DataFrame:
    """Distinct keys with their 1-based place in code point order, null last.  Ranges are ordered on
    their own and shifted by the sizes of those before, so no task holds all keys."""
    parts = keys.sparkSession.conf.get("spark.sql.shuffle.partitions")
    spread = cut(
        keys.repartitionByRange(int(parts), F.col(key).asc_nulls_last())
        .withColumn("_range", F.spark_partition_id())
    )
    within = spread.withColumn("_at", F.row_number().over(Window.partitionBy("_range").orderBy(F.col(key).asc_nulls_last())))
    sizes = spread.groupBy("_range").agg(F.count("*").alias("_n"))  # one row a range
    shift = sizes.withColumn("_shift", F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)))
    return within.join(shift, "_range").withColumn("place", F.col("_at") + F.coalesce("_shift", F.lit(0))).drop("_range", "_at", "_n", "_shift")


def targets(sources: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """sources (source, weight, source_size, ...) with target: capped water-filling."""
    cap = F.col("source_size") * epochs
    total, open_weight, clamped = sources.agg(F.sum("source_size"), F.sum("weight"), F.lit(0).cast("long")).first()
    total, level_of = total or 0, None
    while total and open_weight:
        level_of = (total - clamped, open_weight)
        above = F.col("weight") * F.lit(float(level_of[0])) / F.lit(float(level_of[1])) > cap
        found = sources.agg(F.coalesce(F.sum(F.when(above, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0))).first()
        if (found[0], found[1]) == (clamped, open_weight):
            break
        clamped, open_weight = found
    if not total or not open_weight:
        return sources.withColumn("target", cap.cast("double"))
    due = F.col("weight") * F.lit(float(level_of[0])) / F.lit(float(level_of[1]))
    return sources.withColumn("target", F.when(due > cap, cap.cast("double")).otherwise(due))


def mix_plan(docs: DataFrame, epochs: int = EPOCHS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken, copies.

    Sources in code point order, null last, weigh 1, 2, 3, 1, ...  A text that is null or without words
    has size 0 and takes 0 words, ``copies`` as its neighbours in the order.  Rows with the same id are
    in or out together.  An empty table gives an empty plan.  Other columns are not read.
    """
    sized = cut(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col).cast("string")).alias("size"))
        .withColumn("h", seeded_order(F.col("doc_id"), seed))
    )
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    weighed = cut(ranked(totals, "source").withColumn("weight", ((F.col("place") - 1) % CYCLE + 1).cast("long")))
    aim = targets(weighed, epochs)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    aim = aim.withColumn("whole", F.least(F.floor(ratio), F.lit(epochs)).cast("long"))
    aim = cut(aim.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("ranges", F.ceil(F.sqrt("n")).cast("long")))

    bound = _bounds(sized, aim.select("source", "rest", "ranges"))
    plan = _of(_of(sized, aim.select("source", "source_size", "target", "whole", "rest", "ranges")), bound)
    plan = plan.withColumn("extra", (F.col("rest") > 0) & _up_to_bound()).drop("ranges", "edge", "mark")

    # What is still missing, or too much: documents are added or removed one by one, each time the one
    # that leaves least.  One candidate per source, size and side is enough, so rounds are small.
    side = plan.where("size > 0").groupBy("source", "extra", "size").agg(F.min(F.struct("h", "doc_id")).alias("doc"), F.first("whole").alias("whole"))
    candidates = cut(side)
    missing = cut(plan.groupBy("source").agg((F.first("rest") - F.sum(F.when(F.col("extra"), F.col("size")).otherwise(0))).alias("missing")))
    moved = None
    for _ in range(ROUNDS):
        left = candidates if moved is None else candidates.join(_nameable(moved), (F.col("source").eqNullSafe(F.col("_s")) & (F.col("extra") == F.col("_extra")) & (F.col("size") == F.col("_size"))), "left_anti")
        gap = F.abs("missing")
        movable = F.when(F.col("missing") > 0, ~F.col("extra") & (F.col("whole") < epochs)).otherwise(F.col("extra"))
        best = F.min(F.struct(F.abs(F.col("size") - gap).alias("left"), F.col("doc.h").alias("h"), F.col("doc.doc_id").alias("doc_id"), "extra", "size"))
        picked = cut(_of(left, missing).where(movable & (F.abs(F.col("size") - gap) < gap)).groupBy("source").agg(best.alias("best")).select("source", "best.*"))
        if not picked.take(1):
            break
        moved = picked if moved is None else moved.unionByName(picked)
        change = picked.select("source", F.when(F.col("extra"), F.col("size")).otherwise(-F.col("size")).alias("change"))
        missing = cut(_of(missing, change).select("source", (F.col("missing") + F.coalesce("change", F.lit(0))).alias("missing")))
    flips = F.lit(False)
    if moved is not None:
        marks = moved.select(F.col("source").alias("_s"), F.col("h").alias("_h"), F.col("doc_id").alias("_id"), F.lit(True).alias("_moved"))
        same = plan["source"].eqNullSafe(marks["_s"]) & (plan["h"] == marks["_h"]) & plan["doc_id"].eqNullSafe(marks["_id"])
        plan = plan.join(marks, same, "left")
        flips = F.coalesce("_moved", F.lit(False))
    plan = plan.withColumn("extra", F.col("extra") != flips)
    plan = _filled(plan.select("doc_id", "source", "size", "h", "source_size", "target", "whole", "extra"), epochs)
    copies = F.col("whole") + F.col("extra").cast("long")
    return plan.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def _bounds(rows: DataFrame, room: DataFrame) -> DataFrame:
    """Per source of ``room`` (source, rest, ranges): edge and mark, the range and the last document
    (h, doc_id) up to which ``rows`` (source, h, doc_id, size) fit into ``rest`` in the seeded order."""
    placed = _of(rows, room).withColumn("range", _spot())
    per_range = placed.groupBy("source", "range").agg(F.sum("size").alias("in_range"), F.first("rest").alias("rest"))
    before = F.sum("in_range").over(Window.partitionBy("source").orderBy("range")) - F.col("in_range")
    last = per_range.withColumn("before", before).where("before <= rest").groupBy("source").agg(F.max_by(F.struct("range", "before"), "range").alias("at"))
    edge = cut(last.select("source", F.col("at.range").alias("edge"), F.col("at.before").alias("before")))
    inside = _of(placed, edge).where("range = edge")
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("h", "doc_id"))
    fits = inside.withColumn("upto", upto + F.col("before")).groupBy("source", "h", "doc_id").agg(F.max("upto").alias("upto"), F.sum("size").alias("size"), F.first("rest").alias("rest"), F.first("edge").alias("edge"))
    chosen = fits.where(F.col("upto") <= F.col("rest")).groupBy("source").agg(F.max(F.struct("h", "doc_id")).alias("mark"))
    return cut(edge.withColumnRenamed("source", "s").join(chosen, F.col("s").eqNullSafe(F.col("source")), "left").select(F.col("s").alias("source"), "edge", "mark"))


def _spot() -> Column:
    return F.floor(F.col("h") * F.col("ranges") / F.lit(2.0**32)).cast("long")


def _up_to_bound() -> Column:
    inside = (_spot() < F.col("edge")) | ((_spot() == F.col("edge")) & (F.struct("h", "doc_id") <= F.col("mark")))
    return F.coalesce(inside, F.lit(False))


def _filled(plan: DataFrame, epochs: int) -> DataFrame:
    """``plan`` with documents added where words are missing, removed where there are too many, until none
    fits into what is left or that is at most SLACK of the target.  A round goes along the seeded order over the documents of at most half of
    what is left, so it either takes them all or leaves less than half; where there are none of those,
    at most one longer document fits, the first.  So rounds are logarithmic in the words left."""
    plan = cut(plan)
    while True:
        rest = F.first("target") - F.first("whole") * F.first("source_size")
        missing = plan.groupBy("source").agg((rest - F.sum(F.when(F.col("extra"), F.col("size")).otherwise(0))).alias("missing"), (F.lit(SLACK) * F.first("target")).alias("slack"))
        missing = missing.where(F.abs("missing") > F.col("slack")).drop("slack")
        movable = F.when(F.col("missing") > 0, ~F.col("extra") & (F.col("whole") < epochs)).otherwise(F.col("extra"))
        open_ = _of(plan, missing).where(F.col("missing").isNotNull() & (F.col("size") > 0) & movable)
        # rows with the same id move together, so they fit together or not at all
        docs = open_.groupBy("source", "h", "doc_id").agg(F.sum("size").alias("size"), F.abs(F.first("missing")).alias("rest"))
        fitting = cut(docs.where("size <= rest"))
        if not fitting.take(1):
            return plan
        half = F.col("size") * 2 <= F.col("rest")
        found = fitting.groupBy("source").agg(F.first("rest").alias("rest"), F.count(F.when(half, 1)).alias("n"), F.min(F.struct("h", "doc_id")).alias("first"))
        found = cut(found.withColumn("ranges", F.greatest(F.ceil(F.sqrt("n")), F.lit(1)).cast("long")))
        small = fitting.where(half).select("source", "h", "doc_id", "size")
        bound = _bounds(small, found.where("n > 0").select("source", "rest", "ranges"))
        spots = _of(_of(fitting, found.select("source", "ranges", "n", "first")), bound)
        taken = F.when(F.col("n") > 0, half & _up_to_bound()).otherwise(F.struct("h", "doc_id") == F.col("first"))
        moved = cut(spots.where(taken).select("source", "h", "doc_id", "size"))
        marks = moved.select(F.col("source").alias("_s"), F.col("h").alias("_h"), F.col("doc_id").alias("_id"), F.lit(True).alias("_moved"))
        same = plan["source"].eqNullSafe(marks["_s"]) & (plan["h"] == marks["_h"]) & plan["doc_id"].eqNullSafe(marks["_id"])
        plan = cut(plan.join(marks, same, "left").withColumn("extra", F.col("extra") != F.coalesce("_moved", F.lit(False))).drop("_s", "_h", "_id", "_moved"))


def _nameable(moved: DataFrame) -> DataFrame:
    return moved.select(F.col("source").alias("_s"), F.col("extra").alias("_extra"), F.col("size").alias("_size"))


def _of(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """Rows with their source's columns; a null source is a source of its own."""
    other = per_source.withColumnRenamed("source", "_s")
    return rows.join(other, rows["source"].eqNullSafe(other["_s"]), "left").drop("_s")


def mix(docs: DataFrame, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """The mixed documents: each row of ``docs``, all its columns, as often as the plan takes it.

    Rows that share id and source are taken together, those that share the id alone apart.  Null ids,
    sources and texts count as in ``mix_plan``; an empty table stays empty."""
    plan = mix_plan(docs, epochs, seed).groupBy("doc_id", "source").agg(F.max("copies").alias("copies")).where("copies > 0")
    names = {c: unused(f"_{c}", docs) for c in ("id", "of", "copies", "copy")}
    plan = plan.select(F.col("doc_id").alias(names["id"]), F.col("source").alias(names["of"]), F.col("copies").cast("int").alias(names["copies"]))
    same = docs["doc_id"].eqNullSafe(plan[names["id"]]) & docs["source"].cast("string").eqNullSafe(plan[names["of"]])
    found = docs.join(plan, same)
    return found.withColumn(names["copy"], F.explode(F.sequence(F.lit(1), F.col(names["copies"])))).drop(*names.values())
