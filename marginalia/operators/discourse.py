"""Sentence roles, argument links, reporting checklists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import lexicons as lx
from marginalia.functions.text import either_word, settled
from marginalia.operators.narrative import rising_places


def roles(sents: DataFrame) -> DataFrame:
    """Adds all_roles, in order of priority, and role, the first of them ('other' if none).  Every signal is
    looked for once a sentence."""
    low = settled(sents, F.lower("text").alias("_low"))
    every = F.array_compact(F.array(*[F.when(F.col("_low").rlike(either_word(p)), F.lit(r)) for r, p in lx.ROLE_SIGNALS.items()]))
    found = settled(low, every.alias("all_roles")).drop("_low")
    return found.withColumn("role", F.coalesce(F.try_element_at("all_roles", F.lit(1)), F.lit("other")))


def argument_links(labelled: DataFrame, by: tuple[str, ...] = ("doc_id", "section")) -> DataFrame:
    """Claims with whether a warrant stands within one sentence, and grounds within two."""
    order = Window.partitionBy(*by).orderBy("sent")

    def near(role: tuple[str, ...], k: int) -> Column:
        has = F.max(F.arrays_overlap("all_roles", F.array(*map(F.lit, role))).cast("int"))
        return F.coalesce(has.over(order.rowsBetween(-k, k)) == 1, F.lit(False))

    found = labelled.withColumns({"near_warrant": near(("warrant",), 1), "near_grounds": near(("evidence", "result"), 2)})
    return found.where(F.array_contains("all_roles", "claim"))


def missing_links(labelled: DataFrame) -> DataFrame:
    """(doc_id, section, code, n): claims without warrant or grounds in argued sections, results without
    interpretation, unqualified claims beside limitations, no contribution at the end."""
    claims = argument_links(labelled).where(F.col("section").isin(lx.ARGUED_SECTIONS))
    lone = claims.groupBy("doc_id", "section").agg(F.count_if(~F.col("near_warrant")).alias("claim_without_warrant"), F.count_if(~F.col("near_grounds")).alias("claim_without_grounds"))

    def n(role: str, anywhere: bool = False) -> Column:
        return F.count_if(F.array_contains("all_roles", role) if anywhere else F.col("role") == role)

    sums = labelled.groupBy("doc_id", "section").agg(n("evidence").alias("evidence"), n("result").alias("result"), n("warrant").alias("warrant"), n("claim").alias("claim"), n("limitation").alias("limitation"), n("qualifier", True).alias("qualifier"), n("contribution").alias("contribution"))
    all_ = sums.join(lone, ["doc_id", "section"], "left").na.fill(0, ["claim_without_warrant", "claim_without_grounds"])
    bare = F.col("section").isin("results", "discussion") & (F.col("evidence") + F.col("result") > 0) & (F.col("warrant") == 0) & (F.col("claim") == 0)
    flat = (F.col("limitation") > 0) & (F.col("claim") > 0) & (F.col("qualifier") == 0)
    late = F.col("section").isin("discussion", "conclusion") & (F.col("contribution") == 0)
    wide = all_.select("doc_id", "section", "claim_without_warrant", "claim_without_grounds", bare.cast("long").alias("no_interpretation"), flat.cast("long").alias("unqualified"), late.cast("long").alias("no_contribution"))
    long = wide.unpivot(["doc_id", "section"], ["claim_without_warrant", "claim_without_grounds", "no_interpretation", "unqualified", "no_contribution"], "code", "n")
    return long.where("n > 0")


def longest_rising(items: Column) -> Column:
    """Length of the longest strictly rising run of picks from an array of numbers, in order."""
    return F.size(rising_places(F.transform(items, lambda x, i: F.struct(i.alias("place"), x.alias("x")))))


#: A short reporting checklist; users add rows of their own.
CHECKLIST = [
    ("design", 1, r"\b(cohort|cross-sectional|case-control|randomi[sz]ed|trial)\b", ["abstract", "methods"]),
    ("setting", 2, r"\b(setting|location|site|hospital|clinic|school)s?\b", ["methods"]),
    ("sample size", 3, r"\bsample size\b|\bn\s?=\s?\d+", ["methods", "results"]),
    ("statistics", 4, r"\b(regression|likelihood|confidence interval|bayesian)\b", ["methods"]),
    ("limitations", 5, r"\blimitations?\b", ["discussion", "limitations"]),
    ("funding", 6, r"\bfund(ed|ing)\b", []),
]


def checklist_report(sents: DataFrame, checklist: list[tuple] | None = None) -> DataFrame:
    """Per document and item: reported, and the first matching sentence among the item's sections that
    the document has (all sections, if it has none of them)."""
    items = checklist or CHECKLIST
    spark = sents.sparkSession
    dim = F.broadcast(spark.createDataFrame([(i, k, s or None) for i, k, _, s in items], "item string, place int, sections array<string>"))
    text = F.lower("text")
    hits = F.filter(F.array(*[F.when(text.rlike(p), F.lit(i)) for i, _, p, _ in items]), lambda i: i.isNotNull())
    evidence = sents.select("doc_id", "section", "sent", "text", F.explode(hits).alias("item"))
    present = sents.groupBy("doc_id").agg(F.collect_set("section").alias("there"))
    grid = present.crossJoin(dim)  # one row per item and document
    fits = evidence.join(grid, ["doc_id", "item"]).where(F.coalesce(F.array_contains("sections", F.col("section")) | ~F.arrays_overlap("sections", "there"), F.lit(True)))
    first = fits.groupBy("doc_id", "item").agg(F.min("sent").alias("sent"))
    return grid.join(first, ["doc_id", "item"], "left").select("doc_id", "item", "place", F.col("sent").isNotNull().alias("reported"), "sent")
