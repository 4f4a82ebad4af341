"""Numbers that a sentence quotes from a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import lexicons as lx
from marginalia.functions.text import mask_matches, matches, sentence_spans, settled
from marginalia.operators import structure

#: A run that may be a number, with its per-cent sign, and the number at its head.
RUN = r"[A-Za-z0-9_.,]+(?:\s*\\?%)?"
NUMBER = r"^(\d{1,3}(?:,\d{3})+|\d+)(\.\d+)?(\s*\\?%)?(?:[^.\d].*)?$"


def values(text: Column) -> Column:
    """Numbers in order: (start, end, written, value, decimals, percent).  A run that is no number to its
    first sign after the digits gives none."""

    def one(m: Column) -> Column:
        whole, fraction, percent = (F.regexp_extract(m["text"], NUMBER, k) for k in (1, 2, 3))
        written = F.trim(F.concat(whole, fraction, percent))
        return F.struct(
            m["start"].alias("start"), (m["start"] + F.length(written)).alias("end"), written.alias("written"),
            F.concat(F.replace(whole, F.lit(","), F.lit("")), fraction).cast("double").alias("value"),
            F.greatest(F.length(fraction) - 1, F.lit(0)).alias("decimals"), (percent != "").alias("percent"),
        )

    return F.transform(F.filter(matches(text, RUN), lambda m: m["text"].rlike(NUMBER)), one)


def numbers_not_in_table(docs: DataFrame) -> DataFrame:
    """X401: decimals and percentages, in a sentence that cites one table and no other float, that the table
    does not hold, not even in more decimals (ties may go either way).  Only kinds of number that the table
    has are judged; sums and levels such as "95% CI" are not.

    Sentences without a number of that kind are gone before anything is shuffled, and of the others only
    their numbers meet those of the table they cite.
    """
    f = structure.floats(docs).where("number is not null")
    outside = docs.select("doc_id", mask_matches(F.col("text"), structure.FLOAT).alias("text"))
    sentences = settled(outside, sentence_spans(F.col("text")).alias("spans")).select("doc_id", F.explode("spans").alias("s")).select("doc_id", F.col("s.start").alias("start"), F.col("s.text").alias("text"))
    citing = sentences.where((F.col("text").rlike(structure.MENTION) | F.col("text").rlike(structure.REF)) & F.col("text").rlike(r"\d(?:\.\d|\s*\\?%)") & ~F.col("text").rlike(lx.SUMMED))

    # the floats each sentence cites: every mention stands for its sentence
    said = structure.mentions(citing.select(F.struct("doc_id", "start").alias("doc_id"), "text"))
    said = said.select("doc_id.doc_id", F.col("doc_id.start").alias("start"), F.col("doc_id.start").alias("end"), "kind", "number", "label")
    own = f.select("doc_id", "kind", "number", "label")
    by_number = said.where("number is not null").select("doc_id", "start", "kind", "number").join(own.drop("label"), ["doc_id", "kind", "number"])
    by_label = structure.resolved(said, structure.labels(docs)).where("label is not null").join(own, ["doc_id", "label"])
    cited = by_number.select("doc_id", "start", "kind", "number").unionByName(by_label.select("doc_id", "start", "kind", "number")).distinct()
    one = cited.groupBy("doc_id", "start").agg(F.count("*").alias("n"), F.min("kind").alias("kind"), F.min("number").alias("number")).where("n = 1 and kind = 'table'").drop("n")

    held = settled(f.where("kind = 'table'"), values(F.col("body")).alias("vs")).select("doc_id", "kind", "number", F.transform("vs", lambda v: F.struct(v["value"], v["decimals"])).alias("held"), F.contains("body", F.lit("%")).alias("has_percent"), F.col("body").rlike(r"\d\.\d").alias("has_decimal"))
    quoted = settled(citing, values(F.col("text")).alias("vs")).select("doc_id", "start", F.col("text").alias("sentence"), F.explode("vs").alias("v")).where("v.percent or v.decimals > 0")
    after, before = F.substring("sentence", F.col("v.end") + 1, F.lit(40)), F.substring("sentence", F.greatest(F.col("v.start") - 11, F.lit(1)), F.least(F.col("v.start"), F.lit(12)))
    quoted = quoted.where(~after.rlike(lx.LEVEL_AFTER) & ~before.rlike(lx.LEVEL_BEFORE)).select("doc_id", "start", "v")
    judged = quoted.join(one, ["doc_id", "start"]).join(held, ["doc_id", "kind", "number"]).where((F.col("v.percent") & F.col("has_percent")) | (~F.col("v.percent") & F.col("has_decimal")))

    def close(h: Column) -> Column:
        slack = F.when(h["decimals"] > F.col("v.decimals"), 0.5 * F.pow(F.lit(10.0), -F.col("v.decimals"))).otherwise(0.0)
        return F.abs(h["value"] - F.col("v.value")) < slack + 1e-9

    missing = judged.where(~F.exists("held", close))
    return missing.select("doc_id", F.lit("X401").alias("rule_id"), (F.col("start") + F.col("v.start")).alias("start"), (F.col("start") + F.col("v.end")).alias("end"), F.col("v.written").alias("text"), F.lit(None).cast("string").alias("replacement"))
