"""Spelling by a delete-neighbourhood join: no pair of words is formed but those that share a form with
up to two letters left out.  The dictionary is a frequency table made from a supplied corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def vocabulary(docs: DataFrame, least_docs: int = 5) -> DataFrame:
    """(word, freq) of plain lower-case words in ``least_docs`` documents or more."""
    w = docs.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z]+"), F.lit(0))).alias("word"))
    counts = w.groupBy("word", "doc_id").count().groupBy("word").agg(F.sum("count").alias("freq"), F.count("*").alias("docs"))
    return counts.where((F.col("docs") >= least_docs) & (F.length("word") >= 3)).select("word", "freq")


def deletes(word: Column) -> Column:
    """The word and its forms with one letter left out."""
    places = F.sequence(F.lit(1), F.length(word))
    return F.array_distinct(F.concat(F.array(word), F.transform(places, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))))


def corrections(docs: DataFrame, known: DataFrame, shortest: int = 6, repeated: int = 3) -> DataFrame:
    """(doc_id, word, correction): words of one document, used fewer than ``repeated`` times there, that
    the dictionary lacks and that one edit or one swap of neighbours makes known; the most frequent known word."""
    w = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\b[a-z]+\b"), F.lit(0))).alias("word")).where(F.length("word") >= shortest)
    own = w.groupBy("doc_id", "word").count().where(F.col("count") < repeated)
    unknown = own.join(known.hint("merge"), "word", "left_anti")
    forms = unknown.select("word").distinct().select("word", F.explode(deletes(F.col("word"))).alias("form"))
    targets = known.where(F.length("word") >= shortest - 1).select(F.col("word").alias("to"), "freq", F.explode(deletes(F.col("word"))).alias("form"))
    pairs = forms.hint("merge").join(targets.hint("merge"), "form")  # their size is guessed from the words, so never broadcast.select("word", "to", "freq").distinct()
    swapped = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.substring("word", i + 1, F.lit(1)), F.substring("word", i, F.lit(1)), F.substring("word", i + 2, F.length("word"))))
    near = pairs.where((F.levenshtein("word", "to") <= 1) | F.array_contains(swapped, F.col("to")))
    best = near.withColumn("n", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("freq"), "to"))).where("n = 1")
    return unknown.join(best.select("word", F.col("to").alias("correction")), "word").select("doc_id", "word", "correction")
