"""Read-outs per document: sentence lengths, densities, balance; document type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import lexicons as lx
from marginalia.functions.text import sentence_array, words


def lexical_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, hedges, boosters, self_mentions, nominals) over lower-cased tokens."""
    low = docs.select("doc_id", F.transform(words(F.col("text")), F.lower).alias("w"))
    suffix = rf"(?:{'|'.join(lx.NOMINAL_SUFFIXES)})$"

    def n(test) -> Column:
        return F.size(F.filter("w", test)).cast("long")

    return low.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        n(lambda t: t.isin(lx.HEDGES)).alias("hedges"),
        n(lambda t: t.isin(lx.BOOSTERS)).alias("boosters"),
        n(lambda t: t.isin(lx.SELF_MENTIONS)).alias("self_mentions"),
        n(lambda t: (F.length(t) >= 7) & t.rlike(suffix) & ~t.isin(lx.NOMINAL_ALLOWED)).alias("nominals"),
    )


def balance(hedges: Column, boosters: Column) -> Column:
    """Hedges against boosters, in words."""
    ratio = F.format_string("%.1f", hedges / boosters)
    return (
        F.when((hedges == 0) & (boosters == 0), "flat")
        .when(boosters == 0, "hedge-only")
        .when(hedges == 0, "booster-only")
        .when(hedges >= boosters * 3, F.concat(F.lit("hedge-heavy "), ratio))
        .when(hedges * 3 <= boosters, F.concat(F.lit("booster-heavy "), ratio))
        .otherwise(F.concat(F.lit("balanced "), ratio))
    )


def document_metrics(docs: DataFrame) -> DataFrame:
    """Per document: sentences, words, mean sentence length, sentences over 40 words, densities per 100
    words, balance.  Rounding is half to even."""
    lengths = docs.select("doc_id", F.transform(F.filter(sentence_array(F.col("text")), lambda s: s.rlike(r"\S")), lambda s: F.size(words(s))).alias("n"))
    sents = lengths.select("doc_id", F.size("n").cast("long").alias("n_sentences"), F.size(F.filter("n", lambda k: k > 40)).cast("long").alias("n_over_40"))
    both = lexical_counts(docs).join(sents, "doc_id")

    def per_100(c: str) -> Column:
        return F.when(F.col("n_words") > 0, F.bround(F.col(c) * 100.0 / F.col("n_words"), 2)).otherwise(0.0)

    return both.select(
        "doc_id", "n_sentences", "n_words", "n_over_40",
        F.when(F.col("n_sentences") > 0, F.bround(F.col("n_words") * 1.0 / F.col("n_sentences"), 1)).otherwise(0.0).alias("mean_length"),
        *[per_100(c).alias(f"{c}_per_100") for c in ("hedges", "boosters", "self_mentions", "nominals")],
        balance(F.col("hedges"), F.col("boosters")).alias("balance"),
    )


def hedging_by_section(placed: DataFrame) -> DataFrame:
    """Hedges and boosters per 100 words of each section, of sentences with their section."""
    low = placed.select("doc_id", "section", F.transform(words(F.col("text")), F.lower).alias("w"))
    sums = low.groupBy("doc_id", "section").agg(
        F.sum(F.size("w")).alias("n_words"),
        F.sum(F.size(F.filter("w", lambda t: t.isin(lx.HEDGES)))).alias("hedges"),
        F.sum(F.size(F.filter("w", lambda t: t.isin(lx.BOOSTERS)))).alias("boosters"),
    )
    return sums.withColumn("per_100", F.when(F.col("n_words") > 0, F.round(F.col("hedges") * 100.0 / F.col("n_words"), 1)).otherwise(0.0))


def document_type(headings: DataFrame, docs: DataFrame) -> DataFrame:
    """Guess per document: thesis-chapter, manuscript, policy-brief or general."""
    flags = headings.groupBy("doc_id").agg(
        F.bool_or(F.col("level") == 0).alias("chapter"),
        F.bool_or(F.col("section") == "methods").alias("methods"),
        F.bool_or(F.col("section") == "results").alias("results"),
        F.bool_or(F.lower("title").rlike("policy|recommendation")).alias("policy"),
    )
    no = F.lit(False)
    guess = (
        F.when(F.coalesce("chapter", no) & F.coalesce("methods", no), "thesis-chapter")
        .when(F.coalesce("methods", no) & F.coalesce("results", no), "manuscript")
        .when(F.coalesce("policy", no) & ~F.coalesce("methods", no), "policy-brief")
        .otherwise("general")
    )
    return docs.select("doc_id").join(flags, "doc_id", "left").select("doc_id", guess.alias("document_type"))
