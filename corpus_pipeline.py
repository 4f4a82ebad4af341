"""The corpus pipeline: toxicity, line dedup, near-duplicates, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import toxicity
from marginalia.llm.line_dedup import drop_recurring_lines
from marginalia.llm.mixing import mix
from marginalia.llm.neardup import near_duplicates
from marginalia.llm.packing import pack_documents
from marginalia.llm.store import crc_mod, cut, table, unused


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches their language's threshold go.  The model learns from the same
    rows as query op6 does.

    Null and empty texts have the score of a text without words; a null language has the threshold of all.
    Each repeated row is judged alike.  If all labels learned are of one class nothing goes.  An empty
    table stays empty; other columns stay, whatever their names.
    """
    labels = table(spark, sf_dir, "labels").where(crc_mod(F.col("doc_id"), 5) != 0)
    model = toxicity.train(table(spark, sf_dir, "documents"), labels)
    score = unused("_score", docs)
    return toxicity.scored(docs, model, score_col=score).where(F.col(score) < toxicity.threshold(model)).drop(score)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines leave the texts; no row goes, and ``n_chars`` counts anew.

    Null texts stay null (as their ``n_chars``), texts all of whose lines go become empty.  Repeated rows
    are treated alike and count once.  An empty table stays empty; other columns stay.
    """
    found = drop_recurring_lines(docs)
    return found.drop(found.columns[-1]).withColumn("n_chars", F.length("text").cast("long"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one of the least id.

    Texts that are null or without words are in no group and stay, as do rows of a null id.  Of several
    rows with one id one stays.  An empty table stays empty; other columns stay.
    """
    theirs = unused("_id", docs)
    gone = cut(near_duplicates(docs).where("not kept").select(F.col("doc_id").alias(theirs)).distinct())
    kept = docs.join(gone, docs["doc_id"] == F.col(theirs), "left_anti")
    again = cut(docs.where("doc_id is not null").groupBy(F.col("doc_id").alias(theirs)).agg(F.count("*").alias("n")).where("n > 1").select(theirs))
    once = kept.join(again, kept["doc_id"] == F.col(theirs), "left_anti")
    return once.unionByName(kept.join(again, kept["doc_id"] == F.col(theirs), "left_semi").dropDuplicates(["doc_id"]))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, or left out, so that sources come near their targets.

    A null source is a source.  Texts without words are taken as often as their neighbours in the seeded
    order.  Rows that share id and source go together.  An empty table stays empty; other columns stay.
    """
    return mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in sequences: rows of ``pack_documents``, no longer those of documents.

    Null and word-less texts are one piece of no words; copies that mixing made are packed each.  An empty
    table gives no rows; other columns are not read.
    """
    return pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near-duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs


#: The classifier and the sketches have no SQL form; tests compare run() with brute force instead.
ORACLE_SQL = None
