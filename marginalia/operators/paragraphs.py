"""Captions, tables and heading styles of word-processor documents, given as paragraphs: (doc_id, idx, start,
text, style, kind), kind 'body' or 'table', style in lower case without blanks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import lexicons as lx
from marginalia.functions.text import matches, space_tokens
from marginalia.operators.structure import MENTION, numbers

REACH = 400  # characters between a caption and its table
LONG_HEADING, LONG_TITLE = 25, 40  # words


def placed(paragraphs: DataFrame) -> DataFrame:
    """Adds start: two characters lie between paragraphs."""
    before = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return paragraphs.withColumn("start", F.coalesce(F.sum(F.length("text") + 2).over(before), F.lit(0)))


def captions(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, start, end, kind, number, styled): one caption a float.  Continued ones go; a typed one goes
    where a styled one, or a later typed one, has its number.  Entries of a list of figures are none."""
    text = F.col("text")
    typed = text.rlike(lx.CAPTION_TYPED) & ~text.rlike(lx.CAPTION_LISTED) & ~F.col("style").startswith("toc") & ~F.col("style").startswith("tableoffigures")
    rows = paragraphs.where((F.col("kind") == "body") & text.rlike(lx.CAPTION_HEAD) & ~text.rlike(lx.CAPTION_CONTINUED)).withColumn("styled", F.col("style") == "caption").where(F.col("styled") | typed)
    kind = F.when(F.regexp_extract(text, lx.CAPTION_HEAD, 1).startswith("Tab"), "table").otherwise("figure")
    found = rows.select("doc_id", "start", (F.col("start") + F.length(text)).alias("end"), kind.alias("kind"), F.regexp_extract(text, lx.CAPTION_HEAD, 2).cast("long").alias("number"), "styled")
    same = Window.partitionBy("doc_id", "kind", "number")
    kept = found.withColumns({"_any": F.max("styled").over(same), "_last": F.max("start").over(same)})
    return kept.where("styled or (not _any and start = _last)").drop("_any", "_last")


def claimed_tables(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, start, number, table_start, table_end): each table caption with the nearest table within REACH
    that no earlier caption took and no other caption stands before; below wins over above at one distance.

    The fold goes over one document's captions.  Only the caption before can have taken the table above, so
    the state is one number.
    """
    c = captions(paragraphs)
    listed = c.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind", "number"))).alias("caps"))
    tables = paragraphs.where("kind = 'table'").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("start"), (F.col("start") + F.length("text")).alias("end")))).alias("tabs"))
    both = listed.join(tables, "doc_id")

    def near(cap: Column, i: Column) -> Column:
        last = F.when(i > 0, F.try_element_at("caps", i)["start"])
        following = F.try_element_at("caps", i + 2)["start"]
        above = F.try_element_at(F.filter("tabs", lambda t: (t["end"] <= cap["start"]) & (last.isNull() | (last < t["end"]))), F.lit(-1))
        below = F.try_element_at(F.filter("tabs", lambda t: (t["start"] >= cap["end"]) & (following.isNull() | (following >= t["start"]))), F.lit(1))
        return F.struct(cap["start"].alias("start"), cap["end"].alias("end"), cap["kind"].alias("kind"), cap["number"].alias("number"), above.alias("above"), below.alias("below"))

    out = "array<struct<start:bigint,number:bigint,table_start:bigint,table_end:bigint>>"

    def step(state: Column, n: Column) -> Column:
        up = F.when((n["above"]["start"] != state["taken"]) & (n["start"] - n["above"]["end"] < REACH), n["start"] - n["above"]["end"])
        down = F.when(n["below"]["start"] - n["end"] < REACH, n["below"]["start"] - n["end"])
        pick = F.when(n["kind"] == "table", F.when(up.isNull() | (down <= up), F.when(down.isNotNull(), n["below"])).otherwise(n["above"]))
        row = F.array(F.struct(n["start"].cast("bigint"), n["number"].cast("bigint"), pick["start"].cast("bigint"), pick["end"].cast("bigint")))
        return F.struct(F.coalesce(pick["start"], state["taken"]).cast("bigint").alias("taken"), F.when(pick.isNotNull(), F.concat(state["out"], row.cast(out))).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(-1).cast("bigint").alias("taken"), F.array().cast(out).alias("out"))
    done = F.aggregate(F.transform("caps", near), start, step)["out"]
    return both.select("doc_id", F.explode(done).alias("c")).select("doc_id", "c.*")


def written_mentions(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, idx, start, end, kind, number) of mentions in running text: neither captions nor table cells."""
    body = paragraphs.where((F.col("kind") == "body") & (F.col("style") != "caption") & ~F.col("text").rlike(lx.CAPTION_TYPED))
    said = body.select("doc_id", "idx", F.col("start").alias("_at"), F.explode(matches(F.col("text"), MENTION)).alias("m"))
    kind = F.when(F.col("m.text").startswith("Tab"), "table").otherwise("figure")
    return said.select("doc_id", "idx", (F.col("_at") + F.col("m.start")).alias("start"), (F.col("_at") + F.col("m.end")).alias("end"), kind.alias("kind"), F.explode(numbers(F.col("m.text")).cast("array<long>")).alias("number"))


def floats_before_citation(paragraphs: DataFrame) -> DataFrame:
    """X104: styled captions whose float ends before the text first mentions it, outside appendices."""
    first = written_mentions(paragraphs).groupBy("doc_id", "kind", "number").agg(F.min("start").alias("first"))
    table = claimed_tables(paragraphs).select("doc_id", "start", "table_end")
    appendix = paragraphs.where(F.col("style").startswith("heading") & F.lower("text").rlike(r"^\s*appendi(?:x|ces)\b")).groupBy("doc_id").agg(F.min("start").alias("appendix"))
    c = captions(paragraphs).where("styled").join(first, ["doc_id", "kind", "number"]).join(table, ["doc_id", "start"], "left").join(appendix, "doc_id", "left")
    late = c.where((F.col("first") > F.greatest("end", F.coalesce("table_end", "end"))) & (F.col("appendix").isNull() | (F.col("start") < F.col("appendix"))))
    return late.select("doc_id", F.lit("X104").alias("rule_id"), "start", "end", F.concat_ws(" ", "kind", F.col("number").cast("string")).alias("text"))


def headings_on_body(paragraphs: DataFrame) -> DataFrame:
    """X501: paragraphs in a heading style (or title) that are too long for a heading."""
    n = F.size(space_tokens(F.col("text")))
    most = F.when(F.col("style").rlike(r"heading\d"), LONG_HEADING).otherwise(LONG_TITLE)
    hit = paragraphs.where((F.col("kind") == "body") & (F.contains("style", F.lit("heading")) | (F.col("style") == "title"))).withColumn("n_words", n).where(F.col("n_words") > most)
    return hit.select("doc_id", F.lit("X501").alias("rule_id"), "start", (F.col("start") + F.length("text")).alias("end"), "n_words")


def coverage(paragraphs: DataFrame) -> DataFrame:
    """Per document what was read: paragraphs, words of body text, table cells and headings."""
    body = F.col("kind") == "body"
    return paragraphs.groupBy("doc_id").agg(
        F.count("*").alias("n_paragraphs"),
        F.count_if(~body).alias("n_tables"),
        F.count_if(body & F.contains("style", F.lit("heading"))).alias("n_headings"),
        F.sum(F.when(body, F.size(space_tokens(F.col("text")))).otherwise(0)).alias("n_words"),
    )
