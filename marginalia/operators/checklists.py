"""Published reporting checklists: which fits a text, and which of its items the text reports, and where."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import checklists as lists
from marginalia.functions.text import either, sentence_spans, settled, squeezed
from marginalia.operators.sections import section_in, with_sections


def suggested(text: Column) -> Column:
    """The checklist the text's own words point to, or null; the most specific kind of study wins."""
    out = F.lit(None).cast("string")
    for name, cue in reversed(lists.CUES.items()):
        out = F.when(text.rlike(f"(?i){cue}"), F.lit(name)).otherwise(out)
    return out


def listing() -> list[tuple[str, int, str, list[str]]]:
    """(checklist, place, item, sections) of every item."""
    return [(c, k, item, where) for c, items in lists.ITEMS.items() for k, (item, _, where) in enumerate(items, 1)]


def _by_checklist(checklist: Column, kind: str, value) -> Column:
    out = F.array().cast(f"array<{kind}>")
    for name, items in lists.ITEMS.items():
        out = F.when(checklist == name, value(items)).otherwise(out)
    return out


def _hits(items: list, text: Column) -> Column:
    def one(k: int, item: str, signals: list[str], where: list[str]) -> Column:
        sections = F.array(*map(F.lit, where)).cast("array<string>")
        return F.when(text.rlike("(?i)" + either(signals)), F.struct(F.lit(k).alias("place"), sections.alias("sections")))

    return F.array_compact(F.array(*(one(k, *item) for k, item in enumerate(items, 1))))


def report(docs: DataFrame, checklist: str | None = None) -> DataFrame:
    """(doc_id, checklist, place, item, status, evidence): the first sentence that reports each item, among
    the item's sections that the document has (all of it, if it has none of them).  An item that no signal
    finds is 'needs_check', never missing.  Documents that no checklist fits give no rows, unless one is
    named.  Sentences are judged in the row, by the items of their document's checklist only; what is
    shuffled is the evidence, a short quotation an item."""
    fit = F.lit(checklist) if checklist else suggested(F.col("text"))
    fitting = settled(docs.select("doc_id", "text"), fit.alias("checklist")).where("checklist is not null")
    spans = settled(with_sections(fitting), sentence_spans(F.col("text")).alias("_all"))
    placed = F.transform("_all", lambda s: F.struct(section_in(F.col("sections"), s["start"]).alias("section"), s["text"].alias("text")))
    there = settled(settled(spans, placed.alias("_placed")), F.array_distinct(F.col("_placed.section")).alias("_there"))
    sents = there.select("doc_id", "checklist", "_there", F.posexplode("_placed").alias("sent", "s")).select("doc_id", "checklist", "_there", "sent", "s.*")
    found = sents.select("*", F.explode(_by_checklist(F.col("checklist"), "struct<place:int,sections:array<string>>", lambda items: _hits(items, F.col("text")))).alias("h"))
    inside = F.array_contains("h.sections", F.col("section")) | ~F.arrays_overlap("h.sections", "_there")
    first = found.where(inside).groupBy("doc_id", F.col("h.place").alias("place")).agg(F.min_by(squeezed(F.col("text")), "sent").alias("evidence"))
    items = _by_checklist(F.col("checklist"), "struct<place:int,item:string>", lambda items: F.array(*(F.struct(F.lit(k).alias("place"), F.lit(i[0]).alias("item")) for k, i in enumerate(items, 1))))
    grid = fitting.select("doc_id", "checklist", F.explode(items).alias("i")).select("doc_id", "checklist", "i.*")
    status = F.when(F.col("evidence").isNotNull(), "reported").otherwise("needs_check")
    return grid.join(first, ["doc_id", "place"], "left").select("doc_id", "checklist", "place", "item", status.alias("status"), "evidence")


def summary(reported: DataFrame) -> DataFrame:
    """Per document: how many items of how many were found in the text."""
    n = F.count_if(F.col("status") == "reported")
    return reported.groupBy("doc_id", "checklist").agg(n.alias("reported"), F.count("*").alias("total"))
