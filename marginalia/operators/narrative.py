"""What each section of a paper does: its rhetorical moves, those that lack or stand out of order, and what an
abstract lacks.  Sentences bring doc_id, section, sent (from 0) and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import lexicons as lx
from marginalia.functions.text import either, either_word, sentence_array, settled, squeezed

#: An abstract of fewer characters cannot be judged.
LEAST = 300


def _by_section(sents: DataFrame) -> DataFrame:
    """One row a document and mapped section: per move of any schema the first sentence that makes it, with its
    quotation, and the section's first sentence with whether it makes none.  A move is looked for only in the
    sections that expect it; rows combine before the shuffle, which carries quotations, no texts."""
    low = settled(sents.where(F.col("section").isin(list(lx.SECTION_MOVES))), F.lower("text").alias("_low"))

    def makes(move: str, patterns: list[str]) -> Column:
        where = [s for s, ms in lx.SECTION_MOVES.items() if move in ms]
        return F.when(F.col("section").isin(where) & F.col("_low").rlike(either_word(patterns)), F.lit(move))

    made = settled(low, F.array_compact(F.array(*(makes(m, p) for m, p in lx.MOVE_SIGNALS.items()))).alias("_made"))
    at = F.struct("sent", squeezed(F.col("text")).alias("evidence"))
    first = [F.min(F.when(F.array_contains("_made", m), at)).alias(f"_{m}") for m in lx.MOVE_SIGNALS]
    return made.groupBy("doc_id", "section").agg(F.min(F.struct("sent", (F.size("_made") == 0).alias("bare"), squeezed(F.col("text")).alias("evidence"))).alias("_opening"), *first)


def rising_places(items: Column) -> Column:
    """From an array of (place, x), the places of a longest strictly rising run of picks of x, in order; of
    several as long, the one whose last pick comes first, then the one before it, and so on."""

    def longest(runs: Column) -> Column:
        most = F.array_max(F.transform(runs, F.size))
        return F.try_element_at(F.filter(runs, lambda r: F.size(r) == most), F.lit(1))

    def grow(done: Column, item: Column) -> Column:
        before = F.filter(done, lambda r: F.element_at(r, -1)["x"] < item["x"])
        return F.concat(done, F.array(F.concat(F.coalesce(longest(before), F.array().cast(run)), F.array(item))))

    run = "array<struct<place:int,x:int>>"
    runs = F.aggregate(items.cast(run), F.array().cast(f"array<{run}>"), grow)
    return F.coalesce(F.transform(longest(runs), lambda i: i["place"]), F.array().cast("array<int>"))


def narrative_map(sents: DataFrame) -> DataFrame:
    """A row for each move that a document's section should make: doc_id, section, place (from 1), move, status
    (present, missing, out_of_order), sent and evidence of the first sentence that makes it, and note: the later
    move that it comes after, or the earlier one that it comes before, where it is out of order.

    Order counts in abstract and introduction; out of order are the moves off a longest rising run, so one
    misplaced sentence is told once.  A section's first sentence that makes no move makes the opening one.
    """
    entry = "struct<place:int,move:string,sent:int,evidence:string>"

    def entries(section: str) -> Column:
        own = []
        for k, m in enumerate(lx.SECTION_MOVES[section]):
            at = F.col(f"_{m}")
            if lx.OPENING_MOVES.get(section) == m:
                at = F.when(F.col("_opening.bare"), F.struct("_opening.sent", "_opening.evidence")).otherwise(at)
            own.append(F.struct(F.lit(k + 1).alias("place"), F.lit(m).alias("move"), at["sent"].alias("sent"), at["evidence"].alias("evidence")).cast(entry))
        return F.array(*own)

    listed = F.lit(None).cast(f"array<{entry}>")
    for s in lx.SECTION_MOVES:
        listed = F.when(F.col("section") == s, entries(s)).otherwise(listed)
    rows = settled(_by_section(sents), listed.alias("_all"))
    rows = settled(rows, F.filter("_all", lambda e: e["sent"].isNotNull()).alias("_found"))
    rows = settled(rows, rising_places(F.transform("_found", lambda e: F.struct(e["place"].alias("place"), e["sent"].alias("x")))).alias("_kept"))
    ordered = F.col("section").isin(lx.ORDERED_SECTIONS)
    flat = rows.select("doc_id", "section", "_found", "_kept", F.inline("_all"))
    status = F.when(F.col("sent").isNull(), "missing").when(ordered & ~F.array_contains("_kept", F.col("place")), "out_of_order").otherwise("present")
    after = F.try_element_at(F.filter("_found", lambda e: (e["place"] > F.col("place")) & (e["sent"] < F.col("sent"))), F.lit(-1))["move"]
    before = F.try_element_at(F.filter("_found", lambda e: (e["place"] < F.col("place")) & (e["sent"] > F.col("sent"))), F.lit(1))["move"]
    told = flat.withColumn("status", status)
    note = F.when(F.col("status") == "out_of_order", F.coalesce(F.concat(F.lit("after "), after), F.concat(F.lit("before "), before), F.lit(""))).otherwise("")
    return told.select("doc_id", "section", "place", "move", "status", "sent", "evidence", note.alias("note"))


def move_map(sents: DataFrame) -> DataFrame:
    """Per document and mapped section: moves present and missing, in their order, and how many of the present
    ones are out of order."""
    rows = narrative_map(sents).groupBy("doc_id", "section").agg(F.array_sort(F.collect_list(F.struct("place", "move", "status"))).alias("m"))

    def names(missing: bool) -> Column:
        own = F.filter("m", lambda e: (e["status"] == "missing") == F.lit(missing))
        return F.array_join(F.transform(own, lambda e: e["move"]), ",")

    late = F.size(F.filter("m", lambda e: e["status"] == "out_of_order"))
    return rows.select("doc_id", "section", names(False).alias("present"), names(True).alias("missing"), late.alias("out_of_order"))


def moves(sents: DataFrame) -> DataFrame:
    """(doc_id, section, move, sent): first sentence of each expected move that a section makes."""
    return narrative_map(sents).where("sent is not null").select("doc_id", "section", "move", "sent")


def unmapped(sents: DataFrame) -> DataFrame:
    """Per document: how many sections are mapped, how many of their moves lack, and the sections that have no
    schema, by first sentence (front matter and references aside)."""
    known = F.col("section").isin(list(lx.SECTION_MOVES))
    here = sents.groupBy("doc_id", "section").agg(F.min("sent").alias("sent"))
    rest = F.collect_list(F.when(~known & ~F.col("section").isin("front", "references"), F.struct("sent", "section")))
    per = here.groupBy("doc_id").agg(F.count_if(known).alias("n_mapped"), F.array_join(F.transform(F.array_sort(rest), lambda s: s["section"]), ",").alias("unmapped"))
    lacks = narrative_map(sents).groupBy("doc_id").agg(F.count_if(F.col("status") == "missing").alias("n_missing"))
    return per.join(lacks, "doc_id", "left").na.fill(0, ["n_missing"]).select("doc_id", "n_mapped", "n_missing", "unmapped")


def abstract_lens(docs: DataFrame) -> DataFrame:
    """AB802: (doc_id, start, end, missing) of abstracts of LEAST characters or more that lack a move.

    ``docs``: doc_id, text and sections (``with_sections``).  An abstract goes from its first heading to the next
    of another section; each move is looked for in its sentences, and its opening is known where the first
    sentence tells neither aim nor methods.  The span is the first sentence (at most 200 characters, if it has
    no end).  All in the row; null texts have no abstract.
    """
    begin = F.array_min(F.transform(F.filter("sections", lambda h: h["section"] == "abstract"), lambda h: h["start"]))
    rows = settled(docs.select("doc_id", "text", "sections"), begin.alias("_a")).where("_a is not null")
    stop = F.array_min(F.transform(F.filter("sections", lambda h: (h["start"] > F.col("_a")) & (h["section"] != "abstract")), lambda h: h["start"]))
    body = F.substring("text", F.col("_a") + 1, F.coalesce(stop, F.length("text")) - F.col("_a"))
    rows = settled(rows, body.alias("_body")).drop("text", "sections")
    lead = F.length("_body") - F.length(F.regexp_replace("_body", r"^\s+", ""))
    rows = settled(rows, (F.col("_a") + lead).alias("start"), F.regexp_replace("_body", r"^\s+|\s+$", "").alias("_own")).where(F.length("_own") >= LEAST)
    rows = settled(rows, sentence_array(F.lower("_own")).alias("_sents"))
    first = F.element_at("_sents", 1)

    def told(patterns: list[str]) -> Column:
        return F.exists("_sents", lambda s: s.rlike(either_word(patterns)))

    has = {m: told(ps) for m, ps in lx.ABSTRACT_SIGNALS.items()}
    has["background"] = ~first.rlike(either(lx.ABSTRACT_SIGNALS["aim"] + lx.ABSTRACT_SIGNALS["methods"]))
    lacks = F.array_join(F.array_compact(F.array(*(F.when(~has[m], F.lit(m)) for m in lx.ABSTRACT_MOVES))), ",")
    sentence = F.length(F.regexp_extract("_own", r"(?s)^.*?[.!?](?:\s|$)", 0))
    end = F.col("start") + F.when(sentence > 0, sentence).otherwise(F.least(F.length("_own"), F.lit(200)))
    return rows.select("doc_id", F.col("start").cast("int").alias("start"), end.cast("int").alias("end"), lacks.alias("missing")).where("missing <> ''")
