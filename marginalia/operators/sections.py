"""Headings, sections, and what lies in which section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import lexicons as lx
from marginalia.functions.text import mask_spans, matches, once, settled

#: A line of letters that may be a heading in plain text.
PLAIN_HEADING = r"(?m)^[A-Z][A-Za-z &\-]{2,60}[ \t]*$"
MARKDOWN_HEADING = r"(?m)^#{1,6}[ \t]+[^\n{]+"
LATEX_LEVELS = "part chapter section subsection subsubsection paragraph subparagraph".split()
LATEX_HEADING = r"\\(?:" + "|".join(LATEX_LEVELS) + r")\*?\{[^{}]+\}"
UNHEADED = ["unknown", "front", "other"]


def classify_heading(title: Column) -> Column:
    """Section a heading names, by the first pattern that matches; 'other' for topical headings."""

    def named(low: Column) -> Column:
        out = F.lit("other")
        for pattern, name in reversed(lx.SECTION_PATTERNS):
            out = F.when(low.rlike(pattern), name).otherwise(out)
        return out

    return once(F.lower(title), named)


def is_section_name(title: Column) -> Column:
    """Only words of section names, numbered or not."""
    bare = F.regexp_replace(F.lower(title), lx.NUMBERING, "")
    own = F.array_except(F.regexp_extract_all(bare, F.lit("[a-z]+"), F.lit(0)), F.array(*map(F.lit, lx.SECTION_NAME_FILLER)))
    return (F.size(own) > 0) & (F.size(F.array_except(own, F.array(*map(F.lit, lx.SECTION_NAME_WORDS)))) == 0)


def plain_headings(docs: DataFrame) -> DataFrame:
    """(doc_id, start, title, keyword, level) of short lines that name a known section."""
    found = docs.select("doc_id", F.explode(matches(F.col("text"), PLAIN_HEADING)).alias("m"))
    titled = found.select("doc_id", F.col("m.start").alias("start"), F.rtrim(F.col("m.text")).alias("title"))
    return titled.withColumn("keyword", classify_heading(F.col("title"))).where("keyword <> 'other' and not contains(title, '   ')").withColumn("level", F.lit(None).cast("int"))


def markdown_title(line: Column) -> tuple[Column, Column]:
    """Title and level."""
    return F.trim(F.regexp_replace(line, "^#+", "")), F.length(F.regexp_extract(line, "^#+", 0))


def markdown_headings(docs: DataFrame) -> DataFrame:
    found = docs.select("doc_id", F.explode(matches(F.col("text"), MARKDOWN_HEADING)).alias("m"))
    title, level = markdown_title(F.col("m.text"))
    titled = found.select("doc_id", F.col("m.start").alias("start"), title.alias("title"), level.alias("level"))
    return titled.where("title <> ''").withColumn("keyword", classify_heading(F.col("title"))).select("doc_id", "start", "title", "keyword", "level")


def latex_title(command: Column) -> tuple[Column, Column]:
    """Title and level, a part's being -1."""
    level = F.array_position(F.array(*map(F.lit, LATEX_LEVELS)), F.regexp_extract(command, r"^\\([a-z]+)", 1)).cast("int") - 2
    return F.trim(F.regexp_extract(command, r"\{([^{}]+)\}", 1)), level


def latex_headings(docs: DataFrame) -> DataFrame:
    found = docs.select("doc_id", F.explode(matches(F.col("text"), LATEX_HEADING)).alias("m"))
    title, level = latex_title(F.col("m.text"))
    titled = found.select("doc_id", F.col("m.start").alias("start"), title.alias("title"), level.alias("level"))
    return titled.withColumn("keyword", classify_heading(F.col("title"))).select("doc_id", "start", "title", "keyword", "level")


def resolve_sections(headings: DataFrame) -> DataFrame:
    """Adds section: nested headings inherit their parent's where they name none of their own, or where
    the parent is a plain section name and they are not.  A heading without level stands alone.

    The fold runs over one document's headings in order, carrying the open ones as a stack.
    """
    one = F.struct("start", "title", "keyword", "level", is_section_name(F.col("title")).alias("named"))
    listed = headings.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("hs"))
    return listed.select("doc_id", F.explode(_nested(F.col("hs"))).alias("h")).select("doc_id", "h.*")


def _nested(headings: Column) -> Column:
    """Headings of one document (start, title, keyword, level, named), in order, with their sections."""
    frame = "array<struct<level:int,section:string,sure:boolean>>"
    result = "array<struct<start:int,title:string,keyword:string,level:int,section:string>>"

    def step(state: Column, h: Column) -> Column:
        open_ = F.when(h["level"].isNull(), F.array().cast(frame)).otherwise(F.filter(state["open"], lambda f: f["level"] < h["level"]))
        top = F.try_element_at(open_, F.lit(-1))
        alone = top.isNull() | (top["section"] == "other")
        inherits = ~alone & ((h["keyword"] == "other") | (top["sure"] & ~h["named"]))
        section = F.when(inherits, top["section"]).otherwise(h["keyword"])
        sure = F.when(~alone & (h["keyword"] == "other"), top["sure"]).when(inherits, F.lit(True)).otherwise(h["named"])
        pushed = F.when(h["level"].isNull(), open_).otherwise(F.concat(open_, F.array(F.struct(h["level"].alias("level"), section.alias("section"), sure.alias("sure")))))
        out = F.struct(h["start"].alias("start"), h["title"].alias("title"), h["keyword"].alias("keyword"), h["level"].alias("level"), section.alias("section"))
        return F.struct(pushed.alias("open"), F.concat(state["out"], F.array(out)).alias("out"))

    start = F.struct(F.array().cast(frame).alias("open"), F.array().cast(result).alias("out"))
    return F.aggregate(headings, start, step)["out"]


SECTIONS = "array<struct<start:int,section:string>>"


def plain_sections(text: Column) -> Column:
    """The headings of plain text inside the row, in order: (start, section).  A heading without level
    stands alone, so no fold over open ones is needed."""
    found = F.transform(matches(text, PLAIN_HEADING), lambda m: F.struct(m["start"].alias("start"), F.rtrim(m["text"]).alias("title")))
    named = F.transform(found, lambda h: F.struct(h["start"].alias("start"), F.when(~F.contains(h["title"], F.lit("   ")), classify_heading(h["title"])).otherwise("other").alias("section")))
    return F.filter(named, lambda h: h["section"] != "other").cast(SECTIONS)


def marked_sections(text: Column, kind: str) -> Column:
    """The headings that a kind's markup tells, inside the row, in order: (start, section); nested ones take
    their parent's section as in ``resolve_sections``.  Plain and HTML texts have those of ``plain_sections``."""
    if kind not in ("markdown", "latex"):
        return plain_sections(text)

    def heading(m: Column) -> Column:
        title, level = (markdown_title if kind == "markdown" else latex_title)(m["text"])
        return F.struct(m["start"].alias("start"), title.alias("title"), classify_heading(title).alias("keyword"), level.alias("level"), is_section_name(title).alias("named"))

    found = F.filter(F.transform(matches(text, MARKDOWN_HEADING if kind == "markdown" else LATEX_HEADING), heading), lambda h: h["title"] != "")
    return F.transform(_nested(found), lambda h: F.struct(h["start"].alias("start"), h["section"].alias("section"))).cast(SECTIONS)


def section_in(sections: Column, at: Column) -> Column:
    """As-of look-up inside the row: the section of the last heading not after ``at``; 'front' before the
    first heading, 'unknown' without any.  Nothing is shuffled."""
    last = F.try_element_at(F.filter(sections, lambda h: h["start"] <= at), F.lit(-1))["section"]
    return F.coalesce(last, F.when(F.size(sections) > 0, "front").otherwise("unknown"))


def with_sections(docs: DataFrame) -> DataFrame:
    """``docs`` and their plain headings as an array column."""
    return settled(docs, plain_sections(F.col("text")).alias("sections"))


def section_at(points: DataFrame, headings: DataFrame, at: str = "start", default: str | None = None) -> DataFrame:
    """As-of join for headings and points that come as tables.  The points' document meets its headings, a
    short list, in one row; the points themselves are joined with that list and looked up in the row."""
    listed = headings.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "section"))).alias("_sections"))
    found = points.join(listed, "doc_id", "left").withColumn("_sections", F.coalesce("_sections", F.array().cast(SECTIONS)))
    out = found.withColumn("section", section_in(F.col("_sections"), F.col(at))).select(*points.columns, "section")
    return out.withColumn("section", F.when(F.col("section").isin(UNHEADED), default).otherwise(F.col("section"))) if default else out


def gate(section: Column, only: Column, excluded: Column) -> Column:
    """Whether a rule speaks in a section; it does wherever the section is unknown."""
    inside = only.isNull() | F.array_contains(only, section)
    return (section == "unknown") | (inside & ~F.coalesce(F.array_contains(excluded, section), F.lit(False)))


def mask_references(text: Column, sections: Column) -> Column:
    """Blank each reference list, from its heading to the next heading of another section.  ``sections``:
    array of (start, section) in order."""
    def end_of(h: Column) -> Column:
        later = F.filter(sections, lambda g: (g["start"] > h["start"]) & (g["section"] != "references"))
        return F.coalesce(F.array_min(F.transform(later, lambda g: g["start"])), F.length(text))

    refs = F.filter(sections, lambda h: h["section"] == "references")
    some = F.exists(sections, lambda h: h["section"] == "references")
    return F.when(some, mask_spans(text, F.transform(refs, lambda h: F.struct(h["start"].alias("start"), end_of(h).alias("end"))))).otherwise(text)
