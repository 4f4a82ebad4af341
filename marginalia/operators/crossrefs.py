"""Floats, mentions and the checks on them over sources that ``latex.latex_documents`` has read, with chapters.

A number is an array: [3], or [chapter, 3] in a document with chapters; a lettered appendix stands at 100 and
more, so A.4 is [100, 4].  Arrays sort as the numbers do.  Places of one document meet by running windows over
it in order of place (a point belongs to the last span that began), never by pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import tex
from marginalia.functions.text import matches
from marginalia.operators import latex
from marginalia.operators.sections import resolve_sections, section_at
from marginalia.sources.shared import stored

LETTERED = 100
MOST_BETWEEN = 50
# --- fixed values: written numbers, mentions and what excuses them ---
NUMBER = r"(?:[A-Z]\.\d+|[SA]\d+|\d+(?:\.\d+)?)[a-z]?"
MENTION = rf"\b(?:Fig(?:ure)?s?\.?|Tables?)~?\s*{NUMBER}(?:\s*(?:,|and|&|–|—|-|to)\s*{NUMBER})*"
PART = rf"{NUMBER}|–|—|-|to\b"
RANGE = r"^\s*(?:-{1,3}|–|—|to)\s*$"
ELSEWHERE = r"^\s*(?:of|in|from)\s+(?:ref\b|refs?\.|\[|\(|[A-Z][A-Za-z'-]+\s+et\s+al)"
RUN_IN_CAPTION = rf"\b(?:Fig(?:ure)?\.?|Table)\s+{NUMBER}\s*:\s*\S"
APPENDIX = r"(?m)^(?:[^%\n\\]++|\\(?!appendix\b).)*+\\appendix\b"
NUMBER_TYPE = "array<int>"


def number_text(number: Column) -> Column:
    """[2, 4] as 2.4, [100, 4] as A.4; ? without a number."""
    first = F.element_at(number, 1)
    head = F.when(first >= LETTERED, F.chr((first - LETTERED + 65).cast("long"))).otherwise(first.cast("string"))
    rest = F.transform(F.slice(number, 2, F.greatest(F.size(number) - 1, F.lit(0))), lambda x: x.cast("string"))
    return F.when(F.size(number) > 0, F.array_join(F.concat(F.array(head), rest), ".")).otherwise("?")


def parsed_number(part: Column) -> Column:
    """The number a part of a listing writes, its panel letter dropped; null for S1, A2 and separators."""
    bare = F.regexp_replace(part, r"[a-z]$", "")
    lettered = F.array((F.ascii(bare) - 65 + LETTERED).cast("int"), F.substring_index(bare, ".", -1).cast("int"))
    return F.when(bare.rlike(r"^[A-Z]\.\d+$"), lettered).when(bare.rlike(r"^\d+(?:\.\d+)?$"), F.transform(F.split(bare, r"\."), lambda x: x.cast("int")))


def listed_numbers(listing: Column) -> Column:
    """All numbers of "1, 3-5 and 7"; a range of whole numbers names those between its ends too."""
    parts = F.regexp_extract_all(listing, F.lit(PART), F.lit(0))

    def named(p: Column, i: Column) -> Column:
        n, before = parsed_number(p), parsed_number(F.try_element_at(parts, F.when(i > 1, (i - 1).cast("int"))))
        mark = F.when(i > 1, F.try_element_at(parts, F.when(i > 1, i.cast("int")))).isin("–", "—", "-", "to")
        a, b = F.element_at(before, 1), F.element_at(n, 1)
        spread = mark & (F.size(n) == 1) & (F.size(before) == 1) & (b > a) & (b - a < MOST_BETWEEN)
        return F.when(n.isNull(), F.array().cast(f"array<{NUMBER_TYPE}>")).when(F.coalesce(spread, F.lit(False)), F.transform(F.sequence(a + 1, b), lambda k: F.array(k))).otherwise(F.array(n))

    return F.flatten(F.transform(parts, named))


def inside(points: DataFrame, spans: DataFrame, name: str) -> DataFrame:
    """``points`` (doc_id, start, ...) with the start of the span of ``spans`` (doc_id, start, end) that holds
    them, or null.  Spans of one document do not overlap: the last that began is the only candidate."""
    columns = points.columns
    marked = points.withColumn("_p", F.struct(*columns)).select("doc_id", "start", F.lit(1).alias("_k"), "_p", F.lit(None).cast("struct<start:int,end:int>").alias("_s"))
    begun = spans.select("doc_id", "start", F.lit(0).alias("_k"), F.lit(None).cast(marked.schema["_p"].dataType).alias("_p"), F.struct("start", "end").alias("_s"))
    before = Window.partitionBy("doc_id").orderBy("start", "_k").rowsBetween(Window.unboundedPreceding, 0)
    held = marked.unionByName(begun).withColumn("_s", F.last("_s", ignorenulls=True).over(before)).where("_p is not null")
    return held.select("_p.*", F.when(F.col("_s.end") > F.col("start"), F.col("_s.start")).alias(name))


def floats(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, start, end, label, cap_start, cap_end, number, appendix) of floats: figure and table
    environments, and captions given by \\captionof.  Those with a caption are numbered in order per kind and
    chapter.  A float's caption is the one that shares its label, else its last."""
    caps = docs.select("doc_id", "text", F.explode(F.filter("items", lambda i: i["kind"] == "caption")).alias("i"))
    head = F.substring("text", F.col("i.start") + 1, F.lit(40))
    caps = caps.select(
        "doc_id",
        F.col("i.start").alias("start"),
        F.col("i.end").alias("end"),
        F.col("i.label").alias("label"),
        F.nullif(F.regexp_extract(head, r"^\\captionof\s*\{(figure|table)\}", 1), F.lit("")).alias("of"),
        (head.startswith("\\caption") & ~head.rlike(r"^\\caption(?:of|setup|\*)")).alias("main"),
    )
    rows = latex.items(docs)
    environments = rows.where("kind in ('figure', 'table')")
    held = inside(caps.where("main"), environments, "f_start").where("f_start is not null")
    best = held.join(environments.select("doc_id", F.col("start").alias("f_start"), F.col("label").alias("f_label")), ["doc_id", "f_start"])
    best = best.groupBy("doc_id", F.col("f_start").alias("start")).agg(
        F.coalesce(F.min(F.when(F.col("label") == F.col("f_label"), F.struct("start", "end", "label"))), F.max(F.struct("start", "end", "label"))).alias("c")
    )
    own = environments.join(best, ["doc_id", "start"], "left").select("doc_id", "kind", "start", "end", F.coalesce("label", "c.label").alias("label"), F.col("c.start").alias("cap_start"), F.col("c.end").alias("cap_end"))
    given = caps.where("of is not null").select("doc_id", F.col("of").alias("kind"), "start", "end", "label", F.col("start").alias("cap_start"), F.col("end").alias("cap_end"))
    return numbered(own.unionByName(given), docs)


def numbered(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Two-level running counts: chapters before a float, then captioned floats of its kind in that chapter."""
    chapters = docs.select("doc_id", F.explode(F.filter("headings", lambda h: h["level"] == 0)).alias("h")).select("doc_id", F.col("h.start").alias("start"))
    order = Window.partitionBy("doc_id").orderBy("start", "_k").rowsBetween(Window.unboundedPreceding, 0)
    both = found.withColumn("_k", F.lit(1)).unionByName(chapters.withColumn("_k", F.lit(0)), allowMissingColumns=True)
    both = both.withColumns({"chapter": F.count_if(F.col("_k") == 0).over(order), "_any": F.max(F.when(F.col("_k") == 0, F.lit(True))).over(Window.partitionBy("doc_id"))}).where("_k = 1")
    within = F.count("cap_start").over(Window.partitionBy("doc_id", "kind", "chapter").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    number = F.when(F.col("_any"), F.array(F.col("chapter").cast("int"), within)).otherwise(F.array(within))
    both = both.withColumn("number", F.when(F.col("cap_start").isNotNull(), number))
    begins = docs.select("doc_id", F.try_element_at(matches(F.col("text"), APPENDIX), F.lit(1))["end"].alias("_appendix"))
    both = section_at(both, resolve_sections(latex.headings(docs))).join(begins, "doc_id")
    appendix = (F.col("section") == "appendix") | F.coalesce(F.col("start") >= F.col("_appendix"), F.lit(False))
    return both.select("doc_id", "kind", "start", "end", "label", "cap_start", "cap_end", "number", appendix.alias("appendix"))


def labels(docs: DataFrame) -> DataFrame:
    return latex.items(docs).where("label is not null and kind in ('label', 'figure', 'table', 'equation', 'caption')").select("doc_id", "label").distinct()


def references(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, key, label): references by label; label is the one named, itself or with a prefix
    that a style adds, and null where none is defined."""
    refs = latex.items(docs).where("kind = 'ref'").select("doc_id", "start", "end", F.col("label").alias("key"))
    options = F.array(F.col("key"), *[F.concat(F.lit(p), F.col("key")) for p in tex.LABEL_PREFIXES])
    tries = refs.select("doc_id", "key").distinct().select("doc_id", "key", F.posexplode(options).alias("choice", "label"))
    named = tries.join(labels(docs), ["doc_id", "label"]).groupBy("doc_id", "key").agg(F.min_by("label", "choice").alias("label"))
    return refs.join(named, ["doc_id", "key"], "left").select("doc_id", "start", "end", "key", "label")


def reference_ranges(docs: DataFrame, fl: DataFrame) -> DataFrame:
    """(doc_id, kind, number, start): floats between the ends of a range of references."""
    refs = F.filter("items", lambda i: i["kind"] == "ref")
    pairs = docs.select("doc_id", "masked", refs.alias("r")).select("doc_id", "masked", F.explode(F.transform("r", lambda a, i: F.struct(a.alias("a"), F.try_element_at("r", i + 2).alias("b")))).alias("p"))
    gap = F.substring("masked", F.col("p.a.end") + 1, F.col("p.b.start") - F.col("p.a.end"))
    pairs = pairs.where((F.col("p.b.start") - F.col("p.a.end") <= 40) & gap.rlike(RANGE)).select("doc_id", F.col("p.a.start").alias("start"), F.col("p.a.label").alias("ka"), F.col("p.b.label").alias("kb"))
    known = references(docs).where("label is not null").select("doc_id", "key", "label").distinct()
    f = fl.where("number is not null").select("doc_id", "label", "kind", "number").join(known, ["doc_id", "label"]).select("doc_id", "key", "kind", "number")
    ends = pairs.join(f.select("doc_id", F.col("key").alias("ka"), "kind", F.col("number").alias("na")), ["doc_id", "ka"]).join(f.select("doc_id", F.col("key").alias("kb"), "kind", F.col("number").alias("nb")), ["doc_id", "kb", "kind"])
    first, a, b = F.slice("na", 1, F.size("na") - 1), F.element_at("na", -1), F.element_at("nb", -1)
    ends = ends.where((F.slice("nb", 1, F.size("nb") - 1) == first) & (b - a > 1))
    return ends.select("doc_id", "kind", F.explode(F.transform(F.sequence(a + 1, b - 1), lambda k: F.concat(first, F.array(k)))).alias("number"), "start").distinct()


def written(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, kind, numbers, after): mentions written by number, with the masked text after them."""
    found = docs.select("doc_id", "masked", F.explode(matches(F.col("masked"), MENTION)).alias("m"))
    listing = F.regexp_replace("m.text", r"^[A-Za-z]+\.?~?\s*", "")
    kind = F.when(F.col("m.text").startswith("Tab"), "table").otherwise("figure")
    rows = found.select("doc_id", F.col("m.start").alias("start"), F.col("m.end").alias("end"), kind.alias("kind"), listed_numbers(listing).alias("numbers"), F.substring("masked", F.col("m.end") + 1, F.lit(60)).alias("after"))
    return rows.where(F.size("numbers") > 0)


def mentions(docs: DataFrame, fl: DataFrame) -> DataFrame:
    """(doc_id, start, kind, number, cap): floats the source mentions, by label, range or number; ``cap`` is the
    start of the caption the mention stands in, null in running text.  Table bodies hold no prose, so none."""
    by_label = references(docs).join(fl.where("number is not null").select("doc_id", "label", "kind", "number"), ["doc_id", "label"]).select("doc_id", "start", "kind", "number")
    by_number = written(docs).select("doc_id", "start", "kind", F.explode("numbers").alias("number"))
    by_number = by_number.join(fl.select("doc_id", "kind", "number").where("number is not null").distinct(), ["doc_id", "kind", "number"])
    said = by_label.unionByName(reference_ranges(docs, fl)).unionByName(by_number.select("doc_id", "start", "kind", "number"))
    return inside(said, _captions(docs), "cap")


def _captions(docs: DataFrame) -> DataFrame:
    return latex.items(docs).where("kind = 'caption'").select("doc_id", "start", "end")


def _out(df: DataFrame, rule_id: str, end: str) -> DataFrame:
    return df.select("doc_id", F.lit(rule_id).alias("rule_id"), "start", F.col(end).cast("int").alias("end"), "what")


def _name(kind: str = "kind", number: str = "number") -> Column:
    return F.concat(F.initcap(kind), F.lit(" "), number_text(F.col(number)))


def uncited_floats(docs: DataFrame) -> DataFrame:
    """X101: numbered floats that neither the text nor another float's caption mentions."""
    fl = stored(floats(docs))
    said = mentions(docs, fl).join(fl.select("doc_id", "kind", "number", "cap_start"), ["doc_id", "kind", "number"]).where("cap is null or cap <> cap_start")
    left = fl.where("number is not null").join(said.select("doc_id", "kind", "number").distinct(), ["doc_id", "kind", "number"], "left_anti")
    return _out(left.withColumn("what", _name()).drop("start").withColumnRenamed("cap_start", "start"), "X101", "cap_end")


def cited_out_of_order(docs: DataFrame) -> DataFrame:
    """X102: floats first mentioned after one of a higher number of their kind and chapter.  Floats of an
    appendix may come in any order."""
    fl = stored(floats(docs))
    said = mentions(docs, fl).where("cap is null").join(fl.where("not appendix").select("doc_id", "kind", "number"), ["doc_id", "kind", "number"], "left_semi")
    first = said.groupBy("doc_id", "kind", "number").agg(F.min("start").alias("start"))
    group = first.withColumn("scope", F.slice("number", 1, F.size("number") - 1))
    top = F.max("number").over(Window.partitionBy("doc_id", "kind", "scope").orderBy("start", "number").rowsBetween(Window.unboundedPreceding, -1))
    late = group.withColumn("top", top).where("number < top")
    return _out(late.withColumn("what", F.concat(_name(), F.lit(" after "), _name(number="top"))), "X102", "start")


def broken_references(docs: DataFrame) -> DataFrame:
    """X103: labels that are not defined, and numbers that no float has, where the document has floats of the
    kind and chapter.  Figures of other works, and captions run into a paragraph, are no faults."""
    undefined = references(docs).where("label is null").select("doc_id", "start", "end", F.col("key").alias("what"))
    fl = stored(floats(docs).where("number is not null").select("doc_id", "kind", "number"))
    scopes = fl.select("doc_id", "kind", F.slice("number", 1, F.size("number") - 1).alias("scope")).distinct()
    said = inside(written(docs).where(~F.col("after").rlike(ELSEWHERE)), _captions(docs), "cap").where("cap is null")
    each = said.select("doc_id", "start", "end", "kind", F.posexplode("numbers").alias("i", "number"))
    each = each.withColumn("scope", F.slice("number", 1, F.size("number") - 1)).join(scopes, ["doc_id", "kind", "scope"], "left_semi")
    run_in = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN_IN_CAPTION), F.lit(0))).alias("c"))
    run_in = run_in.select("doc_id", F.when(F.col("c").startswith("Tab"), "table").otherwise("figure").alias("kind"), parsed_number(F.regexp_extract("c", rf"({NUMBER})\s*:\s*\S$", 1)).alias("number")).where("number is not null").distinct()
    missing = each.join(fl, ["doc_id", "kind", "number"], "left_anti").join(run_in, ["doc_id", "kind", "number"], "left_anti")
    missing = missing.groupBy("doc_id", "start", "end", "kind").agg(F.min_by("number", "i").alias("number"))
    return _out(undefined.unionByName(missing.select("doc_id", "start", "end", _name().alias("what"))), "X103", "end")
