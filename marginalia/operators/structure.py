"""Floats, captions, mentions and labels of LaTeX sources, and the checks on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import lexicons as lx
from marginalia.functions.text import matches, settled

FLOAT = r"(?s)\\begin\{(?:figure|table)\*?\}.*?\\end\{(?:figure|table)\*?\}"
REF = r"\\(?:ref|autoref|cref|Cref|vref)\*?\{[^{}]+\}"
MENTION = r"\b(?:Fig(?:ure)?s?\.?|Tables?)~?\s*\d+(?:\.\d+)?(?:\s*(?:,|and|&|–|-|to)\s*\d+(?:\.\d+)?)*"
EQUATION = r"(?s)\\begin\{(?:equation|align|gather|multline|eqnarray)\}.*?\\end\{(?:equation|align|gather|multline|eqnarray)\}"
PREFIXES = ["fig:", "tab:", "eq:", "sec:"]


def floats(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, kind, caption, label, body, number): captioned floats are numbered in order by
    kind, others have no number."""
    found = docs.select("doc_id", F.explode(matches(F.col("text"), FLOAT)).alias("m")).select("doc_id", "m.*")
    rows = found.select(
        "doc_id", "start", "end",
        F.regexp_extract("text", r"\\begin\{(figure|table)", 1).alias("kind"),
        F.nullif(F.trim(F.regexp_extract("text", r"\\caption(?:\[[^\]]*\])?\{([^{}]*)\}", 1)), F.lit("")).alias("caption"),
        F.nullif(F.regexp_extract("text", r"\\label\{([^{}]+)\}", 1), F.lit("")).alias("label"),
        F.col("text").alias("body"),
    )
    running = F.count("caption").over(Window.partitionBy("doc_id", "kind").orderBy("start").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("number", F.when(F.col("caption").isNotNull(), running))


def numbers(listing: Column) -> Column:
    """Numbers of a list such as "1, 3-5 and 7", ranges of fewer than 50 expanded."""
    parts = F.regexp_extract_all(listing, F.lit(r"\d+\s*(?:–|-|to)\s*\d+|\d+"), F.lit(0))

    def expand(p: Column) -> Column:
        a, b = F.regexp_extract(p, r"^(\d+)", 1).cast("int"), F.regexp_extract(p, r"(\d+)$", 1).cast("int")
        return F.when((b > a) & (b - a < 50), F.sequence(a, b)).otherwise(F.array(a))

    return F.flatten(F.transform(parts, expand))


def mentions(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, kind, number, label): one row per number written or label referred to."""
    written = docs.select("doc_id", F.explode(matches(F.col("text"), MENTION)).alias("m")).select("doc_id", "m.*")
    kind = F.when(F.col("text").rlike("^Tab"), "table").otherwise("figure")
    by_number = written.select("doc_id", "start", "end", kind.alias("kind"), F.explode(numbers(F.col("text")).cast("array<long>")).alias("number"), F.lit(None).cast("string").alias("label"))
    refs = docs.select("doc_id", F.explode(matches(F.col("text"), REF)).alias("m")).select("doc_id", "m.*")
    keys = F.split(F.regexp_extract("text", r"\{([^{}]+)\}", 1), r"\s*,\s*")
    by_label = refs.select("doc_id", "start", "end", F.lit("ref").alias("kind"), F.lit(None).cast("long").alias("number"), F.explode(keys).alias("label"))
    return by_number.unionByName(by_label)


def labels(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\\label\{([^{}]+)\}"), F.lit(1))).alias("label")).distinct()


def resolved(mention: DataFrame, label: DataFrame) -> DataFrame:
    """Mentions by label with the label they name: itself, else with a prefix that a style adds."""
    refs = mention.where("label is not null")
    options = F.transform(F.array(F.lit(""), *map(F.lit, PREFIXES)), lambda p: F.concat(p, F.col("label")))
    tries = refs.select("doc_id", "start", "end", F.col("label").alias("key"), F.posexplode(options).alias("choice", "label"))
    hit = tries.join(label, ["doc_id", "label"]).groupBy("doc_id", "start", "end", "key").agg(F.min_by("label", "choice").alias("label"))
    return refs.select("doc_id", "start", "end", F.col("label").alias("key")).join(hit, ["doc_id", "start", "end", "key"], "left")


def reference_ranges(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, number, at): floats that lie between the two ends of a written range of references.
    Pairs of neighbouring references are looked at inside the row."""
    refs = settled(docs.select("doc_id", "text"), matches(F.col("text"), REF).alias("refs"))
    pairs = refs.select("doc_id", "text", F.explode(F.transform("refs", lambda m, i: F.struct(m.alias("a"), F.try_element_at("refs", i + 2).alias("b")))).alias("p")).where("p.b is not null")
    gap = F.substring("text", F.col("p.a.end") + 1, F.col("p.b.start") - F.col("p.a.end"))
    key = r"\{\s*([^{},]+?)\s*\}"
    spans = pairs.where((F.col("p.b.start") - F.col("p.a.end") <= 40) & gap.rlike(lx.RANGE_MARK)).select("doc_id", F.col("p.a.start").alias("at"), F.regexp_extract("p.a.text", key, 1).alias("low"), F.regexp_extract("p.b.text", key, 1).alias("high"))
    f = floats(docs).where("number is not null and label is not null").select("doc_id", "kind", "number", "label")
    ends = spans.join(f.select("doc_id", "kind", F.col("number").alias("a"), F.col("label").alias("low")), ["doc_id", "low"]).join(f.select("doc_id", "kind", F.col("number").alias("b"), F.col("label").alias("high")), ["doc_id", "high", "kind"])
    return ends.where("b - a > 1").select("doc_id", "kind", F.explode(F.sequence(F.col("a") + 1, F.col("b") - 1)).alias("number"), "at")


def cited_floats(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, number, at): every float citation outside the float itself, those within a written range too."""
    f = floats(docs).where("number is not null")
    said = mentions(docs)
    by_number = said.where("number is not null").select("doc_id", "kind", "number", F.col("start").alias("at"))
    named = resolved(said, labels(docs)).where("label is not null").select("doc_id", "label", F.col("start").alias("at"))
    by_label = named.join(f, ["doc_id", "label"]).select("doc_id", "kind", "number", "at")
    own = f.select("doc_id", "kind", "number", F.col("start").alias("fs"), F.col("end").alias("fe"))
    return by_number.unionByName(by_label).unionByName(reference_ranges(docs)).join(own, ["doc_id", "kind", "number"]).where("at < fs or at >= fe").select("doc_id", "kind", "number", "at")


def _out(df: DataFrame, rule_id: str, text: Column) -> DataFrame:
    return df.select("doc_id", F.lit(rule_id).alias("rule_id"), "start", "end", text.alias("text"), F.lit(None).cast("string").alias("replacement"))


def uncited_floats(docs: DataFrame) -> DataFrame:
    f = floats(docs).where("number is not null")
    return _out(f.join(cited_floats(docs), ["doc_id", "kind", "number"], "left_anti"), "X101", F.concat_ws(" ", "kind", F.col("number").cast("string")))


def cited_out_of_order(docs: DataFrame) -> DataFrame:
    """Floats first cited after one of a higher number of their kind."""
    first = cited_floats(docs).groupBy("doc_id", "kind", "number").agg(F.min("at").alias("start"))
    top = F.max("number").over(Window.partitionBy("doc_id", "kind").orderBy("start", "number").rowsBetween(Window.unboundedPreceding, -1))
    late = first.withColumn("top", top).where("number < top").withColumn("end", F.col("start"))
    return _out(late, "X102", F.concat_ws(" ", "kind", F.col("number").cast("string")))


def broken_references(docs: DataFrame) -> DataFrame:
    """Labels referred to but not defined, and numbers of kinds the document has but no such float."""
    said = mentions(docs)
    undefined = resolved(said, labels(docs)).where("label is null").select("doc_id", "start", "end", F.col("key").alias("what"))
    f = floats(docs).where("number is not null").select("doc_id", "kind", "number")
    written = said.where("number is not null").join(f.select("doc_id", "kind").distinct(), ["doc_id", "kind"], "left_semi")
    other = F.substring("_t", F.col("end") + 1, F.lit(24))
    foreign = written.join(docs.select("doc_id", F.col("text").alias("_t")), "doc_id").where(~other.rlike(r"^\s+(?:of|in)\s+[A-Z][a-z]+ et al"))
    missing = foreign.join(f, ["doc_id", "kind", "number"], "left_anti").select("doc_id", "start", "end", F.concat_ws(" ", "kind", F.col("number").cast("string")).alias("what"))
    return _out(undefined.unionByName(missing), "X103", F.col("what"))


def short_captions(docs: DataFrame, most: int = 4) -> DataFrame:
    n = F.size(F.regexp_extract_all("caption", F.lit(r"[A-Za-z][\w'-]*"), F.lit(0)))
    return _out(floats(docs).where((F.col("kind") == "figure") & F.col("caption").isNotNull() & n.between(1, most)), "X202", F.col("caption"))


def unreferenced_equations(docs: DataFrame) -> DataFrame:
    """Numbered equations neither whose label nor whose number the text refers to."""
    e = docs.select("doc_id", F.explode(matches(F.col("text"), EQUATION)).alias("m")).select("doc_id", "m.*")
    e = e.select("doc_id", "start", "end", F.nullif(F.regexp_extract("text", r"\\label\{([^{}]+)\}", 1), F.lit("")).alias("label"), F.row_number().over(Window.partitionBy("doc_id").orderBy("start")).cast("long").alias("number"))
    refs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\\(?:eq|auto|c|C)?ref\*?\{([^{}]+)\}"), F.lit(1))).alias("label")).distinct()
    said = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\b(?:Equation|Eq\.?)~?\s*\(?(\d+)"), F.lit(1)).cast("array<long>")).alias("number")).distinct()
    left = e.join(refs, ["doc_id", "label"], "left_anti").join(said, ["doc_id", "number"], "left_anti")
    return _out(left, "X301", F.concat_ws(" ", F.lit("equation"), F.col("number").cast("string")))


def detached_equations(docs: DataFrame) -> DataFrame:
    """Display equations after a full stop: not part of a sentence."""
    e = docs.select("doc_id", "text", F.explode(matches(F.col("text"), EQUATION)).alias("m"))
    before = F.regexp_replace(F.substring("text", F.lit(1), F.col("m.start")), r"\s+$", "")
    hit = e.where(before.rlike(r"\.$") & ~before.rlike(r"(?:\b(?:e\.g|i\.e|cf|al|Eq|Fig)|\b[A-Z])\.$"))
    return _out(hit.select("doc_id", "m.start", "m.end", F.right(before, F.lit(20)).alias("tail")), "X302", F.col("tail"))
