"""Line dedup by a log-template tree, as counts instead of one growing tree.

A line's place in the tree is fixed: its token count, then its leading tokens; tokens with a digit are
variable from the start.  A line of fewer than ``SHORT`` tokens has a leaf of its exact tokens, digits
too, which is its template.  What follows is divided into ``FIELDS`` fields.  A field's text that recurs in
its leaf over ``MIN_DOCS`` documents is constant, any other is variable; the leaf and its constant fields
are the line's template; at least half of the fields that are not empty, and one, must be constant.  Both
steps are counts with map-side combining, so the result depends on no order.  Rows of a common leaf meet
only small tables of what recurs.

Templates that recur over documents are boilerplate and go.  Copies of a whole document are not a reason
(near-duplicate removal is for those): a group of copies is one witness.  A document is a copy where at most
``OWN_SHARE`` of its tokens stand in lines unlike those of others, and more than ``COPY_SHARE`` in lines
that recur word for word, digits too.  Pages with text of their own between a common head and foot are no
copies, nor are logs whose lines differ in their values.  A group is named by the least hash among its
recurring templates, which scattered edits leave the same in nearly all copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import once
from marginalia.llm.store import GAP, cut, unused

MIN_DOCS, SHORT, LEADING, FIELDS = 10, 4, 2, 4
COPY_SHARE = 0.5
#: Two texts that share 6/7 of theirs have a Jaccard similarity of 0.75, the least of near-duplicates.
OWN_SHARE = 1 / 7


def _tokens(line: Column) -> Column:
    return F.filter(F.split(line, GAP), lambda t: t != "")


def _masked(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), "<*>").otherwise(t))


def parsed(docs: DataFrame) -> DataFrame:
    """Lines of one token or more: key, at (line number from 0), n (tokens), raw (hash of the tokens), leaf, hashes of the fields that are not empty."""
    lines = docs.select("key", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    split = lines.select("key", "at", _tokens(F.col("line")).alias("w")).withColumn("n", F.size("w")).where(F.col("n") > 0)
    tokens = split.select("key", "at", "n", "w", _masked(F.col("w")).alias("t"))
    rest = F.col("n") - LEADING

    def field(k: int) -> Column:
        begin, end = F.floor(rest * k / FIELDS).cast("int"), F.floor(rest * (k + 1) / FIELDS).cast("int")
        return F.when(end > begin, F.xxhash64(F.lit(k), F.array_join(F.slice("t", begin + LEADING + 1, end - begin), " ")))

    short = F.col("n") < SHORT
    leaf = F.when(short, F.xxhash64("n", F.array_join("w", " "))).otherwise(F.xxhash64("n", F.array_join(F.slice("t", 1, LEADING), " ")))
    fields = F.when(short, F.array().cast("array<bigint>")).otherwise(F.array_compact(F.array(*(field(k) for k in range(FIELDS)))))
    return tokens.select("key", "at", "n", F.xxhash64("w").alias("raw"), leaf.alias("leaf"), fields.alias("fields"))


def _recurring(rows: DataFrame, *by: str) -> DataFrame:
    """Keys of ``by`` found in MIN_DOCS documents or more: a table of its own, so that a join with it can
    send it to the rows' tasks where it is small, and split a hot key's rows where it is not."""
    return cut(rows.select("key", *by).distinct().groupBy(*by).count().where(F.col("count") >= MIN_DOCS).select(*by))


def templates(lines: DataFrame) -> DataFrame:
    """Lines in leaves that recur, with their template's hash: key, at, n, raw, template, constant and filled (fields; none in short lines)."""
    known = cut(lines.join(_recurring(lines, "leaf"), "leaf", "left_semi"))
    fields = known.select("key", "leaf", F.explode("fields").alias("field"))
    constant = _recurring(fields, "leaf", "field")
    marked = known.select("leaf", F.explode(F.array_distinct("fields")).alias("field"), "fields").distinct().join(constant, ["leaf", "field"])
    kept = marked.groupBy("leaf", "fields").agg(F.array_sort(F.collect_set("field")).alias("constant"))
    named = cut(kept.select("leaf", "fields", F.xxhash64("leaf", F.filter("fields", lambda f: F.array_contains("constant", f)), F.transform("fields", lambda f: F.array_contains("constant", f))).alias("template"), F.size(F.filter("fields", lambda f: F.array_contains("constant", f))).alias("constant"), F.size("fields").alias("filled")))
    short = known.where(F.col("n") < SHORT).select("key", "at", "n", "raw", F.col("leaf").alias("template"), F.lit(0).alias("constant"), F.lit(0).alias("filled"))
    return known.join(named, ["leaf", "fields"]).select("key", "at", "n", "raw", "template", "constant", "filled").unionByName(short)


def _copies(lines: DataFrame, named: DataFrame, often: DataFrame) -> DataFrame:
    """Documents that are copies of others: key, group."""
    total = lines.groupBy("key").agg(F.sum("n").alias("total"))
    alike = named.groupBy("key").agg(F.sum("n").alias("alike")).join(total, "key").where(F.col("total") - F.col("alike") <= OWN_SHARE * F.col("total"))
    theirs = cut(named.join(alike.select("key", "total"), "key"))
    verbatim = theirs.join(_recurring(theirs, "raw"), "raw", "left_semi").groupBy("key").agg(F.sum("n").alias("same"), F.first("total").alias("total"))
    copies = verbatim.where(F.col("same") > COPY_SHARE * F.col("total")).select("key")
    return often.join(copies, "key", "left_semi").groupBy("key").agg(F.min("template").alias("group"))


def boilerplate(docs: DataFrame) -> DataFrame:
    """(key, at) of the lines to drop, of documents (key, text); equal texts have equal keys."""
    lines = cut(parsed(docs).distinct())
    named = cut(templates(lines).where(F.col("constant") * 2 >= F.col("filled")))
    often = cut(named.join(_recurring(named, "template"), "template", "left_semi").select("key", "at", "n", "template"))
    witness = F.coalesce("group", F.xxhash64("key")).alias("key")
    witnessed = _recurring(often.join(_copies(lines, named, often), "key", "left").select(witness, "template"), "template")
    return often.join(witnessed, "template", "left_semi").select("key", "at")


def _without(items: Column, places: Column) -> Column:
    """``items`` without those at ``places`` (from 0).  The places that stay are a difference of sets, so a long
    array costs its length."""

    def rest(a: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(a) - 1), places)
        return F.transform(stay, lambda i: F.get(a, i))

    return once(items, rest)


def drop_recurring_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, boilerplate lines taken out of the text; a last column,
    ``_dropped`` (with further underlines where that name is taken), counts them.

    Lines end at line feeds; all others stay as they are, in order.  Lines without a token, null and
    empty texts stay.  Rows with equal texts are one document here, so copies add
    no witnesses.  A text all of whose lines go becomes empty; its row stays.
    """
    text = F.col(text_col).cast("string")
    key, other, lines, count = (unused(c, docs) for c in ("_key", "_gone_key", "_gone", "_dropped"))
    keyed = docs.withColumn(key, F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b")))
    gone = boilerplate(keyed.where(text.isNotNull()).select(F.col(key).alias("key"), text.alias("text"))).groupBy(F.col("key").alias(other)).agg(F.collect_set("at").alias(lines))
    found = keyed.join(gone, F.col(key) == F.col(other), "left")
    kept = F.array_join(_without(F.split(text, "\n", -1), F.col(lines)), "\n")
    columns = [F.when(F.col(lines).isNull(), F.col(c)).otherwise(kept).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return found.select(*columns, F.coalesce(F.size(lines), F.lit(0)).cast("long").alias(count))
