"""Safe edits composed into a rewritten text: every change comes from a named rule with a given replacement.

Rules that leave the choice to the writer are not applied, nor is G102, whose verb would need its tense."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import lexicons as lx
from marginalia.functions.text import matches, once, settled
from marginalia.operators.rules import BY_ID, DOUBLED, back

PASSES = 3
SAFE = ["W201", "W202", "W205", "W206"]
#: 'There are X that V' after the end of a sentence or line, as 'X V'.
THERE = r"(?i)[.!?\n][ \t]*There[ \t]+(?:is|are|was|were)[ \t]+[^,;.!?\n]{3,80}?[ \t]+(?:that|which|who)[ \t]+"
THERE_PARTS = r"(?i)^[.!?\n]([ \t]*)There[ \t]+(?:is|are|was|were)[ \t]+(.*?)[ \t]+(?:that|which|who)[ \t]+$"
EDITS = "array<struct<start:int,back:int,rule_id:string,replacement:string>>"


def upper_first(text: Column) -> Column:
    return F.concat(F.upper(F.left(text, F.lit(1))), F.substring(text, F.lit(2), F.length(text)))


def _edit(start: Column, end: Column, rule_id: str, replacement: Column) -> Column:
    return F.struct(start.alias("start"), (-end).alias("back"), F.lit(rule_id).alias("rule_id"), replacement.alias("replacement"))


def _of_rule(text: Column, rule_id: str) -> Column:
    rule = BY_ID[rule_id]
    table = F.create_map(*[F.lit(x) for p in rule.replacements.items() for x in p])
    found = matches(text, rule.pattern)
    if rule_id == "W201":
        found = F.filter(found, lambda m: ~(F.lower(m["text"]).isin(lx.GRAND_ONLY_AS_VERB) & back(text, m["start"], 30).rlike(lx.BEFORE_NOUN)))
    edits = F.transform(found, lambda m: _edit(m["start"], m["end"], rule_id, F.try_element_at(table, F.lower(m["text"]))))
    return F.filter(edits, lambda e: e["replacement"].isNotNull())


def _doubled(text: Column) -> Column:
    def good(m: Column) -> Column:
        parts = F.split(m["text"], r"[ \t]+")
        word = F.lower(F.try_element_at(parts, F.lit(1)))
        gap = F.length(m["text"]) - F.length(F.regexp_replace(m["text"], r"[ \t]", ""))
        return (F.size(parts) == 2) & ~word.isin("had", "that") & (gap < 3) & ((F.length(word) > 1) | (word == "a"))

    return F.transform(F.filter(matches(text, DOUBLED), good), lambda m: _edit(m["start"], m["end"], "W207", F.element_at(F.split(m["text"], r"[ \t]+"), 1)))


def _there(text: Column) -> Column:
    def one(m: Column) -> Column:
        lead, noun = (F.regexp_extract(m["text"], THERE_PARTS, k) for k in (1, 2))
        return _edit(m["start"], m["end"] - 1, "G105", F.concat(lead, upper_first(noun), F.lit(" ")))

    return F.transform(matches(F.concat(F.lit("\n"), text), THERE), one)  # places are after the mark, less the line feed


def edits(text: Column) -> Column:
    """Edits of one pass in order, the first of those that overlap (the longer, where two begin alike)."""
    every = F.array_sort(F.concat(*(_of_rule(text, r) for r in SAFE), _doubled(text), _there(text)))

    def step(kept: Column, e: Column) -> Column:
        last = F.coalesce(-F.try_element_at(kept, F.lit(-1))["back"], F.lit(0))
        return F.when(e["start"] >= last, F.concat(kept, F.array(e))).otherwise(kept)

    return F.aggregate(every, F.array().cast(EDITS), step)


def applied(text: Column, made: Column) -> Column:
    """The text with edits made.  A deletion takes one blank after it with it, and gives its capital to the
    next word at the start of a sentence; then blanks before marks and doubled commas go."""

    def settle(e: Column) -> Column:
        gone = e["replacement"] == ""
        end = -e["back"] + (gone & (F.substring(text, -e["back"] + 1, F.lit(1)) == " ")).cast("int")
        nxt = F.substring(text, end + 1, F.lit(1))
        begins = (e["start"] == 0) | back(text, e["start"], 2).rlike(r"^[.!?] $|\n$")
        raised = gone & begins & nxt.rlike(r"^\p{Ll}$")
        return F.struct(e["start"].alias("start"), (end + raised.cast("int")).alias("end"), F.when(raised, F.upper(nxt)).otherwise(e["replacement"]).alias("put"))

    def joined(done: Column) -> Column:
        def piece(e: Column, i: Column) -> Column:
            at = F.when(i > 0, F.element_at(done, F.greatest(i, F.lit(1)))["end"]).otherwise(0)
            return F.concat(F.substring(text, at + 1, F.greatest(e["start"] - at, F.lit(0))), e["put"])

        rest = F.substring(text, F.element_at(done, -1)["end"] + 1, F.length(text))
        return F.concat(F.array_join(F.transform(done, piece), ""), rest)

    new = once(F.transform(made, settle), joined)
    mended = F.regexp_replace(F.regexp_replace(new, r" +([,.;:!?])", "$1"), r",\s*,", ",")
    return F.when(F.size(made) > 0, mended).otherwise(text)


def polished(docs: DataFrame, passes: int = PASSES) -> DataFrame:
    """(doc_id, n_edits, changed, text): passes until nothing changes, ``passes`` at most, since one edit can
    bring out another.  Null texts stay null, with no edits.  Every pass is map-only."""
    rows = docs.select("doc_id", F.col("text").alias("_was"), "text", F.lit(0).alias("n_edits"), F.lit(True).alias("_open"))
    for _ in range(passes):
        # a text that the pass before left alone is not read again
        made = settled(rows, F.when(F.col("_open"), edits(F.col("text"))).otherwise(F.array().cast(EDITS)).alias("_made"))
        n = F.greatest(F.size("_made"), F.lit(0))
        new = applied(F.col("text"), F.col("_made"))
        rows = made.select("doc_id", "_was", F.explode(F.array(F.struct(new.alias("text"), (F.col("n_edits") + n).alias("n_edits"), (n > 0).alias("_open")))).alias("_s")).select("doc_id", "_was", "_s.*")
    return rows.select("doc_id", "n_edits", (~F.col("text").eqNullSafe(F.col("_was"))).alias("changed"), "text")
