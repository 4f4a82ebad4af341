"""From raw findings to shown findings: trim, section, gate, aggregate, overlaps, hiding, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import column_of, fingerprint, line_of, matches, settled
from marginalia.operators.masks import masked
from marginalia.operators.rules import all_findings, rules_table, with_cues
from marginalia.operators.sections import gate, marked_sections, mask_references, section_at, with_sections
from marginalia.sources.shared import stored

TIER_RANK = {"spelling": 0, "grammar": 1, "gec": 2}


def trimmed(findings: DataFrame, docs: DataFrame, headings: DataFrame) -> DataFrame:
    """Drops reversed, outlying and blank spans, and moves the ends of others off blanks; a span that
    begins at a heading stays as it is."""
    own = findings.join(docs.select("doc_id", F.col("text").alias("_doc")), "doc_id")
    at_heading = headings.select("doc_id", F.col("start"), F.lit(True).alias("_heading")).distinct()
    rows = own.join(at_heading, ["doc_id", "start"], "left").where((F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("end") <= F.length("_doc")))
    body = F.substring("_doc", F.col("start") + 1, F.col("end") - F.col("start"))
    lead = F.length(body) - F.length(F.regexp_replace(body, r"^\s+", ""))
    trail = F.length(body) - F.length(F.regexp_replace(body, r"\s+$", ""))
    keep = F.coalesce("_heading", F.lit(False))
    rows = rows.where(keep | body.rlike(r"\S"))
    return rows.withColumns({"start": F.when(keep, F.col("start")).otherwise(F.col("start") + lead), "end": F.when(keep, F.col("end")).otherwise(F.col("end") - trail)}).drop("_doc", "_heading").select(findings.columns)


def prose(docs: DataFrame, kind: str | None = None) -> DataFrame:
    """Documents with their reference lists blanked: every offset stays valid in the source.  With a ``kind``
    (plain, markdown, latex, html) its markup is blanked too, and ``sections`` holds the headings that the markup
    tells, since they do not outlast it."""
    if kind is None:
        placed = with_sections(docs)
        return placed.withColumn("text", mask_references(F.col("text"), F.col("sections"))).drop("sections")
    read = settled(docs, masked(F.col("text"), kind).alias("_masked"))
    source = F.col("text") if kind in ("markdown", "latex") else F.col("_masked")
    placed = settled(read, marked_sections(source, kind).alias("sections"))
    return placed.withColumn("text", mask_references(F.col("_masked"), F.col("sections"))).drop("_masked")


def with_sections_of(docs: DataFrame) -> DataFrame:
    """``docs`` with their sections, those of the markup where it told them."""
    return docs if "sections" in docs.columns else with_sections(docs)


def analysed(docs: DataFrame, disabled: list[str] | None = None, kind: str | None = None) -> DataFrame:
    """Documents to shown findings: markup of their ``kind`` and reference lists masked, every rule in one plan,
    rules gated by section, aggregated rules once a section.  ``ordered`` puts them in reading order."""
    rules = F.broadcast(rules_table(docs.sparkSession))  # one row a rule
    # masked and looked over for cues once: each of the plan's scans begins from here
    found = all_findings(stored(with_cues(with_sections_of(prose(docs.select("doc_id", "text"), kind))), "wide"), disabled).join(rules, "rule_id")
    return aggregated(found.where(gate(F.col("section"), F.col("only"), F.col("excluded"))).drop("only", "excluded", "grade"))


def ordered(findings: DataFrame) -> DataFrame:
    """Adds place, from 1: the order of a document's findings by start, then rule."""
    return findings.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "rule_id", "end")))


def enriched(findings: DataFrame, headings: DataFrame | None = None) -> DataFrame:
    """Findings with their rule's columns and their section (that of ``headings``, where they bring none),
    those gated away left out."""
    rules = F.broadcast(rules_table(findings.sparkSession))  # one row a rule
    known = "section" in findings.columns
    found = findings.join(rules, "rule_id") if known else section_at(findings.join(rules, "rule_id"), headings)
    return found.where(gate(F.col("section"), F.col("only"), F.col("excluded"))).drop("only", "excluded", "grade")


def aggregated(findings: DataFrame) -> DataFrame:
    """Of rules marked ``aggregate`` the first finding per section name, with how many there are."""
    group = Window.partitionBy("doc_id", "rule_id", "section")
    ranked = findings.withColumns({"similar": F.count("*").over(group), "_n": F.row_number().over(group.orderBy("start", "end"))})
    kept = ranked.where(~F.col("aggregate") | (F.col("_n") == 1)).drop("_n")
    return kept.withColumn("similar", F.when(F.col("aggregate"), F.col("similar")).otherwise(F.lit(1).cast("long")))


def resolve_overlaps(findings: DataFrame) -> DataFrame:
    """Among correction tiers of one document a finding stays if it overlaps none kept before it, the
    longest first, then by tier, confidence and rule.  Other findings are not touched.  The fold is per
    document, over its correction findings only."""
    tier = F.create_map(*[F.lit(x) for p in TIER_RANK.items() for x in p])
    ranked = findings.withColumn("_rank", F.try_element_at(tier, F.col("tier")))
    key = F.struct((F.col("start") - F.col("end")).alias("length"), F.col("_rank").alias("rank"), (-F.col("confidence")).alias("doubt"), "rule_id", "start", "end")
    listed = ranked.where("_rank is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list(key)).alias("all"))
    kept_type = "array<struct<start:int,end:int,rule_id:string>>"

    def step(kept: Column, f: Column) -> Column:
        clash = F.exists(kept, lambda k: (k["start"] < f["end"]) & (f["start"] < k["end"]))
        one = F.array(F.struct(f["start"].alias("start"), f["end"].alias("end"), f["rule_id"].alias("rule_id")))
        return F.when(clash, kept).otherwise(F.concat(kept, one))

    winners = listed.select("doc_id", F.explode(F.aggregate("all", F.array().cast(kept_type), step)).alias("w")).select("doc_id", "w.*").distinct()
    corrections = ranked.where("_rank is not null").join(winners, ["doc_id", "start", "end", "rule_id"], "left_semi")
    return ranked.where("_rank is null").unionByName(corrections).drop("_rank")


def shown(findings: DataFrame, preferences: bool = False, draft: bool = False) -> DataFrame:
    """Hides preference findings, then in Draft mode all but sentence-scoped ones."""
    out = findings if preferences else findings.where("category <> 'preference'")
    return out.where("scope = 'sentence'") if draft else out


def counters(findings: DataFrame, preferences: bool = False, draft: bool = False) -> DataFrame:
    """Per document: shown by category, hidden preferences, hidden by mode, in one pass."""
    hidden = F.lit(not preferences) & (F.col("category") == "preference")
    by_mode = ~hidden & F.lit(draft) & (F.col("scope") != "sentence")
    visible = ~hidden & ~by_mode
    names = ["correction", "improvement", "convention", "preference"]
    return findings.groupBy("doc_id").agg(
        *[F.count_if(visible & (F.col("category") == c)).alias(f"n_{c}") for c in names],
        F.count_if(hidden).alias("hidden_preferences"),
        F.count_if(by_mode).alias("hidden_by_mode"),
    )


def section_split(findings: DataFrame, focus: str) -> DataFrame:
    """Per document what a reader of one section sees: findings of the whole document, those of the section,
    and how many lie elsewhere.  Findings bring scope and section."""
    whole, inside = F.col("scope") != "sentence", F.col("section") == focus
    return findings.groupBy("doc_id").agg(F.count_if(~whole & inside).alias("in_section"), F.count_if(whole).alias("whole_document"), F.count_if(~whole & ~inside).alias("elsewhere"))


def stale_after_edit(findings: DataFrame, docs: DataFrame) -> DataFrame:
    """Per finding its line, and how many other findings an edit there makes stale: those of the same line.
    Places become lines once a document, in a list that its findings are looked up in."""
    listed = docs.select("doc_id", F.transform(matches(F.col("text"), "\n"), lambda m: m["end"]).alias("_begins"))
    placed = findings.join(listed, "doc_id").withColumn("line", F.size(F.filter("_begins", lambda b: b <= F.col("start"))) + 1)
    return placed.select("doc_id", "rule_id", "start", "end", "line", (F.count("*").over(Window.partitionBy("doc_id", "line")) - 1).alias("n_stale"))


def located(findings: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds line, col and a fingerprint that stays the same while the finding does."""
    own = findings.join(docs.select("doc_id", F.col("text").alias("_doc")), "doc_id")
    out = own.withColumns({"line": line_of(F.col("_doc"), F.col("start")), "col": column_of(F.col("_doc"), F.col("start"))}).drop("_doc")
    return out.withColumn("fingerprint", fingerprint(F.col("rule_id"), F.col("start"), F.col("end"), F.col("text")))


def highlight_segments(findings: DataFrame) -> DataFrame:
    """(doc_id, start, end, ids): contiguous stretches between span ends, with the findings over each."""
    bounds = findings.select("doc_id", F.explode(F.array("start", "end")).alias("at")).distinct()
    order = Window.partitionBy("doc_id").orderBy("at")
    cells = bounds.withColumn("end", F.lead("at").over(order)).where("end is not null").withColumnRenamed("at", "start")
    over = cells.alias("c").join(findings.alias("f"), (F.col("c.doc_id") == F.col("f.doc_id")) & (F.col("f.start") <= F.col("c.start")) & (F.col("c.end") <= F.col("f.end")))
    name = F.concat_ws(":", F.col("f.rule_id"), F.col("f.start").cast("string"))
    return over.groupBy("c.doc_id", "c.start", "c.end").agg(F.array_sort(F.collect_set(name)).alias("ids"))


def tier_status(findings: DataFrame) -> DataFrame:
    """One row per tier: what runs, and what does not and why, so that no findings is never mistaken for
    not run."""
    rows = [("craft", True, "ready", ""), ("spelling", True, "ready", "dictionary from the corpus"), ("grammar", False, "missing", "needs an external checker"), ("gec", False, "disabled", "no backend given")]
    return findings.sparkSession.createDataFrame(rows, "tier string, ok boolean, state string, detail string")
