"""Queries over documents, pages and conversations: rates, metrics, sections, discourse, masking, offsets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions import lexicons as lx
from marginalia.functions.text import SENTENCE_GAP, either, fingerprint, mask_matches, sentence_array, space_tokens, utf16_offset, words
from marginalia.operators import discourse, masks, metrics, pipeline, reports, rules, spelling
from marginalia.operators.sections import PLAIN_HEADING, latex_headings, plain_headings, resolve_sections, with_sections
from marginalia.plans.rule_queries import ORACLES as RULE_SQL
from marginalia.plans.seeded import PLAIN, SEEDED, SENTENCES, hits_sql, listed, quoted, seeded, seeded_tex, words_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _own(sql: str) -> str:
    """A rule's oracle over the documents as they are."""
    return sql.replace(SEEDED, "seeded AS (SELECT doc_id, lang, source, text FROM documents)")


def _placed(docs: DataFrame) -> DataFrame:
    return rules.sentences(with_sections(docs))


# --- flagship: findings of all rules, gated and aggregated, per 1000 words ---
def _classify(title: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({title}), {quoted(p)}) THEN {quoted(n)}" for p, n in lx.SECTION_PATTERNS) + " ELSE 'other' END"


HEADINGS = f"{PLAIN}, {hits_sql(PLAIN_HEADING, name='hl')}, heads AS (SELECT doc_id, start, rtrim(text) AS title, {_classify('rtrim(text)')} AS section FROM hl WHERE {_classify('rtrim(text)')} <> 'other' AND NOT contains(rtrim(text), '   '))"
_WIDE = [n for n in RULE_SQL if n.split("_")[0].upper() in {*(r.rule_id for r in rules.RULES if r.pattern), *rules.SENTENCE_RULES, "C301", *rules.DOCUMENT_RULES}]
_GATES = ", ".join(
    f"({quoted(r.rule_id)}, {'[' + ', '.join(map(quoted, r.only)) + ']' if r.only else 'NULL::VARCHAR[]'}, {'[' + ', '.join(map(quoted, r.excluded)) + ']' if r.excluded else 'NULL::VARCHAR[]'}, {r.aggregate})" for r in rules.RULES
)
_RAW = f"{SEEDED}, {HEADINGS}".replace("seeded", "raw").replace("plain", "raw_plain").replace("heads", "raw_heads").replace("hl", "rl")
_KINDS = ", ".join(f"({quoted(r.rule_id)}, {quoted(r.category)}, {quoted(r.scope)})" for r in rules.RULES)
#: Every rule over texts whose reference lists are blanked, as the operators do it.
ALL = (
    f"{_RAW}, cuts AS (SELECT doc_id, 0 AS start, 'front' AS section FROM raw UNION ALL SELECT doc_id, start, section FROM raw_heads), "
    "parts AS (SELECT doc_id, start, section, lead(start) OVER (PARTITION BY doc_id ORDER BY start, section = 'front' DESC) AS stop FROM cuts), "
    "pieces AS (SELECT doc_id, start, section = 'front' AS lead_, substr(text, (start + 1)::BIGINT, (coalesce(stop, length(text)) - start)::BIGINT) AS piece, section FROM parts JOIN raw USING (doc_id)), "
    "seeded AS MATERIALIZED (SELECT doc_id, lang, source, string_agg(CASE WHEN section = 'references' THEN regexp_replace(piece, '[^\n]', ' ', 'g') ELSE piece END, '' ORDER BY start, lead_ DESC) AS text FROM pieces JOIN (SELECT doc_id, lang, source FROM raw) USING (doc_id) GROUP BY ALL), "
    f"{HEADINGS}, gates(rule_id, only_in, not_in, agg) AS (VALUES {_GATES}), found AS MATERIALIZED ("
    + " UNION ALL ".join("SELECT * FROM (" + RULE_SQL[n].replace(f"WITH {SEEDED}, ", "WITH ", 1) + ")" for n in _WIDE)
    + "), at_section AS (SELECT f.*, coalesce(h.section, CASE WHEN f.doc_id IN (SELECT doc_id FROM heads) THEN 'front' ELSE 'unknown' END) AS section FROM found f ASOF LEFT JOIN heads h ON f.doc_id = h.doc_id AND f.start >= h.start), "
    "gated AS (SELECT a.*, agg FROM at_section a JOIN gates USING (rule_id) WHERE section = 'unknown' OR ((only_in IS NULL OR list_contains(only_in, section)) AND NOT coalesce(list_contains(not_in, section), FALSE))), "
    'ranked AS (SELECT *, count(*) OVER w AS k, row_number() OVER (w ORDER BY start, "end") AS r FROM gated WINDOW w AS (PARTITION BY doc_id, rule_id, section)), '
    "kept AS (SELECT *, CASE WHEN agg THEN k ELSE 1 END AS similar FROM ranked WHERE NOT agg OR r = 1)"
)


def _analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.analysed(seeded(spark, sf_dir))


@query(
    f"WITH {ALL}, size AS (SELECT lang, count(*) AS n_docs, sum(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')))::BIGINT AS n_words FROM raw GROUP BY lang), "
    "flags AS (SELECT lang, count(*) AS n FROM kept JOIN raw USING (doc_id) GROUP BY lang) "
    "SELECT lang, n_docs, n_words, coalesce(n, 0) AS n_flags, CASE WHEN n_words > 0 THEN round(coalesce(n, 0) * 1000.0::DOUBLE / n_words, 2) ELSE 0.0 END AS per_1000 FROM size LEFT JOIN flags USING (lang)"
)
def checked_corpus_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.corpus_rates(_analysed(spark, sf_dir), seeded(spark, sf_dir))


@query(f'WITH {ALL} SELECT doc_id, rule_id, section, start::INT AS start, "end"::INT AS "end", text, "similar", (row_number() OVER (PARTITION BY doc_id ORDER BY start, rule_id, "end"))::INT AS place FROM kept')
def analysed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.ordered(_analysed(spark, sf_dir)).select("doc_id", "rule_id", "section", "start", "end", "text", "similar", "place")


#: Prose, and between its pieces addresses with words of several rules.
_ADDRESSED = ["\nResults\nWe utilize it, see ", "https://very-novel.example/utilize?q=clearly", ". Mail ", "utilize.it@very.novel.example", ", it is very novel."]
_RAW_VIEW = SEEDED.replace("seeded", "raw")
#: The given texts hold addresses too: blanked by length between the texts around them.
_HELD = quoted(r"(?:https?://|www\.)\S*[^\s.,;:)\]'\"]|[\w.+-]+@[\w-]+(?:\.[\w-]+)+")
_OWN = f"array_to_string(list_transform(string_split_regex(text, {_HELD}), lambda g, i: g || coalesce(repeat(' ', length(regexp_extract_all(text, {_HELD})[i])), '')), '')"
_BLANKED = f"raw AS (SELECT * REPLACE ({_OWN} || {' || '.join(quoted(p) if k % 2 == 0 else f'repeat({chr(39)} {chr(39)}, {len(p)})' for k, p in enumerate(_ADDRESSED))} AS text) FROM (WITH {_RAW_VIEW} SELECT * FROM raw))"


@query(f'WITH {ALL.replace(_RAW_VIEW, _BLANKED, 1)} SELECT doc_id, rule_id, section, start::INT AS start, "end"::INT AS "end", text, "similar" FROM kept')
def analysed_plain_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL puts blanks where the added addresses would stand; the operator must find and mask them."""
    docs = seeded(spark, sf_dir).withColumn("text", F.concat("text", F.lit("".join(_ADDRESSED))))
    return pipeline.analysed(docs, kind="plain").select("doc_id", "rule_id", "section", "start", "end", "text", "similar")


@query(f"WITH {ALL} SELECT rule_id, count(*) AS count FROM kept GROUP BY rule_id ORDER BY count DESC, rule_id LIMIT 8")
def top_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top_rules(_analysed(spark, sf_dir))


@query(
    f'WITH {ALL}, r AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY doc_id, start, "end") AS n FROM kept) SELECT doc_id, rule_id, start, "end", text, replacement, n::INT AS n FROM r WHERE n <= 3'
)
def rule_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.examples(_analysed(spark, sf_dir).select("doc_id", "rule_id", "start", "end", "text", "replacement"))


@query(
    f"WITH {ALL} SELECT rule_id, " + ", ".join(f"count(*) FILTER (lang = '{v}') AS {v}" for v in ("de", "en", "es", "fr")) + " FROM kept JOIN raw USING (doc_id) GROUP BY rule_id"
)
def pivot_rule_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.pivot_by(_analysed(spark, sf_dir), seeded(spark, sf_dir), ["de", "en", "es", "fr"])


@query(
    f"WITH {ALL}, w AS (SELECT doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))::BIGINT AS n FROM raw), f AS (SELECT doc_id, count(*) AS k, count(DISTINCT rule_id) AS rules FROM kept GROUP BY doc_id) "
    "SELECT sum(coalesce(k, 0))::BIGINT AS n_flags, sum(n)::BIGINT AS n_words, count(*) FILTER (k > 0) AS n_flagged_docs, round(sum(coalesce(k, 0))::DOUBLE * 1000 / sum(n), 3) AS per_1000, max(coalesce(rules, 0)) AS most_rules FROM w LEFT JOIN f USING (doc_id)"
)
def stress_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = _analysed(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("k"), F.countDistinct("rule_id").alias("rules"))
    sized = seeded(spark, sf_dir).select("doc_id", F.size(space_tokens(F.col("text"))).cast("long").alias("n")).join(sums, "doc_id", "left")
    k, n = F.sum(F.coalesce("k", F.lit(0))), F.sum("n")
    return sized.agg(k.alias("n_flags"), n.alias("n_words"), F.count_if(F.col("k") > 0).alias("n_flagged_docs"), F.round(k.cast("double") * 1000 / n, 3).alias("per_1000"), F.max(F.coalesce("rules", F.lit(0))).alias("most_rules"))


# --- text units ---
@query(
    f"WITH s AS (SELECT doc_id, lang, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM documents) SELECT doc_id, len(list_filter(s, lambda x: regexp_matches(x, '\\S')))::BIGINT AS n_sentences, max(list_max(list_transform(s, lambda x: length(x))))::BIGINT AS longest FROM s GROUP BY doc_id, s"
)
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _docs(spark, sf_dir).select("doc_id", sentence_array(F.col("text")).alias("s"))
    return s.select("doc_id", F.size(F.filter("s", lambda x: x.rlike(r"\S"))).cast("long").alias("n_sentences"), F.array_max(F.transform("s", F.length)).cast("long").alias("longest"))


@query(f"WITH w AS (SELECT lang, {words_sql()} AS w FROM documents) SELECT lang, sum(len(w))::BIGINT AS n_tokens, max(len(w))::BIGINT AS most, count(*) FILTER (len(w) > 1000) AS n_long FROM w GROUP BY lang")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _docs(spark, sf_dir).select("lang", F.size(words(F.col("text"))).cast("long").alias("n"))
    return w.groupBy("lang").agg(F.sum("n").alias("n_tokens"), F.max("n").alias("most"), F.count_if(F.col("n") > 1000).alias("n_long"))


@query(
    f"WITH t AS (SELECT doc_id, unnest(list_transform({words_sql()}, lambda x: lower(x))) AS term FROM documents) SELECT doc_id, term, count(*) AS n FROM t WHERE length(term) >= 4 GROUP BY ALL HAVING count(*) >= 3"
)
def repeated_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _docs(spark, sf_dir).select("doc_id", F.explode(F.transform(words(F.col("text")), F.lower)).alias("term")).where(F.length("term") >= 4)
    return t.groupBy("doc_id", "term").agg(F.count("*").alias("n")).where("n >= 3")


def _listed(values: list[str]) -> str:
    return listed(values)


_LEX = f"SELECT doc_id, list_transform({words_sql()}, lambda x: lower(x)) AS w FROM seeded"
_COUNTS = (
    f"lex AS ({_LEX}), counts AS (SELECT doc_id, len(w)::BIGINT AS n_words, "
    f"len(list_filter(w, lambda x: x IN {_listed(lx.HEDGES)}))::BIGINT AS hedges, len(list_filter(w, lambda x: x IN {_listed(lx.BOOSTERS)}))::BIGINT AS boosters, "
    f"len(list_filter(w, lambda x: x IN {_listed(lx.SELF_MENTIONS)}))::BIGINT AS self_mentions, "
    f"len(list_filter(w, lambda x: length(x) >= 7 AND regexp_matches(x, '(?:{'|'.join(lx.NOMINAL_SUFFIXES)})$') AND x NOT IN {_listed(lx.NOMINAL_ALLOWED)}))::BIGINT AS nominals FROM lex)"
)


@query(f"WITH {SEEDED}, {_COUNTS} SELECT * FROM counts")
def lexical_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.lexical_counts(seeded(spark, sf_dir))


@query(
    f"WITH {SEEDED}, {_COUNTS} SELECT doc_id, hedges, boosters, CASE WHEN hedges = 0 AND boosters = 0 THEN 'flat' WHEN boosters = 0 THEN 'hedge-only' WHEN hedges = 0 THEN 'booster-only' "
    "WHEN hedges >= boosters * 3 THEN 'hedge-heavy ' || printf('%.1f', hedges::DOUBLE / boosters) WHEN hedges * 3 <= boosters THEN 'booster-heavy ' || printf('%.1f', hedges::DOUBLE / boosters) ELSE 'balanced ' || printf('%.1f', hedges::DOUBLE / boosters) END AS balance FROM counts"
)
def hedge_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = metrics.lexical_counts(seeded(spark, sf_dir))
    return c.select("doc_id", "hedges", "boosters", metrics.balance(F.col("hedges"), F.col("boosters")).alias("balance"))


_PER_100 = ", ".join(f"CASE WHEN n_words > 0 THEN round_even({c} * 100.0::DOUBLE / n_words, 2) ELSE 0.0 END AS {c}_per_100" for c in ("hedges", "boosters", "self_mentions", "nominals"))


@query(
    f"WITH {SEEDED}, {_COUNTS}, s AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_matches(x, '\\S')) AS s FROM seeded), "
    f"k AS (SELECT doc_id, len(s)::BIGINT AS n_sentences, len(list_filter(s, lambda x: len({words_sql('x')}) > 40))::BIGINT AS n_over_40 FROM s) "
    f"SELECT doc_id, n_sentences, n_words, n_over_40, CASE WHEN n_sentences > 0 THEN round_even(n_words * 1.0::DOUBLE / n_sentences, 1) ELSE 0.0 END AS mean_length, {_PER_100}, h.balance FROM counts JOIN k USING (doc_id) JOIN ({ORACLES['hedge_balance']}) h USING (doc_id)".replace("n_words, n_over_40, CASE", "counts.n_words AS n_words, n_over_40, CASE").replace("round_even(hedges *", "round_even(counts.hedges *").replace("round_even(boosters *", "round_even(counts.boosters *")
)
def document_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.document_metrics(seeded(spark, sf_dir))


# --- sections ---
PLACED = (
    f"{SENTENCES}, {HEADINGS}, placed AS (SELECT s.doc_id, s.sent, s.start, s.text, s.flat, coalesce(h.section, CASE WHEN s.doc_id IN (SELECT doc_id FROM heads) THEN 'front' ELSE 'unknown' END) AS section "
    "FROM sents s ASOF LEFT JOIN heads h ON s.doc_id = h.doc_id AND s.start >= h.start)"
)


@query(f"WITH {SEEDED}, {HEADINGS} SELECT doc_id, start::INT AS start, title, section FROM heads")
def heading_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_sections(plain_headings(seeded(spark, sf_dir))).select("doc_id", "start", "title", "section")


@query()
def nested_heading_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_sections(latex_headings(seeded_tex(spark, sf_dir)))


@query(f"WITH {SEEDED}, {PLACED} SELECT section, count(*) AS n_sentences, count(DISTINCT doc_id) AS n_docs FROM placed GROUP BY section")
def section_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(seeded(spark, sf_dir)).groupBy("section").agg(F.count("*").alias("n_sentences"), F.countDistinct("doc_id").alias("n_docs"))


_GATED = ["c302_overclaim", "c304_bare_significant", "c305_assertive_adverb", "ab801_vague_forward_reference"]
_KEPT = (
    f"WITH {SEEDED}, {HEADINGS}, gates(rule_id, only_in, not_in, agg) AS (VALUES {_GATES}), found AS ("
    + " UNION ALL ".join(f"SELECT * FROM ({RULE_SQL[n]})" for n in _GATED)
    + "), at_section AS (SELECT f.*, coalesce(h.section, CASE WHEN f.doc_id IN (SELECT doc_id FROM heads) THEN 'front' ELSE 'unknown' END) AS section FROM found f ASOF LEFT JOIN heads h ON f.doc_id = h.doc_id AND f.start >= h.start), "
    "kept AS (SELECT a.*, agg FROM at_section a JOIN gates USING (rule_id) WHERE section = 'unknown' OR only_in IS NULL OR list_contains(only_in, section))"
)


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.enriched(rules.pattern_findings(with_sections(seeded(spark, sf_dir)), ["C302", "C304", "C305", "AB801"]))


@query(_KEPT + " SELECT rule_id, section, count(*) AS n FROM kept GROUP BY ALL")
def section_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir).groupBy("rule_id", "section").agg(F.count("*").alias("n"))


@query(
    _KEPT
    + ', n AS (SELECT *, count(*) OVER w AS k, row_number() OVER (w ORDER BY start, "end") AS r FROM kept WINDOW w AS (PARTITION BY doc_id, rule_id, section)) SELECT doc_id, rule_id, section, start, CASE WHEN agg THEN k ELSE 1 END AS similar FROM n WHERE NOT agg OR r = 1'
)
def aggregate_by_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.aggregated(_gated(spark, sf_dir)).select("doc_id", "rule_id", "section", "start", "similar")


@query(
    f"WITH {SEEDED}, {HEADINGS}, gates(rule_id, only_in, not_in, agg) AS (VALUES {_GATES}), kinds(rule_id, category, scope) AS (VALUES {_KINDS}), found AS ("
    + " UNION ALL ".join(f"SELECT * FROM ({RULE_SQL[n]})" for n in _WIDE if rules.BY_ID[n.split("_")[0].upper()].pattern)
    + "), at_section AS (SELECT f.*, coalesce(h.section, CASE WHEN f.doc_id IN (SELECT doc_id FROM heads) THEN 'front' ELSE 'unknown' END) AS section FROM found f ASOF LEFT JOIN heads h ON f.doc_id = h.doc_id AND f.start >= h.start), "
    "gated AS (SELECT a.*, agg FROM at_section a JOIN gates USING (rule_id) WHERE section = 'unknown' OR ((only_in IS NULL OR list_contains(only_in, section)) AND NOT coalesce(list_contains(not_in, section), FALSE))), "
    'ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, rule_id, section ORDER BY start, "end") AS r FROM gated), '
    "kept AS (SELECT doc_id, category, category = 'preference' AS hidden, category <> 'preference' AND scope <> 'sentence' AS by_mode FROM ranked JOIN kinds USING (rule_id) WHERE NOT agg OR r = 1) "
    "SELECT doc_id, " + ", ".join(f"count(*) FILTER (NOT hidden AND NOT by_mode AND category = '{c}') AS n_{c}" for c in ("correction", "improvement", "convention", "preference"))
    + ", count(*) FILTER (hidden) AS hidden_preferences, count(*) FILTER (by_mode) AS hidden_by_mode FROM kept GROUP BY doc_id"
)
def shown_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pipeline.enriched(rules.pattern_findings(with_sections(seeded(spark, sf_dir))))
    return pipeline.counters(pipeline.aggregated(found), draft=True)


@query()
def overlap_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    tiers = F.element_at(F.array(F.lit("spelling"), F.lit("grammar"), F.lit("craft")), (F.col("start") % 3 + 1).cast("int"))
    found = rules.doubled_words(docs).unionByName(rules.doubled_words(docs).withColumn("start", F.col("start") + 2)).withColumns({"tier": tiers, "confidence": F.lit(1.0)})
    return pipeline.resolve_overlaps(found).select("doc_id", "rule_id", "start", "end", "tier")


@query(
    f"WITH w AS ({RULE_SQL['w207_doubled_word']}), seeded0 AS ({SEEDED.split('(', 1)[1].rsplit(')', 1)[0]}), s AS (SELECT w.*, left(d.text, start) AS before FROM w JOIN seeded0 d USING (doc_id)) "
    "SELECT doc_id, rule_id, start, \"end\", text, replacement, (length(before) - length(replace(before, chr(10), '')) + 1)::INT AS line, (length(regexp_extract(before, '[^\\n]*$', 0)) + 1)::INT AS col, "
    "sha1(rule_id || chr(31) || start || chr(31) || \"end\" || chr(31) || text) AS fingerprint FROM s"
)
def located_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = seeded(spark, sf_dir)
    return pipeline.located(rules.doubled_words(docs), docs)


@query(
    f"WITH w AS ({_own(RULE_SQL['w207_doubled_word'])}) SELECT doc_id, sha1('W207' || chr(31) || start || chr(31) || \"end\" || chr(31) || text) AS fp FROM w"
)
def fingerprint_sha1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.doubled_words(_docs(spark, sf_dir)).select("doc_id", fingerprint(F.col("rule_id"), F.col("start"), F.col("end"), F.col("text")).alias("fp"))


@query(
    f"WITH w AS ({_own(RULE_SQL['w207_doubled_word'])}), s AS (SELECT doc_id, start, left(text, start) AS before FROM w JOIN (SELECT doc_id, text AS body FROM documents) USING (doc_id)) SELECT 1".replace("left(text, start)", "left(body, start)").replace("SELECT 1", "SELECT doc_id, start, (length(before) - length(replace(before, chr(10), '')) + 1)::INT AS line, (length(regexp_extract(before, '[^\\n]*$', 0)) + 1)::INT AS col, (length(before) + len(regexp_extract_all(before, '[\\x{10000}-\\x{10FFFF}]')))::INT AS utf16 FROM s")
)
def line_col(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    own = rules.doubled_words(docs).select("doc_id", "start").join(docs.select("doc_id", "text"), "doc_id")
    from marginalia.functions.text import column_of, line_of

    return own.select("doc_id", "start", line_of(F.col("text"), F.col("start")).alias("line"), column_of(F.col("text"), F.col("start")).alias("col"), utf16_offset(F.col("text"), F.col("start")).alias("utf16"))


@query(
    "WITH f AS (" + " UNION ALL ".join(f"SELECT * FROM ({RULE_SQL[n]})" for n in ("w202_wordy_phrase", "w203_hype", "w206_redundant_pair", "c305_assertive_adverb"))
    + '), ends AS (SELECT DISTINCT doc_id, unnest([start, "end"]) AS a FROM f), cells AS (SELECT doc_id, a AS start, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS "end" FROM ends) '
    'SELECT c.doc_id, c.start, c."end", list_sort(list(DISTINCT rule_id || \':\' || f.start)) AS ids FROM cells c JOIN f ON f.doc_id = c.doc_id AND f.start <= c.start AND c."end" <= f."end" WHERE c."end" IS NOT NULL GROUP BY ALL'
)
def highlight_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.highlight_segments(rules.pattern_findings(seeded(spark, sf_dir), ["W202", "W203", "W206", "C305"]))


# --- discourse ---
_ROLE_LIST = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(flat), {quoted(either(p))}) THEN {quoted(r)} END" for r, p in lx.ROLE_SIGNALS.items()) + "], lambda x: x IS NOT NULL)"
_ROLES = f"{PLACED}, labelled AS (SELECT *, {_ROLE_LIST} AS all_roles FROM placed), roled AS (SELECT *, coalesce(all_roles[1], 'other') AS role FROM labelled)"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discourse.roles(_placed(seeded(spark, sf_dir)))


@query(f"WITH {SEEDED}, {_ROLES} SELECT doc_id, sent, role, array_to_string(all_roles, ',') AS all_roles FROM roled WHERE role <> 'other'")
def sentence_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).where("role <> 'other'").select("doc_id", "sent", "role", F.array_join("all_roles", ",").alias("all_roles"))


_NEAR = """near AS (SELECT *, max(CASE WHEN list_contains(all_roles, 'warrant') THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 1 AS near_warrant,
 max(CASE WHEN list_has_any(all_roles, ['evidence', 'result']) THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 1 AS near_grounds
 FROM roled WINDOW w AS (PARTITION BY doc_id, section ORDER BY sent)), claims AS (SELECT * FROM near WHERE list_contains(all_roles, 'claim'))"""


@query(f"WITH {SEEDED}, {_ROLES}, {_NEAR} SELECT doc_id, sent, section, near_warrant, near_grounds FROM claims")
def near_warrant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discourse.argument_links(_labelled(spark, sf_dir)).select("doc_id", "sent", "section", "near_warrant", "near_grounds")


@query(
    f"WITH {SEEDED}, {_ROLES}, {_NEAR}, "
    + """lone AS (SELECT doc_id, section, count(*) FILTER (NOT near_warrant) AS cw, count(*) FILTER (NOT near_grounds) AS cg FROM claims WHERE section IN ('introduction', 'results', 'discussion', 'conclusion') GROUP BY ALL),
sums AS (SELECT doc_id, section, count(*) FILTER (role IN ('evidence', 'result')) AS g, count(*) FILTER (role = 'warrant') AS w, count(*) FILTER (role = 'claim') AS c, count(*) FILTER (role = 'limitation') AS l,
 count(*) FILTER (list_contains(all_roles, 'qualifier')) AS q, count(*) FILTER (role = 'contribution') AS k FROM roled GROUP BY ALL),
codes AS (SELECT doc_id, section, unnest([{'code': 'claim_without_warrant', 'n': coalesce(cw, 0)}, {'code': 'claim_without_grounds', 'n': coalesce(cg, 0)},
 {'code': 'no_interpretation', 'n': (section IN ('results', 'discussion') AND g > 0 AND w = 0 AND c = 0)::BIGINT}, {'code': 'unqualified', 'n': (l > 0 AND c > 0 AND q = 0)::BIGINT},
 {'code': 'no_contribution', 'n': (section IN ('discussion', 'conclusion') AND k = 0)::BIGINT}]) AS x FROM sums LEFT JOIN lone USING (doc_id, section))
SELECT doc_id, section, x.code AS code, x.n AS n FROM codes WHERE x.n > 0"""
)
def missing_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discourse.missing_links(_labelled(spark, sf_dir))


@query(
    f"WITH {SEEDED}, {PLACED}, items(item, place, signal, sections) AS (VALUES " + ", ".join(f"({quoted(i)}, {k}, {quoted(p)}, {'[' + ', '.join(map(quoted, s)) + ']' if s else 'NULL::VARCHAR[]'})" for i, k, p, s in discourse.CHECKLIST)
    + "), there AS (SELECT doc_id, list(DISTINCT section) AS there FROM placed GROUP BY doc_id), hit AS (SELECT p.doc_id, item, min(sent) AS sent FROM placed p JOIN there USING (doc_id), items WHERE regexp_matches(lower(flat), signal) AND (sections IS NULL OR list_contains(sections, section) OR NOT list_has_any(sections, there)) GROUP BY ALL) "
    "SELECT doc_id, item, place, sent IS NOT NULL AS reported, sent FROM there CROSS JOIN (SELECT item, place FROM items) LEFT JOIN hit USING (doc_id, item)"
)
def checklist_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discourse.checklist_report(_placed(seeded(spark, sf_dir)))


@query(
    f"WITH {SEEDED}, {PLACED}, w AS (SELECT doc_id, section, list_transform({words_sql()}, lambda x: lower(x)) AS w FROM placed), "
    f"k AS (SELECT doc_id, section, sum(len(w))::BIGINT AS n_words, sum(len(list_filter(w, lambda x: x IN {listed(lx.HEDGES)})))::BIGINT AS hedges, sum(len(list_filter(w, lambda x: x IN {listed(lx.BOOSTERS)})))::BIGINT AS boosters FROM w GROUP BY ALL) "
    "SELECT *, CASE WHEN n_words > 0 THEN round(hedges * 100.0::DOUBLE / n_words, 1) ELSE 0.0 END AS per_100 FROM k"
)
def hedging_by_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.hedging_by_section(_placed(seeded(spark, sf_dir)))


@query(
    f"WITH {SEEDED}, {HEADINGS}, k AS (SELECT doc_id, bool_or(section = 'methods') AS m, bool_or(section = 'results') AS r, bool_or(regexp_matches(lower(title), 'policy|recommendation')) AS p FROM heads GROUP BY doc_id) "
    "SELECT doc_id, CASE WHEN coalesce(m AND r, FALSE) THEN 'manuscript' WHEN coalesce(p AND NOT m, FALSE) THEN 'policy-brief' ELSE 'general' END AS document_type FROM seeded LEFT JOIN k USING (doc_id)"
)
def document_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = seeded(spark, sf_dir)
    return metrics.document_type(resolve_sections(plain_headings(docs)), docs)


# --- masking ---
_TAG = masks.HTML[0]


@query(
    f"SELECT page_id, length(html)::BIGINT AS n, (length(html) - sum_tags)::BIGINT AS n_kept, len(tags)::BIGINT AS n_tags FROM (SELECT page_id, html, regexp_extract_all(html, {quoted(_TAG)}) AS tags, coalesce(list_sum(list_transform(regexp_extract_all(html, {quoted(_TAG)}), lambda x: length(regexp_replace(x, '\\s', '', 'g')))), 0) AS sum_tags FROM pages) "
)
def mask_html_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    masked = mask_matches(F.col("html"), _TAG)
    blank = F.length(F.regexp_replace("html", r"\s", "")) - F.length(F.regexp_replace(masked, r"\s", ""))
    return pages.select("page_id", F.length(masked).cast("long").alias("n"), (F.length("html") - blank).cast("long").alias("n_kept"), F.size(F.regexp_extract_all("html", F.lit(_TAG), F.lit(0))).cast("long").alias("n_tags"))


@query()
def mask_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    own = masks.masked(F.col("text"), "markdown")
    return docs.select("doc_id", F.length(own).alias("n"), (F.length("text") == F.length(own)).alias("same_length"), F.size(masks.atoms(F.col("text"), "markdown")).alias("n_atoms"), F.sha2(own, 256).alias("masked_sha256"))


@query()
def mask_latex(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = seeded_tex(spark, sf_dir)
    own = masks.masked(F.col("text"), "latex")
    return docs.select("doc_id", F.length(own).alias("n"), (F.length("text") == F.length(own)).alias("same_length"), F.sha2(own, 256).alias("masked_sha256"))


@query(f"SELECT doc_id, unnest(list_transform(regexp_extract_all(text, {quoted(masks.URL)}), lambda x: regexp_replace(x, '[.,;:)\\]''\"]+$', ''))) AS url FROM documents")
def url_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.explode(F.transform(masks.url_spans(F.col("text")), lambda s: s["text"])).alias("url"))


# --- word-processor paragraphs: conversations as documents, turns as paragraphs ---
@query(
    "WITH p AS (SELECT conv_id, turn, text, coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM conversations) SELECT conv_id, turn, start, start + length(text) AS \"end\" FROM p"
)
def word_paragraph_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 2).over(before), F.lit(0))
    return p.withColumn("start", start).select("conv_id", "turn", "start", (F.col("start") + F.length("text")).alias("end"))


@query("SELECT conv_id, array_to_string(list(text ORDER BY turn), chr(10) || chr(10)) AS text, count(*) FILTER (role = 'user') AS n_user FROM conversations GROUP BY conv_id")
def word_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]), "\n\n")
    return p.groupBy("conv_id").agg(joined.alias("text"), F.count_if(F.col("role") == "user").alias("n_user"))


# --- spelling, parity ---
@query()
def spelling_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return spelling.corrections(docs, spelling.vocabulary(docs))


_TERMS = "SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS key FROM"


@query(
    f"WITH a AS ({_TERMS} documents), b AS ({_TERMS} benchmark), x AS (SELECT key, count(*) AS n_a FROM a GROUP BY key), y AS (SELECT key, count(*) AS n_b FROM b GROUP BY key), z AS (SELECT key, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b FROM x FULL JOIN y USING (key)) SELECT *, abs(n_a - n_b) > greatest(2.0::DOUBLE, greatest(n_a, n_b) * 0.25::DOUBLE) AS divergent FROM z"
)
def parity_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (spark.read.parquet(f"{sf_dir}/{t}.parquet").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("key")) for t in ("documents", "benchmark"))
    return reports.parity(a, b)


@query("SELECT unnest(string_split(text, ' ')) AS w FROM benchmark EXCEPT ALL SELECT unnest(string_split(text, ' ')) AS w FROM documents")
def multiset_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (spark.read.parquet(f"{sf_dir}/{t}.parquet").select(F.explode(F.split("text", " ")).alias("w")) for t in ("benchmark", "documents"))
    return reports.multiset_difference(a, b)


@query("SELECT lang, source, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM documents GROUP BY ALL")
def structure_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


@query("SELECT doc_id, length(text)::INT AS n, CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN length(text) > 1000000 THEN 'too_long' ELSE 'ok' END AS state, len(string_split_regex(trim(text), '\\s+')) > 1500 AS needs_account FROM documents")
def input_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    state = F.when(text.isNull() | (F.trim(text) == ""), "empty").when(F.length(text) > 1_000_000, "too_long").otherwise("ok")
    return _docs(spark, sf_dir).select("doc_id", F.length(text).alias("n"), state.alias("state"), (F.size(F.split(F.trim(text), r"\s+")) > 1500).alias("needs_account"))


ORACLES["d902_missing_niche_signal"] = (
    f"WITH {SEEDED}, {HEADINGS}, i AS (SELECT doc_id, min(start) AS start, min_by(title, start) AS title FROM heads WHERE section = 'introduction' GROUP BY doc_id), "
    "b AS (SELECT i.doc_id, i.start, i.title, min(h.start) AS stop FROM i LEFT JOIN heads h ON h.doc_id = i.doc_id AND h.section <> 'introduction' AND h.start > i.start GROUP BY ALL), "
    "t AS (SELECT b.*, substr(p.flat, (b.start + 1)::BIGINT, (coalesce(stop, length(p.flat)) - b.start)::BIGINT) AS body FROM b JOIN plain p USING (doc_id)) "
    f"SELECT doc_id, 'D902' AS rule_id, start::INT AS start, (start + length(title))::INT AS \"end\", title AS text, NULL::VARCHAR AS replacement FROM t WHERE length(body) >= 600 AND NOT (regexp_matches(body, {quoted('(?i)' + lx.CONTRAST)}) AND regexp_matches(body, {quoted('(?i)' + lx.GAP)}))"
)
