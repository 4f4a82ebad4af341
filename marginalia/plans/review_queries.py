"""Queries of the review layer: checklists, polish, the reader's brief, settings, gates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import checklists as lists
from marginalia.functions import lexicons as lx
from marginalia.functions.text import either
from marginalia.operators import bench, checklists, discourse, pipeline, polish, review, rules, settings
from marginalia.operators.sections import with_sections
from marginalia.plans import corpus_queries as corpus
from marginalia.plans.rule_queries import ORACLES as RULE_SQL
from marginalia.plans.seeded import EQUATION_SEEDS, POLISH_SEEDS, SEEDED, SEEDED_EQUATIONS, SEEDED_POLISH, SEEDED_STUDY, STUDY_SEEDS, hits_sql, quoted, seeded, seeded_with

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


# --- published checklists ---
def _names(values: list[str]) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]::VARCHAR[]"


_FIT = "fit AS (SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(flat, {quoted('(?i)' + cue)}) THEN {quoted(name)}" for name, cue in lists.CUES.items()) + " END AS checklist FROM plain)"
_PLACES = "CASE checklist " + " ".join(
    f"WHEN {quoted(name)} THEN list_filter([" + ", ".join(f"CASE WHEN regexp_matches(flat, {quoted('(?i)' + either(signals))}) THEN {k} END" for k, (_, signals, _w) in enumerate(items, 1)) + "], lambda x: x IS NOT NULL)"
    for name, items in lists.ITEMS.items()
) + " END"
_SQUEEZE = "CASE WHEN length(trim(regexp_replace({0}, '\\s+', ' ', 'g'))) > 180 THEN left(trim(regexp_replace({0}, '\\s+', ' ', 'g')), 179) || '…' ELSE trim(regexp_replace({0}, '\\s+', ' ', 'g')) END"
_CHECKED = (
    f"WITH {SEEDED_STUDY}, {corpus.PLACED}, {_FIT}, s AS (SELECT p.*, checklist FROM placed p JOIN fit USING (doc_id) WHERE checklist IS NOT NULL), there AS (SELECT doc_id, list(DISTINCT section) AS there FROM s GROUP BY doc_id), "
    + "items(checklist, place, item, sections) AS (VALUES " + ", ".join(f"({quoted(c)}, {k}, {quoted(i)}, {_names(w)})" for c, k, i, w in checklists.listing()) + "), "
    + f"h AS (SELECT doc_id, checklist, sent, section, text, unnest({_PLACES}) AS place FROM s), "
    "ok AS (SELECT h.* FROM h JOIN items USING (checklist, place) JOIN there USING (doc_id) WHERE list_contains(sections, section) OR NOT list_has_any(sections, there)), "
    f"firsts AS (SELECT doc_id, place, {_SQUEEZE.format('min_by(text, sent)')} AS evidence FROM ok GROUP BY ALL), "
    "checked AS (SELECT f.doc_id, f.checklist, i.place::INT AS place, i.item, CASE WHEN evidence IS NOT NULL THEN 'reported' ELSE 'needs_check' END AS status, evidence FROM fit f JOIN items i USING (checklist) LEFT JOIN firsts o ON o.doc_id = f.doc_id AND o.place = i.place)"
)


@query(_CHECKED + " SELECT * FROM checked")
def published_checklists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checklists.report(seeded_with(spark, sf_dir, STUDY_SEEDS))


@query(_CHECKED + " SELECT doc_id, checklist, count(*) FILTER (status = 'reported') AS reported, count(*) AS total FROM checked GROUP BY ALL")
def checklist_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checklists.summary(checklists.report(seeded_with(spark, sf_dir, STUDY_SEEDS)))


# --- polish ---
def _pass(k: int) -> str:
    """One pass over in_k as CTE in_{k+1}."""
    found = " UNION ALL ".join(
        "SELECT doc_id, start, \"end\", rule_id, replacement FROM (" + RULE_SQL[n].replace(f"WITH {SEEDED}, ", "WITH ", 1) + ")"
        for n in ("w201_grand_word", "w202_wordy_phrase", "w205_filler", "w206_redundant_pair", "w207_doubled_word")
    )
    parts = quoted(polish.THERE_PARTS)
    return f"""in_{k + 1} AS MATERIALIZED (WITH RECURSIVE seeded AS MATERIALIZED (SELECT doc_id, text FROM in_{k}),
fed AS (SELECT doc_id, chr(10) || text AS text FROM seeded), {hits_sql(polish.THERE, 'fed', 'text', 'th')},
e AS (SELECT * FROM ({found}) WHERE replacement IS NOT NULL UNION ALL
  SELECT doc_id, start, "end" - 1, 'G105', regexp_extract(text, {parts}, 1) || upper(left(regexp_extract(text, {parts}, 2), 1)) || substr(regexp_extract(text, {parts}, 2), 2) || ' ' FROM th),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, "end" DESC, rule_id, replacement) AS n FROM e),
nx AS MATERIALIZED (SELECT a.doc_id, a.n, min(b.n) AS nxt FROM o a JOIN o b ON a.doc_id = b.doc_id AND b.n > a.n AND b.start >= a."end" GROUP BY ALL),
walk AS (SELECT doc_id, n FROM o WHERE n = 1 UNION ALL SELECT w.doc_id, nx.nxt FROM walk w JOIN nx ON nx.doc_id = w.doc_id AND nx.n = w.n),
k AS (SELECT o.*, s.text AS doc, o.replacement = '' AS gone FROM o JOIN walk USING (doc_id, n) JOIN seeded s USING (doc_id)),
c AS (SELECT *, "end" + CASE WHEN gone AND substr(doc, ("end" + 1)::BIGINT, 1) = ' ' THEN 1 ELSE 0 END AS e1 FROM k),
d AS (SELECT *, gone AND (start = 0 OR regexp_matches(substr(doc, greatest(start - 1, 1)::BIGINT, least(start, 2)::BIGINT), '^[.!?] $|\\n$')) AND regexp_matches(substr(doc, (e1 + 1)::BIGINT, 1), '^\\p{{Ll}}$') AS up FROM c),
g AS (SELECT doc_id, n, doc, start, e1 + up::INT AS e2, CASE WHEN up THEN upper(substr(doc, (e1 + 1)::BIGINT, 1)) ELSE replacement END AS put FROM d),
p AS (SELECT *, lag(e2, 1, 0) OVER (PARTITION BY doc_id ORDER BY n) AS a0 FROM g),
t AS (SELECT doc_id, count(*) AS made, string_agg(substr(doc, (a0 + 1)::BIGINT, greatest(start - a0, 0)::BIGINT) || put, '' ORDER BY n) || substr(any_value(doc), (arg_max(e2, n) + 1)::BIGINT) AS new FROM p GROUP BY doc_id)
SELECT i.doc_id, i.was, i.n_edits + coalesce(made, 0) AS n_edits, CASE WHEN made > 0 THEN regexp_replace(regexp_replace(new, ' +([,.;:!?])', '\\1', 'g'), ',\\s*,', ',', 'g') ELSE i.text END AS text FROM in_{k} i LEFT JOIN t USING (doc_id))"""


@query(f"WITH {SEEDED_POLISH.replace('seeded AS', 'start_ AS')}, in_0 AS (SELECT doc_id, text AS was, text, 0 AS n_edits FROM start_), {', '.join(map(_pass, range(polish.PASSES)))} SELECT doc_id, n_edits::INT AS n_edits, text <> was AS changed, text FROM in_{polish.PASSES}")
def polished(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polish.polished(seeded_with(spark, sf_dir, POLISH_SEEDS))


# --- the reader's brief ---
def _first(move: str) -> str:
    return f"{_SQUEEZE.format(f'min_by(text, CASE WHEN regexp_matches(lower(flat), {quoted(either(lx.MOVE_SIGNALS[move]))}) THEN sent END)')} AS {move}"


@query(
    f"WITH f AS (WITH {corpus.ALL} SELECT doc_id, rule_id FROM kept), s AS MATERIALIZED (WITH {SEEDED}, {corpus.PLACED} SELECT doc_id, sent, section, text, flat FROM placed), m AS (SELECT doc_id, count(*) AS links FROM ({corpus.ORACLES['missing_links']}) GROUP BY doc_id), "
    + "c AS (SELECT doc_id, " + ", ".join(f"count(*) FILTER (rule_id = '{r}') AS {n}" for n, r in review.COUNTED.items()) + " FROM f GROUP BY doc_id), "
    + f"e AS (SELECT doc_id, {', '.join(map(_first, review.QUOTED))}, bool_or(regexp_matches(lower(flat), {quoted(either(lx.ROLE_SIGNALS['claim']))})) AS claims, bool_or(section = 'introduction') AS intro, bool_or(section = 'limitations') AS limits, bool_or(section <> 'unknown') AS structured FROM s GROUP BY doc_id), "
    + "w AS (SELECT e.*, " + ", ".join(f"coalesce({n}, 0) AS {n}" for n in review.COUNTED) + ", coalesce(links, 0) AS links FROM e LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)), "
    "x AS (SELECT *, (overclaims + stacks + novelty + links + (structured AND intro AND NOT (no_gap = 0 AND gap IS NOT NULL))::INT + (structured AND NOT limits)::INT)::BIGINT AS worries FROM w) "
    "SELECT doc_id, CASE WHEN aim IS NOT NULL THEN 'detected' ELSE 'not_detected' END AS b_aim, CASE WHEN causal + consensus > 0 THEN 'detected' ELSE 'not_detected' END AS c_claims, "
    "CASE WHEN worries > 0 THEN 'detected' WHEN claims OR causal + overclaims > 0 THEN 'not_detected' ELSE 'not_applicable' END AS d_convincing, CASE WHEN significance IS NOT NULL THEN 'detected' ELSE 'not_detected' END AS e_use, worries, aim, gap, significance FROM x"
)
def review_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = seeded(spark, sf_dir)
    sents = rules.sentences(with_sections(docs))
    return review.brief(corpus._analysed(spark, sf_dir), sents, discourse.missing_links(discourse.roles(sents)))


# --- settings: events stand for the changes users make ---
def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _mutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).where("event_type in ('error', 'signup')")
    return e.select("user_id", F.concat(F.lit("W"), (F.col("event_id") % 11 + 201).cast("string")).alias("rule_id"), (F.col("event_type") == "error").alias("muted"), F.col("event_id").alias("at"))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).where("event_type = 'click'")
    return settings.dictionaries(e.select("user_id", F.concat(F.lit("w"), (F.col("event_id") % 97).cast("string")).alias("word"), F.col("event_id").alias("at")))


_MUTES = (
    "log AS (SELECT user_id, 'W' || (201 + event_id % 11) AS rule_id, event_type = 'error' AS muted, event_id AS seq FROM events WHERE event_type IN ('error', 'signup')), "
    "last_off AS (SELECT user_id, rule_id, max(seq) AS gone FROM log WHERE NOT muted GROUP BY ALL), held AS (SELECT user_id, rule_id, min(seq) AS seq FROM log LEFT JOIN last_off USING (user_id, rule_id) WHERE muted AND (gone IS NULL OR seq > gone) GROUP BY ALL), "
    "muted AS (SELECT user_id, list(rule_id ORDER BY seq) AS disabled_rules, bool_and(regexp_full_match(rule_id, '[A-Z]{1,4}[0-9]{1,4}')) AND count(*) <= 200 AS valid FROM held GROUP BY user_id)"
)
_DICTIONARY = (
    "added AS (SELECT user_id, 'w' || (event_id % 97) AS word, min(event_id) AS added FROM events WHERE event_type = 'click' GROUP BY ALL), "
    "words AS (SELECT user_id, word, added FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY added, word) AS k FROM added) WHERE k <= 5000)"
)


@query(f"WITH {_MUTES} SELECT user_id, array_to_string(disabled_rules, ',') AS disabled_rules, valid FROM muted")
def muted_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settings.disabled_rules(_mutes(spark, sf_dir)).select("user_id", F.array_join("disabled_rules", ",").alias("disabled_rules"), "valid")


@query(f"WITH {_DICTIONARY} SELECT user_id, word, added FROM words")
def dictionary_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir)


@query(
    f"WITH {_MUTES}, {_DICTIONARY}, chosen AS (SELECT user_id, arg_max(value > 20, event_id) AS show_preferences, CASE WHEN max(event_id) % 2 = 0 THEN 'en-GB' ELSE 'en-US' END AS locale FROM events WHERE event_type = 'purchase' GROUP BY user_id), "
    "own AS (SELECT user_id, list(word ORDER BY word) AS dictionary FROM words GROUP BY user_id) SELECT c_custkey AS user_id, coalesce(array_to_string(disabled_rules, ','), '') AS disabled_rules, coalesce(show_preferences, FALSE) AS show_preferences, "
    "coalesce(locale, 'en-US') AS locale, 'revise' AS mode, 'auto' AS document_type, coalesce(array_to_string(dictionary, ','), '') AS dictionary FROM customer LEFT JOIN muted ON muted.user_id = c_custkey LEFT JOIN chosen ON chosen.user_id = c_custkey LEFT JOIN own ON own.user_id = c_custkey"
)
def my_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("user_id"))
    bought = _events(spark, sf_dir).where("event_type = 'purchase'").groupBy("user_id")
    choices = bought.agg(F.max_by(F.col("value") > 20, "event_id").alias("show_preferences"), F.when(F.max("event_id") % 2 == 0, "en-GB").otherwise("en-US").alias("locale"))
    out = settings.configurations(users, settings.disabled_rules(_mutes(spark, sf_dir)), choices, _words(spark, sf_dir))
    return out.withColumns({c: F.array_join(c, ",") for c in ("disabled_rules", "dictionary")})


# --- reports on a whole run ---
_SPLIT = "list_filter(string_split_regex({0}, '\\s+'), lambda x: x <> '')"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query(
    f"WITH k AS (SELECT CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN length(text) > 1000000 THEN 'refused_too_large' WHEN NOT (len({_SPLIT.format('text')}) * 6.0::DOUBLE / length(text)) BETWEEN 0.5 AND 2.0 THEN 'word_count_drift' END AS kind FROM documents), "
    "s AS (SELECT kind, count(*) AS n FROM k GROUP BY kind), r AS (SELECT kind, n FROM s WHERE kind IS NOT NULL UNION ALL SELECT 'nothing_checked', 1 WHERE NOT EXISTS (SELECT 1 FROM s WHERE kind IS NULL OR kind = 'word_count_drift')) "
    "SELECT CASE WHEN kind IN ('empty', 'nothing_checked') THEN 'failure' ELSE 'warning' END AS severity, kind, n FROM r"
)
def run_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bench.run_gate(_docs(spark, sf_dir))


_RULES = ", ".join(f"({quoted(r.rule_id)}, {quoted(r.name)}, {quoted(r.category)}, {quoted(r.tier)})" for r in rules.RULES)


@query(f"WITH {corpus.ALL}, rules(rule_id, name, category, tier) AS (VALUES {_RULES}), c AS (SELECT rule_id, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM kept GROUP BY rule_id) SELECT rule_id, name, category, tier, coalesce(n, 0) AS n, coalesce(n_docs, 0) AS n_docs FROM rules LEFT JOIN c USING (rule_id)")
def rule_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bench.rule_coverage(corpus._analysed(spark, sf_dir))


@query(
    f"WITH {corpus.ALL}, w AS (SELECT doc_id, len({_SPLIT.format('text')})::BIGINT AS n_words FROM raw), r AS (SELECT doc_id, rule_id, count(*) AS n FROM kept GROUP BY ALL), s AS (SELECT doc_id, sum(n)::BIGINT AS n_flags, array_to_string((list(rule_id || ':' || n ORDER BY n DESC, rule_id))[1:5], ',') AS top FROM r GROUP BY doc_id) "
    "SELECT doc_id, n_words, coalesce(n_flags, 0) AS n_flags, CASE WHEN n_words > 0 THEN round(coalesce(n_flags, 0) * 1000.0::DOUBLE / n_words, 2) ELSE 0.0 END AS per_1000, coalesce(top, '') AS top FROM w LEFT JOIN s USING (doc_id)"
)
def progress_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bench.progress_rows(corpus._analysed(spark, sf_dir), seeded(spark, sf_dir))


@query(
    f"WITH {SEEDED}, {corpus.HEADINGS}, n AS (SELECT doc_id, section, start, lead(start) OVER (PARTITION BY doc_id ORDER BY start) AS stop FROM heads), c AS (SELECT n.doc_id, count(*) AS k, sum(CASE WHEN section = 'references' THEN coalesce(stop, length(text)) - start ELSE 0 END) AS chars FROM n JOIN seeded USING (doc_id) GROUP BY n.doc_id) "
    "SELECT lang, count(*) AS n_docs, count(k) AS with_sections, sum(coalesce(k, 0))::BIGINT AS n_sections, sum(coalesce(chars, 0))::BIGINT AS set_aside FROM seeded LEFT JOIN c USING (doc_id) GROUP BY lang"
)
def set_aside_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bench.set_aside(seeded(spark, sf_dir))


_KIND = ", ".join(f"CASE WHEN n_{c} > 0 THEN n_{c} || ' {c}' || CASE WHEN n_{c} = 1 THEN '' ELSE 's' END END" for c in bench.CATEGORIES)


@query(
    f"WITH c AS ({corpus.ORACLES['shown_counters']}), t AS (SELECT *, n_correction + n_improvement + n_convention + n_preference AS n, hidden_preferences + hidden_by_mode AS h FROM c) "
    f"SELECT doc_id, n || ' suggestion' || CASE WHEN n = 1 THEN '' ELSE 's' END || CASE WHEN n > 0 THEN ' (' || array_to_string(list_filter([{_KIND}], lambda x: x IS NOT NULL), ', ') || ')' ELSE '' END || CASE WHEN h > 0 THEN '; ' || h || ' hidden' ELSE '' END AS line FROM t"
)
def summary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bench.summary_lines(corpus.shown_counters(spark, sf_dir))


@query("SELECT source AS rule_id, count(*) FILTER (quality = 0) AS wrong, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY source ORDER BY wrong DESC, rule_id DESC LIMIT 5")
def worst_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return bench.worst(labels.join(_docs(spark, sf_dir), "doc_id").select(F.col("source").alias("rule_id"), (F.col("quality") == 1).alias("right")))


@query("SELECT event_id AS check_id, value AS seconds FROM events ORDER BY seconds DESC, check_id LIMIT 10")
def slowest_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bench.slowest(_events(spark, sf_dir).select(F.col("event_id").alias("check_id"), F.col("value").alias("seconds")))


@query(
    f"WITH {SEEDED_EQUATIONS}, s AS (SELECT doc_id, list_distinct(regexp_extract_all(text, {quoted(bench.DEFINED)}, 1)) AS d, list_distinct(regexp_extract_all(text, {quoted(bench.REFERRED)}, 1)) AS r FROM seeded) "
    "SELECT doc_id, len(list_distinct(list_concat(d, r)))::INT AS n_any, len(list_intersect(d, r))::INT AS n_both, len(list_filter(r, lambda x: NOT list_contains(d, x)))::INT AS n_dangling, len(list_filter(d, lambda x: NOT list_contains(r, x)))::INT AS n_unused, array_to_string(list_sort(list_filter(r, lambda x: NOT list_contains(d, x))), ',') AS dangling FROM s"
)
def label_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bench.label_sets(seeded_with(spark, sf_dir, EQUATION_SEEDS))


@query(
    f"WITH {SEEDED_EQUATIONS}, p AS (SELECT doc_id, unnest(regexp_extract_all(text, {quoted(bench.EQUATIONS)}, 1)) AS a, unnest(regexp_extract_all(text, {quoted(bench.EQUATIONS)}, 2)) AS b FROM seeded), q AS (SELECT doc_id, try_cast(a AS INT) AS a, try_cast(nullif(b, '') AS INT) AS b FROM p), "
    f"n AS (SELECT doc_id, unnest(CASE WHEN b IS NULL THEN [a] WHEN b - a BETWEEN 0 AND {bench.LONGEST - 1} THEN range(a, b + 1) ELSE [a, b] END)::INT AS number FROM q WHERE a IS NOT NULL) SELECT doc_id, number, count(*) AS n FROM n GROUP BY ALL"
)
def equation_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bench.equation_mentions(seeded_with(spark, sf_dir, EQUATION_SEEDS))


def _stripped(column: str) -> str:
    for p in bench.UNREAD:
        column = f"regexp_replace({column}, {quoted(p)}, ' ', 'g')"
    return column


@query(f"SELECT page_id, len(list_filter(string_split_regex({_stripped('html')}, '\\s+'), lambda x: regexp_matches(x, '[A-Za-z0-9\\x{{80}}-\\x{{10FFFF}}]')))::BIGINT AS n_words FROM pages")
def page_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bench.prose_words(spark.read.parquet(f"{sf_dir}/pages.parquet"))


# --- what a reader sees of a section, and what an edit makes stale ---
@query(f"WITH {corpus.ALL}, kinds(rule_id, category, scope) AS (VALUES {corpus._KINDS}) SELECT doc_id, count(*) FILTER (scope = 'sentence' AND section = 'results') AS in_section, count(*) FILTER (scope <> 'sentence') AS whole_document, count(*) FILTER (scope = 'sentence' AND section <> 'results') AS elsewhere FROM kept JOIN kinds USING (rule_id) GROUP BY doc_id")
def section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.section_split(corpus._analysed(spark, sf_dir), "results")


@query(
    f"WITH {corpus.ALL}, l AS (SELECT doc_id, rule_id, start, \"end\", length(left(r.text, start)) - length(replace(left(r.text, start), chr(10), '')) + 1 AS line FROM kept JOIN (SELECT doc_id, text FROM raw) r USING (doc_id)) "
    "SELECT *, count(*) OVER (PARTITION BY doc_id, line) - 1 AS n_stale FROM l"
)
def stale_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.stale_after_edit(corpus._analysed(spark, sf_dir), seeded(spark, sf_dir))
