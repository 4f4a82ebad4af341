"""One query a rule, over the seeded view, with SQL that computes the same findings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marginalia.functions import lexicons as lx
from marginalia.functions.text import WORD, any_of, either
from marginalia.operators import rules, structure
from marginalia.operators.sections import plain_headings, resolve_sections
from marginalia.plans.seeded import PLAIN, SEEDED, SEEDED_TEX, SENTENCES, hits_sql, listed, quoted, seeded, seeded_tex, words_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def _out(rule_id: str, rows: str, where: str = "TRUE", start: str = "start", end: str = '"end"', text: str = "text", replacement: str = "NULL::VARCHAR") -> str:
    return f'SELECT doc_id, {quoted(rule_id)} AS rule_id, ({start})::INT AS start, ({end})::INT AS "end", {text} AS text, {replacement} AS replacement FROM {rows} WHERE {where}'


def _on_docs(operator) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(seeded(spark, sf_dir))


def _on_sentences(operator) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(rules.sentences(seeded(spark, sf_dir)))


def _sentence_rule(rule_id: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: rules.sentence_rule(rules.sentences(seeded(spark, sf_dir), context=rule_id in ("E702", "E703")), rule_id)


def _on_tex(operator) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(seeded_tex(spark, sf_dir))


# --- pattern rules: one alternation each ---
for _rule in rules.RULES:
    if _rule.pattern:
        _where = "TRUE"
        if _rule.rule_id == "W203":
            _where = f"NOT regexp_matches(substr(doc, \"end\" + 1, 40), '(?i)^\\s*(?:{'|'.join(lx.HYPE_TECHNICAL)})')"
        _before = "substr(doc, greatest(start - 29, 1), least(start, 30))"
        if _rule.rule_id == "C304":
            _where = f"NOT regexp_matches({_before}, {quoted(lx.BEFORE_SIGNIFICANT)})"
        if _rule.rule_id == "W201":
            _where = f"NOT (lower(text) IN {listed(lx.GRAND_ONLY_AS_VERB)} AND regexp_matches({_before}, {quoted(lx.BEFORE_NOUN)}))"
        if _rule.rule_id == "C303":
            _where = f"NOT regexp_matches({_before}, {quoted(lx.BEFORE_CALIBRATED)}) AND NOT (regexp_matches(text, {quoted(lx.CHANGE_FORMS)}) AND NOT regexp_matches(substr(doc, \"end\" + 1, 8), {quoted(lx.AFTER_CHANGE)}))"
        _repl = "NULL::VARCHAR"
        if _rule.replacements is not None:
            _repl = "CASE lower(text) " + " ".join(f"WHEN {quoted(a)} THEN {quoted(b)}" for a, b in _rule.replacements.items()) + " END"
        _name = f"{_rule.rule_id.lower()}_{_rule.name.replace('-', '_')}"
        _sql = f"WITH {SEEDED}, {PLAIN}, {hits_sql(_rule.pattern)} " + _out(_rule.rule_id, "hits", _where, replacement=_repl)
        if _rule.rule_id == "C302":  # 'prove' is spared in sentences about proofs
            _sql = f"WITH {SEEDED}, {PLAIN}, {hits_sql(_rule.pattern)}, picked AS (SELECT doc_id, text FROM seeded WHERE doc_id IN (SELECT doc_id FROM hits)), {SENTENCES.replace('FROM seeded', 'FROM picked')}, around AS (SELECT h.*, s.text AS sentence FROM hits h ASOF JOIN sents s ON h.doc_id = s.doc_id AND h.start >= s.start) "
            _sql += _out("C302", "around", f"NOT (starts_with(lower(text), 'prov') AND regexp_matches(lower(sentence), {quoted(lx.PROOF)}))")
        _add(_name, lambda spark, sf_dir, rid=_rule.rule_id: rules.pattern_findings(seeded(spark, sf_dir), [rid]), _sql)


# --- sentence rules ---
def _first_sql(rule_id: str, pattern: str, group: int = 0, guard: str = "TRUE") -> str:
    p = quoted(pattern)
    hit, whole = f"regexp_extract(text, {p}, {group})", f"regexp_extract(text, {p}, 0)"
    lead = f"length(string_split_regex(text, {p})[1]) + strpos({whole}, {hit}) - 1"
    return f"WITH {SEEDED}, {SENTENCES} " + _out(rule_id, "sents", f"regexp_matches(text, {p}) AND {guard}", f"start + {lead}", f"start + {lead} + length({hit})", hit)


_add("g105_expletive_opener", _sentence_rule("G105"), _first_sql("G105", "(?i)" + lx.EXPLETIVE, 1))
_add("e707_display_first_opener", _sentence_rule("E707"), _first_sql("E707", lx.FIGURE_OPENER))
_add("e704_uncited_consensus", _sentence_rule("E704"), _first_sql("E704", lx.CONSENSUS, guard=f"NOT regexp_matches(text, {quoted(lx.CITATION)})"))
_add("e705_absolute_novelty", _sentence_rule("E705"), _first_sql("E705", "(?i)" + lx.NOVELTY, guard=f"NOT regexp_matches(lower(text), {quoted(either(lx.SOFTENERS))})"))
_body = "rtrim(regexp_replace(rtrim(text), '[.!?]+$', ''))"
_trail = "CASE " + " ".join(f"WHEN regexp_matches({_body}, {quoted('(?i)' + p)}) THEN regexp_extract({_body}, {quoted('(?i)' + p)}, 0)" for p in lx.TRAILING_QUALIFIERS) + " END"
_add(
    "g108_weak_stress_position",
    _sentence_rule("G108"),
    f"WITH {SEEDED}, {SENTENCES}, t AS (SELECT *, {_trail} AS hit, {_body} AS body FROM sents) " + _out("G108", "t", "hit IS NOT NULL", "start + length(body) - length(hit)", "start + length(body)", "hit"),
)
_add(
    "g106_overlong_sentence",
    _sentence_rule("G106"),
    f"WITH {SEEDED}, {SENTENCES}, t AS (SELECT *, {words_sql()} AS w FROM sents) "
    + _out("G106", "t", "len(w) > 50 AND len(list_filter(w, lambda x: NOT regexp_full_match(x, '[A-Za-z\\x{80}-\\x{10FFFF}]+'))) < 0.25 * len(w)", "start", "start + len"),
)
_suffix = f"[a-z]*(?:{'|'.join(lx.NOMINAL_SUFFIXES)})s?"
_add(
    "g103_nominalization_density",
    _sentence_rule("G103"),
    f"WITH {SEEDED}, {SENTENCES}, t AS (SELECT *, list_filter(list_transform({words_sql()}, lambda x: lower(x)), lambda x: length(x) >= 7 AND regexp_full_match(x, '{_suffix}') AND x NOT IN {listed(lx.NOMINAL_ALLOWED)}) AS f FROM sents) "
    + _out("G103", "t", "len(f) >= 3", "start", "start + len"),
)
_add(
    "e703_naked_this",
    _sentence_rule("E703"),
    f"WITH {SEEDED}, {SENTENCES}, t AS (SELECT *, {words_sql()} AS w FROM sents), u AS (SELECT *, lag(len(w), 1, 0) OVER (PARTITION BY doc_id ORDER BY sent) AS prev, regexp_extract(text, 'This[^A-Za-z0-9]+[A-Za-z]+', 0) AS hit FROM t) "
    + _out("E703", "u", f"len(w) >= 3 AND w[1] = 'This' AND lower(w[2]) IN {listed(lx.NAKED_THIS_VERBS)} AND prev >= 18", "start + strpos(text, 'This') - 1", "start + strpos(text, 'This') - 1 + length(hit)", "hit"),
)
_add(
    "e702_adversative_run",
    _sentence_rule("E702"),
    f"WITH {SEEDED}, {SENTENCES}, t AS (SELECT *, regexp_extract(text, {quoted('(?i)' + lx.ADVERSATIVE)}, 1) AS hit FROM sents), u AS (SELECT *, count(CASE WHEN hit <> '' THEN 1 END) OVER (PARTITION BY doc_id ORDER BY sent RANGE BETWEEN 2 PRECEDING AND 1 PRECEDING) AS n FROM t) "
    + _out("E702", "u", "hit <> '' AND n > 0", "start + strpos(text, hit) - 1", "start + strpos(text, hit) - 1 + length(hit)", "hit"),
)
_add(
    "n102_numeral_opener",
    _sentence_rule("N102"),
    f"WITH {SEEDED}, {SENTENCES}, t AS (SELECT *, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM sents) "
    + _out(
        "N102",
        "t",
        "len(w) >= 4 AND regexp_full_match(w[1], '[0-9]+(?:[.,][0-9]+)*') AND NOT regexp_full_match(w[1], '(1[89]|20)[0-9]{2}') AND regexp_full_match(w[2], '[a-z]+') AND len(list_filter(w, lambda x: regexp_full_match(x, '[A-Za-z]+[.,;:!?]?'))) >= 5 AND len(list_filter(w, lambda x: regexp_full_match(x, '[0-9][0-9.,]*'))) * 4 <= len(w)",
        "start + strpos(text, w[1]) - 1",
        "start + strpos(text, w[1]) - 1 + length(w[1])",
        "w[1]",
    ),
)
_HEDGED = f"""hedged AS (SELECT doc_id || ':' || sent AS doc_id, doc_id AS d, start AS s, text FROM sents WHERE len(regexp_extract_all(flat, {quoted("(?i)" + any_of(lx.HEDGES))})) > 1)"""
_add(
    "c301_hedge_stack",
    _on_sentences(rules.hedge_stacks),
    f"WITH {SEEDED}, {SENTENCES}, {_HEDGED}, {hits_sql(WORD, 'hedged', 'text', 'tok')}, "
    f"""lows AS (SELECT doc_id, list(lower(text) ORDER BY i) AS w FROM tok GROUP BY doc_id),
hh AS (SELECT *, lag(i) OVER o AS a, lag(start) OVER o AS a_start FROM tok WHERE lower(text) IN {listed(lx.HEDGES)} WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT hh.*, coalesce(i - a <= 4 AND NOT list_has_any(w[a + 1:i - 1], ['that', 'which', 'whether', 'if', 'and', 'or', 'but'])
  AND len(list_filter(w[greatest(a - 2, 1):i - 1], lambda x: x IN ('not', 'never') OR regexp_matches(x, 'n[''’]t$'))) = 0, FALSE) AS good FROM hh JOIN lows USING (doc_id)),
r AS (SELECT *, sum(CASE WHEN good THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run, good ORDER BY i) AS k FROM r),
pairs AS (SELECT hedged.d AS doc_id, s + a_start AS start, s + n."end" AS "end", substr(hedged.text, (a_start + 1)::BIGINT, (n."end" - a_start)::BIGINT) AS text FROM n JOIN hedged USING (doc_id) WHERE good AND k % 2 = 1) """
    + _out("C301", "pairs"),
)

# --- document rules ---
_add(
    "w207_doubled_word",
    _on_docs(rules.doubled_words),
    f"WITH {SEEDED}, {PLAIN}, {hits_sql(r'\b[A-Za-z]+\b')}, "
    """linked AS (SELECT *, lower(text) = lower(lag(text) OVER w) AND regexp_full_match(substr(doc, lag("end") OVER w + 1, start - lag("end") OVER w), '[ \\t]+') AS again FROM hits WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
runs AS (SELECT *, sum(CASE WHEN coalesce(again, FALSE) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM linked),
pairs AS (SELECT doc_id, run, count(*) AS n, min(start) AS start, max("end") AS "end", min_by(text, i) AS word, any_value(doc) AS doc FROM runs GROUP BY doc_id, run) """
    + _out("W207", "pairs", """n = 2 AND lower(word) NOT IN ('had', 'that') AND "end" - start - 2 * length(word) < 3 AND (length(word) > 1 OR lower(word) = 'a')""", text='substr(doc, start + 1, "end" - start)', replacement="word"),
)
_pairs = ", ".join(f"({k}, {f}, {quoted(w)})" for k, p in enumerate(lx.VARIANT_PAIRS) for f, w in enumerate(p))
_add(
    "w210_variant_consistency",
    _on_docs(rules.variant_consistency),
    f"WITH {SEEDED}, {PLAIN}, {hits_sql('(?i)' + any_of(w for p in lx.VARIANT_PAIRS for w in p))}, pairs(pair, form, word) AS (VALUES {_pairs}), "
    """used AS (SELECT doc_id, pair, form, count(*) AS n, min(start) AS start FROM hits JOIN pairs ON lower(text) = word GROUP BY ALL),
both_forms AS (SELECT *, count(*) OVER (PARTITION BY doc_id, pair) AS forms, row_number() OVER (PARTITION BY doc_id, pair ORDER BY n, form) AS r FROM used) """
    + 'SELECT doc_id, \'W210\' AS rule_id, b.start, h."end", h.text, NULL::VARCHAR AS replacement FROM both_forms b JOIN hits h USING (doc_id, start) WHERE forms = 2 AND r = 1',
)
_add(
    "w211_compound_two_ways",
    _on_docs(rules.compounds_two_ways),
    f"WITH {SEEDED}, {hits_sql('[A-Za-z]+(?:-[A-Za-z]+)?', 'seeded', 'text')}, "
    """t AS (SELECT doc_id, i, start, "end", lower(text) AS w, substr(doc, "end" + 1, 1) AS nxt FROM hits),
two AS (SELECT *, lead(w) OVER o AS w2, lead(start) OVER o AS s2, lead("end") OVER o AS e2 FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
split AS (SELECT doc_id, w || w2 AS joined, start, e2 AS "end" FROM two WHERE nxt = ' ' AND s2 = "end" + 1 AND NOT contains(w, '-') AND NOT contains(w2, '-') AND length(w) >= 3 AND length(w2) >= 3
          UNION ALL SELECT doc_id, replace(w, '-', ''), start, "end" FROM t WHERE contains(w, '-')),
ns AS (SELECT doc_id, joined, count(*) AS n, min(start) AS start, min_by("end", start) AS "end" FROM split WHERE length(joined) >= 6 GROUP BY ALL),
nc AS (SELECT doc_id, w AS joined, count(*) AS n, min(start) AS start, min_by("end", start) AS "end" FROM t WHERE NOT contains(w, '-') AND length(w) >= 6 GROUP BY ALL),
j AS (SELECT ns.doc_id, ns.joined AS text, CASE WHEN nc.n < ns.n THEN nc.start ELSE ns.start END AS start, CASE WHEN nc.n < ns.n THEN nc."end" ELSE ns."end" END AS "end" FROM ns JOIN nc USING (doc_id, joined)) """
    + _out("W211", "j"),
)
_units = "|".join(sorted(lx.UNITS, key=lambda u: (-len(u), u)))
_add(
    "n101_number_unit_spacing",
    _on_docs(rules.unit_spacing),
    f"WITH {SEEDED}, {hits_sql(rf'\d+(?:[.,]\d+)? ?(?:{_units})', 'seeded', 'text')}, "
    """t AS (SELECT *, replace(lower(regexp_replace(text, '^[0-9.,]+ ?', '')), 'μ', 'µ') AS unit, contains(text, ' ') AS spaced FROM hits
      WHERE NOT regexp_matches(substr(doc, start, 1), '[A-Za-z0-9_.\\x{80}-\\x{10FFFF}]') AND NOT regexp_matches(substr(doc, "end" + 1, 1), '[A-Za-z]')),
g AS (SELECT doc_id, unit, count(*) FILTER (spaced) AS s, count(*) AS n FROM t GROUP BY ALL),
o AS (SELECT t.*, row_number() OVER (PARTITION BY t.doc_id, t.unit ORDER BY start) AS r FROM t JOIN g USING (doc_id, unit) WHERE s > 0 AND s < n AND spaced = (s < n - s)) """
    + _out("N101", "o", "r = 1"),
)
_verbs = "CASE lower(regexp_extract(text, '[A-Za-z]+$', 0)) " + " ".join(f"WHEN {quoted(n)} THEN {quoted(v)}" for n, v in lx.NOMINAL_VERBS.items()) + " END"
_add("g102_buried_action", _on_docs(rules.buried_actions), f"WITH {SEEDED}, {PLAIN}, {hits_sql(rules.BURIED)} " + _out("G102", "hits", replacement=_verbs))
_add(
    "f601_acronym_undefined",
    _on_docs(rules.undefined_acronyms),
    f"WITH {SEEDED}, {PLAIN}, {hits_sql(r'\b[A-Z]{2,6}s?\b')}, "
    f"""listed AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?m)^\\s*([A-Z]{{2,6}})s?\\s*(?:[—–:\\-]|\\s{{2,}})\\s*[A-Z(]', 1)) AS acr FROM seeded),
t AS (SELECT *, regexp_extract(text, '^[A-Z]+', 0) AS acr, regexp_replace(substr(doc, greatest(start - 44, 1), "end" + 45 - greatest(start - 45, 0)), '[^A-Za-z]', '', 'g') AS win,
      substr(doc, "end" + 1, 2) AS after2, substr(doc, greatest(start - 19, 1), least(start, 20)) AS before20, left(doc, start) AS before FROM hits),
k AS (SELECT * FROM t WHERE acr NOT IN {listed(lx.ACRONYMS_ALLOWED)} AND (doc_id, acr) NOT IN (SELECT doc_id, acr FROM listed)
      AND NOT (length(acr) >= 2 AND regexp_full_match(acr, 'X{{0,3}}(?:IX|IV|V?I{{0,3}})'))
      AND length(regexp_replace(win, '[^A-Z]', '', 'g')) <= 0.55 * length(win)
      AND NOT regexp_matches(after2, '^(?:\\.[0-9]|\\([0-9])')
      AND len(string_split_regex(regexp_extract(substr(doc, greatest(start - 79, 1), least(start, 80)), '(?:\\b[A-Z][A-Z&''’-]+[ \\t]+)+$', 0), '[ \\t]+')) + len(string_split_regex(regexp_extract(substr(doc, "end" + 1, 80), '^(?:[ \\t]+[A-Z][A-Z&''’-]+\\b)+', 0), '[ \\t]+')) < 4
      AND NOT (length(acr) <= 3 AND regexp_matches(before20, '[A-Z][a-z]{{2,}}\\s+$') AND (regexp_matches(after2, '^\\s*[,.;]') OR after2 = ''))),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, acr ORDER BY start) AS r FROM k) """
    + _out("F601", "f", "r = 1 AND NOT regexp_matches(substr(doc, greatest(start - 1, 1), least(start, 2)), '\\( ?$') AND NOT contains(before, '(' || acr || ')') AND NOT contains(before, '(' || acr || 's)')", text="acr"),
)
_DEFINITIONS = (
    f"WITH {SEEDED}, {hits_sql(rules.DEFINED, 'seeded', 'text')}, "
    + f"""d1 AS (SELECT *, regexp_extract(text, '^\\((.*?)s?\\)$', 1) AS acr FROM hits WHERE start > 0),
d2 AS (SELECT *, substr(doc, greatest(start - (length(acr) * 12 + 20) + 1, 1), least(start, length(acr) * 12 + 20)) AS before FROM d1
       WHERE length(regexp_replace(acr, '[^A-Z]', '', 'g')) >= 2 AND acr NOT IN {listed(lx.ACRONYMS_ALLOWED)}),
defs AS (SELECT doc_id, doc, acr, start + 1 AS start, start + 1 + length(acr) AS "end" FROM d2 WHERE regexp_matches(before, '\\s$')
         AND regexp_matches(lower(rtrim(before)), '(?s)(?:^|[^a-z0-9])' || array_to_string(string_split(lower(regexp_replace(acr, '[^A-Za-z0-9]', '', 'g')), ''), '.*')))"""
)
_add(
    "f612_defined_twice",
    _on_docs(rules.defined_twice),
    _DEFINITIONS + ', b AS (SELECT *, lag(start) OVER (PARTITION BY doc_id, acr ORDER BY start) AS prev FROM defs) ' + _out("F612", "b", "start - prev <= 20000", text="acr"),
)
_add(
    "f613_rarely_used",
    _on_docs(rules.rarely_used),
    _DEFINITIONS
    + f""", {hits_sql('[A-Za-z0-9_-]+', 'seeded', 'text', 'tok')},
firsts AS (SELECT doc_id, acr, min(start) AS start, min_by("end", start) AS "end", count(*) AS defs FROM defs GROUP BY ALL),
uses AS (SELECT f.doc_id, f.acr, f.start, f."end", f.defs, count(t.start) AS n FROM firsts f LEFT JOIN (SELECT doc_id, start, regexp_replace(text, 's$', '') AS acr FROM tok WHERE regexp_full_match(text, '[A-Z][A-Za-z0-9-]*')) t
  ON t.doc_id = f.doc_id AND t.acr = f.acr AND t.start >= f."end" GROUP BY ALL) """
    + _out("F613", "uses", "n - (defs - 1) <= 1", text="acr"),
)


def _missing_niche(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = seeded(spark, sf_dir)
    return rules.missing_niche(docs, resolve_sections(plain_headings(docs)))


_add("d902_missing_niche_signal", _missing_niche)

# --- structure rules, over LaTeX passages ---
_FLOATS = (
    f"WITH {SEEDED_TEX}, {hits_sql(structure.FLOAT, 'seeded', 'text')}, "
    """f0 AS (SELECT *, regexp_extract(text, '\\\\begin\\{(figure|table)', 1) AS kind, nullif(trim(regexp_extract(text, '\\\\caption(?:\\[[^\\]]*\\])?\\{([^{}]*)\\}', 1)), '') AS caption,
      nullif(regexp_extract(text, '\\\\label\\{([^{}]+)\\}', 1), '') AS label FROM hits),
floats AS (SELECT *, CASE WHEN caption IS NOT NULL THEN count(caption) OVER (PARTITION BY doc_id, kind ORDER BY start) END AS number FROM f0)"""
)
_add(
    "x202_caption_too_short",
    _on_tex(structure.short_captions),
    _FLOATS + " " + _out("X202", "floats", "kind = 'figure' AND len(regexp_extract_all(caption, '[A-Za-z][0-9A-Za-z_''-]*')) BETWEEN 1 AND 4", text="caption"),
)
_add(
    "x302_equation_not_in_sentence",
    _on_tex(structure.detached_equations),
    f"WITH {SEEDED_TEX}, {hits_sql(structure.EQUATION, 'seeded', 'text')}, t AS (SELECT *, regexp_replace(left(doc, start), '\\s+$', '') AS before FROM hits) "
    + _out("X302", "t", "regexp_matches(before, '\\.$') AND NOT regexp_matches(before, '(?:\\b(?:e\\.g|i\\.e|cf|al|Eq|Fig)|\\b[A-Z])\\.$')", text="right(before, 20)"),
)
_CITED = (
    _FLOATS
    + f", labels AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\\\\label\\{{([^{{}}]+)\\}}', 1)) AS label FROM seeded), {hits_sql(structure.REF, 'seeded', 'text', 'refs')}, {hits_sql(structure.MENTION.replace('–', '-'), 'seeded', 'text', 'said')}, "
    + """keys AS (SELECT doc_id, start, "end", unnest(string_split_regex(regexp_extract(text, '\\{([^{}]+)\\}', 1), '\\s*,\\s*')) AS key FROM refs),
tries AS (SELECT k.*, l.label, p.o FROM keys k, (VALUES ('', 0), ('fig:', 1), ('tab:', 2), ('eq:', 3), ('sec:', 4)) p(pre, o) JOIN labels l ON TRUE WHERE l.doc_id = k.doc_id AND l.label = p.pre || k.key),
named AS (SELECT doc_id, start, key, min_by(label, o) AS label FROM tries GROUP BY ALL),
nums AS (SELECT doc_id, start, "end", CASE WHEN starts_with(text, 'Tab') THEN 'table' ELSE 'figure' END AS kind, unnest(regexp_extract_all(text, '\\d+\\s*(?:-|to)\\s*\\d+|\\d+')) AS part FROM said),
spread AS (SELECT doc_id, start, "end", kind, unnest(CASE WHEN regexp_matches(part, '\\D') AND regexp_extract(part, '(\\d+)$', 1)::INT > regexp_extract(part, '^(\\d+)', 1)::INT AND regexp_extract(part, '(\\d+)$', 1)::INT - regexp_extract(part, '^(\\d+)', 1)::INT < 50
           THEN range(regexp_extract(part, '^(\\d+)', 1)::BIGINT, regexp_extract(part, '(\\d+)$', 1)::BIGINT + 1) ELSE [regexp_extract(part, '^(\\d+)', 1)::BIGINT] END) AS number FROM nums),
cites AS (SELECT doc_id, kind, number, start AS pos FROM spread UNION ALL SELECT n.doc_id, f.kind, f.number, n.start AS pos FROM named n JOIN floats f USING (doc_id, label) WHERE f.number IS NOT NULL),
cited AS (SELECT c.* FROM cites c JOIN floats f USING (doc_id, kind, number) WHERE pos < f.start OR pos >= f."end")"""
)
_add(
    "x101_float_not_cited",
    _on_tex(structure.uncited_floats),
    _CITED + " " + _out("X101", "floats", "number IS NOT NULL AND (doc_id, kind, number) NOT IN (SELECT doc_id, kind, number FROM cited)", text="kind || ' ' || number"),
)
_add(
    "x102_cited_out_of_order",
    _on_tex(structure.cited_out_of_order),
    _CITED
    + ", fc AS (SELECT doc_id, kind, number, min(pos) AS start FROM cited GROUP BY ALL), o AS (SELECT *, max(number) OVER (PARTITION BY doc_id, kind ORDER BY start, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM fc) "
    + _out("X102", "o", "number < top", end="start", text="kind || ' ' || number"),
)
_add(
    "x103_broken_cross_reference",
    _on_tex(structure.broken_references),
    _CITED
    + """, bad AS (SELECT k.doc_id, k.start, k."end", k.key AS what FROM keys k LEFT JOIN named n USING (doc_id, start, key) WHERE n.label IS NULL
  UNION ALL SELECT s.doc_id, s.start, s."end", s.kind || ' ' || s.number FROM spread s JOIN seeded d USING (doc_id)
  WHERE (s.doc_id, s.kind) IN (SELECT doc_id, kind FROM floats WHERE number IS NOT NULL) AND (s.doc_id, s.kind, s.number) NOT IN (SELECT doc_id, kind, number FROM floats WHERE number IS NOT NULL)
    AND NOT regexp_matches(substr(d.text, s."end" + 1, 24), '^\\s+(?:of|in)\\s+[A-Z][a-z]+ et al')) """
    + _out("X103", "bad", text="what"),
)
_add(
    "x301_equation_not_referenced",
    _on_tex(structure.unreferenced_equations),
    f"WITH {SEEDED_TEX}, {hits_sql(structure.EQUATION, 'seeded', 'text')}, "
    """e AS (SELECT doc_id, start, "end", nullif(regexp_extract(text, '\\\\label\\{([^{}]+)\\}', 1), '') AS label, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS number FROM hits),
refs AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\\\\(?:eq|auto|c|C)?ref\\*?\\{([^{}]+)\\}', 1)) AS label FROM seeded),
said AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\\b(?:Equation|Eq\\.?)~?\\s*\\(?(\\d+)', 1))::BIGINT AS number FROM seeded),
open_ AS (SELECT e.* FROM e ANTI JOIN refs USING (doc_id, label)), lone AS (SELECT open_.* FROM open_ ANTI JOIN said USING (doc_id, number)) """
    + _out("X301", "lone", text="'equation ' || number"),
)
