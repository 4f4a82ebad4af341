"""Queries over what sections do: the narrative map, its notes, and what abstracts lack."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marginalia.functions import lexicons as lx
from marginalia.functions.text import either
from marginalia.operators import narrative, rules
from marginalia.operators.sections import with_sections
from marginalia.plans.corpus_queries import HEADINGS, PLACED
from marginalia.plans.review_queries import _SQUEEZE
from marginalia.plans.seeded import NARRATIVE_SEEDS, SEEDED_NARRATIVE, listed, quoted, seeded_with

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_sections(seeded_with(spark, sf_dir, NARRATIVE_SEEDS))


def _sents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.sentences(_docs(spark, sf_dir))


def _expects(move: str) -> str:
    return listed(s for s, ms in lx.SECTION_MOVES.items() if move in ms)


_MADE = "list_filter([" + ", ".join(f"CASE WHEN section IN {_expects(m)} AND regexp_matches(lower(flat), {quoted(either(p))}) THEN {quoted(m)} END" for m, p in lx.MOVE_SIGNALS.items()) + "], lambda x: x IS NOT NULL)"
_OPENS = "CASE section " + " ".join(f"WHEN {quoted(s)} THEN [{quoted(m)}]" for s, m in lx.OPENING_MOVES.items()) + " ELSE made END"
#: Misplaced moves by trying every subset: the largest that rises, of several the least as a binary number.
_MAP = (
    f"WITH {SEEDED_NARRATIVE}, {PLACED}, m AS (SELECT doc_id, section, sent, text, {_MADE} AS made, min(sent) OVER (PARTITION BY doc_id, section) AS first FROM placed WHERE section IN {listed(lx.SECTION_MOVES)}), "
    f"u AS (SELECT doc_id, section, sent, text, unnest(CASE WHEN len(made) = 0 AND sent = first THEN {_OPENS} ELSE made END) AS move FROM m), "
    f"f AS (SELECT doc_id, section, move, min(sent) AS sent, min_by({_SQUEEZE.format('text')}, sent) AS evidence FROM u GROUP BY ALL), "
    "plan(section, place, move) AS (VALUES " + ", ".join(f"({quoted(s)}, {k + 1}, {quoted(m)})" for s, ms in lx.SECTION_MOVES.items() for k, m in enumerate(ms)) + "), "
    "e AS (SELECT doc_id, section, place, move, sent, evidence FROM (SELECT DISTINCT doc_id, section FROM m) JOIN plan USING (section) LEFT JOIN f USING (doc_id, section, move)), "
    "p AS (SELECT doc_id, section, list({'place': place, 'sent': sent} ORDER BY place) AS ps FROM e WHERE sent IS NOT NULL GROUP BY ALL), "
    f"sub AS (SELECT doc_id, section, mask, list_filter(ps, lambda x, i: (mask // (1 << (i - 1)::INT)) % 2 = 1) AS picks FROM p, range(1, 64) AS r(mask) WHERE section IN {listed(lx.ORDERED_SECTIONS)} AND mask < (1 << len(ps)::INT)), "
    "rising AS (SELECT doc_id, section, mask, list_transform(picks, lambda x: x.place) AS kept FROM sub WHERE list_transform(picks, lambda x: x.sent) = list_sort(list_distinct(list_transform(picks, lambda x: x.sent)))), "
    "best AS (SELECT doc_id, section, arg_max(kept, len(kept) * 1000 - mask) AS kept FROM rising GROUP BY ALL), "
    "s AS (SELECT e.*, CASE WHEN sent IS NULL THEN 'missing' WHEN kept IS NOT NULL AND NOT list_contains(kept, place) THEN 'out_of_order' ELSE 'present' END AS status FROM e LEFT JOIN best USING (doc_id, section)), "
    "late AS (SELECT a.doc_id, a.section, a.place, coalesce('after ' || arg_max(b.move, b.place) FILTER (b.place > a.place AND b.sent < a.sent), 'before ' || arg_min(b.move, b.place) FILTER (b.place < a.place AND b.sent > a.sent), '') AS note "
    "FROM s a JOIN s b USING (doc_id, section) WHERE a.status = 'out_of_order' GROUP BY ALL), "
    "told AS (SELECT s.*, coalesce(note, '') AS note FROM s LEFT JOIN late USING (doc_id, section, place))"
)


@query(f"{_MAP} SELECT doc_id, section, place, move, status, sent, evidence, note FROM told")
def narrative_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return narrative.narrative_map(_sents(spark, sf_dir))


@query(
    f"{_MAP} SELECT doc_id, section, coalesce(string_agg(move, ',' ORDER BY place) FILTER (status <> 'missing'), '') AS present, "
    "coalesce(string_agg(move, ',' ORDER BY place) FILTER (status = 'missing'), '') AS missing, (count(*) FILTER (status = 'out_of_order'))::INT AS out_of_order FROM told GROUP BY ALL"
)
def move_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return narrative.move_map(_sents(spark, sf_dir))


@query(f"{_MAP} SELECT doc_id, section, move, sent FROM f")
def rhetorical_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return narrative.moves(_sents(spark, sf_dir))


@query(
    f"{_MAP}, here AS (SELECT doc_id, section, min(sent) AS sent, section IN {listed(lx.SECTION_MOVES)} AS known FROM placed GROUP BY ALL), "
    "per AS (SELECT doc_id, count(*) FILTER (known) AS n_mapped, coalesce(string_agg(section, ',' ORDER BY sent) FILTER (NOT known AND section NOT IN ('front', 'references')), '') AS unmapped FROM here GROUP BY doc_id) "
    "SELECT doc_id, n_mapped, coalesce(n, 0) AS n_missing, unmapped FROM per LEFT JOIN (SELECT doc_id, count(*) FILTER (status = 'missing') AS n FROM told GROUP BY doc_id) USING (doc_id)"
)
def narrative_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return narrative.unmapped(_sents(spark, sf_dir))


def _told(patterns: list[str], of: str = "sents") -> str:
    return f"len(list_filter({of}, lambda x: regexp_matches(x, {quoted(either(patterns))}))) > 0"


_LACKS = {m: f"NOT {_told(lx.ABSTRACT_SIGNALS[m])}" for m in lx.ABSTRACT_SIGNALS} | {"background": _told(lx.ABSTRACT_SIGNALS["aim"] + lx.ABSTRACT_SIGNALS["methods"], "sents[1:1]")}


@query(
    f"WITH {SEEDED_NARRATIVE}, {HEADINGS}, a AS (SELECT doc_id, min(start) AS a FROM heads WHERE section = 'abstract' GROUP BY doc_id), "
    "z AS (SELECT doc_id, a, min(start) FILTER (section <> 'abstract' AND start > a) AS z FROM a JOIN heads USING (doc_id) GROUP BY ALL), "
    "b AS (SELECT doc_id, a, substr(flat, (a + 1)::BIGINT, (coalesce(z, length(flat)) - a)::BIGINT) AS body FROM z JOIN plain USING (doc_id)), "
    "o AS (SELECT doc_id, a + length(body) - length(regexp_replace(body, '^\\s+', '')) AS start, regexp_replace(body, '^\\s+|\\s+$', '', 'g') AS own FROM b), "
    "s AS (SELECT *, string_split_regex(lower(own), '[.!?]\\s+') AS sents, length(regexp_extract(own, '^(?s:.*?)[.!?](?:\\s|$)')) AS n FROM o WHERE length(own) >= 300), "
    "l AS (SELECT *, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_LACKS[m]} THEN '{m}' END" for m in lx.ABSTRACT_MOVES) + "], lambda x: x IS NOT NULL), ',') AS missing FROM s) "
    "SELECT doc_id, start::INT AS start, (start + CASE WHEN n > 0 THEN n ELSE least(length(own), 200) END)::INT AS \"end\", missing FROM l WHERE missing <> ''"
)
def abstract_lens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return narrative.abstract_lens(_docs(spark, sf_dir))


@query(ORACLES["abstract_lens"].replace('SELECT doc_id, start::INT AS start, (start + CASE WHEN n > 0 THEN n ELSE least(length(own), 200) END)::INT AS "end", missing', "SELECT doc_id, missing"))
def abstract_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return narrative.abstract_lens(_docs(spark, sf_dir)).select("doc_id", "missing")
