"""Queries on LaTeX sources as the reader reads them: masks, items, floats by chapter and the checks on them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import tex
from marginalia.operators import crossrefs, latex
from marginalia.plans.seeded import hits_sql, quoted
from marginalia.plans.tex_seeds import TEX_VIEW, tex_documents
from marginalia.sources.shared import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


def _read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latex.latex_documents(tex_documents(spark, sf_dir))


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read once: the checks look at items, headings and text from several sides."""
    return stored(_read(spark, sf_dir))


@query(f"WITH {TEX_VIEW} SELECT doc_id, CASE WHEN k = 3 THEN 'lenient' ELSE 'parsed' END AS reader, length(masked)::INT AS n_chars, md5(masked) AS masked_md5 FROM tex")
def latex_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir).select("doc_id", "reader", F.length("masked").alias("n_chars"), F.md5("masked").alias("masked_md5"))


@query(f"WITH {TEX_VIEW} SELECT doc_id, kind, start, \"end\", label FROM tex_items WHERE kind NOT IN ('chapter', 'appendix')")
def latex_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latex.items(_read(spark, sf_dir))


# --- the checks in SQL, over the places known by construction ---
_PREFIXED = " ".join(f"WHEN EXISTS (SELECT 1 FROM labs l WHERE l.doc_id = r.doc_id AND l.label = {quoted(p)} || r.key) THEN {quoted(p)} || r.key" for p in ["", *tex.LABEL_PREFIXES])
_FLOATS = (
    f"{TEX_VIEW}, caps AS (SELECT * FROM tex_items WHERE kind = 'caption'), env AS (SELECT * FROM tex_items WHERE kind IN ('figure', 'table')), "
    'inner_ AS (SELECT e.doc_id, e.start, arg_max(c.start, (c.label IS NOT DISTINCT FROM e.label, c.start)) AS cs, arg_max(c."end", (c.label IS NOT DISTINCT FROM e.label, c.start)) AS ce FROM env e JOIN caps c ON c.doc_id = e.doc_id AND c.start >= e.start AND c.start < e."end" GROUP BY ALL), '
    'all_ AS (SELECT e.doc_id, e.k, e.kind, e.start, e."end", e.label, cs, ce FROM env e LEFT JOIN inner_ USING (doc_id, start) '
    "UNION ALL SELECT doc_id, k, 'table', start, \"end\", label, start, \"end\" FROM caps c WHERE k = 4 AND NOT EXISTS (SELECT 1 FROM env e WHERE e.doc_id = c.doc_id AND c.start >= e.start AND c.start < e.\"end\")), "
    "chaps AS (SELECT doc_id, start FROM tex_items WHERE kind = 'chapter'), "
    "put AS (SELECT a.*, (SELECT count(*) FROM chaps c WHERE c.doc_id = a.doc_id AND c.start < a.start) AS chapter, EXISTS (SELECT 1 FROM tex_items x WHERE x.doc_id = a.doc_id AND x.kind = 'appendix' AND x.start < a.start) AS appendix FROM all_ a), "
    "fl AS (SELECT doc_id, kind, start, \"end\", label, cs, ce, appendix, CASE WHEN cs IS NOT NULL THEN CASE WHEN k = 1 THEN [chapter::INT, n::INT] ELSE [n::INT] END END AS number FROM "
    "(SELECT *, count(cs) OVER (PARTITION BY doc_id, kind, chapter ORDER BY start) AS n FROM put))"
)
_TEXT_OF = "array_to_string(list_transform({0}, lambda x: x::VARCHAR), '.')"


def _name(kind: str = "kind", number: str = "number") -> str:
    lettered = f"CASE WHEN {number}[1] >= 100 THEN chr(({number}[1] - 35)::INT) || '.' || {number}[2] ELSE {_TEXT_OF.format(number)} END"
    return f"upper(left({kind}, 1)) || substr({kind}, 2) || ' ' || {lettered}"


def _n(part: str) -> str:
    return (
        f"CASE WHEN regexp_matches({part}, '^[A-Z]\\.\\d+[a-z]?$') THEN [(ascii({part}) + 35)::INT, regexp_extract({part}, '\\.(\\d+)', 1)::INT] "
        f"WHEN regexp_matches({part}, '^\\d') THEN list_transform(string_split(regexp_replace({part}, '[a-z]$', ''), '.'), lambda x: x::INT) END"
    )


_SAID = (
    f"{_FLOATS}, labs AS (SELECT DISTINCT doc_id, label FROM tex_items WHERE label IS NOT NULL AND kind IN ('label', 'figure', 'table', 'equation', 'caption')), "
    "rs AS (SELECT doc_id, start, \"end\", label AS key FROM tex_items WHERE kind = 'ref'), "
    f"refs AS (SELECT r.*, CASE {_PREFIXED} END AS label FROM rs r), "
    f"texts AS (SELECT doc_id, masked AS text, masked FROM tex), {hits_sql(crossrefs.MENTION, 'texts', 'masked', 'said')}, "
    f"parts AS (SELECT doc_id, start, \"end\", substr(doc, \"end\" + 1, 60) AS after, CASE WHEN text LIKE 'Tab%' THEN 'table' ELSE 'figure' END AS kind, regexp_extract_all(regexp_replace(text, '^[A-Za-z]+\\.?~?\\s*', ''), {quoted(crossrefs.PART)}) AS p FROM said), "
    f"ns AS (SELECT *, p[i - 1] AS mark, {_n('p[i]')} AS n, CASE WHEN i > 2 THEN {_n('p[i - 2]')} END AS before FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM parts)), "
    "written AS (SELECT doc_id, start, \"end\", after, kind, i, unnest(CASE WHEN mark IN ('–', '—', '-', 'to') AND len(n) = 1 AND len(before) = 1 AND n[1] > before[1] AND n[1] - before[1] < 50 THEN list_transform(range(before[1] + 1, n[1] + 1), lambda x: [x::INT]) ELSE [n] END) AS number FROM ns WHERE n IS NOT NULL), "
    "nexts AS (SELECT *, lead(key) OVER w AS key2, lead(start) OVER w AS start2 FROM rs WINDOW w AS (PARTITION BY doc_id ORDER BY start)), "
    f"spread AS (SELECT x.doc_id, x.start, a.kind, unnest(range(a.number[-1] + 1, b.number[-1]))::INT AS m, a.number AS na FROM nexts x JOIN texts t USING (doc_id) JOIN refs r ON r.doc_id = x.doc_id AND r.start = x.start JOIN fl a ON a.doc_id = x.doc_id AND a.label = r.label JOIN refs s ON s.doc_id = x.doc_id AND s.start = x.start2 JOIN fl b ON b.doc_id = x.doc_id AND b.label = s.label AND a.kind = b.kind AND a.number[:-2] = b.number[:-2] WHERE start2 - x.\"end\" <= 40 AND regexp_matches(substr(t.text, x.\"end\" + 1, start2 - x.\"end\"), {quoted(crossrefs.RANGE)})), "
    "cited AS (SELECT r.doc_id, r.start, f.kind, f.number FROM refs r JOIN fl f USING (doc_id, label) WHERE f.number IS NOT NULL UNION SELECT doc_id, start, kind, list_append(na[:-2], m) FROM spread "
    "UNION SELECT w.doc_id, w.start, w.kind, w.number FROM written w JOIN fl f USING (doc_id, kind, number)), "
    'held AS (SELECT c.*, (SELECT max(p.start) FROM caps p WHERE p.doc_id = c.doc_id AND p.start <= c.start AND c.start < p."end") AS cap FROM cited c)'
)


@query(f"WITH {_FLOATS} SELECT doc_id, kind, start, \"end\", label, cs AS cap_start, CASE WHEN number IS NOT NULL THEN {_name()} END AS name, appendix FROM fl")
def latex_floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("number").isNotNull(), crossrefs._name())
    return crossrefs.floats(_placed(spark, sf_dir)).select("doc_id", "kind", "start", "end", "label", "cap_start", name.alias("name"), "appendix")


@query(
    f"WITH {_SAID} SELECT doc_id, 'X101' AS rule_id, cs AS start, ce AS \"end\", {_name()} AS what FROM fl WHERE number IS NOT NULL "
    "AND NOT EXISTS (SELECT 1 FROM held h WHERE h.doc_id = fl.doc_id AND h.kind = fl.kind AND h.number = fl.number AND (h.cap IS NULL OR h.cap <> fl.cs))"
)
def latex_uncited_floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crossrefs.uncited_floats(_placed(spark, sf_dir))


@query(
    f"WITH {_SAID}, firsts AS (SELECT h.doc_id, kind, number, number[:-2] AS scope, min(h.start) AS start FROM held h JOIN fl USING (doc_id, kind, number) WHERE cap IS NULL AND NOT appendix GROUP BY ALL), "
    "tops AS (SELECT *, max(number) OVER (PARTITION BY doc_id, kind, scope ORDER BY start, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM firsts) "
    f"SELECT doc_id, 'X102' AS rule_id, start, start AS \"end\", {_name()} || ' after ' || {_name(number='top')} AS what FROM tops WHERE number < top"
)
def latex_cited_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crossrefs.cited_out_of_order(_placed(spark, sf_dir))


@query(
    f"WITH {_SAID}, runin AS (SELECT doc_id, 'table' AS kind, [1] AS number FROM tex WHERE k = 4), "
    f"bad AS (SELECT w.*, row_number() OVER (PARTITION BY w.doc_id, w.start ORDER BY i, number) AS r FROM written w WHERE NOT regexp_matches(after, {quoted(crossrefs.ELSEWHERE)}) "
    'AND NOT EXISTS (SELECT 1 FROM caps p WHERE p.doc_id = w.doc_id AND p.start <= w.start AND w.start < p."end") '
    "AND EXISTS (SELECT 1 FROM fl f WHERE f.doc_id = w.doc_id AND f.kind = w.kind AND f.number[:-2] = w.number[:-2]) "
    "AND NOT EXISTS (SELECT 1 FROM fl f WHERE f.doc_id = w.doc_id AND f.kind = w.kind AND f.number = w.number) "
    "AND NOT EXISTS (SELECT 1 FROM runin f WHERE f.doc_id = w.doc_id AND f.kind = w.kind AND f.number = w.number)) "
    "SELECT doc_id, 'X103' AS rule_id, start, \"end\", key AS what FROM refs WHERE label IS NULL "
    f"UNION ALL SELECT doc_id, 'X103', start, \"end\", {_name()} FROM bad WHERE r = 1"
)
def latex_broken_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crossrefs.broken_references(_placed(spark, sf_dir))
