"""Queries on quoted numbers, ranges of references, captions, tables, articles in XML and chart points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import lexicons as lx
from marginalia.operators import paragraphs, quoted as numbers, reports, structure
from marginalia.plans.rule_queries import _CITED, _FLOATS
from marginalia.plans.seeded import SEEDED_TABLES, SEEDED_TEX, SENTENCES, TABLE_SEEDS, WORD_SEEDS, hits_sql, quoted, seeded_with
from marginalia.sources.articles import article_blocks
from marginalia.sources.shared import dealt

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


# --- numbers quoted from tables, over LaTeX passages ---
def _values(source: str, column: str, name: str) -> str:
    """CTEs ending in ``name`` (doc_id, start, end, written, value, decimals, pct, doc)."""
    n = quoted(numbers.NUMBER)
    return (
        hits_sql(numbers.RUN, source, column, f"{name}_runs")
        + f", {name}_p AS (SELECT doc_id, start, doc, regexp_extract(text, {n}, 1) AS w, regexp_extract(text, {n}, 2) AS f, regexp_extract(text, {n}, 3) AS p FROM {name}_runs WHERE regexp_matches(text, {n})), "
        + f"{name} AS (SELECT doc_id, start, (start + length(trim(w || f || p)))::INT AS \"end\", trim(w || f || p) AS written, (replace(w, ',', '') || f)::DOUBLE AS value, greatest(length(f) - 1, 0) AS decimals, p <> '' AS pct, doc FROM {name}_p)"
    )


_LATEX = _CITED.replace(SEEDED_TEX, SEEDED_TABLES)


@query(
    f"{_LATEX}, fp AS (SELECT doc_id, string_split_regex(text, {quoted(structure.FLOAT)}) AS g, regexp_extract_all(text, {quoted(structure.FLOAT)}) AS h FROM seeded), "
    "masked AS (SELECT doc_id, array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || coalesce(regexp_replace(h[i], '[^\n]', ' ', 'g'), '')), '') AS text FROM fp), "
    + SENTENCES.replace("FROM seeded", "FROM masked")
    + f", citing AS (SELECT {{'d': doc_id, 's': start}} AS doc_id, text, start, start + length(text) AS stop FROM sents WHERE regexp_matches(text, '\\d(?:\\.\\d|\\s*\\\\?%)') AND NOT regexp_matches(text, {quoted(lx.SUMMED)})), "
    'outside AS (SELECT c.* FROM cites c JOIN floats USING (doc_id, kind, number) WHERE NOT EXISTS (SELECT 1 FROM floats f WHERE f.doc_id = c.doc_id AND c.pos >= f.start AND c.pos < f."end")), '
    "per AS (SELECT DISTINCT s.doc_id, o.kind, o.number FROM citing s JOIN outside o ON s.doc_id.d = o.doc_id AND o.pos >= s.start AND o.pos < s.stop), "
    "lone AS (SELECT doc_id, min(kind) AS kind, min(number) AS number FROM per GROUP BY doc_id HAVING count(*) = 1 AND min(kind) = 'table'), "
    "bodies AS (SELECT {'d': doc_id, 'n': number} AS doc_id, text FROM floats WHERE kind = 'table' AND number IS NOT NULL), "
    + _values("bodies", "text", "held") + ", " + _values("citing", "text", "said_values")
    + f", q AS (SELECT v.*, l.number, b.text AS body FROM said_values v JOIN lone l USING (doc_id) JOIN bodies b ON b.doc_id.d = v.doc_id.d AND b.doc_id.n = l.number WHERE (pct OR decimals > 0) AND CASE WHEN pct THEN contains(b.text, '%') ELSE regexp_matches(b.text, '\\d\\.\\d') END "
    f"AND NOT regexp_matches(substr(doc, v.\"end\" + 1, 40), {quoted(lx.LEVEL_AFTER)}) AND NOT regexp_matches(substr(doc, greatest(v.start - 11, 1), least(v.start, 12)), {quoted(lx.LEVEL_BEFORE)})) "
    "SELECT doc_id.d AS doc_id, 'X401' AS rule_id, (doc_id.s + start)::INT AS start, (doc_id.s + \"end\")::INT AS \"end\", written AS text, NULL::VARCHAR AS replacement FROM q "
    "WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.doc_id.d = q.doc_id.d AND h.doc_id.n = q.number AND abs(h.value - q.value) < CASE WHEN h.decimals > q.decimals THEN 0.5 * pow(10.0, -q.decimals) ELSE 0 END + 1e-9)"
)
def x401_number_not_in_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbers.numbers_not_in_table(seeded_with(spark, sf_dir, TABLE_SEEDS))


@query(
    f"{_FLOATS.replace(SEEDED_TEX, SEEDED_TABLES)}, {hits_sql(structure.REF, 'seeded', 'text', 'refs')}, "
    "k AS (SELECT doc_id, start, \"end\", doc, regexp_extract(text, '\\{\\s*([^{},]+?)\\s*\\}', 1) AS label, lead(start) OVER w AS nstart, lead(regexp_extract(text, '\\{\\s*([^{},]+?)\\s*\\}', 1)) OVER w AS nlabel FROM refs WINDOW w AS (PARTITION BY doc_id ORDER BY start)), "
    f"p AS (SELECT * FROM k WHERE nstart - \"end\" <= 40 AND regexp_matches(substr(doc, \"end\" + 1, nstart - \"end\"), {quoted(lx.RANGE_MARK)})) "
    "SELECT p.doc_id, a.kind, unnest(range(a.number + 1, b.number)) AS number, p.start AS at FROM p JOIN floats a ON a.doc_id = p.doc_id AND a.label = p.label JOIN floats b ON b.doc_id = p.doc_id AND b.label = p.nlabel AND a.kind = b.kind"
)
def reference_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.reference_ranges(seeded_with(spark, sf_dir, TABLE_SEEDS))


# --- word-processor documents: conversations as documents, turns and a seeded end as paragraphs ---
def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turns = said.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("long").alias("idx"), F.lit("body").alias("kind"), F.lit("normal").alias("style"), "text")
    ends = F.array(*[F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(s).alias("style"), F.lit(t).alias("text")) for k, s, t in seed]) for seed in WORD_SEEDS])
    own = F.element_at(ends, (F.col("doc_id") % len(WORD_SEEDS) + 1).cast("int"))
    added = turns.select("doc_id").distinct().select("doc_id", F.posexplode(own).alias("i", "p")).select("doc_id", (F.col("i") + 100000).cast("long").alias("idx"), "p.*")
    return paragraphs.placed(turns.unionByName(added))


_ENDS = ", ".join(f"({k}, {i}, {quoted(kind)}, {quoted(style)}, {quoted(text)})" for k, seed in enumerate(WORD_SEEDS) for i, (kind, style, text) in enumerate(seed))
_PARAGRAPHS = (
    f"ends(k, i, kind, style, text) AS (VALUES {_ENDS}), rows_ AS (SELECT conv_id AS doc_id, turn::BIGINT AS idx, 'body' AS kind, 'normal' AS style, text FROM conversations "
    f"UNION ALL SELECT c.conv_id, i + 100000, kind, style, text FROM (SELECT DISTINCT conv_id FROM conversations) c JOIN ends ON k = c.conv_id % {len(WORD_SEEDS)}), "
    "paragraphs AS (SELECT *, coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM rows_)"
)
_HEAD = quoted(lx.CAPTION_HEAD)
_CAPTIONS = (
    f"{_PARAGRAPHS}, found AS (SELECT doc_id, start, start + length(text) AS \"end\", CASE WHEN regexp_extract(text, {_HEAD}, 1) LIKE 'Tab%' THEN 'table' ELSE 'figure' END AS kind, regexp_extract(text, {_HEAD}, 2)::BIGINT AS number, style = 'caption' AS styled FROM paragraphs "
    f"WHERE kind = 'body' AND regexp_matches(text, {_HEAD}) AND NOT regexp_matches(text, {quoted(lx.CAPTION_CONTINUED)}) AND (style = 'caption' OR (regexp_matches(text, {quoted(lx.CAPTION_TYPED)}) AND NOT regexp_matches(text, {quoted(lx.CAPTION_LISTED)}) AND style NOT LIKE 'toc%' AND style NOT LIKE 'tableoffigures%'))), "
    "captions AS (SELECT * FROM found f WHERE styled OR NOT EXISTS (SELECT 1 FROM found g WHERE g.doc_id = f.doc_id AND g.kind = f.kind AND g.number = f.number AND (g.styled OR g.start > f.start)))"
)
_CLAIMED = (
    f"{_CAPTIONS}, tabs AS (SELECT doc_id, start, start + length(text) AS \"end\" FROM paragraphs WHERE kind = 'table'), "
    "caps AS (SELECT *, row_number() OVER w AS i, lag(start) OVER w AS prev, lead(start) OVER w AS nxt FROM captions WINDOW w AS (PARTITION BY doc_id ORDER BY start)), "
    'up AS (SELECT c.doc_id, c.i, max(t.start) AS us, max(t."end") AS ue FROM caps c JOIN tabs t ON t.doc_id = c.doc_id AND t."end" <= c.start AND (prev IS NULL OR prev < t."end") GROUP BY ALL), '
    'down AS (SELECT c.doc_id, c.i, min(t.start) AS ds, min(t."end") AS de FROM caps c JOIN tabs t ON t.doc_id = c.doc_id AND t.start >= c."end" AND (nxt IS NULL OR nxt >= t.start) GROUP BY ALL), '
    f"near AS (SELECT c.*, us, ue, ds, de, CASE WHEN c.start - ue < {paragraphs.REACH} THEN c.start - ue END AS ug, CASE WHEN ds - c.\"end\" < {paragraphs.REACH} THEN ds - c.\"end\" END AS dg FROM caps c LEFT JOIN up USING (doc_id, i) LEFT JOIN down USING (doc_id, i)), "
    "fold AS (SELECT doc_id, 0::BIGINT AS i, -1::BIGINT AS taken, NULL::BIGINT AS start, NULL::BIGINT AS number, NULL::BIGINT AS table_start, NULL::BIGINT AS table_end FROM caps GROUP BY doc_id "
    "UNION ALL SELECT n.doc_id, n.i, coalesce(CASE WHEN n.kind <> 'table' THEN NULL WHEN ug IS NULL OR us = taken OR dg <= ug THEN CASE WHEN dg IS NOT NULL THEN ds END ELSE us END, taken), n.start, n.number, "
    "CASE WHEN n.kind <> 'table' THEN NULL WHEN ug IS NULL OR us = taken OR dg <= ug THEN CASE WHEN dg IS NOT NULL THEN ds END ELSE us END, "
    "CASE WHEN n.kind <> 'table' THEN NULL WHEN ug IS NULL OR us = taken OR dg <= ug THEN CASE WHEN dg IS NOT NULL THEN de END ELSE ue END FROM fold f JOIN near n ON n.doc_id = f.doc_id AND n.i = f.i + 1), "
    "claimed AS (SELECT doc_id, start, number, table_start, table_end FROM fold WHERE table_start IS NOT NULL)"
)
_MENTION = structure.MENTION.replace("–", "-")
_WRITTEN = (
    f"body AS (SELECT {{'d': doc_id, 'x': idx, 's': start}} AS doc_id, text FROM paragraphs WHERE kind = 'body' AND style <> 'caption' AND NOT regexp_matches(text, {quoted(lx.CAPTION_TYPED)})), {hits_sql(_MENTION, 'body', 'text', 'said')}, "
    "nums AS (SELECT doc_id.d AS doc_id, doc_id.x AS idx, doc_id.s + start AS start, doc_id.s + \"end\" AS \"end\", CASE WHEN text LIKE 'Tab%' THEN 'table' ELSE 'figure' END AS kind, unnest(regexp_extract_all(text, '\\d+\\s*(?:-|to)\\s*\\d+|\\d+')) AS part FROM said), "
    "pairs AS (SELECT *, regexp_extract(part, '^(\\d+)', 1)::BIGINT AS a, regexp_extract(part, '(\\d+)$', 1)::BIGINT AS b FROM nums), "
    'written AS (SELECT doc_id, idx, start, "end", kind, unnest(CASE WHEN b > a AND b - a < 50 THEN range(a, b + 1) ELSE [a] END) AS number FROM pairs)'
)


@query(f"WITH {_CAPTIONS} SELECT * FROM captions")
def word_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.captions(_paragraphs(spark, sf_dir))


@query(f"WITH RECURSIVE {_CLAIMED} SELECT * FROM claimed")
def word_claimed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.claimed_tables(_paragraphs(spark, sf_dir))


@query(f"WITH {_PARAGRAPHS}, {_WRITTEN} SELECT * FROM written")
def word_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.written_mentions(_paragraphs(spark, sf_dir))


@query(
    f"WITH RECURSIVE {_CLAIMED}, {_WRITTEN}, firsts AS (SELECT doc_id, kind, number, min(start) AS first_ FROM written GROUP BY ALL), ap AS (SELECT doc_id, min(start) AS begins FROM paragraphs WHERE style LIKE 'heading%' AND regexp_matches(lower(text), '^\\s*appendi(?:x|ces)\\b') GROUP BY doc_id) "
    "SELECT c.doc_id, 'X104' AS rule_id, c.start, c.\"end\", c.kind || ' ' || c.number AS text FROM captions c JOIN firsts USING (doc_id, kind, number) LEFT JOIN claimed t ON t.doc_id = c.doc_id AND t.start = c.start LEFT JOIN ap ON ap.doc_id = c.doc_id "
    'WHERE styled AND first_ > greatest(c."end", coalesce(table_end, c."end")) AND (begins IS NULL OR c.start < begins)'
)
def x104_float_before_citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.floats_before_citation(_paragraphs(spark, sf_dir))


_WORDS = "len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))"


@query(
    f"WITH {_PARAGRAPHS} SELECT doc_id, 'X501' AS rule_id, start, start + length(text) AS \"end\", {_WORDS}::INT AS n_words FROM paragraphs WHERE kind = 'body' AND (contains(style, 'heading') OR style = 'title') "
    f"AND {_WORDS} > CASE WHEN regexp_matches(style, 'heading\\d') THEN {paragraphs.LONG_HEADING} ELSE {paragraphs.LONG_TITLE} END"
)
def x501_heading_style_on_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.headings_on_body(_paragraphs(spark, sf_dir))


@query(
    f"WITH {_PARAGRAPHS} SELECT doc_id, count(*) AS n_paragraphs, count(*) FILTER (kind <> 'body') AS n_tables, count(*) FILTER (kind = 'body' AND contains(style, 'heading')) AS n_headings, "
    f"sum(CASE WHEN kind = 'body' THEN {_WORDS} ELSE 0 END)::BIGINT AS n_words FROM paragraphs GROUP BY doc_id"
)
def word_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.coverage(_paragraphs(spark, sf_dir))


# --- articles in XML: each document's lines as paragraphs, the first as the title ---
_UNWRITABLE = r"[\x00-\x08\x0B-\x1F\x{FFFE}\x{FFFF}]"
_LINES = f"list_filter(list_transform(string_split(regexp_replace(text, {quoted(_UNWRITABLE)}, '', 'g'), chr(10)), lambda x: regexp_replace(x, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')), lambda x: x <> '')"


@query(
    f"WITH l AS (SELECT doc_id, source, {_LINES} AS ls FROM documents), b AS (SELECT doc_id, source, unnest(ls) AS text, unnest(range(len(ls)))::INT AS place FROM l) "
    "SELECT doc_id, place, CASE WHEN place = 0 THEN 'title' WHEN place = 1 THEN 'abstract' ELSE 'body' END AS part, CASE WHEN place > 1 THEN 'From ' || source END AS title, text, NULL::VARCHAR AS error FROM b"
)
def article_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text").where("text is not null"))
    lines = F.filter(F.split(F.regexp_replace("text", _UNWRITABLE, ""), "\n"), lambda x: F.regexp_replace(x, r"[\x00-\x20]+", "") != "")

    def escaped(x):
        return F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    own = docs.select("doc_id", "source", F.transform(lines, escaped).alias("ls"))
    first, second = (F.coalesce(F.try_element_at("ls", F.lit(k)), F.lit("")) for k in (1, 2))
    rest = F.array_join(F.transform(F.slice("ls", 3, F.greatest(F.size("ls"), F.lit(1))), lambda x: F.concat(F.lit("<p><italic>"), x, F.lit("</italic></p>"))), "")
    xml = F.concat(F.lit("<article><front><article-meta><title-group><article-title>"), first, F.lit("</article-title></title-group><abstract><p>"), second, F.lit("</p></abstract></article-meta></front><body><sec><title>From "), "source", F.lit("</title>"), rest, F.lit("<fig><caption><p>Left out</p></caption></fig></sec></body></article>"))
    return article_blocks(own.select("doc_id", xml.alias("xml")))


# --- points of a small line chart: daily counts by kind of event, scaled to 0 to 1 ---
@query(
    "WITH d AS (SELECT event_type, ts::DATE AS day, count(*)::DOUBLE AS n FROM events GROUP BY ALL), l AS (SELECT event_type, list(n ORDER BY day) AS ns FROM d GROUP BY event_type) "
    "SELECT event_type, list_transform(ns, lambda x: round(CASE WHEN list_max(ns) > list_min(ns) THEN (x - list_min(ns)) / (list_max(ns) - list_min(ns)) ELSE 0.5 END, 6)) AS points FROM l"
)
def sparkline_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    daily = events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").cast("double").alias("n"))
    listed = daily.groupBy("event_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "n"))), lambda d: d["n"]).alias("ns"))
    return listed.select("event_type", F.transform(reports.sparkline(F.col("ns")), lambda x: F.round(x, 6)).alias("points"))
