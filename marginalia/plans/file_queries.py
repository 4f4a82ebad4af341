"""Queries on files: zipped projects and Word files made of the given texts, read back from their bytes."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import lexicons as lx
from marginalia.operators import latex, segments, styles
from marginalia.plans.seeded import hits_sql, quoted
from marginalia.sources import documents
from marginalia.sources.shared import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


def _zipped(pick: Callable[[pd.DataFrame], Iterator[tuple[str, dict[str, str]]]], kind: str):
    """Rows to (path, kind, content): archives of the files that ``pick`` names."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, files in pick(batch):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
                    for name, text in files.items():
                        archive.writestr(zipfile.ZipInfo(name), text)
                rows.append((path, kind, out.getvalue()))
            yield pd.DataFrame(rows, columns=["path", "kind", "content"])

    return make


# --- zipped LaTeX projects: T stands for the document's words ---
PROJECT = {
    "main.tex": "\\documentclass{article}\n\\begin{document}\nT \\ref{a}\n\\input{parts/one} and\n\\input{parts/two}\n \\ref{b} \\end{document}\n",
    "notes.tex": "Never read: \\ref{z}\n",
    "parts/one.tex": "One\nT\n\\ref{c} \\input{parts/three}\n\\ref{d}",
    "parts/three.tex": "T\\ref{f}\n\\ref{g}",
    "parts/two.tex": " \\ref{e} T",
}
_WORDS = r"[^A-Za-z .\n]"


def _projects(batch: pd.DataFrame):
    for i, text in zip(batch["doc_id"], batch["words"], strict=True):
        yield str(i), {p: t.replace("T", "\ue000").replace("\ue000", text) if "T" in t else t for p, t in PROJECT.items()}


def _file(path: str) -> str:
    return f"replace({quoted(PROJECT[path])}, 'T', t)"


def _cut(path: str, command: str) -> str:
    """Place of an input in its file."""
    return f"(strpos({_file(path)}, {quoted(command)}) - 1)"


#: Segments in reading order: path, begin and end in that file.
_PIECES = [
    ("main.tex", "0", _cut("main.tex", "\\input{parts/one}")),
    ("parts/one.tex", "0", _cut("parts/one.tex", "\\input{parts/three}")),
    ("parts/three.tex", "0", f"length({_file('parts/three.tex')})"),
    ("parts/one.tex", f"{_cut('parts/one.tex', chr(92) + 'input{parts/three}')} + 19", f"length({_file('parts/one.tex')})"),
    ("main.tex", f"{_cut('main.tex', chr(92) + 'input{parts/one}')} + 17", _cut("main.tex", "\\input{parts/two}")),
    ("parts/two.tex", "0", f"length({_file('parts/two.tex')})"),
    ("main.tex", f"{_cut('main.tex', chr(92) + 'input{parts/two}')} + 17", f"length({_file('main.tex')})"),
]
_PROJECT_VIEW = (
    f"w AS (SELECT doc_id, replace(regexp_replace(coalesce(text, ''), {quoted(_WORDS)}, '', 'g'), 'T', 't') AS t FROM documents), "
    "pieces AS (" + " UNION ALL ".join(f"SELECT doc_id, {k} AS k, {quoted(p)} AS path, ({a})::INT AS source_start, ({b})::INT AS source_end FROM w" for k, (p, a, b) in enumerate(_PIECES)) + "), "
    "segs AS (SELECT *, coalesce(sum(source_end - source_start) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start FROM pieces WHERE source_end > source_start), "
    "files AS (" + " UNION ALL ".join(f"SELECT {{'d': doc_id, 'p': {quoted(p)}}} AS doc_id, {_file(p)} AS text FROM w" for p in PROJECT) + ")"
)


def project_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = F.replace(F.regexp_replace(F.coalesce("text", F.lit("")), _WORDS, ""), F.lit("T"), F.lit("t"))
    return docs.select("doc_id", words.alias("words")).mapInPandas(_zipped(_projects, "project"), "path string, kind string, content binary")


@query(
    f"WITH {_PROJECT_VIEW}, {hits_sql(chr(92) * 2 + 'ref' + chr(92) + '{[a-z]' + chr(92) + '}', 'files', 'text', 'refs')} "
    "SELECT r.doc_id.d AS doc_id, (s.start + r.start - s.source_start)::INT AS start, substr(r.text, 6, 1) AS label, r.doc_id.p AS path, "
    "(1 + length(substr(doc, 1, r.start)) - length(replace(substr(doc, 1, r.start), chr(10), '')))::INT AS line, "
    "(length(regexp_extract(substr(doc, 1, r.start), '[^\n]*$')) + 1)::INT AS col "
    "FROM refs r ASOF JOIN segs s ON s.doc_id = r.doc_id.d AND s.path = r.doc_id.p AND r.start >= s.source_start"
)
def project_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = stored(documents.projects(project_files(spark, sf_dir)).select(F.col("path").cast("long").alias("doc_id"), "text", "segments"))
    refs = latex.items(latex.latex_documents(read)).where("kind = 'ref'").select("doc_id", "start", "label")
    return segments.source_positions(refs, read, segments.project_segments(read))


# --- Word files: conversations as documents, turns as paragraphs, styled by number ---
#: (style id, name, outline level, based on); the second set holds a circle, a style of nothing and two of one id.
STYLE_SETS = [
    [("Heading1", "heading 1", "0", None), ("Sub", "My heading", None, "Heading1"), ("SubSub", "Deep", None, "Sub"), ("Odd", "Odd", "9", "Heading1"), ("Title", "Title", None, None), ("Normal", "Normal", None, None)],
    [("Heading1", "heading 1", None, "Base"), ("Base", "Base", "2", None), ("Sub", "A", None, "SubSub"), ("SubSub", "B", None, "Sub"), ("Odd", None, "x", None), ("Normal", "Normal", None, "None"), ("Heading1", "heading 0", "5", None)],
]
USED = ["Normal", "Heading1", "Sub", "SubSub", "Odd", "Title", "heading3"]
_UNWRITABLE = r"[\x00-\x08\x0B-\x1F\x{FFFE}\x{FFFF}]"
_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def _styles_xml(rows) -> str:
    def one(i, name, level, based):
        parts = ("" if name is None else f'<w:name w:val="{name}"/>') + ("" if based is None else f'<w:basedOn w:val="{based}"/>') + ("" if level is None else f'<w:pPr><w:outlineLvl w:val="{level}"/></w:pPr>')
        return f'<w:style w:styleId="{i}">{parts}</w:style>'

    return f"<w:styles {_NS}>{''.join(one(*r) for r in rows)}</w:styles>"


def _word_files(batch: pd.DataFrame):
    for i, paragraphs in zip(batch["doc_id"], batch["ps"], strict=True):
        body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{p["style"]}"/></w:pPr><w:r><w:t>{escape(p["text"])}</w:t></w:r><w:del><w:r><w:t>gone</w:t></w:r></w:del></w:p>' for p in paragraphs)
        yield str(i), {"word/document.xml": f"<w:document {_NS}><w:body>{body}</w:body></w:document>", "word/styles.xml": _styles_xml(STYLE_SETS[i % len(STYLE_SETS)])}


def word_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    style = F.element_at(F.array(*map(F.lit, USED)), ((F.col("conv_id") + F.col("turn")) % len(USED) + 1).cast("int"))
    text = F.regexp_replace(F.coalesce("text", F.lit("")), _UNWRITABLE, "")
    ps = F.array_sort(F.collect_list(F.struct("turn", style.alias("style"), text.alias("text"))))
    return said.groupBy(F.col("conv_id").alias("doc_id")).agg(ps.alias("ps")).mapInPandas(_zipped(_word_files, "word"), "path string, kind string, content binary")


_STYLE_ROWS = ", ".join(f"({k}, {', '.join('NULL' if x is None else quoted(x) for x in r)})" for k, rows in enumerate(STYLE_SETS) for r in rows)
_KEYWORD = "CASE " + " ".join(f"WHEN regexp_matches(lower(title), {quoted(p)}) THEN {quoted(s)}" for p, s in lx.SECTION_PATTERNS) + " ELSE 'other' END"
_LEVELS = (
    f"given(k, style_id, name, level, based_on) AS (VALUES {_STYLE_ROWS}), one AS (SELECT k, style_id, max({{'n': coalesce(name, style_id), 'l': level, 'b': based_on}}) AS s FROM given GROUP BY ALL), "
    "own AS (SELECT k, style_id, s.n AS name, s.l AS level, s.b AS based_on FROM one), "
    "chain AS (SELECT k, style_id, level, based_on, [style_id] AS seen FROM own UNION ALL SELECT c.k, c.style_id, s.level, s.based_on, list_append(c.seen, s.style_id) FROM chain c JOIN own s ON s.k = c.k AND s.style_id = c.based_on WHERE c.level IS NULL AND NOT list_contains(c.seen, s.style_id)), "
    "found AS (SELECT k, style_id, CASE WHEN regexp_matches(level, '^\\d+$') AND level::INT <= 8 THEN level::INT END AS level FROM chain WHERE level IS NOT NULL), "
    "levels AS (SELECT o.k, o.style_id, o.name, f.level FROM own o LEFT JOIN found f USING (k, style_id))"
)


@query(f"WITH RECURSIVE {_LEVELS} SELECT DISTINCT conv_id AS doc_id, style_id, name, level FROM conversations JOIN levels ON k = conv_id % {len(STYLE_SETS)}")
def word_style_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = documents.word_styles(word_files(spark, sf_dir)).withColumn("doc_id", F.col("path").cast("long"))
    return styles.outline_levels(stored(found)).select("doc_id", "style_id", "name", "level")


@query(
    f"WITH RECURSIVE {_LEVELS}, ps AS (SELECT conv_id AS doc_id, turn, ([{', '.join(map(quoted, USED))}])[((conv_id + turn) % {len(USED)} + 1)::INT] AS style, regexp_replace(coalesce(text, ''), {quoted(_UNWRITABLE)}, '', 'g') AS text FROM conversations), "
    "placed AS (SELECT *, coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM ps), "
    f"named AS (SELECT p.doc_id, start, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS title, lower(coalesce(name, style)) AS said, level FROM placed p LEFT JOIN levels l ON l.k = p.doc_id % {len(STYLE_SETS)} AND l.style_id = p.style), "
    "leveled AS (SELECT doc_id, start, title, coalesce(level, CASE WHEN regexp_matches(said, '^heading ?[1-9]$') THEN right(said, 1)::INT - 1 WHEN said = 'title' THEN -1 END) AS level FROM named) "
    f"SELECT doc_id, start::INT AS start, md5(title) AS title_md5, level, {_KEYWORD} AS keyword FROM leveled WHERE level IS NOT NULL AND title <> ''"
)
def word_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = stored(word_files(spark, sf_dir))
    paragraphs = documents.word_paragraphs(files).withColumn("doc_id", F.col("path").cast("long"))
    levels = styles.outline_levels(stored(documents.word_styles(files).withColumn("doc_id", F.col("path").cast("long"))))
    return styles.styled_headings(paragraphs, levels).select("doc_id", "start", F.md5("title").alias("title_md5"), "level", "keyword")
