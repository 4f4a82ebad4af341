"""LaTeX documents made from the given texts, with what a reader must find in them known by construction.

A template marks prose by « and » (no pair inside another), items by ‹kind:label| and ›, and the document's own words by T.  From it come
the source, the masked text and the items, each as SQL over the length of T; no reader takes part.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.sources.shared import dealt

HOLE = "\ue000"
TEX_TEMPLATES = [
    # nested arguments, comments, escapes, code and maths
    "\\documentclass[11pt]{article}\n\\newcommand{\\prog}[1]{\\texttt{#1}}\n\\newcommand{\\fig}[1]{Figure~\\ref{fig:#1}}\n\\begin{document}\n\\section{A \\emph{study}}‹label:sec:s|\\label{sec:s}›"
    "\n« T» \\emph{«deep »\\textbf{«down T»}« up»}« 50\\% of it» % a remark\n« and» \\prog{a_b}« or»~‹citation:k1,k2|\\cite[p.~2]{k1,k2}›«.» \\footnote{«see» ‹citation:k3|\\citep{k3}›« there»}\n"
    "‹figure:fig:a|\\begin{figure}[ht]\\centering T ‹caption:fig:a|\\caption[short]{«Rates of »\\emph{«all»}« sites»}›‹label:fig:a|\\label{fig:a}›\\end{figure}›"
    "« See» ‹ref:fig:a|\\fig{a}›« and» ‹ref:fig:none|\\ref{fig:none}›« too.» $x_1 < y$« holds»\\hspace{1cm}\\textcolor{red}{« red T»}\n\\end{document} T\n",
    # two chapters: numbers start again, and come out of order
    "‹chapter:|\\chapter{One}›\n« T»\n‹figure:fig:b|\\begin{figure}‹caption:fig:b|\\caption{«First T»}›‹label:fig:b|\\label{fig:b}›\\end{figure}›\n‹figure:fig:c|\\begin{figure}‹caption:fig:c|\\caption{«Second»}›‹label:fig:c|\\label{fig:c}›\\end{figure}›\n"
    "« Figure 1.2 and then Figure 1.1 are seen, not Figure 1.7.»\n‹chapter:|\\chapter{Two}›\n‹figure:fig:d|\\begin{figure*}‹caption:fig:d|\\caption{«Third, as Figure 1.1»}›‹label:fig:d|\\label{fig:d}›\\end{figure*}›\n"
    "‹table:tab:e|\\begin{table}‹caption:tab:e|\\caption{«Counts, with Figure 2.1»}›‹label:tab:e|\\label{tab:e}›\\begin{tabular}{l} T & 3 \\end{tabular}\\end{table}›« T»\n"
    "« By Tables 2.1 and 2.2, and Figure 7.1, it holds.»\n",
    # a range of references, a panel, a verbatim block and a false comment
    "« T»\\vskip 1.5em plus 2pt\n‹figure:fig:1|\\begin{figure}\\begin{subfigure}[b]{2cm}‹caption:fig:1a|\\caption{«Panel»}›‹label:fig:1a|\\label{fig:1a}›\\end{subfigure}‹caption:fig:1|\\caption{«Whole»}›‹label:fig:1|\\label{fig:1}›\\end{figure}›\n"
    "‹figure:fig:2|\\begin{figure}‹caption:fig:2|\\caption{«Two»}›‹label:fig:2|\\label{fig:2}›\\end{figure}›‹figure:fig:3|\\begin{figure}‹caption:fig:3|\\caption{«Three»}›‹label:fig:3|\\label{fig:3}›\\end{figure}›\n"
    "\\begin{verbatim}\n$ T { % \\ref{no}\n\\end{verbatim}\n« Figures»~‹ref:fig:1|\\ref{fig:1}›«--»‹ref:fig:3|\\ref{fig:3}›« T.» ‹equation:eq:q|\\begin{align*} a &= b ‹none:|\\label{eq:q}› \\end{align*}›« So» ‹ref:eq:q|\\eqref{eq:q}›\\iffalse T \\fi« holds.»\n",
    # a brace too many: read leniently
    "« T»} « and» \\emph{« more T»}« See Figure 3 of Smith et al. here.» ‹figure:fig:x|\\begin{figure}‹caption:fig:x|\\caption{«Odd»}›‹label:fig:x|\\label{fig:x}›\\end{figure}›« Nobody cites it, nor Figure 9.»\n",
    # an appendix, a caption outside a float, labels with a style's prefix
    "« Figure A.1 shows it, Figs. 1-3 do not, and Table 1: Counts by site, run in.» ‹ref:one|\\ref{one}› ‹figure:fig:one|\\begin{figure}‹caption:fig:one|\\caption{«One T»}›‹label:fig:one|\\label{fig:one}›\\end{figure}›« T»\n"
    "\\begin{minipage}{3cm}‹caption:|\\captionof{table}{«Given»}›\\end{minipage}\n‹appendix:|\\appendix›\n\\section{More}\n‹figure:fig:z|\\begin{figure}‹caption:fig:z|\\caption{«Late»}›‹label:fig:z|\\label{fig:z}›\\end{figure}›« Last T, as in Table 4.»\n",
]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _made(template: str) -> tuple[str, str, list[tuple[str, str | None, int, int, int, int]]]:
    """Source and mask with HOLE for T, and items (kind, label, a, b, c, d): start a + b x length of T, end
    c + d x length of T.  Kinds chapter and appendix are places the checks need, not items."""
    source: list[str] = []
    mask: list[str] = []
    items, open_, depth, n, holes = [], [], 0, 0, 0
    for part in re.findall(r"‹[^|]*\||[«»›]|(?<![A-Za-z])T(?![A-Za-z])|.", template, re.S):
        if part in "«»":
            depth = 1 if part == "«" else 0
        elif part == "›":
            kind, label, a, b = open_.pop()
            items.append((kind, label, a, b, n, holes))
        elif part[0] == "‹":
            kind, _, label = part[1:-1].partition(":")
            open_.append((kind, label or None, n, holes))
        elif part == "T":
            source.append(HOLE)
            mask.append(HOLE if depth else "\ue001")
            holes += 1
        else:
            source.append(part)
            mask.append(part if depth or part == "\n" else " ")
            n += len(part)
    return "".join(source), "".join(mask), [i for i in items if i[0] != "none"]


MADE = [_made(_t) for _t in TEX_TEMPLATES]


def tex_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): each document's words in one of the templates."""
    docs = dealt(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    words = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^A-Za-z .\n]|Fig|Tab", "")
    own = F.element_at(F.array(*[F.lit(m[0]) for m in MADE]), (F.col("doc_id") % len(MADE) + 1).cast("int"))
    return docs.select("doc_id", F.replace(own, F.lit(HOLE), words).alias("text"))


_LIST = "[" + ", ".join(_quoted(m[1]) for m in MADE) + "]"
#: What must be found: tex (doc_id, k, t, masked) and tex_items (doc_id, k, kind, label, start, end).
TEX_VIEW = (
    f"words_ AS (SELECT doc_id, (doc_id % {len(MADE)})::INT AS k, regexp_replace(coalesce(text, ''), '[^A-Za-z .\n]|Fig|Tab', '', 'g') AS t FROM documents), "
    f"tex AS (SELECT doc_id, k, t, replace(replace(({_LIST})[k + 1], chr(57344), t), chr(57345), regexp_replace(t, '[^\n]', ' ', 'g')) AS masked FROM words_), "
    "marks(k, kind, label, a, b, c, d) AS (VALUES "
    + ", ".join(f"({k}, {_quoted(i[0])}, {'NULL' if i[1] is None else _quoted(i[1])}, {i[2]}, {i[3]}, {i[4]}, {i[5]})" for k, m in enumerate(MADE) for i in m[2])
    + '), tex_items AS (SELECT doc_id, k, kind, label, (a + b * length(t))::INT AS start, (c + d * length(t))::INT AS "end" FROM tex JOIN marks USING (k))'
)
