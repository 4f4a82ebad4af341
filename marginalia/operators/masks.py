"""Markup masking: spans blanked in place, so that every offset stays valid in the source.

All span families are found in the original text, merged, and blanked once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.text import mask_matches, mask_spans, matches

# --- fixed values: span families by markup ---
MARKDOWN = [
    r"(?s)\A---\n.*?\n(?:---|\.\.\.)\s*\n", r"(?ms)^(```|~~~).*?^\1[^\n]*$", r"`[^`\n]+`", r"(?s)\$\$.*?\$\$", r"(?<![\\$])\$[^$\n]+\$",
    r"\[[^\]\n]*@[^\]\n]*\]", r"(?<![\w.])@[\w:.\-]+", r"!\[[^\]]*\]\([^)]*\)", r"(?s)<!--.*?-->", r"</?[a-zA-Z][^>\n]*>",
    r"(?m)^:{3,}.*$", r"\*{1,3}", r"(?<![\w])_{1,3}(?=\w)|(?<=\w)_{1,3}(?![\w])", r"(?<=[^!]|^)\[(?=[^\]\n]+\]\([^)]*\))", r"\]\([^)]*\)",
]
TEX_ENVIRONMENTS = (
    "equation align alignat gather eqnarray multline displaymath math verbatim lstlisting minted tikzpicture tabular array Shaded "
    "Highlighting Verbatim algorithmic algorithmicx algorithm comment"
).split()
TEX_WHOLE = (
    "cite citep citet citealt citealp parencite textcite ref eqref autoref cref Cref vref label url includegraphics input include "
    "bibliography bibliographystyle usepackage documentclass footnote footnotemark href texttt code path verb newacronym "
    "newglossaryentry newtheorem theoremstyle newcommand renewcommand providecommand DeclareMathOperator"
).split()
LATEX = [
    r"(?<!\\)%[^\n]*", rf"(?s)\\begin\{{({'|'.join(TEX_ENVIRONMENTS)})\*?\}}.*?\\end\{{\1\*?\}}", r"(?s)\$\$.*?\$\$", r"(?<!\\)\$[^$]+\$",
    r"(?s)\\\[.*?\\\]", r"(?s)\\\(.*?\\\)", rf"\\(?:{'|'.join(TEX_WHOLE)})\*?(?:\[[^\]]*\])*(?:\{{[^{{}}]*\}})+",
    r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\])?", r"\\[a-zA-Z@]+\*?", r"\\[\\,;:!]", r"[{}~^]",
]
HTML = [r"(?s)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|</?[a-zA-Z][^>]*>|&#?[a-zA-Z0-9]+;"]
URL = r"\b(?:https?://|www\.)\S+|\b[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
COLUMN_GAP = r"(?m)^[^\n]*\S {4,}\S[^\n]*$"
FAMILIES = {"markdown": MARKDOWN, "latex": LATEX, "html": HTML}
ATOMS = {
    "markdown": r"(?s)`[^`\n]+`|\$\$.*?\$\$|(?<![\\$])\$[^$\n]+\$|\[[^\]\n]*@[^\]\n]*\]|(?<![\w.])@[\w:.\-]+|!\[[^\]]*\]\([^)]*\)",
    "latex": r"(?s)\$\$.*?\$\$|(?<!\\)\$[^$]+\$|\\\[.*?\\\]|\\\(.*?\\\)|\\(?:[a-zA-Z]*cite[a-zA-Z]*|ref|eqref|autoref|[cC]ref|url|texttt|verb)\*?(?:\[[^\]]*\])*(?:\{[^{}]*\})+",
}


def masked(text: Column, kind: str) -> Column:
    """Text with the markup of a kind blanked; of plain text, addresses and aligned columns."""
    if kind == "html":
        return mask_matches(text, HTML[0])
    if kind == "plain":
        return mask_spans(text, F.concat(_bare(url_spans(text)), _bare(matches(text, COLUMN_GAP))))
    return mask_spans(text, F.concat(*[_bare(matches(text, p)) for p in FAMILIES[kind]]))


def _bare(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def url_spans(text: Column) -> Column:
    """Web and mail addresses without closing punctuation."""

    def cut(m: Column) -> Column:
        own = F.regexp_replace(m["text"], r"[.,;:)\]'\"]+$", "")
        return F.struct(m["start"].alias("start"), (m["start"] + F.length(own)).alias("end"), own.alias("text"))

    return F.transform(matches(text, URL), cut)


def atoms(text: Column, kind: str) -> Column:
    """Masked spans that stand for a word in the sentence: maths, code, citations."""
    return matches(text, ATOMS[kind])
