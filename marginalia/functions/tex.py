"""What the commands and environments of LaTeX stand for."""

from __future__ import annotations

# --- fixed values: command and environment names by role ---
LEVELS = {"part": -1, "chapter": 0, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4, "subparagraph": 5}
CAPTIONS = "caption captionof subcaption".split()
CITATIONS = (
    "cite citep citet citealt citealp citeauthor citeyear citeyearpar citenum nocite Cite Citep Citet Citealt Citealp Citeauthor "
    "parencite Parencite textcite Textcite autocite Autocite footcite smartcite Smartcite supercite fullcite cites parencites textcites autocites"
).split()
REFERENCES = "ref eqref autoref cref Cref vref pageref nameref".split()
#: Reference commands that journal styles define out of a project's sight.
STYLE_REFERENCES = "figref Figref figureref tabref Tabref tableref secref Secref sectionref eqnref Eqnref equationref algref appref fref Fref tref".split()
#: Masked commands that stand for a word, beside the references.
WORD_COMMANDS = "url verb lstinline footnotemark".split()
#: Nothing in the arguments of these is prose.
WHOLE = (
    "label url href includegraphics input include subfile includeonly bibliography bibliographystyle addbibresource printbibliography "
    "usepackage RequirePackage documentclass footnotemark author date affiliation affil address email institute hspace vspace setlength "
    "addtolength addlength setcounter addtocounter addcounter newcommand renewcommand providecommand newenvironment renewenvironment "
    "provideenvironment DeclareMathOperator def gdef edef xdef definecolor providecolor colorlet color pagecolor rowcolors selectlanguage "
    "hypersetup hphantom vphantom verb lstinline graphicspath newtheorem pagestyle thispagestyle pagenumbering iffalse"
).split()
CODE = "texttt code path file filename pkg cmd command nolinkurl addcontentsline".split()
DEFINITIONS = "newacronym newglossaryentry newabbreviation theoremstyle newtheorem setacronymstyle glsaddall".split()
DIMENSIONS = (
    "vskip hskip kern mkern mskip hspace vspace raise lower moveleft moveright penalty hfuzz vfuzz parskip parindent baselineskip lineskip linewidth"
).split()
LAST_ARGUMENT = {"textcolor": 1, "colorbox": 1, "fcolorbox": 2}
ESCAPED = "%&$#_{}"
MATHS = "equation align alignat gather multline eqnarray flalign displaymath math split dmath".split()
VERBATIM = "verbatim verbatim* Verbatim lstlisting minted comment Shaded Highlighting".split()
TABULAR = "tabular tabular* tabularx tabulary".split()
NO_PROSE = [*TABULAR, "array", "tikzpicture", "thebibliography", "algorithmic", "algorithmicx", "algorithm", "algorithm2e"]
FIGURES = "figure figure* wrapfigure sidewaysfigure SCfigure".split()
TABLES = "table table* wraptable sidewaystable longtable longtable*".split()
PANELS = "subfigure subtable minipage".split()
#: Arguments of masked commands: * a star, [ an option, { a group or one command, c a command with its
#: parameters, v a delimited text, f all up to \fi.  Others take a star, an option and a group.
ARGUMENTS = {
    "href": "{",
    "url": "{",
    "path": "{",
    "nolinkurl": "{",
    "addcontentsline": "{{{",
    "footnotemark": "[",
    "printbibliography": "[",
    "setlength": "{{",
    "addtolength": "{{",
    "addlength": "{{",
    "setcounter": "{{",
    "addtocounter": "{{",
    "addcounter": "{{",
    "newcommand": "*{[[{",
    "renewcommand": "*{[[{",
    "providecommand": "*{[[{",
    "newenvironment": "*{[[{{",
    "renewenvironment": "*{[[{{",
    "provideenvironment": "*{[[{{",
    "DeclareMathOperator": "*{{",
    "def": "c{",
    "gdef": "c{",
    "edef": "c{",
    "xdef": "c{",
    "definecolor": "{{{",
    "providecolor": "{{{",
    "colorlet": "{{",
    "rowcolors": "{{{",
    "newtheorem": "*{[{[",
    "verb": "v",
    "lstinline": "v",
    "iffalse": "f",
}
#: Arguments of environments; others take an option.
ENVIRONMENT_ARGUMENTS = {"wrapfigure": "[{[{", "wraptable": "[{[{", "minipage": "[[[{", "subfigure": "[{", "subtable": "[{", "multicols": "{[", "multicols*": "{[", "adjustbox": "{"}
#: A preamble's own commands: wrappers around code, and around references with the prefix they add.
NEW_COMMAND = r"\\(?:re)?newcommand\*?\s*\{?\\([A-Za-z]+)\}?\s*(?:\[\d\])?\s*(?:\[[^\]]*\])?\s*\{"
CODE_BODY = r"\\(?:texttt|ttfamily|verb|lstinline|url|path|nolinkurl|code)\b"
REFERENCE_BODY = r"\\(?:ref|cref|Cref|autoref|eqref|vref)\s*\{([^{}#]*)#1\}"
BODY_CHARS = 200
UNIT = r"(?:pt|em|ex|cm|mm|in|bp|pc|sp|dd|cc|mu|fil{1,3}|\\[a-zA-Z]+)"
NUMBER = r"[-+]?(?:\d+(?:[.,]\d*)?|[.,]\d+)"
#: A lenient reading is kept from this share of the words that the patterns leave.
LENIENT_SHARE = 0.8
LENIENT_WORD = r"[A-Za-z]{2,}"
#: Prefixes that a style's commands add to labels.
LABEL_PREFIXES = "fig: tab: sec: eq: eqn: app: alg: fig- tab- sec- eq-".split()
