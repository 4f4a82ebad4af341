"""The LaTeX reader against fragments made with their masks, and the choice between its readings."""

import random
import re

import pytest

from marginalia.operators import crossrefs, latex
from pyspark.sql import functions as F


def blank(s):
    return re.sub(r"[^\n]", " ", s)


class Made:
    """Random nested source with its mask and items, built piece by piece."""

    def __init__(self, seed):
        self.r, self.source, self.mask, self.items, self.n = random.Random(seed), "", "", [], 0

    def put(self, text, prose):
        self.source += text
        self.mask += text if prose else blank(text)

    def words(self, prose):
        self.put(self.r.choice(["some words", "a line\nand one", "50\\% of it", "R\\&D, here", "-- so ``said''", "naïve 😀"]), prose)

    def item(self, kind, label):
        item = {"kind": kind, "start": len(self.source), "end": None, "label": label}
        self.items.append(item)
        return item

    def some(self, depth, prose, sink):
        for _ in range(self.r.randint(1, 4)):
            self.one(depth, prose, sink)
            self.put(" ", prose)

    def one(self, depth, prose, sink):
        r = self.r
        kind = r.choice(["words", "words", "comment", "cite", "ref", "label", "maths", "hidden", "code"] + ["styled", "group", "float", "caption", "align", "list"] * (depth > 0))
        self.n += 1
        if kind == "words":
            self.words(prose)
        elif kind == "comment":
            self.put("% } $ \\begin{x}", False)
            self.put("\n", True)
        elif kind == "cite":
            if prose:
                item = self.item("citation", f"k{self.n},z")
            self.put(f"\\citep[see][p. 2]{{k{self.n},z}}", False)
            if prose:
                item["end"] = len(self.source)
        elif kind == "ref":
            item = self.item("ref", f"r{self.n}")
            self.put(r.choice(["\\ref", "\\autoref", "\\eqref", "\\figref"]) + f"{{r{self.n}}}", False)
            item["end"] = len(self.source)
        elif kind == "label":
            item = self.item("label", f"l{self.n}")
            self.put(f"\\label{{l{self.n}}}", False)
            item["end"] = len(self.source)
            if sink is not None and sink["label"] is None:
                sink["label"] = f"l{self.n}"
        elif kind == "maths":
            shown = r.random() < 0.5
            if shown:
                item = self.item("equation", f"e{self.n}")
            self.put(f"\\[ x \\label{{e{self.n}}} = \\text{{a $b$}} \\]" if shown else "$a_{1} < \\$2$", False)
            if shown:
                item["end"] = len(self.source)
        elif kind == "hidden":
            self.put(r.choice(["\\vspace{1cm}", "\\includegraphics[width=2cm]{a_b}", "\\verb|{ % $|", "\\url{http://a.b/%7E{x}}", "\\newcommand{\\x}[1]{{#1} \\emph{q}}", "\\iffalse } { \\fi", "\\vskip 2.5em plus 1pt", "~", "&", "\\\\[2pt]", "\\item[short]", "\\begin{tikzpicture} \\draw { $ \\end{tikzpicture}".replace("{ $ ", "")]), False)
        elif kind == "code":
            self.put("\\mycode{a_b{c}}", False)
        elif kind == "styled":
            self.put(r.choice(["\\emph{", "\\footnote{", "\\unknown{", "\\textcolor{red}{", "\\href{http://x/%20}{"]), False)
            self.some(depth - 1, prose, sink)
            self.put("}", False)
        elif kind == "group":
            self.put("{\\bfseries ", False)
            self.some(depth - 1, prose, sink)
            self.put("}", False)
        elif kind == "list":
            self.put("\\begin{itemize}[noitemsep]", False)
            self.some(depth - 1, prose, sink)
            self.put("\\end{itemize}", False)
        elif kind == "align":
            item = self.item("equation", None)
            self.put("\\begin{align*} a &= b \\end{align*}", False)
            item["end"] = len(self.source)
        elif kind == "float":
            if prose:
                item = self.item("figure", None)
            else:
                item = {"label": None}
            self.put("\\begin{figure}[t]", False)
            self.some(depth - 1, False, item)
            self.put("\\end{figure}", False)
            item["end"] = len(self.source)
        elif kind == "caption":
            item = self.item("caption", None)
            item["sink"] = sink
            self.put("\\caption[s{x}]{", False)
            self.some(depth - 1, True, sink)
            self.put("}", False)
            item["end"] = len(self.source)


@pytest.mark.parametrize("seed", range(150))
def test_made_sources(seed):
    made = Made(seed)
    made.some(4, True, None)
    ok, at, masked, _, items, _ = latex.read(made.source, ["mycode"], {})
    assert ok and at is None
    assert masked == made.mask
    for i in made.items:
        sink = i.pop("sink", None)
        i["label"] = i["label"] or (sink["label"] if sink else None)
    key = str
    assert sorted(items, key=key) == sorted(made.items, key=key)


@pytest.mark.parametrize("bad", ["a { b", "a } b", "a $b", "\\begin{x} a", "a \\end{x}", "\\url{a", "\\verb|a", "\\begin{verbatim} a", "\\begin{figure}{\\end{figure}}"])
def test_broken_sources_are_errors_and_still_read(bad):
    assert latex.read(bad, [], {})[0] is False
    ok, _, masked, *_ = latex.read(bad, [], {}, lenient=True)
    assert ok and len(masked) == len(bad)


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_choice_of_reading(spark):
    swallowed = "a few words } \\begin{align} one two three four five six seven eight nine ten eleven twelve"
    head = "\\newcommand{\\prog}[1]{\\texttt{#1}}\n\\renewcommand\\fig[1]{Fig.~\\ref{fig:#1}}\n\\newcommand{\\bold}[1]{\\textbf{#1}}\n\\begin{document}"
    rows = latex.latex_documents(docs(spark, "a \\emph{b}", "a } b \\emph{words}", None, "", head + "\\prog{a_b} \\fig{q} \\bold{kept}\\end{document} left out", swallowed).withColumn("masked", F.lit(1))).orderBy("doc_id").collect()
    assert [r.reader for r in rows[:4]] == ["parsed", "lenient", "parsed", "parsed"]
    assert [rows[2].masked, rows[3].masked, rows[1].error_at] == [None, "", 2]
    assert rows[4].masked.split() == ["kept"] and [(i.kind, i.label) for i in rows[4]["items"]] == [("ref", "fig:q")]
    assert len(rows[5].masked) == len(swallowed)


def test_numbers(spark):
    row = docs(spark, "1, 3-5 and 7, A.4, S2, 2.3b to 2.9, 9-3, 1-80").select(F.transform(crossrefs.listed_numbers(F.col("text")), crossrefs.number_text).alias("n")).first()
    assert row.n == ["1", "3", "4", "5", "7", "A.4", "2.3", "2.9", "9", "3", "1", "80"]


FIG = "\\begin{figure}\\caption{Rates of %s}\\label{fig:%s}\\end{figure}\n"


@pytest.mark.parametrize(
    "text, x101, x102, x103",
    [
        (FIG % ("a", "a") + "Figure 1 shows it.", [], [], []),
        (FIG % ("a", "a") + "Nothing.", ["Figure 1"], [], []),
        (FIG % ("Figure 1", "a"), ["Figure 1"], [], []),  # its own caption does not count
        (FIG % ("Figure 2", "a") + FIG % ("\\ref{a}", "b"), [], [], []),  # another's does
        (FIG % ("a", "a") + FIG % ("b", "b") + "Figure 2, Figure 1.", [], ["Figure 1 after Figure 2"], []),
        (FIG % ("a", "a") + FIG % ("b", "b") + FIG % ("c", "c") + "\\ref{fig:a}--\\ref{fig:c}", [], [], []),
        ("\\chapter{A}" + FIG % ("a", "a") + "\\chapter{B}" + FIG % ("b", "b") + "Figure 2.1 then Figure 1.1; Figure 2.2 and Figure 3.1.", [], [], ["Figure 2.2"]),
        (FIG % ("a", "a") + "Figure 1. Figure 3 of Smith et al. Figure 4: Run in. Figure 4 is it. Figure S1.", [], [], []),
        ("\\appendix" + FIG % ("a", "a") + FIG % ("b", "b") + "Figure 2, Figure 1. \\ref{gone}", [], [], ["gone"]),
        ("No floats: Figure 3.", [], [], []),
    ],
)
def test_cross_reference_rules(spark, text, x101, x102, x103):
    read = latex.latex_documents(docs(spark, text, None, "")).persist()
    for rule, want in ((crossrefs.uncited_floats, x101), (crossrefs.cited_out_of_order, x102), (crossrefs.broken_references, x103)):
        assert [r.what for r in rule(read).orderBy("start").collect()] == want


def test_readings_are_held_in_parts():
    import pandas as pd

    rows = pd.DataFrame({"_row": [{"doc_id": k} for k in range(200)], "text": ["x" * (700_000 if k == 5 else 3) if k % 7 else None for k in range(200)], "code": [[]] * 200, "refs": [{}] * 200})
    parts = list(latex._read(iter([rows, rows.iloc[:0]])))
    assert len(parts) >= 4 and max(map(len, parts)) <= latex.PART_ROWS
    assert [r["doc_id"] for p in parts for r in p["_row"]] == list(range(200))
