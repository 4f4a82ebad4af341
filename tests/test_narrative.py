import itertools
import random

from pyspark.sql import functions as F

from marginalia.operators import narrative, pipeline, rules
from marginalia.operators.sections import latex_headings, marked_sections, markdown_headings, resolve_sections, with_sections

DOCS = "doc_id long, text string"


def mapped(spark, text):
    sents = rules.sentences(with_sections(spark.createDataFrame([(1, text)], DOCS)))
    return {(r["section"], r["move"]): (r["status"], r["sent"], r["note"]) for r in narrative.narrative_map(sents).collect()}


def test_one_late_sentence_is_told_once(spark):
    got = mapped(spark, "Introduction\nWe therefore aim to test it. Fever is a leading cause of death. Its spread remains unclear.")
    assert got == {
        ("introduction", "territory"): ("present", 1, ""),
        ("introduction", "gap"): ("present", 2, ""),
        ("introduction", "aim"): ("out_of_order", 0, "before territory"),
    }


def test_opening_sentence_makes_the_opening_move(spark):
    got = mapped(spark, "Introduction\nThe town is old. Its fever has never been counted.\nMethods\nThe town is old.")
    assert got["introduction", "territory"] == ("present", 0, "") and got["introduction", "aim"] == ("missing", None, "")
    assert got["introduction", "gap"][:2] == ("present", 1)
    assert got["methods", "data"][0] == got["methods", "analysis"][0] == "missing"


def test_order_is_no_matter_elsewhere_and_unmapped_sections_have_no_rows(spark):
    got = mapped(spark, "Methods\nThe slope was fitted. Counts are in the registry.\nAppendix\nWe found more.")
    assert {k: v[0] for k, v in got.items()} == {("methods", "data"): "present", ("methods", "analysis"): "present"}


def test_gap_needs_contrast_and_lack_in_one_line(spark):
    whole = "Introduction\nWe ask it. "
    assert mapped(spark, whole + "It is seldom seen, although it is common.")["introduction", "gap"][0] == "present"
    assert mapped(spark, whole + "It is seldom seen. It is common, although mild.")["introduction", "gap"][0] == "missing"
    assert mapped(spark, whole + "It is seldom seen,\nalthough it is common.")["introduction", "gap"][0] == "missing"


def test_rising_places_are_the_least_of_the_longest(spark):
    rng = random.Random(5)
    cases = [[rng.randrange(6) for _ in range(rng.randrange(7))] for _ in range(60)]

    def brute(xs):
        rising = [p for n in range(len(xs) + 1) for p in itertools.combinations(range(len(xs)), n) if all(xs[a] < xs[b] for a, b in itertools.pairwise(p))]
        most = max(map(len, rising))
        return list(min((p for p in rising if len(p) == most), key=lambda p: p[::-1]))

    d = spark.createDataFrame(list(enumerate(cases)), "i int, xs array<int>")
    items = F.transform("xs", lambda x, i: F.struct(i.alias("place"), x.alias("x")))
    got = {r["i"]: r["p"] for r in d.select("i", narrative.rising_places(items).alias("p")).collect()}
    assert got == {i: brute(xs) for i, xs in enumerate(cases)}


def test_abstract_lens(spark):
    pad = "The lists were kept in a box in the hall of the town and could be read by all who came. " * 4
    rows = [
        (1, "Abstract\n" + pad),
        (2, "Abstract\nWe fitted a model. " + pad + "However, it rose. We asked why. It fell by 5%. It must change."),
        (3, "Abstract\nToo short."),
        (4, None),
        (5, ""),
        (6, "Front.\nAbstract\n" + pad.rstrip(" .").replace(".", ",") + "\nMethods\nWe asked why."),
    ]
    found = {r["doc_id"]: (r["missing"], r["start"], r["end"]) for r in narrative.abstract_lens(with_sections(spark.createDataFrame(rows, DOCS))).collect()}
    first = len("Abstract\n" + pad.split(".")[0]) + 2
    assert found == {
        1: ("gap,aim,methods,findings,significance", 0, first),
        2: ("background", 0, len("Abstract\nWe fitted a model. ")),
        6: ("gap,aim,methods,findings,significance", 7, 207),
    }


def test_tables_without_rows(spark):
    none = with_sections(spark.createDataFrame([], DOCS))
    sents = rules.sentences(none)
    assert narrative.narrative_map(sents).count() == narrative.move_map(sents).count() == narrative.unmapped(sents).count() == narrative.abstract_lens(none).count() == 0


MARKED = {
    "latex": "\\section{Methods}\nWe \\emph{utilize} it \\cite{utilize}. % we utilize\n\\subsection{Model fit}\nIt is $utilize$ of \\texttt{utilize}, and we utilize it.\n\\section{References}\nWe utilize it.",
    "markdown": "# Methods\nWe *utilize* it `utilize` [@utilize].\n## Model fit\n<!-- we utilize --> It is $utilize$, and we utilize it.\n# References\nWe utilize it.",
    "plain": "Methods\nWe utilize it at https://utilize.example/utilize now, and we utilize it.\nReferences\nWe utilize it.",
    "html": "<p utilize>\nMethods\nWe <b class='utilize'>utilize</b> it <!-- utilize -->, and we utilize it.\nReferences\nWe utilize it.",
}


def test_analysis_of_a_kind_masks_its_markup(spark):
    for kind, text in MARKED.items():
        docs = spark.createDataFrame([(1, text), (2, None), (3, "")], DOCS)
        found = [r for r in pipeline.analysed(docs, kind=kind).collect() if "utiliz" in r["text"].lower()]
        prose = pipeline.prose(docs, kind).where("doc_id = 1").collect()[0]
        assert len(prose["text"]) == len(text) and prose["text"].count("utilize") == 2
        assert found and {r["section"] for r in found} == {"methods"}
        assert all(r["text"] == text[r["start"] : r["end"]] == prose["text"][r["start"] : r["end"]] for r in found)


def test_headings_in_the_row_are_those_of_the_tables(spark):
    for kind, table in (("latex", latex_headings), ("markdown", markdown_headings)):
        docs = spark.createDataFrame([(1, MARKED[kind]), (2, "none"), (3, None)], DOCS)
        want = {(r["start"], r["section"]) for r in resolve_sections(table(docs)).collect()}
        got = {r["doc_id"]: r["s"] for r in docs.select("doc_id", marked_sections(F.col("text"), kind).alias("s")).collect()}
        assert {tuple(h) for h in got[1]} == want and len(want) == 3 and not got[2] and not got[3]
