"""Small cases of quoted numbers, ranges of references, captions and tables."""

import pytest

from marginalia.operators import paragraphs, pipeline, structure
from marginalia.operators.quoted import numbers_not_in_table, values
from marginalia.sources.articles import article_blocks
from pyspark.sql import functions as F

TABLE = r"\begin{table}\caption{Rates}\label{tab:r}a & 12.5 & 0.4321 & 30\% \end{table} "


def flagged(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return [(r.text, text[r.start : r.end]) for r in numbers_not_in_table(docs).orderBy("start").collect()]


@pytest.mark.parametrize(
    "sentence, wrong",
    [
        ("Table 1 shows 12.5 of it", []),
        ("Table 1 shows 12.6 of it", ["12.6"]),
        (r"Table \ref{tab:r} shows 12.6 of it", ["12.6"]),
        ("Table 1 shows 0.43 of it", []),  # rounds what the table holds
        (r"Table 1 shows 31\% and 9.5 of it", [r"31\%", "9.5"]),
        (r"Table 1 shows a 95\% CI of it", []),  # a level
        ("Table 1 shows p < 0.05 in it", []),
        ("Table 1 shows 99.9 overall here", []),  # a sum
        ("Tables 1 and 2 show 9.9 of it", ["9.9"]),  # there is no second table
        ("Table 1 shows 31 of them in 2019", []),  # counts are not judged
        ("It shows 12.6 of it", []),
    ],
)
def test_numbers_not_in_table(spark, sentence, wrong):
    assert flagged(spark, TABLE + sentence) == [(w, w) for w in wrong]


def test_two_floats_or_a_figure_are_not_judged(spark):
    figure = r"\begin{figure}\caption{A curve of it}\end{figure} "
    assert flagged(spark, TABLE + figure + "Table 1 and Figure 1 show 9.9 of it") == []


def test_null_and_empty_texts_quote_nothing(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert numbers_not_in_table(docs).count() == 0
    assert structure.reference_ranges(docs).count() == 0


def test_values(spark):
    row = spark.createDataFrame([(r"1,250.5, 3.5% and v2.1, 1.2.3 or 7 \%",)], "t string").select(values(F.col("t")).alias("v")).first().v
    assert [(v.written, v.value, v.decimals, v.percent) for v in row] == [("1,250.5", 1250.5, 1, False), ("3.5%", 3.5, 1, True), (r"7 \%", 7.0, 0, True)]


def test_a_range_cites_what_lies_between(spark):
    floats = " ".join(rf"\begin{{figure}}\caption{{Part {k} of it}}\label{{fig:{k}}}\end{{figure}}" for k in range(1, 5))
    docs = spark.createDataFrame([(1, floats + r" See \ref{fig:1}--\ref{fig:4}."), (2, floats + r" See \ref{fig:1} and \ref{fig:4}.")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in structure.uncited_floats(docs).collect()) == [(2, "figure 2"), (2, "figure 3")]


def word(spark, *rows):
    data = [(1, i, kind, style, text) for i, (kind, style, text) in enumerate(rows)]
    return paragraphs.placed(spark.createDataFrame(data, "doc_id long, idx long, kind string, style string, text string"))


def test_captions_are_one_a_float(spark):
    p = word(spark, ("body", "normal", "Table 1: a"), ("body", "caption", "Table 1. b"), ("body", "normal", "Table 2: c"), ("body", "normal", "Table 2: d"), ("body", "caption", "Table 3 (continued)"), ("body", "normal", "Figure 4. x .... 7"), ("body", "normal", "Table 5 shows it"))
    assert sorted((r.number, r.styled, r.start) for r in paragraphs.captions(p).collect()) == [(1, True, 12), (2, False, 36)]


def test_a_table_is_claimed_once(spark):
    cases = [
        ([("table", "", "q"), ("body", "caption", "Table 1. a"), ("body", "caption", "Table 2. b")], {1: 0}),
        ([("body", "caption", "Table 1. a"), ("table", "", "q"), ("body", "caption", "Table 2. b")], {1: 12}),
        ([("body", "caption", "Table 1. a"), ("table", "", "q"), ("table", "", "r"), ("body", "caption", "Table 2. b")], {1: 12, 2: 15}),
        ([("body", "caption", "Figure 1. a"), ("table", "", "q")], {}),
        ([("body", "caption", "Table 1. a"), ("body", "normal", "x" * 500), ("table", "", "q")], {}),
    ]
    for rows, expected in cases:
        found = {r.number: r.table_start for r in paragraphs.claimed_tables(word(spark, *rows)).collect()}
        assert found == expected, rows


def test_float_before_citation(spark):
    caption, table, said = ("body", "caption", "Table 1. a"), ("table", "", "q"), ("body", "normal", "See Table 1.")
    assert paragraphs.floats_before_citation(word(spark, caption, table, said)).count() == 1
    assert paragraphs.floats_before_citation(word(spark, said, caption, table)).count() == 0
    assert paragraphs.floats_before_citation(word(spark, ("body", "heading1", "Appendix A"), caption, table, said)).count() == 0
    assert paragraphs.floats_before_citation(word(spark, ("body", "normal", "Table 1. a"), table, said)).count() == 0


def test_heading_style_on_body(spark):
    long, short = " ".join(["word"] * 26), " ".join(["word"] * 25)
    p = word(spark, ("body", "heading1", long), ("body", "heading2", short), ("body", "title", long), ("table", "heading1", long))
    assert [(r.start, r.n_words) for r in paragraphs.headings_on_body(p).collect()] == [(0, 26)]


def test_articles(spark):
    front = "<front><article-meta><title-group><article-title>A <italic>new</italic> town</article-title></title-group><abstract><p>Short.</p></abstract></article-meta></front>"
    body = '<body><sec><title>Methods</title><p>We read <xref rid="b1">[1]</xref> it<fig><caption><p>Not this</p></caption></fig>.</p><p> </p></sec><sec><title>Results</title></sec></body>'
    rows = [(1, f"<article>{front}{body}</article>"), (2, "<article><front>"), (3, None), (4, "<article><body/></article>"), (5, "")]
    found = article_blocks(spark.createDataFrame(rows, "doc_id long, xml string")).collect()
    read = sorted((r.place, r.part, r.title, r.text) for r in found if r.doc_id == 1)
    assert read == [(0, "title", None, "A new town"), (1, "abstract", None, "Short."), (2, "body", "Methods", "We read [1] it .")]
    assert {r.doc_id for r in found if r.error} >= {2} and not [r for r in found if r.doc_id in (3, 4)]


def test_what_a_reader_of_a_section_sees(spark):
    rows = [(1, "W201", 2, 4, "sentence", "results"), (1, "W202", 7, 9, "sentence", "methods"), (1, "X101", 5, 6, "document", "results"), (1, "W203", 10, 12, "sentence", "front")]
    found = spark.createDataFrame(rows, "doc_id long, rule_id string, start int, end int, scope string, section string")
    assert [tuple(r) for r in pipeline.section_split(found, "results").collect()] == [(1, 1, 1, 2)]
    docs = spark.createDataFrame([(1, "one\ntwo six\nfour"), (2, None)], "doc_id long, text string")
    stale = pipeline.stale_after_edit(found, docs).orderBy("start").collect()
    assert [(r.rule_id, r.line, r.n_stale) for r in stale] == [("W201", 1, 0), ("X101", 2, 2), ("W202", 2, 2), ("W203", 2, 2)]
