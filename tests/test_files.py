"""Places through segments, and levels of styles."""

import pytest

from marginalia.operators import segments, styles
from marginalia.operators.sections import resolve_sections

SEG = "doc_id long, path string, start int, end int, source_start int"


def placed(spark, text, segs, points):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = spark.createDataFrame([(1, p, k) for k, p in enumerate(points)], "doc_id long, start int, path_ int")
    found = segments.source_positions(rows, docs, spark.createDataFrame([(1, *s) for s in segs], SEG))
    return [(r.path, r.line, r.col) for r in found.orderBy("path_").collect()]


def test_a_file_around_its_inputs(spark):
    text = "ab\ncX\nyde\nf"  # main "ab\nc" + "de\nf" around one "X\ny"
    segs = [("main", 0, 4, 0), ("one", 4, 7, 0), ("main", 7, 11, 10)]
    assert placed(spark, text, segs, [0, 3, 4, 6, 7, 10, 11]) == [("main", 1, 1), ("main", 2, 1), ("one", 1, 1), ("one", 2, 1), ("main", 2, 8), ("main", 3, 1), ("main", 3, 2)]


def test_a_file_read_twice_counts_again(spark):
    text = "a\nb--a\nb"
    segs = [("one", 0, 3, 0), ("main", 3, 5, 0), ("one", 5, 8, 0)]
    assert placed(spark, text, segs, [2, 4, 7, 7]) == [("one", 2, 1), ("main", 1, 2), ("one", 2, 1), ("one", 2, 1)]


def test_without_segments_places_are_the_text_s(spark):
    assert placed(spark, "a\nbc", [], [0, 3]) == [(None, 1, 1), (None, 2, 2)]
    assert placed(spark, None, [], [4]) == [(None, 1, 5)]


def test_levels_are_inherited(spark):
    rows = [(1, "A", "a", None, "B"), (1, "B", "b", None, "C"), (1, "C", None, "3", "A"), (1, "X", "x", None, "Y"), (1, "Y", "y", None, "X"), (1, "Z", "z", "9", "C"), (1, "W", "w", "77777777777", None), (2, "A", "heading 1", "0", None), (1, None, "n", "1", None)]
    found = styles.outline_levels(spark.createDataFrame(rows, "doc_id long, style_id string, name string, level string, based_on string"))
    assert {(r.doc_id, r.style_id): (r.name, r.level) for r in found.collect()} == {(1, "A"): ("a", 3), (1, "B"): ("b", 3), (1, "C"): ("C", 3), (1, "X"): ("x", None), (1, "Y"): ("y", None), (1, "Z"): ("z", None), (1, "W"): ("w", None), (2, "A"): ("heading 1", 0)}


def test_styled_headings_become_sections(spark):
    levels = spark.createDataFrame([(1, "S1", "My heading", 0), (1, "S2", "Deep", 1), (1, "T", "Title", None), (1, "N", "Normal", None)], "doc_id long, style_id string, name string, level int")
    rows = [(1, 0, "A study", "T"), (1, 9, "Methods", "S1"), (1, 20, "Sites \n of it", "S2"), (1, 40, "Body text", "N"), (1, 60, "Results", "heading1"), (1, 70, " ", "S1")]
    paragraphs = spark.createDataFrame([(d, s, t, st, "body") for d, s, t, st in rows], "doc_id long, start long, text string, style string, kind string")
    found = resolve_sections(styles.styled_headings(paragraphs, levels)).orderBy("start").collect()
    assert [(r.title, r.level, r.section) for r in found] == [("A study", -1, "other"), ("Methods", 0, "methods"), ("Sites of it", 1, "methods"), ("Results", 0, "results")]


@pytest.mark.parametrize("depth", [90])
def test_long_chains(spark, depth):
    rows = [(1, f"s{k}", "n", "2" if k == depth else None, f"s{k + 1}") for k in range(depth + 1)]
    found = styles.outline_levels(spark.createDataFrame(rows, "doc_id long, style_id string, name string, level string, based_on string"))
    assert {r.level for r in found.collect()} == {2}
