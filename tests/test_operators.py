"""Fire and don't-fire cases, with sentences of our own, and invariants."""

import io
import random
import zipfile

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from marginalia.functions.text import column_of, line_of, matches, sentence_spans
from marginalia.operators import discourse, masks, metrics, pipeline, reports, rules, spelling, structure
from marginalia.operators.sections import plain_headings, resolve_sections, section_at
from marginalia.sources import documents
from marginalia.streaming import events


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def fired(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


@pytest.mark.parametrize(
    ("rule_id", "text", "hits"),
    [
        ("W201", "They utilize tools.", ["utilize"]),
        ("W202", "In order to see, prior to that.", ["In order to", "prior to"]),
        ("W203", "A novel idea and a novel virus.", ["novel"]),
        ("W204", "Very odd; every thing.", ["Very"]),
        ("W208", "It isn't so.", ["isn't"]),
        ("C304", "It was significant, and clinically significant.", ["significant"]),
        ("C305", "Clearly so.", ["Clearly"]),
        ("E706", "relatively unrelatively", ["relatively"]),
    ],
)
def test_pattern_rules(spark, rule_id, text, hits):
    found = rules.pattern_findings(docs(spark, text), [rule_id]).orderBy("start").collect()
    assert [r["text"] for r in found] == hits
    assert all(text[r["start"] : r["end"]] == r["text"] for r in found)


def test_doubled_words(spark):
    d = docs(spark, "the the cat", "had had it", "no no no", "a\nb b", "x x y", "one   one", "Up up we go", None, "")
    assert fired(rules.doubled_words(d)) == [(0, "the the"), (6, "Up up")]


def test_matches_keep_code_points(spark):
    d = docs(spark, "a😀 b ü token token")
    found = d.select(F.explode(matches(F.col("text"), "token")).alias("m")).select("m.*").collect()
    assert [(r["start"], r["end"]) for r in found] == [(7, 12), (13, 18)]


def test_sentence_spans_cover_the_text(spark):
    text = "One is. Two?  Three! \n Four"
    spans = docs(spark, text).select(sentence_spans(F.col("text")).alias("s")).first()["s"]
    assert [text[s["start"] : s["end"]] for s in spans] == ["One is.", "Two?", "Three!", "Four"]


def test_lines(spark):
    r = docs(spark, "ab\ncd\nef").select(line_of(F.col("text"), F.lit(4)).alias("l"), column_of(F.col("text"), F.lit(4)).alias("c")).first()
    assert (r["l"], r["c"]) == (2, 2)


def test_sections(spark):
    d = docs(spark, "Start here.\nMethods\nWe did it.\nResults\nIt worked.", "No headings.")
    h = resolve_sections(plain_headings(d))
    assert sorted((r["doc_id"], r["section"]) for r in h.collect()) == [(0, "methods"), (0, "results")]
    points = spark.createDataFrame([(0, 2), (0, 25), (0, 45), (1, 3)], "doc_id long, start int")
    got = {(r["doc_id"], r["start"]): r["section"] for r in section_at(points, h).collect()}
    assert got == {(0, 2): "front", (0, 25): "methods", (0, 45): "results", (1, 3): "unknown"}


def test_nested_sections_inherit(spark):
    rows = [(0, 0, "Results", "results", 1), (0, 10, "Model fit", "methods", 2), (0, 20, "Priors", "other", 2), (0, 30, "Limitations", "limitations", 2), (0, 40, "A model of spread", "methods", 1), (0, 50, "Solver", "other", 2)]
    h = spark.createDataFrame(rows, "doc_id long, start int, title string, keyword string, level int")
    got = [r["section"] for r in resolve_sections(h).orderBy("start").collect()]
    assert got == ["results", "results", "results", "limitations", "methods", "methods"]


def test_overlaps_keep_the_longest(spark):
    rows = [(0, "S001", 0, 5, "spelling", 1.0), (0, "LT001", 3, 12, "grammar", 1.0), (0, "S001", 12, 15, "spelling", 1.0), (0, "W207", 0, 12, "craft", 1.0), (0, "GEC001", 3, 12, "gec", 1.0)]
    f = spark.createDataFrame(rows, "doc_id long, rule_id string, start int, end int, tier string, confidence double")
    kept = sorted((r["rule_id"], r["start"]) for r in pipeline.resolve_overlaps(f).collect())
    assert kept == [("LT001", 3), ("S001", 12), ("W207", 0)]


@pytest.mark.parametrize("kind", ["markdown", "latex", "plain", "html"])
def test_masks_keep_length_and_lines(spark, kind):
    rng = random.Random(7)
    parts = ["# Title\n", "a *b* c", "$x+1$", "`code`", "\\cite{k}", "% note\n", "<b>t</b>", "http://a.b/c.", "\n\n", "{", "\\begin{equation}a\n\\end{equation}", "[@k]", "word ü😀 "]
    texts = ["".join(rng.choice(parts) for _ in range(12)) for _ in range(25)]
    for r in docs(spark, *texts).select("text", masks.masked(F.col("text"), kind).alias("m")).collect():
        assert len(r["m"]) == len(r["text"])
        assert [i for i, c in enumerate(r["m"]) if c == "\n"] == [i for i, c in enumerate(r["text"]) if c == "\n"]


def test_longest_rising_against_brute_force(spark):
    rng = random.Random(3)
    cases = [[rng.randrange(6) for _ in range(rng.randrange(7))] for _ in range(40)]

    def brute(xs):
        best = 0
        for mask in range(1 << len(xs)):
            pick = [x for i, x in enumerate(xs) if mask >> i & 1]
            if all(a < b for a, b in zip(pick, pick[1:], strict=False)):
                best = max(best, len(pick))
        return best

    d = spark.createDataFrame([Row(i=i, xs=xs) for i, xs in enumerate(cases)], "i int, xs array<int>")
    got = {r["i"]: r["n"] for r in d.select("i", discourse.longest_rising(F.col("xs")).alias("n")).collect()}
    assert got == {i: brute(xs) for i, xs in enumerate(cases)}


def test_structure_rules(spark):
    fig = "\\begin{figure}\\caption{One and two and three and four}\\label{fig:a}\\end{figure}"
    d = docs(spark, f"See Figure 1. {fig}", f"Nothing. {fig}", f"See \\ref{{a}} and \\ref{{b}}. {fig}", f"Figure 4 is odd. {fig}")
    assert fired(structure.uncited_floats(d)) == [(1, "figure 1"), (3, "figure 1")]
    assert fired(structure.broken_references(d)) == [(2, "b"), (3, "figure 4")]


def test_spelling_finds_edits_and_swaps(spark):
    known = spark.createDataFrame([("receive", 9), ("station", 5)], "word string, freq long")
    got = {(r["word"], r["correction"]) for r in spelling.corrections(docs(spark, "we recieve at the statin or stationx but not randomly"), known).collect()}
    assert got == {("recieve", "receive"), ("statin", "station"), ("stationx", "station")}


def test_balance_and_metrics(spark):
    r = metrics.document_metrics(docs(spark, "It may be so. It may clearly fail.")).first()
    assert (r["n_sentences"], r["n_words"], r["balance"]) == (2, 8, "balanced 2.0")


def test_rate_limit_and_newest(spark):
    e = spark.createDataFrame([(1, 1, "2024-01-01 00:00:00"), (2, 1, "2024-01-01 00:00:30"), (3, 1, "2024-01-01 00:01:31")], "event_id long, user_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert {r["event_id"]: r["recent"] for r in reports.within_rate(e, 1, 60).collect()} == {1: 1, 2: 2, 3: 1}
    assert [r["event_id"] for r in reports.newest_per_key(e, "user_id", 1, F.desc("ts")).collect()] == [3]


def test_stream_history_is_pruned(spark, tmp_path):
    write = events.newest_into(str(tmp_path), keep=2)
    for k in range(3):
        write(spark.createDataFrame([(10 * k + j, 1, f"2024-01-01 00:0{k}:0{j}") for j in range(2)], "event_id long, user_id long, ts string"), k)
    assert sorted(r["event_id"] for r in spark.read.parquet(f"{tmp_path}/2").collect()) == [20, 21]


def _zip(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return out.getvalue()


def test_docx_and_projects(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Results</w:t></w:r></w:p><w:p><w:r><w:t>It </w:t></w:r><w:del><w:r><w:t>did</w:t></w:r></w:del><w:ins><w:r><w:t>works</w:t></w:r></w:ins></w:p></w:body></w:document>'
    (tmp_path / "a.docx").write_bytes(_zip(word__document_dot_xml=body))
    (tmp_path / "p.zip").write_bytes(_zip(main_dot_tex="\\documentclass{a}x\\input{sub}y", sub_dot_tex="IN\\input{main}"))
    (tmp_path / "bad.zip").write_bytes(b"nothing")
    (tmp_path / "t.txt").write_bytes("\ufeffhé".encode())
    files = documents.read_files(spark, str(tmp_path))
    assert {r["text"] for r in files.where("kind = 'plain'").collect()} == {"hé"}
    got = [(r["text"], r["style"], r["start"]) for r in documents.word_paragraphs(files).orderBy("idx").collect()]
    assert got == [("Results", "Heading1", 0), ("It works", "", 9)]
    made = {r["path"].rsplit("/", 1)[1]: (r["text"], r["error"]) for r in documents.projects(files).collect()}
    assert made == {"p.zip": ("\\documentclass{a}xIN\\input{main}y", None), "bad.zip": ("", "bad_zip")}


def test_nulls_and_empty_tables(spark):
    none = docs(spark).where("false")
    odd = docs(spark, None, "", " ", ".")
    for d in (none, odd):
        assert rules.all_findings(d).count() == 0
