import pytest
from pyspark.sql import functions as F

from marginalia.operators import bench, checklists, discourse, polish, review, rules, settings
from marginalia.operators.sections import with_sections

DOCS = "doc_id long, text string"


def one(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


@pytest.mark.parametrize(
    "text, expected, n",
    [
        ("It should be noted that there are three things that drive it.", "Three things drive it.", 2),
        ("We utilize the the scheme.", "We use the scheme.", 2),
        ("There was rain , that is all.", "There was rain , that is all.", 0),
        ("They had had enough.", "They had had enough.", 0),
        ("", "", 0),
        (None, None, 0),
    ],
)
def test_polish_goes_on_until_nothing_changes(spark, text, expected, n):
    found = polish.polished(spark.createDataFrame([(1, text)], DOCS))
    assert one(found, "text", "n_edits", "changed") == [(expected, n, text != expected)]


def test_polish_leaves_unedited_marks_alone(spark):
    docs = spark.createDataFrame([(1, "A cost , and a cost."), (1, "A cost , and we utilize it.")], DOCS)
    assert sorted(one(polish.polished(docs), "text")) == [("A cost , and a cost.",), ("A cost, and we use it.",)]


def test_most_specific_checklist_is_suggested(spark):
    docs = spark.createDataFrame([(1, "A systematic review of one randomised trial and a cohort study."), (2, "A randomised trial in a cohort study."), (3, "Nothing."), (4, None)], DOCS)
    found = docs.select("doc_id", checklists.suggested(F.col("text")).alias("c")).orderBy("doc_id")
    assert one(found, "c") == [("prisma",), ("consort",), (None,), (None,)]


def test_items_are_looked_for_in_their_sections(spark):
    text = "Methods\nThe study size was small. It was a cohort study of 2019.\nResults\nThe sample size was 10."
    found = checklists.report(spark.createDataFrame([(1, text)], DOCS))
    status = {r["item"]: (r["status"], r["evidence"]) for r in found.collect()}
    assert len(status) == len(found.collect()) == 16
    assert status["study-size"] == ("reported", "Methods The study size was small.")
    assert status["setting"][0] == "reported" and status["funding"] == ("needs_check", None)
    # no section for the design exists, so all of the text counts
    assert status["design"][0] == "reported"


def test_named_checklist_needs_no_cue(spark):
    docs = spark.createDataFrame([(1, "It was funded by the town."), (2, "")], DOCS)
    found = checklists.summary(checklists.report(docs, "consort")).orderBy("doc_id")
    assert one(found, "reported", "total") == [(1, 18), (0, 18)]
    assert checklists.report(docs).count() == 0


def test_long_evidence_is_cut(spark):
    found = checklists.report(spark.createDataFrame([(1, "A cohort study " + "of rain " * 100 + ".")], DOCS)).where("status = 'reported'")
    assert {len(r["evidence"]) for r in found.collect()} == {180}


def brief(spark, text, found=()):
    sents = rules.sentences(with_sections(spark.createDataFrame([(1, text)], DOCS)))
    findings = spark.createDataFrame([(1, r) for r in found], "doc_id long, rule_id string")
    return review.brief(findings, sents, discourse.missing_links(discourse.roles(sents))).collect()[0]


def test_brief_without_claims_has_nothing_to_weigh(spark):
    r = brief(spark, "The town was quiet.")
    assert (r["b_aim"], r["c_claims"], r["d_convincing"], r["e_use"], r["worries"]) == ("not_detected", "not_detected", "not_applicable", "not_detected", 0)


def test_brief_counts_worries_and_quotes(spark):
    r = brief(spark, "Introduction\nRain is odd. We therefore aim to test it. These findings suggest rain.", ["C302", "C303", "E705"])
    assert r["b_aim"] == r["c_claims"] == r["d_convincing"] == r["e_use"] == "detected"
    assert r["aim"] == "We therefore aim to test it." and r["gap"] is None
    assert r["worries"] >= 4  # overclaim, novelty, no gap, no limitations


def test_muting_again_keeps_the_place_and_unmuting_gives_it_up(spark):
    rows = [(1, "W201", True, 1), (1, "W202", True, 2), (1, "W201", True, 3), (1, "W203", True, 4), (1, "W202", False, 5), (1, "W202", True, 6), (2, "W201", True, 1), (2, "W201", False, 2), (3, "w1", True, 1)]
    found = settings.disabled_rules(spark.createDataFrame(rows, "user_id long, rule_id string, muted boolean, at long")).orderBy("user_id")
    assert one(found, "user_id", "disabled_rules", "valid") == [(1, ["W201", "W203", "W202"], True), (3, ["w1"], False)]


def test_full_dictionary_takes_no_more_and_readding_counts_nothing(spark):
    rows = [(1, "a", 1), (1, "b", 2), (1, "a", 3), (1, "c", 4), (1, "d", 5), (1, "two words", 0), (1, "", 0), (1, "x" * 65, 0), (2, "d", 9)]
    found = settings.dictionaries(spark.createDataFrame(rows, "user_id long, word string, at long"), most=3)
    assert sorted(one(found, "user_id", "word", "added")) == [(1, "a", 1), (1, "b", 2), (1, "c", 4), (2, "d", 9)]


def test_users_without_rows_have_defaults(spark):
    users = spark.createDataFrame([(1,), (2,)], "user_id long")
    muted = spark.createDataFrame([(1, ["W201"], True)], "user_id long, disabled_rules array<string>, valid boolean")
    choices = spark.createDataFrame([(1, "en-GB")], "user_id long, locale string")
    words = spark.createDataFrame([(1, "b", 1), (1, "a", 2)], "user_id long, word string, added long")
    found = settings.configurations(users, muted, choices, words).orderBy("user_id")
    assert [tuple(r) for r in found.collect()] == [(1, ["W201"], False, "en-GB", "revise", "auto", ["a", "b"]), (2, [], False, "en-US", "revise", "auto", [])]


def test_run_gate(spark):
    docs = spark.createDataFrame([(1, "some words that are read"), (2, " "), (3, None), (4, "a b c d e f"), (5, "x" * 30)], DOCS)
    assert sorted(one(bench.run_gate(docs, most_chars=25), "severity", "kind", "n")) == [("failure", "empty", 2), ("warning", "refused_too_large", 1), ("warning", "word_count_drift", 1)]
    assert one(bench.run_gate(docs.where("doc_id = 1")), "kind") == []
    assert one(bench.run_gate(docs.where("false")), "severity", "kind") == [("failure", "nothing_checked")]


def test_ranges_of_equations(spark):
    docs = spark.createDataFrame([(1, "Eqs. (1)-(3) and Eq. 3, Equations 7 to 2, Eqs. 1-80, Eq. (99999999999)")], DOCS)
    assert sorted(one(bench.equation_mentions(docs), "number", "n")) == [(1, 2), (2, 2), (3, 2), (7, 1), (80, 1)]


def test_sets_of_labels(spark):
    docs = spark.createDataFrame([(1, r"\label{a}\label{b}\ref{a}\eqref{c}\ref{c}"), (2, ""), (3, None)], DOCS)
    assert sorted(one(bench.label_sets(docs).where("doc_id < 3"), "n_any", "n_both", "n_dangling", "n_unused", "dangling")) == [(0, 0, 0, 0, ""), (3, 1, 1, 1, "c")]


def test_words_of_a_page(spark):
    html = "<html><style>a {b}</style><p>Two words&nbsp;- </p><!-- not <this> --><script>var x = 1</script></html>"
    pages = spark.createDataFrame([(1, html), (2, "")], "page_id long, html string")
    assert sorted(one(bench.prose_words(pages), "page_id", "n_words")) == [(1, 2), (2, 0)]
