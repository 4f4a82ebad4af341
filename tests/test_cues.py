"""Cues are words of every match; a file of one row group is dealt over all cores."""

import re

from marginalia.functions import lexicons as lx
from marginalia.functions.text import either, either_word
from marginalia.operators import rules
from marginalia.plans.seeded import SEEDS, seeded

PHRASES = [*lx.GRAND_WORDS, *lx.WORDY_PHRASES, *lx.HYPE_WORDS, *lx.INTENSIFIERS, *lx.FILLER_PHRASES, *lx.REDUNDANT_PAIRS, *lx.CONTRACTIONS, *lx.EMPTY_PHRASES, *(w for p in lx.VARIANT_PAIRS for w in p), *lx.NOMINAL_VERBS]
FORMS = """prove proves proved proven conclusively definitively unambiguously undoubtedly|beyond doubt|beyond any doubt|establishes that|lead to|leads to|led to|results in|resulted in
cause caused causes prevent prevents prevented protects affected impact mitigates averted drives drove reduces reduced increases decreased improves raised lowers lowered worsens
significantly|of course|it is clear that|it is obvious that|relatively|in terms of|was reviewed by Miller|results will be discussed|data shall be examined|there have been studies|much research has been done|many authors have explored"""


def test_every_match_has_a_cue():
    texts = [*PHRASES, *FORMS.replace("\n", "|").split("|"), *FORMS.split(), *SEEDS, "there are manystudies of it"]
    for r in rules.RULES:
        for text in (f"({t})" for t in texts if r.rule_id in rules.CUES and r.pattern):
            for form in (text, text.upper()):
                runs = {w.lower() for w in re.findall("[A-Za-z]+", form)}
                assert not re.search(r.pattern, form) or runs & set(rules.CUES[r.rule_id]), (r.rule_id, form)


def test_borders_looked_for_once():
    for patterns in [*lx.ROLE_SIGNALS.values(), *lx.MOVE_SIGNALS.values(), [r"\ba|b", r"x\b", r"\b(c|d)"]]:
        for text in [*SEEDS, "b", "ab", "xc c", "95% ci", "p < 0.05", "et al", ""]:
            assert bool(re.search(either(patterns), text.lower())) == bool(re.search(either_word(patterns), text.lower())), text


def test_one_row_group_is_dealt(spark, sf_dir):
    assert seeded(spark, sf_dir).rdd.getNumPartitions() >= 4


def test_quick_patterns_match_alike():
    texts = [*PHRASES, *FORMS.replace("\n", "|").split("|"), *SEEDS, "anovel", "novels", "x-novel_", "very verily", "state-of-the-arts", ""]
    for rule_id, quick in rules._QUICK.items():
        for text in texts:
            for form in (f"({text})", text.upper(), f"{text} {text}x {text}."):
                slow = [m.span() for m in re.finditer(rules.BY_ID[rule_id].pattern, form, re.ASCII)]
                assert slow == [m.span() for m in re.finditer(quick, form, re.ASCII)], (rule_id, form)


def test_words_of_compounds_leave_the_row_with_their_places():
    cues, found = rules._words_of("The data set, a Data-set. The dataset, prior to data  set.")
    assert found == [(4, "data", "set"), (16, "data-set", None), (30, "dataset", None)]
    assert cues & rules._BITS["W202"] and rules._words_of("ta ri tari") == (0, []) and rules._words_of(None) == (0, [])


def test_few_sentences_are_looked_at_in_full(spark):
    """Of most sentences no rule can speak; only the others leave their row."""
    text = "The town was quiet. " * 50 + "However, rates fell. This suggests it. They rose. " + "The town was quiet. " * 50
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    every = [*rules.SENTENCE_RULES, "C301"]
    some = rules.hinted_sentences(rules.with_cues(rules.with_sections(docs)), every)
    assert [(r.sent, r.start, r.text) for r in some.orderBy("sent").collect()] == [(50, 1000, "However, rates fell."), (51, 1021, "This suggests it.")]
    of = lambda s: sorted(tuple(r) for r in rules.sentence_findings(s).select("rule_id", "start", "end").collect())
    assert of(some) == of(rules.sentences(rules.with_sections(docs), context=True))
