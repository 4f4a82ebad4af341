"""A tagger from a sample, rules over tags, and word diffs."""

import random
import re

from marginalia.operators import tagging, worddiff
from marginalia.plans.tag_queries import SHAPES, by_shape
from pyspark.sql import functions as F

SAMPLE = [
    ("the small towns reported a rise", "DET ADJ NOUN VERB DET NOUN"),
    ("a large site was closed by the town", "DET ADJ NOUN AUX VERB ADP DET NOUN"),
    ("she counted the cases in May", "PRON VERB DET NOUN ADP PROPN"),
    ("the case of a town was reported", "DET NOUN ADP DET NOUN AUX VERB"),
]


def test_a_tagger_learns(spark):
    sample = spark.createDataFrame([(w.split(), t.split()) for w, t in SAMPLE], "words array<string>, tags array<string>")
    tag = tagging.train(sample)
    assert tag([["the", "small", "case", "was", "counted"], [], ["a", "town", "recounted"]]) == [["DET", "ADJ", "NOUN", "AUX", "VERB"], [], ["DET", "NOUN", "VERB"]]
    docs = spark.createDataFrame([(1, "The small towns reported a rise. She counted the cases."), (2, None), (3, "")], "doc_id long, text string")
    rows = tagging.tagged(tagging.sentence_tokens(docs), batch=tag).orderBy("sent").collect()
    assert [r.tags[:4] for r in rows] == [["DET", "ADJ", "NOUN", "VERB"], ["PRON", "VERB", "DET", "NOUN"]]


def given(spark, *sentences):
    rows = []
    for k, s in enumerate(sentences):
        at, tokens, tags = 0, [], []
        for part in s.split():
            word, tag = part.rsplit("/", 1)
            tokens.append((at, at + len(word), word))
            tags.append(tag)
            at += len(word) + 1
        rows.append((1, k, tokens, tags))
    return spark.createDataFrame(rows, "doc_id long, sent int, tokens array<struct<start:int,end:int,text:string>>, tags array<string>")


def test_noun_strings(spark):
    rows = given(
        spark,
        "the/DET town/NOUN water/NOUN plant/NOUN costs/NOUN rose/VERB",
        "Town/NOUN water/NOUN plant/NOUN cost/NOUN rose/VERB",
        "a/DET water/NOUN plant/NOUN cost/NOUN",  # three
        "World/PROPN Health/PROPN Day/NOUN plan/NOUN",  # a name
        "Smith/PROPN et/NOUN al/NOUN study/NOUN",
        "water/NOUN x/NOUN plant/NOUN cost/NOUN",  # a fragment
    )
    assert [(r.text, r.uses, r.start) for r in tagging.noun_strings(rows).collect()] == [("town water plant cost", 2, 0)]


def test_separated_verbs(spark):
    aside = " ".join(f"w{k}/NOUN" for k in range(8))
    rows = given(
        spark,
        f"rates/NOUN ,/PUNCT seen/VERB in/ADP {aside} ,/PUNCT rose/VERB",
        "rates/NOUN ,/PUNCT seen/VERB here/ADV ,/PUNCT rose/VERB",  # short
        f"rates/NOUN ,/PUNCT {aside} a/NOUN b/NOUN ,/PUNCT rose/VERB",  # a list
        f"rates/NOUN that/PRON were/AUX {aside} a/NOUN rose/VERB",  # part of the subject, not long enough
        f"rates/NOUN that/PRON were/AUX {aside} {aside} rose/VERB",
        f"we/PRON saw/VERB rates/NOUN ,/PUNCT seen/VERB in/ADP {aside} ,/PUNCT rose/VERB",  # a verb before
    )
    assert [(r.sent_, r.words) for r in tagging.separated_verbs(rows.withColumn("tokens", F.transform("tokens", lambda t: F.struct((t["start"] + F.col("sent") * 1000).alias("start"), t["end"].alias("end"), t["text"].alias("text"))))).select((F.col("start") / 1000).cast("int").alias("sent_"), "words").orderBy("sent_").collect()] == [(0, 10), (4, 18)]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_word_diffs(spark):
    r = random.Random(3)
    made = [(k, " ".join(r.choice("abcd") for _ in range(r.randint(0, 9))), " ".join(r.choice("abcd") for _ in range(r.randint(0, 9)))) for k in range(300)]
    made += [(300, None, "a b"), (301, "", ""), (302, "w " * 20000 + "x", "w " * 10000 + "y " + "w " * 10000 + "x"), (302, "a", "b")]
    found = worddiff.diffed(spark.createDataFrame(made, "k long, before string, after string"), "k", r"\S|\s").collect()
    assert len(found) == len(made)
    by = {(x.k, x.n_before): x for x in found}
    for k, a, b in made:
        x, a, b = by[k, len(a or "")], a or "", b or ""
        assert "".join(s.text for s in x.segments if s.op != "ins") == a and "".join(s.text for s in x.segments if s.op != "del") == b
        if k < 300:
            assert x.n_kept == lcs(a, b)


def test_places_are_worked_out_for_findings_only(spark):
    """Sentences as words alone give the findings that sentences as placed tokens give, and no window sorts their tokens."""
    texts = ["It rose. the slow town  water plant costs, it’s so. Water x plant cost, town water Plant Cost", "the rate of it, which in all of the towns that were seen by us was far above the rest, reversed.", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    placed = tagging.tagged(tagging.sentence_tokens(docs), tagger=by_shape)
    bare = tagging.tagged(tagging.sentence_words(docs), tagger=by_shape)
    for rule in (tagging.noun_strings, tagging.separated_verbs):
        found = sorted(tuple(r) for r in rule(bare).collect())
        assert found and found == sorted(tuple(r) for r in rule(placed).collect())
    assert "Window" not in tagging.noun_strings(bare)._jdf.queryExecution().optimizedPlan().toString()


def test_shapes_without_patterns(spark):
    """The shortcuts of ``by_shape`` give the first shape that fits."""
    words = ["the", "The", "of", "who", "et", "ended", "Sent", "sent", "Town", "town", "7", "1,250", "x1", "1x", "ö", "Ö", "—", "-", ".", "…", "(", "~", "{", "[", "@", "ed", "entity", "édited", "t-ed", "A", "Z", "a", "z", "中"]

    def first(w: str) -> str:
        return next((t for p, t in SHAPES if re.search(p.replace(r"\x{80}-\x{10FFFF}", "\x80-\U0010ffff"), w)), "NOUN")

    rows = spark.createDataFrame([(words,)], "words array<string>").select(by_shape(F.col("words")).alias("tags"))
    assert rows.first()["tags"] == [first(w) for w in words]
