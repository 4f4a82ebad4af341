"""Clashing names, repeated ids, one class of labels, ragged vectors, hot groups: each with its defined result."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import ann, langid, line_dedup, mixing, packing, sample, substring_dedup, toxicity
from marginalia.llm.media import sniff, automaton
from tests.llm import brute

WORDS = [f"w{i}" for i in range(400)]


@pytest.fixture(scope="module")
def clashing(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(30)), "en", "ab"[i % 2], 0) for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("_text", "text_", "_score", "_key", "_gone", "_gone_key", "_dropped", "_id", "_of", "_copies", "_copy", "label", "sign", "gid", "bucket"):
        d = d.withColumn(name, F.lit("own"))
    return d


def test_names_that_operators_make(spark, clashing):
    assert line_dedup.drop_recurring_lines(clashing).columns == [*clashing.columns, "_dropped_"]
    assert mixing.mix(clashing).columns == clashing.columns
    out = toxicity.scored(clashing, toxicity.fit([], np.array([])), score_col="mark")
    assert out.columns == [*clashing.columns, "mark"] and out.where("_score = 'own' and _text = 'own'").count() == 40
    assert "_score" in toxicity.scored(clashing, toxicity.fit([], np.array([]))).columns


def test_stages_keep_the_columns(spark, clashing, sf_dir):
    import corpus_pipeline as p

    for name, stage in p.STAGES[:-1]:
        assert stage(spark, clashing, sf_dir).columns == clashing.columns, name
        assert stage(spark, clashing.where("false"), sf_dir).count() == 0, name
    twice = clashing.where("doc_id < 5").unionByName(clashing.where("doc_id < 5"))
    assert p.drop_near_duplicates(spark, twice, sf_dir).count() == 5


def test_one_class_rejects_nothing(spark):
    d = spark.createDataFrame([(i, f"some words of text {i}", "en") for i in range(8)], "doc_id long, text string, lang string")
    model = toxicity.train(d, d.select("doc_id", F.lit(1).alias("toxic")))
    assert toxicity.scored(d, model).where(F.col("_score") >= toxicity.threshold(model)).count() == 0


def test_mix_takes_id_and_source(spark):
    rows = [(1, "w " * 100, "a"), (1, "w " * 10, "b"), (2, "w " * 5, "b")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = {(r["doc_id"], r["source"]): r["copies"] for r in mixing.mix_plan(d).collect()}
    got = {(r["doc_id"], r["source"]): r["n"] for r in mixing.mix(d).groupBy("doc_id", "source").agg(F.count("*").alias("n")).collect()}
    assert got == {k: n for k, n in plan.items() if n}


def test_samples_are_bounded_by_rows(spark):
    for rows in ([(7, "same")] * 1000, [(7, f"t{i}") for i in range(1000)], [(None, f"t{i}") for i in range(1000)]):
        d = spark.createDataFrame(rows, "doc_id long, text string")
        n = sample.bounded(d, 100).count()
        assert n <= 100 and (len(set(rows)) == 1 or n >= 50)


def test_repeated_rows_spread_over_shards(spark):
    d = spark.createDataFrame([(1, "w " * 10)] * 300, "doc_id long, text string")
    rows = packing.pack_documents(d, shard=50).collect()
    assert len(rows) == 300 and len({r["shard"] for r in rows}) > 3


def test_languages_without_text_are_not_learned(spark):
    d = spark.createDataFrame([(i, "the cat sat on the mat", "en") for i in range(5)] + [(9, None, "xx"), (10, "", "yy")], "doc_id long, text string, lang string")
    assert langid.train(d).langs == ["en"]


def test_ragged_vectors_and_repeated_ids(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(300)] + [(1000 + i, [1.0, 2.0]) for i in range(5)] + [(7, [9.0] * 4)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(d).collect()
    assert {r["query_id"] for r in got} == {0, 100, 200} and all(r["vec_id"] < 1000 for r in got) and len(got) == 30


def test_exact_reach_and_structure(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(100, 16)) * 10
    x = np.concatenate([c + rng.normal(size=(40, 16)) for c in centres])
    index = ann.Index.of(x, ann.fit(x.astype(np.float32)))
    looked, hits = [], 0
    for i in range(0, len(x), 100):
        near = np.argsort(((x - x[i]) ** 2).sum(axis=1))[:11]
        for reach in (ann.REACH, 1.0):
            _, leaves = index.visits(x[i], 11, reach)
            seen = {r for t, leaf in leaves for r in index.seats[t][index.ends[t, leaf] : index.ends[t, leaf + 1]].tolist()}
            if reach == 1.0:
                assert set(near.tolist()) <= seen
            else:
                looked.append(len(seen) / len(x))
                hits += len(set(near.tolist()) & seen)
    assert np.mean(looked) < 0.2 and hits >= 0.9 * 11 * len(looked)


def test_hot_anchor_equals_brute_force(spark):
    rng = random.Random(9)
    phrase = "all rights reserved by the owners of this page and its texts".split()
    rows = []
    for i in range(80):
        words = [rng.choice(WORDS) for _ in range(25)]
        rows.append((i, " ".join(words[: 5 + i % 7] + phrase + words[5:] + (phrase * 3 if i % 5 == 0 else []))))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(d).collect()}
    assert got == brute.without_repeats(rows)


def test_toxic_words_are_caught_in_held_out_rows(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(60)) + (" " + rng.choice(["vilest", "vilely", "vile"]) if i % 5 == 0 else ""), "en" if i % 2 else "fr") for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = toxicity.train(d.where("doc_id < 450"), d.where("doc_id < 450").select("doc_id", (F.col("doc_id") % 5 == 0).cast("int").alias("toxic")))
    held = toxicity.scored(d.where("doc_id >= 450"), model).withColumn("gone", F.col("_score") >= toxicity.threshold(model)).collect()
    toxic = [r["gone"] for r in held if r["doc_id"] % 5 == 0]
    clean = [r["gone"] for r in held if r["doc_id"] % 5]
    assert sum(toxic) >= 0.8 * len(toxic) and sum(clean) <= 0.05 * len(clean)


def test_many_opening_marks(spark):
    import time

    began = time.time()
    assert sniff(b"%PDF-1.4 PK\x03\x04 " * 50_000, automaton()) == []
    assert time.time() - began < 20
