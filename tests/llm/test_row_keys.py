"""Rows whose ids are null or repeat, with texts that differ."""

import hashlib

import corpus_pipeline
from marginalia.llm.neardup import near_duplicates
from marginalia.llm.substring_dedup import remove_repeats

from . import brute

P = " ".join(f"p{k}" for k in range(60))
Q = " ".join(f"q{k}" for k in range(60))
R = " ".join(f"r{k}" for k in range(60))
ROWS = [
    (1, P), (2, Q + " " + P), (2, "only two"), (2, Q + " " + P), (3, R), (3, None), (4, ""), (4, R + " x"), (5, Q),
    (None, P), (None, "only two"), (None, None), (None, P), (6, " ".join(f"w{k % 5000}" for k in range(12000))), (7, "only two"),
]
SCHEMA = "doc_id long, text string"


def test_op3_rows_of_one_id_are_told_apart(spark):
    order = sorted(set(ROWS), key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256(("" if r[1] is None else "=" + r[1]).encode()).hexdigest()))
    plain = brute.without_repeats([(k, t) for k, (_, t) in enumerate(order)])
    want = sorted([(i, *plain[order.index((i, t))]) for i, t in ROWS], key=str)
    got = remove_repeats(spark.createDataFrame(ROWS, SCHEMA), with_text=False).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got], key=str) == want


def test_op9_returns_one_row_a_row(spark):
    for rows in (ROWS, [(1, P), (2, P), (2, Q), (3, R)], [(1, P), (2, P), (2, Q), (3, Q), (3, None)]):
        known = [r for r in rows if r[0] is not None]
        single = brute.near_groups(list(enumerate(t for _, t in known)))
        up = {i: i for i, _ in known}

        def root(i, up=up):
            while up[i] != i:
                i = up[i]
            return i

        for k, (i, _) in enumerate(known):
            a, b = root(i), root(known[single[k][1]][0])
            up[max(a, b)] = min(a, b)
        want = [(i, single[k][0], root(i), root(i) == i) for k, (i, _) in enumerate(known)]
        got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None) == sorted(want)
        assert len(got) == len(rows) and all(r.kept and r.component_id is None for r in got if r.doc_id is None)


def test_pipeline_takes_such_rows(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [{"doc_id": i, "text": t, "lang": "en", "source": "s", "n_chars": None if t is None else len(t)} for i, t in ROWS]
    made = spark.createDataFrame(rows, docs.schema)
    assert corpus_pipeline.STAGES[0][1](spark, made, sf_dir).count() <= len(ROWS)  # may take words it never saw for toxic
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[1:]):
        stage(spark, made, sf_dir).write.parquet(f"{tmp_path}/{k}")
        made = spark.read.parquet(f"{tmp_path}/{k}")
    assert made.count() > 0
