"""Registered queries against plain versions, on the small tables."""

import collections
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm.queries import ORACLE_SQL, QUERIES
from tests.llm import brute
from tests.oracle import agree, connect


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, sf_dir, name):
    agree(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLE_SQL[name])


def test_op1_nears_targets(spark, sf_dir):
    rows = QUERIES["op1_mixing"](spark, sf_dir).collect()
    taken, target, largest = collections.Counter(), {}, collections.Counter()
    for r in rows:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = (r["target"], r["source_size"])
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert r["taken"] <= 3 * r["size"]
    assert abs(sum(t for t, _ in target.values()) - sum(s for _, s in target.values())) < 1e-3
    for s, (t, size) in target.items():
        assert t <= 3 * size + 1e-6 and abs(taken[s] - t) <= max(0.1 * t, largest[s] / 2)  # whole documents only


def test_op3(spark, sf_dir, texts):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in QUERIES["op3_substring_dedup"](spark, sf_dir).collect()}
    assert got == brute.without_repeats(texts)


def test_op4(spark, sf_dir, texts):
    for r in QUERIES["op4_secrets"](spark, sf_dir).collect():
        base = brute.base_spans(dict(texts)[r["doc_id"]])
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(x[3] == k for x in base) for k in ("assign", "access", "hex"))
        assert {f"{k}:{a}:{b}" for a, _, b, k in base} <= set(r["spans"].split(","))


def test_op9(spark, sf_dir, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op9_near_duplicates"](spark, sf_dir).collect()}
    assert got == brute.near_groups(texts)


def test_op6_learns(spark, sf_dir):
    found = QUERIES["op6_toxicity"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    clean = [r for r in found if r["toxic"] == 0]
    assert sum(r["predicted"] for r in clean) <= 0.1 * len(clean)


def test_op7_held_out(spark, sf_dir):
    found = QUERIES["op7_language_id"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 0.95 * len(found)


def test_op8_recall(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    x, ids = np.stack(t["embedding"].to_numpy()).astype(np.float64), t["vec_id"].to_numpy()
    got = collections.defaultdict(list)
    for r in QUERIES["op8_nearest_neighbours"](spark, sf_dir).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = total = 0
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        want = [ids[j] for j in np.lexsort((ids, d)) if j != i][:10]
        hits, total = hits + len(set(want) & {v for v, _ in got[ids[i]]}), total + 10
        where = dict(zip(ids, d, strict=True))
        assert len(got[ids[i]]) == 10 and all(where[v] == s for v, s in got[ids[i]])
    assert hits >= 0.9 * total


def test_op10_round_trip(spark, sf_dir, texts):
    for r in QUERIES["op10_media"](spark, sf_dir).collect():
        raw = (dict(texts)[r["doc_id"]] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-16:])
        assert r["feature"].startswith("audio/wav;")


def test_op5_keeps_every_word(spark, sf_dir, texts):
    rows = QUERIES["op5_packing"](spark, sf_dir).collect()
    words, fill = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        words[r["doc_id"]] += r["n_words"]
        fill[r["shard"], r["sequence"]].append((r["begin"], r["n_words"], r["capacity"]))
    assert dict(words) == {i: len((t or "").encode().split()) for i, t in texts}
    for parts in fill.values():
        end = 0
        for begin, n, capacity in sorted(parts):
            assert begin >= end and begin + n <= capacity
            end = begin + n
        smaller = [c for c in (256, 512, 1024, 2048) if c >= end]
        assert parts[0][2] == min(smaller)


def test_pipeline_decisions(spark, sf_dir):
    import corpus_pipeline as p
    from marginalia.llm.store import cut, table

    d0 = table(spark, sf_dir, "documents")
    d1 = cut(p.drop_toxic(spark, d0, sf_dir))
    d2 = cut(p.drop_lines(spark, d1, sf_dir))
    d3 = cut(p.drop_near_duplicates(spark, d2, sf_dir))
    d4 = cut(p.mix_sources(spark, d3, sf_dir))
    assert d1.columns == d2.columns == d3.columns == d4.columns == d0.columns
    assert d2.count() == d1.count() <= d0.count()
    groups = brute.near_groups([(r["doc_id"], r["text"]) for r in d2.select("doc_id", "text").collect()])
    assert sorted(r["doc_id"] for r in d3.select("doc_id").collect()) == sorted(i for i, (_, g) in groups.items() if i == g)
    packed = p.pack_sequences(spark, d4, sf_dir).agg(F.sum("n_words")).first()[0]
    assert packed == sum(len(r["text"].encode().split()) for r in d4.select("text").collect())
