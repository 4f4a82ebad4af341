"""Thresholds come from all labelled ids that are set aside."""

from pyspark.sql import functions as F

from marginalia.llm import toxicity


def test_every_id_set_aside_counts(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(toxicity, "calibrate", lambda model, counts: seen.update(counts))
    docs = spark.range(0, 120_000, 1, 4).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.when(F.col("id") % 3 == 0, "bad word").otherwise("good word").alias("text"), (F.col("id") % 3 == 0).cast("int").alias("toxic"))
    toxicity.train(docs, docs.select("doc_id", "toxic"), rows=200)
    aside = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(toxicity.CALIBRATE)) == 0).count()
    assert sum(c.sum() for c in seen.values()) == aside > 20_000
