"""Registered queries of this subpackage, and the SQL that checks those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from marginalia.llm import chat, langid, secrets, toxicity
from marginalia.llm.ann import nearest
from marginalia.llm.line_dedup import drop_recurring_lines
from marginalia.llm.media import text_media
from marginalia.llm.mixing import ROUNDS, mix_plan
from marginalia.llm.neardup import near_duplicates
from marginalia.llm.packing import pack_documents
from marginalia.llm.store import crc_mod, table
from marginalia.llm.substring_dedup import remove_repeats
from marginalia.llm.trie import conversation_trie
from marginalia.llm.variants import variant_forms


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"), F.length("text").alias("kept_chars"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False).drop("kept_text")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.secrets(table(spark, sf_dir, "documents")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(crc_mod(F.col("doc_id"), 5) != 0))
    found = toxicity.scored(docs.select("doc_id", "lang", "text"), model)
    return found.select(
        "doc_id",
        (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"),
        toxicity.threshold(model).alias("threshold"),
        (F.col("_score") >= toxicity.threshold(model)).alias("rejected"),
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(crc_mod(F.col("doc_id"), 4) != 2))
    found = langid.identify(docs, model)
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(table(spark, sf_dir, "documents"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", added), (-7, 1, "assistant", added)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digest(chat.chat(rows))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_forms(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_line_dedup": op2_line_dedup,
    "op5_packing": op5_packing,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_secrets": op4_secrets,
    "op6_toxicity": op6_toxicity,
    "op7_language_id": op7_language_id,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op10_media": op10_media,
    "op9_near_duplicates": op9_near_duplicates,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_chat_format": op12_chat_format,
    "op13_spelling_variants": op13_spelling_variants,
}

#: One step of adding or removing a document: what has been moved so far, and what is then missing.
_ROUND = """
b{k} AS (SELECT s.*, m.missing, row_number() OVER (PARTITION BY s.source ORDER BY abs(s.size - abs(m.missing)), s.doc) AS r
  FROM side s JOIN m{j} m ON s.source IS NOT DISTINCT FROM m.source
  WHERE CASE WHEN m.missing > 0 THEN NOT s.extra AND s.whole < 3 ELSE s.extra END AND abs(s.size - abs(m.missing)) < abs(m.missing)
    AND NOT EXISTS (SELECT 1 FROM p{j} p WHERE p.source IS NOT DISTINCT FROM s.source AND p.extra = s.extra AND p.size = s.size)),
p{k} AS (SELECT * FROM p{j} UNION ALL SELECT source, extra, size, doc FROM b{k} WHERE r = 1),
m{k} AS (SELECT m.source, m.missing + coalesce(CASE WHEN b.extra THEN b.size ELSE -b.size END, 0) AS missing
  FROM m{j} m LEFT JOIN (SELECT * FROM b{k} WHERE r = 1) b ON m.source IS NOT DISTINCT FROM b.source)"""

ORACLE_SQL: dict[str, str] = {
    "op1_mixing": """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS c, ((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::BIGINT AS w
  FROM sized GROUP BY source),
-- sources fill up in the order of words per weight: the level is the first at which the next one does not
steps AS (
  SELECT *, coalesce(sum(3 * c) OVER before, 0) AS full_c, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS open_w,
         sum(c) OVER () AS total
  FROM sources
  WINDOW before AS (ORDER BY 3.0::DOUBLE * c / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT (total - full_c)::DOUBLE AS num, open_w::DOUBLE AS den FROM steps
  WHERE w * (total - full_c)::DOUBLE / open_w::DOUBLE <= 3 * c
  ORDER BY 3.0::DOUBLE * c / w, source NULLS LAST LIMIT 1),
aims AS (
  SELECT source, c, CASE WHEN w * num / den > 3 * c THEN (3 * c)::DOUBLE ELSE w * num / den END AS target
  FROM sources LEFT JOIN level ON TRUE),
plans AS (
  SELECT *, CASE WHEN c > 0 THEN least(floor(target / c), 3)::BIGINT ELSE 0 END AS whole FROM aims),
rows_in AS (
  SELECT s.*, p.c AS source_size, p.target, p.whole, p.target - p.whole * p.c AS rest,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id) AS upto
  FROM sized s JOIN plans p ON s.source IS NOT DISTINCT FROM p.source),
first_pick AS (SELECT *, rest > 0 AND upto <= rest AS extra FROM rows_in),
side AS (
  SELECT source, extra, size, min({'h': h, 'doc_id': doc_id}) AS doc, any_value(whole) AS whole FROM first_pick WHERE size > 0 GROUP BY ALL),
m0 AS (SELECT source, any_value(rest) - sum(CASE WHEN extra THEN size ELSE 0 END) AS missing FROM first_pick GROUP BY source),
p0 AS (SELECT source, extra, size, doc FROM side WHERE FALSE),
""" + ",\n".join(_ROUND.format(k=k, j=k - 1) for k in range(1, ROUNDS + 1)) + f""",
final AS (SELECT f.*, f.extra <> (p.doc IS NOT NULL) AS chosen FROM first_pick f LEFT JOIN p{ROUNDS} p
          ON f.source IS NOT DISTINCT FROM p.source AND f.h = p.doc.h AND f.doc_id IS NOT DISTINCT FROM p.doc.doc_id)
SELECT doc_id, size, source_size, target, (size * (whole + chosen::BIGINT))::BIGINT AS taken, source, (whole + chosen::BIGINT)::BIGINT AS copies
FROM final
""",
}
