"""Styles of Word files: outline levels inherited from the style a style is based on, and headings by them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators.sections import classify_heading

TOP_OUTLINE = 8  # level 9 is body text

_LEVELS = """
WITH RECURSIVE chain(doc_id, style_id, cur, level, based_on, seen) MAX RECURSION LEVEL 100 AS (
  SELECT doc_id, style_id, style_id, level, based_on, array(style_id) FROM {styles}
  UNION ALL
  SELECT c.doc_id, c.style_id, s.style_id, s.level, s.based_on, array_append(c.seen, s.style_id)
  FROM chain c JOIN {styles} s ON s.doc_id = c.doc_id AND s.style_id = c.based_on
  WHERE c.level IS NULL AND NOT array_contains(c.seen, s.style_id))
SELECT doc_id, style_id, level FROM chain WHERE level IS NOT NULL
"""


def outline_levels(styles: DataFrame) -> DataFrame:
    """(doc_id, style_id, name, level) of ``styles`` (doc_id, style_id, name, level text, based_on).

    A style without a level of its own has that of the nearest style it is based on that has one; a circle of
    styles has none.  Levels other than 0 to 8 (body text, and what is no number) are null, and still end the
    search.  Of several styles of one id the last by name counts.  Chains are followed by a recursive query, one
    step a round for all styles of all files, at most 100 deep: a longer chain is an error.  A null name
    is the id."""
    kept = F.max(F.struct(F.coalesce("name", "style_id").alias("name"), "level", "based_on"))
    own = styles.where("style_id is not null").groupBy("doc_id", "style_id").agg(kept.alias("s")).select("doc_id", "style_id", "s.*")
    spark = styles.sparkSession
    found = spark.sql(_LEVELS, styles=own.select("doc_id", "style_id", "level", "based_on"))
    level = F.when(F.col("level").rlike(r"^\d{1,9}$") & (F.col("level").try_cast("int") <= TOP_OUTLINE), F.col("level").try_cast("int"))
    found = found.select("doc_id", "style_id", level.alias("outline"))
    return own.select("doc_id", "style_id", "name").join(found, ["doc_id", "style_id"], "left").withColumnRenamed("outline", "level")


def styled_headings(paragraphs: DataFrame, levels: DataFrame) -> DataFrame:
    """Headings, as ``sections.resolve_sections`` takes them, of body paragraphs whose style has an outline level,
    or a name such as "Heading 2" or "Title" where it has none."""
    rows = paragraphs.where("kind = 'body'").join(levels.select("doc_id", F.col("style_id").alias("style"), "name", "level"), ["doc_id", "style"], "left")
    said = F.lower(F.coalesce("name", "style"))
    named = F.when(said.rlike(r"^heading ?[1-9]$"), F.right(said, F.lit(1)).cast("int") - 1).when(said == "title", -1)
    rows = rows.withColumn("level", F.coalesce("level", named)).where("level is not null")
    titled = rows.select("doc_id", F.col("start").cast("int").alias("start"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("title"), "level").where("title <> ''")
    return titled.withColumn("keyword", classify_heading(F.col("title"))).select("doc_id", "start", "title", "keyword", "level")
