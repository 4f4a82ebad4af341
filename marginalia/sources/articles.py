"""Journal articles in XML as blocks: section titles and paragraphs in reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Inline elements stand inside sentences: their marks go, their text stays.
INLINE = r"</?(?:bold|italic|sub|sup|sc|monospace|underline|named-content|styled-content|xref|ext-link|email|uri)(?:\s[^<>]*)?>"
#: Elements whose content is no prose.
APART = r"(?s)<(table-wrap|fig|disp-formula|inline-formula|supplementary-material)(?:\s[^<>]*)?>.*?</\1>"
ARTICLE = "front:struct<`article-meta`:struct<`title-group`:struct<`article-title`:string>,abstract:struct<p:array<string>>>>,body:struct<sec:array<struct<title:string,p:array<string>>>>,_bad:string"
BLOCK = "array<struct<part:string,title:string,text:string>>"


def article_blocks(articles: DataFrame, xml_col: str = "xml") -> DataFrame:
    """(doc_id, place, part, title, text, error): the title, the paragraphs of the abstract, those of each
    section.  Formulas, tables and figures are left out, marks of inline elements too.  An article that does
    not parse is one row with an error; a null one has none.  Sections inside sections are not read.
    """
    flat = F.regexp_replace(F.regexp_replace(xml_col, APART, " "), INLINE, "")
    schema = F.lit(f"struct<{ARTICLE}>")
    read = articles.where(F.col(xml_col).isNotNull()).select("doc_id", F.from_xml(flat, schema, {"columnNameOfCorruptRecord": "_bad"}).alias("a"))
    none = F.array().cast(BLOCK)
    title = F.array(F.struct(F.lit("title").alias("part"), F.lit(None).cast("string").alias("title"), F.col("a.front.`article-meta`.`title-group`.`article-title`").alias("text"))).cast(BLOCK)
    abstract = F.transform("a.front.`article-meta`.abstract.p", lambda p: F.struct(F.lit("abstract").alias("part"), F.lit(None).cast("string").alias("title"), p.alias("text"))).cast(BLOCK)
    body = F.flatten(F.transform("a.body.sec", lambda s: F.transform(F.coalesce(s["p"], F.array().cast("array<string>")), lambda p: F.struct(F.lit("body").alias("part"), s["title"].alias("title"), p.alias("text"))))).cast(BLOCK)
    blocks = F.filter(F.concat(title, F.coalesce(abstract, none), F.coalesce(body, none)), lambda b: F.trim(b["text"]) != "")
    error = F.when(F.col("a").isNull() | F.col("a._bad").isNotNull(), "bad_xml")
    rows = read.select("doc_id", error.alias("error"), F.when(error.isNull(), blocks).alias("blocks"))
    good = rows.where("error is null").select("doc_id", F.posexplode("blocks").alias("place", "b")).select("doc_id", "place", "b.*", F.lit(None).cast("string").alias("error"))
    bad = rows.where("error is not null").select("doc_id", F.lit(None).cast("int").alias("place"), *[F.lit(None).cast("string").alias(c) for c in ("part", "title", "text")], "error")
    return good.unionByName(bad)
