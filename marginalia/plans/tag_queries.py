"""Rules that rest on parts of speech, over tags given by a word's shape (any tagger fits the same seam)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators import tagging, worddiff
from marginalia.plans.seeded import SENTENCES, _view, hits_sql, listed, quoted, seeded_with

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


#: Shapes of words and their tags, the first that fits; NOUN otherwise.
SHAPES = [
    (r"^[^A-Za-z0-9\x{80}-\x{10FFFF}]+$", "PUNCT"),
    (r"^[0-9]", "NUM"),
    (r"^(?:the|a|an|der|die|das|le|la|les)$", "DET"),
    (r"^(?:of|in|on|at|by|for|de|von|mit)$", "ADP"),
    (r"^(?:it|they|we|which|that|who|whom|whose)$", "PRON"),
    (r"^(?:and|or|und|et)$", "CCONJ"),
    (r"(?:ed|ent)$", "VERB"),
    (r"^[A-Z]", "PROPN"),
]
ASIDE_SEEDS = [
    "the rate of infection, which in all of the towns that were seen by us was far above the rest, reversed in the spring.",
    "they (as was said by all of the people in the town at the time of it) agreed. the slow town water plant cost was high, the slow town water plant costs too.",
    "the towns, sites and places of it, reversed. it — to the wonder of most of the people who had come in to see it — ended.",
    "the people that lived in the part of the town by the old port at the end of the long road by the sea agreed at once.",
]


def by_shape(words: Column) -> Column:
    """The first of ``SHAPES`` that fits.  Which fits is mostly told by a word's first character and its end, so that few
    words are read by a pattern."""
    (mark, punct), (_, number), *lists, (spoken, verb), (_, name) = SHAPES
    fixed = [(re.fullmatch(r"\^\(\?:(.*)\)\$", p)[1].split("|"), tag) for p, tag in lists]

    def one(w: Column) -> Column:
        out = F.when((w >= "A") & (w < "["), name).otherwise("NOUN")
        out = F.when((F.contains(w, F.lit("ed")) | F.contains(w, F.lit("ent"))) & w.rlike(spoken), verb).otherwise(out)
        for listed_, tag in reversed(fixed):
            out = F.when(w.isin(listed_), tag).otherwise(out)
        out = F.when((w >= "0") & (w < ":"), number).otherwise(out)
        alnum = ((w >= "a") & (w < "{")) | ((w >= "A") & (w < "[")) | (w >= "\x80") | ((w >= "0") & (w < ":"))
        return F.when(~alnum & w.rlike(mark), punct).otherwise(out)

    return F.transform(words, one)


_TAG = "CASE " + " ".join(f"WHEN regexp_matches(text, {quoted(p)}) THEN {quoted(t)}" for p, t in SHAPES) + " ELSE 'NOUN' END"
_TOKENS = (
    f"{_view(ASIDE_SEEDS)}, {SENTENCES}, keyed AS (SELECT {{'d': doc_id, 's': sent, 'b': start}} AS doc_id, text FROM sents), {hits_sql(tagging.TOKEN, 'keyed', 'text', 'tk')}, "
    f'x AS (SELECT doc_id.d AS doc_id, doc_id.s AS sent, (i - 1)::INT AS i, doc_id.b + start AS start, doc_id.b + "end" AS "end", text, lower(text) AS w, {_TAG} AS tag FROM tk)'
)


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagging.tagged(tagging.sentence_words(seeded_with(spark, sf_dir, ASIDE_SEEDS)), tagger=by_shape)


@query(
    f"WITH {_TOKENS}, n AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, sent ORDER BY i) AS island FROM x WHERE tag IN ('NOUN', 'PROPN')), "
    "runs AS (SELECT doc_id, sent, island, min(start) AS start, max(\"end\") AS \"end\", string_agg(regexp_replace(w, '([^s])s$', '\\1'), ' ' ORDER BY i) AS lemmas FROM n GROUP BY ALL "
    f"HAVING count(*) >= 4 AND count(*) FILTER (tag = 'PROPN') < 2 AND NOT bool_or(NOT regexp_matches(text, {quoted(tagging.LETTERS)}) OR length(text) < 3 OR w IN ('et', 'al'))) "
    "SELECT doc_id, 'G107' AS rule_id, min(start)::INT AS start, arg_min(\"end\", start)::INT AS \"end\", lemmas AS text, count(*) AS uses FROM runs GROUP BY doc_id, lemmas"
)
def g107_noun_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagging.noun_strings(_tagged(spark, sf_dir))


_OPENERS = listed([*tagging.ASIDES, *tagging.RELATIVES])
_CLOSING = "CASE o.w " + " ".join(f"WHEN {quoted(a)} THEN {quoted(b)}" for a, b in tagging.ASIDES.items()) + " END"
_WEAK = f"w IN {listed(tagging.RELATIVES)}"


@query(
    f"WITH {_TOKENS}, o AS (SELECT doc_id, sent, min(i) AS oi, arg_min(w, i) AS w FROM x WHERE i > 0 AND w IN {_OPENERS} GROUP BY ALL), "
    f"s AS (SELECT o.*, max(x.i) FILTER (tag IN ('NOUN', 'PROPN', 'PRON') AND x.w NOT IN {listed(tagging.RELATIVES)}) AS si, bool_or(tag IN ('VERB', 'AUX')) AS spoken FROM o JOIN x ON x.doc_id = o.doc_id AND x.sent = o.sent AND x.i < oi GROUP BY ALL), "
    f"c AS (SELECT o.doc_id, o.sent, o.oi, o.w, o.si, min(x.i) FILTER (x.i > oi AND x.w = {_CLOSING}) AS ci FROM s o JOIN x USING (doc_id, sent) WHERE si IS NOT NULL AND NOT spoken GROUP BY ALL), "
    f"a AS (SELECT c.*, c.{_WEAK} AS weak, count(*) FILTER (x.i > oi AND x.i < ci AND regexp_matches(x.w, {quoted(tagging.LETTERS)})) AS inner_, coalesce(bool_or(tag IN ('VERB', 'AUX', 'ADP', 'PRON', 'ADV')) FILTER (x.i > oi AND x.i < ci), FALSE) AS phrase FROM c JOIN x USING (doc_id, sent) GROUP BY ALL), "
    "k AS (SELECT * FROM a WHERE weak OR (ci IS NOT NULL AND CASE WHEN w IN ('(', '[') THEN inner_ >= 3 WHEN w = ',' THEN phrase ELSE TRUE END)), "
    "vs AS (SELECT k.*, x.i AS vi, row_number() OVER (PARTITION BY k.doc_id, k.sent ORDER BY x.i) AS r FROM k JOIN x USING (doc_id, sent) WHERE tag IN ('VERB', 'AUX') AND x.i > CASE WHEN weak THEN oi ELSE ci END), "
    "v AS (SELECT * FROM vs WHERE r = CASE WHEN weak THEN 2 ELSE 1 END), "
    "g AS (SELECT v.doc_id, v.sent, si, vi, weak, count(*) FILTER (x.i > si AND x.i < vi AND tag <> 'PUNCT' AND regexp_matches(x.w, '[A-Za-z0-9\\x{80}-\\x{10FFFF}]'))::INT AS words FROM v JOIN x USING (doc_id, sent) GROUP BY ALL) "
    "SELECT g.doc_id, 'G101' AS rule_id, p.start::INT AS start, q.\"end\"::INT AS \"end\", p.text || ' … ' || q.text AS text, words FROM g JOIN x p ON p.doc_id = g.doc_id AND p.sent = g.sent AND p.i = si JOIN x q ON q.doc_id = g.doc_id AND q.sent = g.sent AND q.i = vi WHERE words >= CASE WHEN weak THEN 15 ELSE 10 END"
)
def g101_subject_verb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagging.separated_verbs(_tagged(spark, sf_dir))


# --- word diffs of short texts: a page's address against the next one's ---
_PARTS = "regexp_extract_all(url, '[A-Za-z0-9]+|[^A-Za-z0-9]')"


@query(
    f"WITH RECURSIVE p AS (SELECT page_id, url, lead(url) OVER (ORDER BY page_id) AS next_url, {_PARTS} AS a, lead({_PARTS}) OVER (ORDER BY page_id) AS b FROM pages), "
    "dp AS (SELECT page_id, a, b, 0 AS i, list_transform(range(0, len(b) + 1), lambda j: 0) AS best FROM p WHERE b IS NOT NULL UNION ALL "
    "SELECT page_id, a, b, i + 1, list_reduce(list_transform(range(0, len(b) + 1), lambda j: [j::INT]), lambda acc, j: list_append(acc, CASE WHEN a[i + 1] = b[j[1]] THEN best[j[1]] + 1 ELSE greatest(best[j[1] + 1], acc[-1]) END)) FROM dp WHERE i < len(a)) "
    "SELECT page_id, len(a)::INT AS n_before, len(b)::INT AS n_after, best[-1]::INT AS n_kept, md5(url) AS before_md5, md5(next_url) AS after_md5 FROM dp JOIN p USING (page_id, a, b) WHERE i = len(a)"
)
def address_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    ids = pages.select("page_id")
    following = ids.alias("a").join(ids.alias("b"), F.col("b.page_id") == F.col("a.page_id") + 1).select(F.col("a.page_id").alias("page_id"), F.col("b.page_id").alias("next_id"))
    pairs = following.join(pages.withColumnRenamed("url", "before"), "page_id").join(pages.select(F.col("page_id").alias("next_id"), F.col("url").alias("after")), "next_id")
    found = worddiff.diffed(pairs.select("page_id", "before", "after"), "page_id", r"[A-Za-z0-9]+|[^A-Za-z0-9]")
    text = lambda *ops: F.md5(F.array_join(F.transform(F.filter("segments", lambda s: s["op"].isin(*ops)), lambda s: s["text"]), ""))
    return found.select("page_id", "n_before", "n_after", "n_kept", text("same", "del").alias("before_md5"), text("same", "ins").alias("after_md5"))
