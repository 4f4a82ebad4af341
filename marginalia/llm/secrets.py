"""Secret scans with DataFrame functions: three patterns, and two character Markov models.

A token is suspicious if a Markov model of random strings explains it better than one of ordinary
identifiers, by the log-likelihood ratio over its characters.  The models are bigram counts: of values
that the patterns caught (label: secret) and of ordinary words (label: not), both from a bounded sample.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import once, spans_of
from marginalia.llm.sample import bounded

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a run that is long enough, or none of its ends is
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Documents that the models learn from at most; pseudo-counts a character brings; odds against a secret.
FIT_DOCS, RANDOM_PRIOR, WORD_PRIOR, ODDS = 20_000, 250.0, 10.0, 1e6
#: Documents whose words are counted as ordinary ones at most.
WORD_DOCS = 2_000


def _hits(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def located(text: Column, pattern: str, hits: Column) -> Column:
    """Begin and end, in code points, of all matches; the pattern must not match the empty text."""
    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), hits.alias("hits"))
    found = once(parts, lambda z: F.transform(spans_of(z["gaps"], z["hits"]), lambda s: F.struct(s["start"].alias("b"), s["end"].alias("e"))))
    return F.when(F.size(hits) > 0, found).otherwise(F.array().cast("array<struct<b:int,e:int>>"))


def _matched(docs: DataFrame) -> DataFrame:
    """doc_id and text with the raw matches of every pattern."""
    text = F.col("text")
    found = docs.withColumns({"h0": _hits(text, ASSIGN), "h1": _hits(text, ACCESS), "h2": _hits(text, HEX), "h3": _hits(text, TOKEN)})
    return found.withColumn("value", F.when(F.size("h0") > 0, _hits(text, ASSIGN, 2)).otherwise(F.array().cast("array<string>")))


def _bigrams(tokens: DataFrame) -> DataFrame:
    """Counts of neighbouring characters in column t: at most len(ALPHABET) ** 2 rows."""
    places = F.sequence(F.lit(1), F.length("t") - 1)
    pairs = tokens.where("length(t) > 1").select(F.explode(F.transform(places, lambda i: F.substring(F.col("t"), i, F.lit(2)))).alias("pair"))
    return pairs.groupBy("pair").count()


def train(docs: DataFrame, fit_docs: int = FIT_DOCS) -> list[float]:
    """Log-likelihood ratios, random against ordinary, of all character pairs in alphabet order.

    At most ``fit_docs`` documents give the labelled values, ``WORD_DOCS`` the ordinary words."""
    text = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    some = bounded(text, fit_docs)
    caught = _matched(some).select(F.explode(F.concat(F.filter("value", lambda v: F.length(v) >= 16), "h1", "h2")).alias("t"))
    words = bounded(text, min(WORD_DOCS, fit_docs), seed=18).select(F.explode(_hits(F.col("text"), r"[A-Za-z0-9+/_=-]{2,}")).alias("t"))
    ordinary = words.where(~F.col("t").rlike(f"^({HEX}|{ACCESS})$"))
    tables = []
    for counts, prior, uniform in ((_bigrams(caught), RANDOM_PRIOR, True), (_bigrams(ordinary), WORD_PRIOR, False)):
        n = {(r["pair"][0], r["pair"][1]): r["count"] for r in counts.collect()}
        total = {a: sum(n.get((a, b), 0) for b in ALPHABET) for a in ALPHABET}
        single = {b: sum(n.get((a, b), 0) for a in ALPHABET) + 0.5 for b in ALPHABET}
        # transitions fall back on single characters; of random strings, on all alike
        base = {b: 1 / len(ALPHABET) if uniform else single[b] / sum(single.values()) for b in ALPHABET}
        tables.append([math.log((n.get((a, b), 0) + prior * base[b]) / (total[a] + prior)) for a in ALPHABET for b in ALPHABET])
    return [round(x - y, 6) for x, y in zip(*tables, strict=True)]


def likelihood_ratio(token: Column, table: list[float]) -> Column:
    """Sum over a token's transitions; characters outside the alphabet add nothing."""
    ratios = F.split(F.lit(",".join(map(str, table))), ",").cast("array<double>")
    n = len(ALPHABET)

    def code(i: Column) -> Column:
        return F.instr(F.lit(ALPHABET), F.substring(token, i, F.lit(1)))

    def add(total: Column, i: Column) -> Column:
        a, b = code(i), code(i + 1)
        return total + F.when((a > 0) & (b > 0), F.element_at(ratios, (a - 1) * n + b)).otherwise(0.0)

    return F.aggregate(F.sequence(F.lit(1), F.length(token) - 1), F.lit(0.0), add)


def secrets(docs: DataFrame, table: list[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id and spans, an array of (start, place in KINDS, end, kind) in order.

    Patterns count leftmost non-overlapping matches; matches that are too short are dropped after
    matching.  Tokens of 20 characters or more with a letter and a digit, overlapping no pattern's span,
    are added if their ratio exceeds log(ODDS).  A null or empty text has no spans.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    table = train(source) if table is None else table
    text, found = F.col("text"), _matched(source)
    at = {f"s{k}": located(text, p, F.col(f"h{k}")) for k, p in enumerate((ASSIGN, ACCESS, HEX, TOKEN))}
    found = found.withColumns(at).withColumn("s0", F.filter("s0", lambda s, i: F.length(F.element_at("value", i + 1)) >= 6))

    def tagged(column: str, k: int) -> Column:
        return F.transform(column, lambda s: F.struct(s["b"].alias("start"), F.lit(k).alias("place"), s["e"].alias("end"), F.lit(KINDS[k]).alias("kind")))

    found = found.withColumn("base", F.concat(*(tagged(f"s{k}", k) for k in range(3))))

    def suspicious(s: Column) -> Column:
        token = F.substring(text, s["b"] + 1, s["e"] - s["b"])
        free = ~F.exists("base", lambda o: (o["start"] < s["e"]) & (s["b"] < o["end"]))
        return free & token.rlike("[0-9]") & token.rlike("[A-Za-z]") & (likelihood_ratio(token, table) > math.log(ODDS))

    found = found.withColumn("s3", F.when(F.size("s3") > 0, F.filter("s3", suspicious)).otherwise(F.col("s3")))
    return found.select("doc_id", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", tagged("s3", 3))).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts by pattern, hash of the patterns' spans, and all spans as text."""

    def of(place: int):
        return lambda s: s["place"] == place

    count = [F.size(F.filter("base", of(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    return found.select("doc_id", *count, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
