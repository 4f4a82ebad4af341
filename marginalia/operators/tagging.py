"""Parts of speech: a seam for taggers, a small tagger trained from a supplied sample, and the two rules that
rest on tags (G101, G107).

A tagger is either a function of a column (tokens to tags, both arrays of strings), which stays in the engine, or a
function of a batch (lists of tokens to lists of tags), which Arrow feeds.  Tags are universal ones: NOUN, PROPN,
PRON, VERB, AUX, ADJ, ADP, ADV, DET, NUM, CCONJ, PUNCT, X.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import matches, settled
from marginalia.operators.rules import sentences

TOKEN = r"[A-Za-z\x{80}-\x{10FFFF}]+(?:['’-][A-Za-z\x{80}-\x{10FFFF}]+)*|\d+(?:[.,]\d+)*|\S"
LETTERS = r"^[A-Za-z\x{80}-\x{10FFFF}]+$"
Batch = Callable[[list[list[str]]], list[list[str]]]
MOST_SENTENCES = 20_000  # of a sample, for fitting
SUFFIX = 3


def sentence_tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, sent, tokens): sentences as arrays of (start, end, text), places in the document."""
    rows = sentences(docs)
    own = F.transform(matches(F.col("text"), TOKEN), lambda m: F.struct((F.col("start") + m["start"]).alias("start"), (F.col("start") + m["end"]).alias("end"), m["text"].alias("text")))
    return rows.select("doc_id", "sent", own.alias("tokens")).where(F.size("tokens") > 0)


def sentence_words(docs: DataFrame) -> DataFrame:
    """(doc_id, sent, start, text, words): sentences as arrays of token texts, which lie where ``sentence_tokens`` has them.
    Places are worked out for findings only."""
    rows = sentences(docs).select("doc_id", "sent", "start", "text")
    return settled(rows, F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)).alias("words")).where(F.size("words") > 0)


def tagged(rows: DataFrame, tagger: Callable[[Column], Column] | None = None, batch: Batch | None = None) -> DataFrame:
    """``rows`` (doc_id, sent, tokens) with ``tags``, one a token; or (doc_id, sent, start, text, words)."""
    texts = F.col("words") if "words" in rows.columns else F.transform("tokens", lambda t: t["text"])
    if tagger is not None:
        return settled(rows, tagger(texts).alias("tags"))
    plain = rows.withColumn("words", texts)
    keys = plain.select("doc_id", "sent", "words")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            tags = batch([list(w) for w in frame["words"]])
            yield pd.DataFrame({"doc_id": frame["doc_id"], "sent": frame["sent"], "tags": tags})

    found = keys.mapInPandas(run, "doc_id long, sent int, tags array<string>")
    return rows.join(found, ["doc_id", "sent"])


def train(sample: DataFrame, most: int = MOST_SENTENCES) -> Batch:
    """A tagger from ``sample`` (words, tags: arrays of one length): the best path under tag pairs and words, unknown
    words by their last letters and whether they are capitalised.  At most ``most`` sentences are used (the first by a
    hash of the row); counts are made in Spark, by form, so what is gathered is bounded by the forms of the sample."""
    some = sample.where(F.size("words") == F.size("tags")).orderBy(F.xxhash64("words", "tags")).limit(most)
    pairs = some.select(F.explode(F.transform(F.arrays_zip("words", "tags"), lambda z, i: F.struct(z["words"].alias("w"), z["tags"].alias("t"), F.when(i > 0, F.try_element_at("tags", i)).otherwise("<s>").alias("p")))).alias("x")).select("x.*")
    shape = F.concat(F.when(F.col("w").rlike("^[A-Z]"), "A").otherwise("a"), F.lower(F.right("w", F.lit(SUFFIX))))
    counts = {k: {} for k in ("word", "shape", "pair")}
    for kind, key, tag in (("word", F.lower("w"), "t"), ("shape", shape, "t"), ("pair", F.col("p"), "t")):
        for r in pairs.groupBy(key.alias("k"), F.col(tag).alias("t")).count().toLocalIterator():
            counts[kind].setdefault(r["k"], {})[r["t"]] = r["count"]
    return lambda batch: [_path(words, counts) for words in batch]


def _share(found: dict[str, int] | None, tag: str, every: int) -> float:
    return math.log(((found or {}).get(tag, 0) + 0.1) / (sum((found or {}).values()) + 0.1 * every))


def _path(words: list[str], counts: dict[str, dict]) -> list[str]:
    """The likeliest tags of a sentence."""
    tags = sorted({t for c in counts["pair"].values() for t in c})
    best = {"<s>": (0.0, ())}
    for w in words:
        known = counts["word"].get(w.lower())
        found = known or counts["shape"].get(("A" if w[:1].isupper() else "a") + w[-SUFFIX:].lower())
        step = {t: _share(found, t, len(tags)) for t in tags}
        best = {t: max((score + _share(counts["pair"].get(p), t, len(tags)) + step[t], way + (t,)) for p, (score, way) in best.items()) for t in tags}
    return list(max(best.values())[1]) if words else []


def _texts(rows: DataFrame) -> Column:
    return F.col("words") if "words" in rows.columns else F.transform("tokens", lambda t: t["text"])


def _ends(rows: DataFrame, first: Column, last: Column) -> tuple[Column, Column]:
    """Where the token ``first`` starts and the token ``last`` ends."""
    if "words" not in rows.columns:
        return F.element_at("tokens", first + 1)["start"], F.element_at("tokens", last + 1)["end"]

    def upto(i: Column) -> Column:
        before = F.array_join(F.slice(F.split("text", TOKEN, -1), F.lit(1), i + 1), "")
        return F.col("start") + F.length(before) + F.length(F.array_join(F.slice("words", F.lit(1), i), ""))

    return upto(first), upto(last) + F.length(F.element_at("words", last + 1))


def noun_strings(rows: DataFrame, least: int = 4) -> DataFrame:
    """G107: runs of ``least`` nouns or more, over (doc_id, sent, tokens, tags): one finding for each wording of a
    document, at its first use, with the number of uses.

    A sentence's tags become a text of one letter a token, in which runs are matches.  Runs of two proper nouns or more, with
    a token that is short or not of letters, or of "et al." are names and fragments.  Wordings are compared in lower case,
    without a plural s."""
    texts = _texts(rows)

    def letter(t: Column, w: Column) -> Column:
        odd = (F.length(w) < 3) | ~w.rlike(LETTERS) | F.lower(w).isin("et", "al")
        return F.when(t.isin("NOUN", "PROPN"), F.when(odd, "x").when(t == "PROPN", "P").otherwise("N")).otherwise(" ")

    # a plain noun run may be long, a token that is odd spoils the whole run
    coded = settled(rows, F.array_join(F.zip_with("tags", texts, letter), "").alias("_code"))
    coded = coded.where(F.col("_code").rlike(f"[NP]{{{least}}}"))
    runs = F.filter(matches(F.col("_code"), f"[NPx]{{{least},}}"), lambda m: ~F.contains(m["text"], F.lit("x")) & ~m["text"].rlike("P.*P"))

    def one(m: Column) -> Column:
        lemmas = F.transform(F.slice(texts, m["start"] + 1, m["end"] - m["start"]), lambda w: F.regexp_replace(F.lower(w), r"(?<=[^s])s$", ""))
        start, end = _ends(rows, m["start"], m["end"] - 1)
        return F.struct(start.alias("start"), end.alias("end"), F.array_join(lemmas, " ").alias("lemmas"))

    kept = coded.select("doc_id", F.explode(F.transform(runs, one)).alias("r")).select("doc_id", "r.*")
    uses = kept.groupBy("doc_id", "lemmas").agg(F.min(F.struct("start", "end")).alias("s"), F.count("*").alias("uses"))
    return uses.select("doc_id", F.lit("G107").alias("rule_id"), "s.start", "s.end", F.col("lemmas").alias("text"), "uses")


#: Openers of asides, what closes them, and words that open a clause.
ASIDES = {",": ",", "—": "—", "–": "–", "(": ")", "[": "]"}
RELATIVES = ["which", "that", "who", "whom", "whose"]
#: What a sentence with one of them holds.
OPENING = r"[,—–(\[]|(?i:which|that|who)"


def separated_verbs(rows: DataFrame, gap: int = 10, weak_gap: int = 15) -> DataFrame:
    """G101: subject and verb held apart by an aside, over (doc_id, sent, tokens, tags).

    Without a parser: the subject is the last noun or pronoun before the first opener, with no verb before it; the
    opener is a comma, dash or bracket (an aside) or a relative word (part of the subject, so it needs the longer
    gap); the verb is the first one after the aside closes, or the second after a relative word.  Brackets of fewer
    than three words, and commas around nothing but nouns (lists), hold nothing apart.  The gap counts words."""
    rows = rows.where(F.col("text").rlike(OPENING)) if "words" in rows.columns else rows
    x = F.zip_with(_texts(rows), F.transform("tags", lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda w, t: F.struct(F.lower(w).alias("w"), t["t"].alias("t"), t["i"].alias("i")))
    r = settled(rows, x.alias("_x"))

    def first(test) -> Column:
        return F.try_element_at(F.filter("_x", test), F.lit(1))["i"]

    def verb(x: Column) -> Column:
        return x["t"].isin("VERB", "AUX")

    def noun(x: Column) -> Column:
        return x["t"].isin("NOUN", "PROPN", "PRON") & ~x["w"].isin(RELATIVES)

    r = settled(r, first(lambda x: (x["i"] > 0) & x["w"].isin(*ASIDES, *RELATIVES)).alias("_o")).where("_o is not null")
    subject = F.try_element_at(F.filter("_x", lambda x: noun(x) & (x["i"] < F.col("_o"))), F.lit(-1))["i"]
    spoken = F.exists("_x", lambda x: verb(x) & (x["i"] < F.col("_o")))
    r = settled(r, subject.alias("_subject"), spoken.alias("_spoken"), F.element_at("_x", F.col("_o") + 1)["w"].alias("_w")).where("_subject is not null and not _spoken")
    closing = F.lit(None).cast("string")
    for opener, close in ASIDES.items():
        closing = F.when(F.col("_w") == opener, close).otherwise(closing)
    r = settled(r, closing.alias("_closing"), F.col("_w").isin(RELATIVES).alias("_weak"))
    r = settled(r, first(lambda x: (x["i"] > F.col("_o")) & (x["w"] == F.col("_closing"))).alias("_c")).where("_weak or _c is not null")
    r = settled(r, F.filter("_x", lambda x: (x["i"] > F.col("_o")) & (x["i"] < F.col("_c"))).alias("_aside"))
    bracket = F.size(F.filter("_aside", lambda x: x["w"].rlike(LETTERS))) >= 3
    phrase = F.exists("_aside", lambda x: x["t"].isin("VERB", "AUX", "ADP", "PRON", "ADV"))
    r = r.where(F.col("_weak") | F.when(F.col("_w").isin("(", "["), bracket).when(F.col("_w") == ",", phrase).otherwise(True))
    after = F.filter("_x", lambda x: verb(x) & (x["i"] > F.when(F.col("_weak"), F.col("_o")).otherwise(F.col("_c"))))
    r = settled(r, F.try_element_at(after, F.when(F.col("_weak"), 2).otherwise(1))["i"].alias("_v")).where("_v is not null")
    between = F.size(F.filter("_x", lambda x: (x["i"] > F.col("_subject")) & (x["i"] < F.col("_v")) & x["w"].rlike(r"[A-Za-z0-9\x{80}-\x{10FFFF}]") & (x["t"] != "PUNCT")))
    r = settled(r, between.alias("_n")).where(F.col("_n") >= F.when(F.col("_weak"), weak_gap).otherwise(gap))
    start, end = _ends(rows, F.col("_subject"), F.col("_v"))
    s, v = F.element_at(_texts(rows), F.col("_subject") + 1), F.element_at(_texts(rows), F.col("_v") + 1)
    return r.select("doc_id", F.lit("G101").alias("rule_id"), start.alias("start"), end.alias("end"), F.concat(s, F.lit(" … "), v).alias("text"), F.col("_n").alias("words"))
