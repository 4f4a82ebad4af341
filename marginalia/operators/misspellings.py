"""S001: misspellings against a frequency dictionary, with guards before it and derived forms behind it.

Guards look at a word's own and neighbouring columns (a window over a document's words), never at the text again.
What is unknown is looked up in rounds: derived forms by a semi-join; then known words one edit away by a join on
forms with one letter left out; and only for words without those, two edits by forms with two letters left out.
An edit is an insertion, a deletion, a replacement or a swap of neighbours.  A form of k letters is shared by words
of at most k + 2 letters that hold it in order, so a key's group is bounded by the alphabet, not by the corpus.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import lexicons as lx

WORD = r"[A-Za-z]+(?:'[A-Za-z]+)?"
SHORTEST, REPEATED, MOST_SUGGESTED = 3, 3, 3
# --- fixed values: broken lines, names, affixes and variants ---
BROKEN = r"^-[ \t]{0,3}\n(?:[ \t]{0,3}\n)?[ \t]{0,3}$"
AUTHOR = r"^,?\s+(?:et\s+al\b|[A-Z]{1,3}(?:[,.;]|\s+[A-Z][a-z])|[A-Z]\.)"
PREFIXES = "non un mis re pre post over under sub co multi inter intra semi pseudo quasi auto hyper hypo anti counter cross self".split()
SUFFIXES = "es s ed d ing ly er est".split()
VARIANTS = [
    ("isation", "ization"), ("ise", "ize"), ("ised", "ized"), ("ising", "izing"), ("yse", "yze"), ("ysed", "yzed"), ("ysing", "yzing"), ("yser", "yzer"),
    ("our", "or"), ("lling", "ling"), ("lled", "led"), ("ller", "ler"), ("ogue", "og"), ("aemia", "emia"), ("oea", "ea"), ("tre", "ter"),
]
FUNCTION_WORDS = (
    "this that these those the and but or nor if is was are were be been being has have had with from for not of to in on at by it its as we you they he "
    "she him her them his our your their than then when which who whom whose what why how would could should will shall may might must do does did done "
    "am us me my mine no so too very can cannot into onto upon about above below over under again further once here there all any both each few more most "
    "other some such only own same"
).split()
LATIN_PHRASES = [
    "ad valorem", "ad hoc", "ad libitum", "ad infinitum", "a priori", "a posteriori", "a fortiori", "per capita", "per se", "per annum", "per diem", "pro rata",
    "pro forma", "pro bono", "de facto", "de jure", "de novo", "ex ante", "ex post", "ex vivo", "ex officio", "in situ", "in vitro", "in vivo", "in silico",
    "in utero", "in toto", "in extremis", "inter alia", "intra vitam", "prima facie", "bona fide", "mutatis mutandis", "ceteris paribus", "status quo",
    "vice versa", "sine qua non", "sui generis", "post hoc", "post mortem", "ante mortem", "ipso facto", "modus operandi", "non sequitur", "quid pro quo",
    "et cetera", "et al", "sensu lato", "sensu stricto", "viva voce", "nota bene", "sic passim", "circa",
]


def _texts(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, i, word, start, end, gap, prev, after, next, g1): each word with the text before it back to the
    word before, and the two words after it with what lies between."""
    parts = F.arrays_zip(F.split(F.col(text_col), WORD, -1).alias("gap"), F.regexp_extract_all(text_col, F.lit(WORD), F.lit(0)).alias("word"))
    rows = docs.select("doc_id", F.posexplode(parts).alias("i", "p")).select("doc_id", "i", "p.gap", "p.word")
    order = Window.partitionBy("doc_id").orderBy("i")
    size = F.length("gap") + F.coalesce(F.length("word"), F.lit(0))
    near = {"end": F.sum(size).over(order).cast("int"), "prev": F.lag("word").over(order), "next": F.lead("word").over(order), "g1": F.lead("gap").over(order), "_g2": F.lead("gap", 2).over(order), "_w2": F.lead("word", 2).over(order)}
    rows = rows.withColumns(near).where("word is not null")
    after = F.concat(*[F.coalesce(c, F.lit("")) for c in ("g1", "next", "_g2", "_w2")])
    return rows.select("doc_id", "i", "word", (F.col("end") - F.length("word")).alias("start"), "end", "gap", "prev", F.left(after, F.lit(40)).alias("after"), "next", "g1")


def variants(word: Column) -> Column:
    """British and American spellings of a word, both ways."""
    tried = [F.when(F.contains(word, F.lit(a)), F.replace(word, F.lit(a), F.lit(b))) for pair in VARIANTS for a, b in (pair, pair[::-1])]
    return F.array_compact(F.array(*tried))


def _stems(word: Column, spared: list[str]) -> Column:
    cut = [F.when(F.endswith(word, F.lit(s)) & (F.length(word) - len(s) >= 3), F.left(word, F.length(word) - len(s))) for s in SUFFIXES]
    stems = F.array_compact(F.array(*cut))
    return F.array_except(stems, _texts(spared)) if spared else stems


def derived(word: Column) -> Column:
    """Forms any of which, if known, makes a word known: itself, what follows a prefix (and its variants; not with
    a letter tripled), what precedes a suffix (function words take none), its variants and what precedes theirs."""
    stem = [F.when(F.startswith(word, F.lit(p)) & (F.length(word) - len(p) >= 4), F.substring(word, len(p) + 1, 1 << 20)) for p in PREFIXES]
    stems = F.when(word.rlike(r"(.)\1\1"), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*stem)))
    twins = variants(word)
    forms = [F.array(word), stems, F.flatten(F.transform(stems, variants)), _stems(word, FUNCTION_WORDS), twins, F.flatten(F.transform(twins, lambda v: _stems(v, [])))]
    return F.array_distinct(F.concat(*forms))


def unknown(found: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of ``found`` (lower) whose word neither the dictionary holds nor a derived form of it."""
    distinct = found.select("lower").distinct()
    forms = distinct.select("lower", F.explode(derived(F.col("lower"))).alias("word")).hint("merge")  # a dictionary grows with its corpus
    return found.join(forms.join(known.select("word").hint("merge"), "word", "left_semi").select("lower").distinct(), "lower", "left_anti")


def _without(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))


def forms(word: Column, edits: int) -> Column:
    """The word with up to ``edits`` letters left out."""
    out = F.array(word)
    last = out
    for _ in range(edits):
        last = F.array_distinct(F.flatten(F.transform(last, _without)))
        out = F.concat(out, last)
    return F.array_distinct(out)


def _swaps(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(word) - 1), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.lit(1)), F.substring(word, i, F.lit(1)), F.substring(word, i + 2, F.length(word))))


def _swap_and_edit(a: Column, b: Column) -> Column:
    """Whether a swap of neighbours and one edit beside them make ``a`` of ``b``."""

    def at(i: Column, d: int) -> Column:
        pair = F.concat(F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)))
        before = F.levenshtein(F.left(a, i - 1), F.left(b, i + d - 1))
        behind = F.levenshtein(F.substring(a, i + 2, F.length(a)), F.substring(b, i + d + 2, F.length(b)))
        return (i + d >= 1) & (F.substring(b, F.greatest(i + d, F.lit(1)), F.lit(2)) == pair) & (before + behind <= 1)

    return F.exists(F.sequence(F.lit(1), F.length(a) - 1), lambda i: at(i, -1) | at(i, 0) | at(i, 1))


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether one edit (or two, not both of the same letters) makes ``a`` of ``b``.  Words have two letters or more."""
    if edits == 1:
        return (F.levenshtein(a, b, 1) >= 0) | F.array_contains(_swaps(a), b)
    return (F.levenshtein(a, b, 2) >= 0) | _swap_and_edit(a, b) | F.arrays_overlap(_swaps(a), _swaps(b))


def suggestions(lost: DataFrame, known: DataFrame) -> DataFrame:
    """(lower, distance, suggested) for the words of ``lost`` (lower): known words at the least distance, at most
    two, the most frequent first, at most three.  Forms are merged, never broadcast: Spark guesses their size from
    the words they are made of, a word of ten letters having 56."""
    lost = lost.select("lower").distinct()
    found = []
    for edits in (1, 2):
        own = lost.select("lower", F.explode(forms(F.col("lower"), edits)).alias("form"))
        theirs = known.select("word", "freq", F.explode(forms(F.col("word"), edits)).alias("form"))
        pairs = own.hint("merge").join(theirs.hint("merge"), "form").select("lower", "word", "freq").distinct().where(within(F.col("lower"), F.col("word"), edits))
        ranked = pairs.withColumn("r", F.row_number().over(Window.partitionBy("lower").orderBy(F.desc("freq"), "word"))).where(F.col("r") <= MOST_SUGGESTED)
        best = ranked.groupBy("lower").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "word"))), lambda x: x["word"]).alias("suggested")).withColumn("distance", F.lit(edits))
        found.append(best)
        lost = lost.join(best.select("lower"), "lower", "left_anti")
    return reduce(DataFrame.unionByName, found).select("lower", "distance", "suggested")


def checked_words(docs: DataFrame, text_col: str = "text", terms: DataFrame | None = None, latin: bool = True, tails: bool = True) -> DataFrame:
    """Words that the guards leave to the dictionary, with ``lower`` and, for halves of a word broken at a line
    end, ``joined``.  With ``tails`` what follows a word and a full stop without a blank is part of an address too."""
    rows = words(docs, text_col)
    lower = F.lower("word")
    times = F.count("*").over(Window.partitionBy("doc_id", "lower"))
    rows = rows.withColumn("lower", lower).withColumn("times", times)
    half = F.coalesce(F.col("gap").rlike(BROKEN) & (F.length("gap") <= 11) & F.col("prev").isNotNull(), F.lit(False))
    follows = F.coalesce(F.col("g1").rlike(BROKEN) & F.col("next").rlike(r"^[a-z]+(?:'|$)"), F.lit(False))
    joined = F.when(follows, F.concat("word", F.regexp_extract("next", r"^[a-z]+", 0)))
    edge, nxt = F.right("gap", F.lit(1)), F.left(F.coalesce("g1", F.lit("")), F.lit(1))
    address = edge.isin(*"@/_-") | nxt.isin(*"@/_") | F.coalesce(F.col("g1").startswith("://"), F.lit(False)) | F.coalesce((F.col("g1") == ".") & F.col("next").isNotNull(), F.lit(False))
    address = address | ((F.col("gap") == ".") & F.col("prev").isNotNull()) if tails else address
    phrases = _texts(LATIN_PHRASES)
    beside = F.coalesce(F.array_contains(phrases, F.concat_ws(" ", F.lower("prev"), "lower")) & F.col("gap").rlike(r"^[\s-]+$"), F.lit(False)) | F.coalesce(F.array_contains(phrases, F.concat_ws(" ", "lower", F.lower("next"))) & F.col("g1").rlike(r"^[\s-]+$"), F.lit(False))
    capital = F.col("word").rlike("^[A-Z]")
    bare = F.regexp_replace("gap", r"[ \t]+$", "")
    starts = F.when(bare == "", F.col("prev").isNull()).otherwise(F.right(bare, F.lit(1)).isin(".", "!", "?", "\n"))
    fine = (
        (F.length("word") >= SHORTEST)
        & F.col("word").rlike("[a-z]")
        & ~F.upper("word").isin(lx.ACRONYMS_ALLOWED)
        & (F.col("times") < REPEATED)
        & ~address
        & ~((nxt == "-") & F.col("lower").isin(PREFIXES))
        & ~(capital & (~starts | F.col("after").rlike(AUTHOR)))
    )
    fine = fine & ~beside if latin else fine
    rows = rows.where(~F.contains("word", F.lit("'")) & ~half).withColumns({"joined": joined, "fine": fine, "capital": capital})
    rows = rows.where("fine or joined is not null")
    return rows if terms is None else rows.join(terms.select(F.lower("term").alias("lower")).distinct(), "lower", "left_anti")


def misspellings(docs: DataFrame, known: DataFrame, terms: DataFrame | None = None, text_col: str = "text", tails: bool = True) -> DataFrame:
    """S001 findings: (doc_id, rule_id, start, end, text, replacement, suggested).

    ``known``: word, freq; ``terms``: a user's and a field's own words (term).  A word broken at a line end is
    judged whole, on its first half: if it is known, joining it is the finding.  A capitalised word that opens a
    sentence is only reported with a suggestion one edit away, as it may be a name.  Null and empty texts have no
    words.  Dictionary words are lower-case."""
    rows = checked_words(docs, text_col, terms, tails=tails)
    whole = rows.where("joined is not null").select("doc_id", "i", F.lower("joined").alias("lower"))
    lost_whole = unknown(whole, known).select("doc_id", "i")
    parts = rows.join(lost_whole.withColumn("_lost", F.lit(True)), ["doc_id", "i"], "left")
    mended = parts.where("joined is not null and _lost is null")
    tail = F.length("g1") + F.length("joined") - F.length("word")
    mended = mended.select("doc_id", "start", (F.col("end") + tail).alias("end"), F.concat("word", "g1", F.substring("joined", F.length("word") + 1, F.length("joined"))).alias("text"), F.col("joined").alias("replacement"), F.array("joined").alias("suggested"))
    single = unknown(parts.where("fine and (joined is null or _lost)"), known)
    single = single.join(suggestions(single, known), "lower", "left").where("not capital or distance = 1")
    cased = F.transform("suggested", lambda s: F.when(F.col("capital"), F.concat(F.upper(F.left(s, F.lit(1))), F.substring(s, F.lit(2), F.length(s)))).otherwise(s))
    single = single.select("doc_id", "start", "end", F.col("word").alias("text"), F.try_element_at(cased, F.lit(1)).alias("replacement"), F.coalesce(cased, F.array().cast("array<string>")).alias("suggested"))
    return mended.unionByName(single).select("doc_id", F.lit("S001").alias("rule_id"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "text", "replacement", "suggested")
