"""Text functions as column expressions: matches with offsets, sentences, tokens, masking.

Offsets are code points, begin inclusive, end exclusive.  Patterns must not match the empty text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,text:string>>"
SENTENCE_GAP = r"[.!?]\s+"
#: Elements that one fold adds up.
RUN = 32


def any_of(phrases: Iterable[str]) -> str:
    """One alternation of literal phrases between word borders, the longest first."""
    quoted = ["".join("\\" + c if c in r".^$*+?()[]{}|\-/" and c != "/" else c for c in p) for p in sorted(phrases, key=lambda p: (-len(p), p))]
    return rf"\b(?:{'|'.join(quoted)})\b"


def by_letter(phrases: Iterable[str]) -> str:
    """One alternation of literal phrases that begin with ASCII letters, the longest first, for reading with ``(?i)``: they
    stand by first letter, so that at a place only those of its letter are tried."""
    groups: dict[str, list[str]] = {}
    for p in sorted(phrases, key=lambda p: (-len(p), p)):
        groups.setdefault(p[0].lower(), []).append("".join("\\" + c if c in r".^$*+?()[]{}|\-" else c for c in p[1:]))
    return rf"(?=[{''.join(sorted(groups))}])(?:{'|'.join(f'{c}(?:{chr(124).join(rest)})' for c, rest in sorted(groups.items()))})"


def led_any_of(phrases: Iterable[str]) -> str:
    """Matches as ``any_of`` does, in less time."""
    letters, rest = by_letter(phrases).split(")", 1)
    return rf"{letters})\b{rest}\b"


def either(patterns: Iterable[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def either_word(patterns: Iterable[str]) -> str:
    """``either``, but the word border that many patterns begin with is looked for once, not once a pattern."""
    led, rest = [], []
    for p in patterns:
        depth = [len(re.findall(r"(?<!\\)\(", p[:i])) - len(re.findall(r"(?<!\\)\)", p[:i])) for i, c in enumerate(p) if c == "|"]
        (led if p.startswith(r"\b") and 0 not in depth else rest).append(p)
    return either([rf"\b(?:{either(p[2:] for p in led)})", *rest]) if led else either(rest)


RUN_OF_LETTERS = "[A-Za-z]+"


def cue_words(phrases: Iterable[str]) -> list[str]:
    """Of each phrase the longest run of letters: where a phrase stands between word borders, so does that run."""
    return sorted({max(re.findall(RUN_OF_LETTERS, p.lower()), key=len) for p in phrases})


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often lambdas inside refer to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _sums(items: Column) -> Column:
    """One fold: the sum of all, and those before each element.  Appending is quadratic, so only for short arrays."""

    def add(state: Column, n: Column) -> Column:
        return F.struct((state["at"] + n).alias("at"), F.array_append(state["out"], state["at"]).alias("out"))

    return F.aggregate(items, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), add)


def offsets(lengths: Column, levels: int = 3) -> Column:
    """Sums of the lengths before each element.  They add up in runs of RUN, then over runs of runs, so the work is
    nearly linear, where one fold that appends to an array is quadratic."""

    def spread(runs: Column) -> Column:
        begins = offsets(F.transform(runs, lambda r: r["at"]), levels - 1)
        return F.flatten(F.zip_with(runs, begins, lambda r, b: F.transform(r["out"], lambda x: x + b)))

    def cut(items: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(RUN))
        return once(F.transform(starts, lambda k: _sums(F.slice(items, k, RUN))), spread)

    if levels == 1:
        return _sums(lengths)["out"]
    return once(lengths, lambda items: F.when(F.size(items) <= RUN, _sums(items)["out"]).otherwise(cut(items)))


def spans_of(gaps: Column, hits: Column) -> Column:
    """Matches with their places, from the texts between and the matches themselves."""

    def placed(z: Column) -> Column:
        def one(h: Column, i: Column) -> Column:
            begin = F.element_at(z["at"], i + 1) + F.element_at(z["gap"], i + 1)
            return F.struct(begin.alias("start"), (begin + F.length(h)).alias("end"), h.alias("text"))

        return F.transform(z["hits"], one)

    gap = F.transform(hits, lambda h, i: F.length(F.element_at(gaps, i + 1)))
    whole = F.transform(hits, lambda h, i: F.length(F.element_at(gaps, i + 1)) + F.length(h))
    return once(F.struct(gap.alias("gap"), offsets(whole).alias("at"), hits.alias("hits")), placed)


def matches(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches with their places; null texts have none."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return once(found, lambda hits: F.when(F.size(hits) > 0, once(F.split(text, pattern, -1), lambda gaps: spans_of(gaps, hits))).otherwise(F.array().cast(SPAN)))


def ends_of(gaps: Column, hits: Column, at: Column) -> Column:
    """Where some of the matches end, those at the places ``at`` (from 0, rising; -1 is the begin of the text), in time
    linear in the text: lengths between two chosen ones are taken as one."""

    def between(texts: Column, i: Column, last: Column) -> Column:
        return F.length(F.array_join(F.slice(texts, last + 2, i - last), ""))

    def lengths(picked: Column) -> Column:
        last = F.concat(F.array(F.lit(-1)), F.slice(picked, F.lit(1), F.greatest(F.size(picked) - 1, F.lit(0))))
        n = F.zip_with(picked, last, lambda i, p: between(gaps, i, p) + between(hits, i, p))
        return once(n, lambda n: F.zip_with(n, offsets(n), lambda a, b: a + b))

    return F.when(F.size(at) > 0, once(at, lengths)).otherwise(F.array().cast("array<int>"))


def dense_matches(docs: DataFrame, pattern: str, text_col: str = "text") -> DataFrame:
    """(doc_id, i, start, end, text) of all matches, for patterns that match at every turn: places are
    running sums over rows, in time linear in the text, where ``matches`` appends to an array."""
    text = F.col(text_col)
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    rows = docs.select("doc_id", F.posexplode(parts).alias("i", "p")).where("p.hit is not null").select("doc_id", "i", (F.length("p.gap") + F.length("p.hit")).alias("n"), F.col("p.hit").alias("text"))
    end = F.sum("n").over(Window.partitionBy("doc_id").orderBy("i")).cast("int")
    return rows.withColumn("end", end).select("doc_id", "i", (F.col("end") - F.length("text")).alias("start"), "end", "text")


def settled(df: DataFrame, *columns: Column) -> DataFrame:
    """Adds columns that later lambdas refer to: computed once a row, not once an element."""
    return df.withColumn("_s", F.explode(F.array(F.struct(*columns)))).select(*df.columns, "_s.*")


def sentence_array(text: Column) -> Column:
    """Texts of sentences: a break is the white space after a full stop, question or exclamation mark."""
    return F.split(text, r"(?<=[.!?])\s+")


def sentence_spans(text: Column) -> Column:
    """Sentences with their places, in order; blank ones stay, so that numbers count from the text."""
    gaps = F.regexp_extract_all(text, F.lit(SENTENCE_GAP), F.lit(0))

    def whole(z: Column) -> Column:
        lengths = F.zip_with(z["bodies"], z["gaps"], lambda b, g: F.length(b) + F.coalesce(F.length(g), F.lit(0)))
        return once(F.struct(z["bodies"].alias("bodies"), z["gaps"].alias("gaps"), offsets(lengths).alias("at")), placed)

    def placed(z: Column) -> Column:
        def one(body: Column, i: Column) -> Column:
            own = F.concat(body, F.coalesce(F.left(F.try_element_at(z["gaps"], i + 1), F.lit(1)), F.lit("")))
            begin = F.element_at(z["at"], i + 1)
            return F.struct(begin.alias("start"), (begin + F.length(own)).alias("end"), own.alias("text"))

        return F.transform(z["bodies"], one)

    return once(F.struct(F.split(text, SENTENCE_GAP, -1).alias("bodies"), gaps.alias("gaps")), whole)


WORD = r"[A-Za-z0-9\x{80}-\x{10FFFF}]+(?:['’-][A-Za-z0-9\x{80}-\x{10FFFF}]+)*"


def words(text: Column) -> Column:
    """Tokens of letters, digits and inner apostrophes or hyphens."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def space_tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def mask_matches(text: Column, pattern: str) -> Column:
    """The text with every match blanked, line feeds and length kept."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    blank = F.transform(hits, lambda h: F.regexp_replace(h, r"[^\n]", " "))
    parts = F.zip_with(gaps, blank, lambda g, b: F.concat(g, F.coalesce(b, F.lit(""))))
    return F.when(F.size(hits) > 0, F.array_join(parts, "")).otherwise(text)


def mask_spans(text: Column, spans: Column) -> Column:
    """The text with spans (start, end) blanked; they may overlap and come in any order."""

    def step(state: Column, s: Column) -> Column:
        begin, end = F.greatest(s["start"], state["at"]), F.greatest(s["end"], state["at"])
        before = F.substring(text, state["at"] + 1, begin - state["at"])
        hidden = F.regexp_replace(F.substring(text, begin + 1, end - begin), r"[^\n]", " ")
        return F.struct(end.alias("at"), F.concat(state["out"], before, hidden).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(F.array_sort(spans), start, step)
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))


def line_of(text: Column, at: Column) -> Column:
    """1-based line of an offset."""
    before = F.substring(text, F.lit(1), at)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"))) + 1


def column_of(text: Column, at: Column) -> Column:
    """1-based column of an offset."""
    return F.length(F.substring_index(F.substring(text, F.lit(1), at), "\n", -1)) + 1


def utf16_offset(text: Column, at: Column) -> Column:
    return (F.octet_length(F.encode(F.substring(text, F.lit(1), at), "UTF-16LE")) / 2).cast("int")


def squeezed(text: Column, most: int = 180) -> Column:
    """White space collapsed; longer texts cut with an ellipsis."""
    one = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(one) > most, F.concat(F.left(one, F.lit(most - 1)), F.lit("…"))).otherwise(one)


def fingerprint(*parts: Column) -> Column:
    return F.sha1(F.concat_ws("\x1f", *[p.cast("string") for p in parts]))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """95 % interval of a share; (0, 0) where n is 0."""
    p = hits / n
    centre, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    low, high = F.greatest(F.lit(0.0), (centre - spread) / scale), F.least(F.lit(1.0), (centre + spread) / scale)
    return F.when(n > 0, low).otherwise(0.0), F.when(n > 0, high).otherwise(0.0)


def rate(part: Column, whole: Column, per: float, digits: int = 1) -> Column:
    return F.when(whole > 0, F.round(part * per / whole, digits)).otherwise(0.0)
