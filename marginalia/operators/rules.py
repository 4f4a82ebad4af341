"""Checks as DataFrame operators: documents in, findings out.

A rule is a row of ``RULES``; pattern rules are one alternation each and run together in one scan.  A
finding has doc_id, rule_id, start, end, text, replacement.  Rules need no parser; those for which the
original notion needs parts of speech are lexical approximations and say so in ``grade``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions import lexicons as lx
from marginalia.functions.text import SENTENCE_GAP, WORD, any_of, by_letter, cue_words, dense_matches, either, either_word, ends_of, led_any_of, matches, once, sentence_spans, settled, spans_of, words
from marginalia.operators.sections import SECTIONS, section_in, with_sections

FINDING = ["doc_id", "rule_id", "start", "end", "text", "replacement"]
CLAIM_SECTIONS = ["abstract", "results", "discussion", "conclusion", "limitations"]


@dataclass(frozen=True)
class Rule:
    rule_id: str
    name: str
    category: str
    pattern: str | None = None  # a pattern rule; others have an operator of their own
    replacements: dict[str, str] | None = None
    scope: str = "sentence"
    tier: str = "craft"
    fix: str = "none"
    only: list[str] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)
    aggregate: bool = False
    grade: str = "exact"
    by_sentence: bool = False  # at most one finding a sentence, the first


def _ci(pattern: str) -> str:
    return f"(?i){pattern}"


RULES: list[Rule] = [
    Rule("W201", "grand-word", "improvement", _ci(any_of(lx.GRAND_WORDS)), lx.GRAND_WORDS, fix="safe", grade="verbs by the word before"),
    Rule("W202", "wordy-phrase", "improvement", _ci(any_of(lx.WORDY_PHRASES)), lx.WORDY_PHRASES, fix="safe"),
    Rule("W203", "hype", "convention", _ci(any_of(lx.HYPE_WORDS))),
    Rule("W204", "intensifier", "preference", _ci(any_of(lx.INTENSIFIERS))),
    Rule("W205", "filler", "improvement", _ci(any_of(lx.FILLER_PHRASES)), dict.fromkeys(lx.FILLER_PHRASES, ""), fix="safe"),
    Rule("W206", "redundant-pair", "improvement", _ci(any_of(lx.REDUNDANT_PAIRS)), lx.REDUNDANT_PAIRS, fix="safe"),
    Rule("W207", "doubled-word", "correction", fix="safe"),
    Rule("W208", "contraction", "convention", _ci(any_of(lx.CONTRACTIONS))),
    Rule("W209", "in-terms-of", "preference", _ci(r"\bin terms of\b")),
    Rule("W210", "variant-consistency", "convention"),
    Rule("W211", "compound-two-ways", "convention", scope="document"),
    Rule("C301", "hedge-stack", "improvement", grade="no clause guard"),
    Rule("C302", "overclaim", "convention", _ci(either(lx.OVERCLAIMS)), only=[*CLAIM_SECTIONS, "introduction"]),
    Rule("C303", "causal-phrase", "convention", _ci(either([*lx.CAUSAL_PHRASES, lx.CAUSAL_FORMS])), only=CLAIM_SECTIONS, grade="no part-of-speech guard"),
    Rule("C304", "bare-significant", "convention", _ci(r"\bsignificant(?:ly)?\b"), only=CLAIM_SECTIONS, aggregate=True),
    Rule("C305", "assertive-adverb", "convention", _ci(either(lx.ASSERTIVES)), aggregate=True),
    Rule("G102", "buried-action", "improvement", fix="safe", grade="lexical"),
    Rule("G103", "nominalization-density", "improvement", grade="no part-of-speech guard"),
    Rule("G104", "passive-with-agent", "convention", r"\b(?:is|are|was|were|been|be) [a-z]+ed by [A-Z][a-z]+", excluded=["methods", "appendix"], grade="lexical"),
    Rule("G105", "expletive-opener", "improvement", by_sentence=True),
    Rule("G106", "overlong-sentence", "improvement"),
    Rule("G108", "weak-stress-position", "improvement", by_sentence=True),
    Rule("E701", "empty-phrase", "convention", _ci(any_of(lx.EMPTY_PHRASES)), aggregate=True),
    Rule("E702", "adversative-run", "improvement"),
    Rule("E703", "naked-this", "improvement", grade="no part-of-speech guard"),
    Rule("E704", "uncited-consensus", "convention", aggregate=True, by_sentence=True),
    Rule("E705", "absolute-novelty", "convention", aggregate=True, by_sentence=True),
    Rule("E706", "missing-comparator", "convention", _ci(r"\brelatively\b"), aggregate=True),
    Rule("E707", "display-first-opener", "improvement", only=["results"], aggregate=True, by_sentence=True),
    Rule("AB801", "vague-forward-reference", "convention", _ci(lx.ABSTRACT_VAGUE), only=["abstract"], aggregate=True),
    Rule("AB802", "abstract-completeness", "improvement", scope="document", only=["abstract"]),
    Rule("L901", "serial-summary-opener", "improvement", _ci(either(lx.SERIAL_SUMMARY)), aggregate=True),
    Rule("D902", "missing-niche-signal", "improvement", scope="document"),
    Rule("F601", "acronym-undefined", "convention", scope="document"),
    Rule("F612", "abbreviation-defined-twice", "convention", scope="document"),
    Rule("F613", "abbreviation-rarely-used", "preference", scope="document"),
    Rule("N101", "number-unit-spacing", "convention", scope="document"),
    Rule("N102", "sentence-starts-with-numeral", "convention", grade="no verb guard"),
    Rule("X101", "float-not-cited", "convention", scope="document"),
    Rule("X102", "cited-out-of-order", "convention", scope="document"),
    Rule("X103", "broken-cross-reference", "correction", scope="document"),
    Rule("X202", "caption-too-short", "improvement", scope="document"),
    Rule("X301", "equation-not-referenced", "preference", scope="document"),
    Rule("X302", "equation-not-in-sentence", "convention"),
    Rule("S001", "spelling", "correction", tier="spelling", fix="safe"),
    Rule("LT001", "grammar", "correction", tier="grammar", grade="off: needs an external checker"),
    Rule("GEC001", "learned-correction", "correction", tier="gec", grade="off until a backend is given"),
]
BY_ID = {r.rule_id: r for r in RULES}


_MADE = ["reduce", "increase", "decrease", "improve", "raise"]
#: Small runs of ASCII letters one of which every match of a rule holds between other characters.
CUES: dict[str, list[str]] = {
    "W201": cue_words(lx.GRAND_WORDS), "W202": cue_words(lx.WORDY_PHRASES), "W203": cue_words(lx.HYPE_WORDS), "W204": cue_words(lx.INTENSIFIERS),
    "W205": cue_words(lx.FILLER_PHRASES), "W206": cue_words(lx.REDUNDANT_PAIRS), "W208": cue_words(lx.CONTRACTIONS), "W209": ["terms"],
    "W210": cue_words(w for p in lx.VARIANT_PAIRS for w in p), "G102": cue_words(lx.NOMINAL_VERBS), "G104": ["by"], "E701": cue_words(lx.EMPTY_PHRASES), "E706": ["relatively"],
    "C302": "prove proves proved proven conclusively definitively unambiguously doubt undoubtedly establishes".split(),
    "C303": [*(f + e for f in ("lead", "result", "prevent", "protect", "affect", "impact", "avert", "lower", "worsen") for e in ("", "s", "ed")),
             *(f + e for f in ("cause", "mitigate", "drive", *_MADE) for e in ("", "s", "d")), "led", "drove"],
    "C304": ["significant", "significantly"], "C305": "clearly obviously course evidently clear obvious".split(),
    "AB801": "discussed presented explored described reported examined".split(), "L901": ["there", "much", "many"],
    "C301": lx.HEDGES, "E702": "however nevertheless nonetheless yet hand conversely".split(), "E703": ["this"],
    "E704": "known considered believed thought recognized recognised regarded assumed".split(), "E705": "been study studies work research".split(),
    "E707": "figure fig table supplementary".split(), "G105": ["there", "it"], "G108": ["according", "as", "in"],
}
#: The bit of ``cues`` that says a rule may match, and the bits of every word.
_BITS = {r: 1 << k for k, r in enumerate(CUES)}
_CUE_BITS = {w: sum(_BITS[r] for r, words in CUES.items() if w in words) for w in sorted({w for words in CUES.values() for w in words})}
COMPOUNDS = "array<struct<start:int,w:string,w2:string>>"


def _words_of(text: str | None) -> tuple[int, list[tuple[int, str, str | None]]]:
    """Of one text the cues of its words, by bit, and the words that may belong to compounds written two ways: (start, small
    word, the word behind one blank), where a run of six letters or more also stands as two runs on end."""
    runs = " ".join(re.findall("[A-Za-z]+", text or "")).lower().split(" ")
    own, bits = set(runs), 0
    for w in own & _CUE_BITS.keys():
        bits |= _CUE_BITS[w]
    if "-" in (text or "") and re.search("[A-Za-z]-[A-Za-z]", text):
        two = {a + b for a, b in zip(runs, runs[1:])}
    else:
        two = {a + b for a, b in zip(runs, runs[1:]) if len(a) > 2 and len(b) > 2}
    known = {w for w in two & own if len(w) >= 6}
    if not known:
        return bits, []
    tokens = [(m.start(), m.end(), m.group().rstrip(" ").lower()) for m in re.finditer("[A-Za-z]+(?:-[A-Za-z]+)? ?", text)]
    found = []
    for k, (start, end, w) in enumerate(tokens):
        after = tokens[k + 1][2] if end == start + len(w) + 1 and k + 1 < len(tokens) and tokens[k + 1][0] == end else None
        if w.replace("-", "") in known or (after is not None and w + after in known):
            found.append((start, w, after))
    return bits, found


def _read_words(texts: pd.Series) -> pd.DataFrame:
    read = [_words_of(t) for t in texts]
    return pd.DataFrame({"cues": [bits for bits, _ in read], **{n: [[f[k] for f in found] for _, found in read] for k, n in enumerate(("starts", "w", "w2"))}})


def with_cues(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds cues: the rules of ``CUES`` (by bit) a word of which a text has, so that most rules need not scan it;
    compounds: its words that may be written two ways, with their places; and wide: whether one of ``_WIDE`` may speak."""
    if "cues" in docs.columns:
        return docs
    read = F.pandas_udf(_read_words, "cues long, starts array<int>, w array<string>, w2 array<string>")
    listed = F.arrays_zip(F.col("_read.starts").alias("start"), F.col("_read.w").alias("w"), F.col("_read.w2").alias("w2")).cast(COMPOUNDS)
    found = docs.withColumn("_read", read(F.col(text_col))).withColumns({"cues": F.col("_read.cues"), "compounds": listed}).drop("_read")
    wide = F.col(text_col).rlike(rf"[A-Z]{{2}}|\([A-Z]|[0-9] ?(?:{'|'.join(lx.UNITS)})") | cued("W210") | cued("G102")
    return found.withColumn("wide", F.coalesce(wide, F.lit(False)))


def cued(rule_id: str) -> Column:
    """Whether a rule may match, by the cues of the row."""
    return F.col("cues").bitwiseAND(F.lit(_BITS[rule_id]).cast("long")) != 0


#: Patterns that match as those of the rules, read faster.
_QUICK = {
    **{r: _ci(led_any_of(p)) for r, p in (("W201", lx.GRAND_WORDS), ("W202", lx.WORDY_PHRASES), ("W203", lx.HYPE_WORDS), ("W204", lx.INTENSIFIERS), ("W205", lx.FILLER_PHRASES),
                                          ("W206", lx.REDUNDANT_PAIRS), ("W208", lx.CONTRACTIONS), ("E701", lx.EMPTY_PHRASES))},
    **{r: _ci(either_word(p)) for r, p in (("C302", lx.OVERCLAIMS), ("C303", [*lx.CAUSAL_PHRASES, lx.CAUSAL_FORMS]), ("C305", lx.ASSERTIVES), ("L901", lx.SERIAL_SUMMARY))},
}


def rules_table(spark: SparkSession) -> DataFrame:
    """The rule dimension, one row a rule, in order of id."""
    rows = [(r.rule_id, r.name, r.category, r.scope, r.tier, r.fix, r.only or None, r.excluded or None, r.aggregate, r.grade) for r in sorted(RULES, key=lambda r: r.rule_id)]
    return spark.createDataFrame(rows, "rule_id string, name string, category string, scope string, tier string, fix string, only array<string>, excluded array<string>, aggregate boolean, grade string")


def back(text: Column, at: Column, n: int) -> Column:
    """Up to n characters before an offset."""
    return F.substring(text, F.greatest(at - n + 1, F.lit(1)), F.least(at, F.lit(n)))


def _spared() -> Column:
    """Matches that a rule's guards spare: W201 nouns of words that are grand only as verbs, W203 technical
    uses, C302 'prove' in a sentence about proofs, C303 aims, modals, authors' own acts and changes without
    an object, C304 uses with a qualifier before them."""
    before, after, low = F.col("before"), F.col("after"), F.lower("text")
    described = F.col("text").rlike(lx.CHANGE_FORMS) & ~F.left(after, F.lit(8)).rlike(lx.AFTER_CHANGE)
    guards = {
        "W201": low.isin(lx.GRAND_ONLY_AS_VERB) & before.rlike(lx.BEFORE_NOUN),
        "W203": after.rlike(rf"(?i)^\s*(?:{'|'.join(lx.HYPE_TECHNICAL)})"),
        "C302": F.coalesce(F.lower("around").rlike(lx.PROOF), F.lit(False)),
        "C303": before.rlike(lx.BEFORE_CALIBRATED) | described,
        "C304": before.rlike(lx.BEFORE_SIGNIFICANT),
    }
    out = F.lit(False)
    for rule_id, guard in guards.items():
        out = F.when(F.col("rule_id") == rule_id, guard).otherwise(out)
    return out


def pattern_findings(docs: DataFrame, rule_ids: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """Findings of all pattern rules (or some) in one scan of the text; where ``docs`` has ``sections``, with
    the section each lies in.  Places are worked out for the rules that match at all."""
    text = F.col(text_col)
    chosen = [r for r in RULES if r.pattern and (rule_ids is None or r.rule_id in rule_ids)]
    placed = "sections" in docs.columns
    none = F.array().cast("array<string>")
    pattern = {r.rule_id: _QUICK.get(r.rule_id, r.pattern) for r in chosen}
    hit = settled(with_cues(docs, text_col), *(F.when(cued(k), F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none).alias(f"_{k}") for k, p in pattern.items()))
    by_rule = F.array(*(F.struct(F.lit(k).alias("rule_id"), F.when(F.size(f"_{k}") > 0, F.split(text, p, -1)).alias("gaps"), F.col(f"_{k}").alias("hits")) for k, p in pattern.items()))

    def found(z: Column) -> Column:
        def one(m: Column) -> Column:
            proof = (z["rule_id"] == "C302") & F.startswith(F.lower(m["text"]), F.lit("prov"))
            left = F.element_at(F.split(F.substring(text, F.lit(1), m["start"]), SENTENCE_GAP), -1)
            right = F.element_at(F.split(F.substring(text, m["start"] + 1, F.length(text)), SENTENCE_GAP), 1)
            own = [z["rule_id"].alias("rule_id"), m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text")]
            own += [back(text, m["start"], 30).alias("before"), F.substring(text, m["end"] + 1, F.lit(40)).alias("after"), F.when(proof, F.concat(left, right)).alias("around")]
            return F.struct(*own, *([section_in(F.col("sections"), m["start"]).alias("section")] if placed else []))

        return F.transform(spans_of(z["gaps"], z["hits"]), one)

    some = F.filter(by_rule, lambda z: F.size(z["hits"]) > 0)
    rows = hit.select("doc_id", F.explode(F.flatten(F.transform(some, found))).alias("f")).select("doc_id", "f.*").where(~_spared())
    known = {f"{r.rule_id} {a}": b for r in chosen for a, b in (r.replacements or {}).items()}
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair]) if known else F.create_map(F.lit(""), F.lit(""))
    replacement = F.try_element_at(table, F.concat_ws(" ", "rule_id", F.lower("text")))
    return rows.select("doc_id", "rule_id", "start", "end", "text", replacement.alias("replacement"), *(["section"] if placed else []))


def sentences(docs: DataFrame, text_col: str = "text", context: bool = False) -> DataFrame:
    """(doc_id, sent, start, end, text), sent from 0; where ``docs`` has ``sections``, the section too.  With
    ``context`` also prev (words of the sentence before) and earlier (an adversative opener in one of the two
    before), looked up in the row."""
    placed = "sections" in docs.columns
    rows = settled(docs, sentence_spans(F.col(text_col)).alias("_all"))
    names = ["start", "end", "text", *(["section"] if placed else []), *(["prev", "earlier"] if context else [])]
    if context:
        rows = settled(rows, F.transform("_all", lambda s: F.struct(F.size(words(s["text"])).alias("n"), s["text"].rlike(_ci(lx.ADVERSATIVE)).alias("turn"))).alias("_kinds"))

    def one(s: Column, i: Column) -> Column:
        own = [s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text")]
        if placed:
            own.append(section_in(F.col("sections"), s["start"]).alias("section"))
        if context:
            own.append(F.when(i > 0, F.element_at("_kinds", F.greatest(i, F.lit(1)))["n"]).otherwise(0).alias("prev"))
            own.append(F.exists(F.slice("_kinds", F.greatest(i - 1, F.lit(1)), F.least(i, F.lit(2))), lambda k: k["turn"]).alias("earlier"))
        return F.struct(*own)

    return rows.select("doc_id", F.posexplode(F.transform("_all", one)).alias("sent", "s")).select("doc_id", "sent", *(f"s.{n}" for n in names))


def _finding(df: DataFrame, rule_id: str, start: Column, end: Column, text: Column, replacement: Column | None = None) -> DataFrame:
    return df.select("doc_id", F.lit(rule_id).alias("rule_id"), start.alias("start"), end.alias("end"), text.alias("text"), (F.lit(None).cast("string") if replacement is None else replacement).alias("replacement"))


#: What a sentence rule says of one sentence: whether it speaks, start and end in the text, and the span.
Said = tuple[Column, Column, Column, Column]


def _first(pattern: str, group: int = 0, unless: Column | None = None) -> Said:
    text = F.col("text")
    hit, whole = F.regexp_extract(text, pattern, group), F.regexp_extract(text, pattern, 0)
    begin = F.col("start") + F.length(F.element_at(F.split(text, pattern, 2), 1)) + (F.instr(whole, hit) - 1)
    speaks = text.rlike(pattern)
    return (speaks if unless is None else speaks & ~unless), begin, begin + F.length(hit), hit


def _expletive() -> Said:
    return _first(_ci(lx.EXPLETIVE), 1)


def _display() -> Said:
    return _first(lx.FIGURE_OPENER)


def _consensus() -> Said:
    return _first(lx.CONSENSUS, unless=F.col("text").rlike(lx.CITATION))


def _novelty() -> Said:
    return _first(_ci(lx.NOVELTY), unless=F.lower("text").rlike(either(lx.SOFTENERS)))


def _stress() -> Said:
    """The first of the trailing qualifiers that ends the sentence, its closing marks apart."""
    body = F.rtrim(F.regexp_replace(F.rtrim("text"), r"[.!?]+$", ""))
    hit = F.lit(None).cast("string")
    for p in reversed(lx.TRAILING_QUALIFIERS):
        hit = F.when(body.rlike(_ci(p)), F.regexp_extract(body, _ci(p), 0)).otherwise(hit)
    end = F.col("start") + F.length(body)
    return hit.isNotNull(), end - F.length(hit), end, hit


LONG = 50


def _overlong(limit: int = LONG, nonword: float = 0.25) -> Said:
    """Sentences of more than ``limit`` tokens, fewer than a quarter of them not plain letters."""
    n = F.size(words(F.col("text")))
    odd = F.size(F.filter(words(F.col("text")), lambda t: ~t.rlike(r"^[A-Za-z\x{80}-\x{10FFFF}]+$")))
    return (F.length("text") > 2 * limit) & (n > limit) & (odd < nonword * n), F.col("start"), F.col("end"), F.col("text")


def _nominal(least: int = 3) -> Said:
    pattern = rf"^[a-z]*(?:{'|'.join(lx.NOMINAL_SUFFIXES)})s?$"
    found = F.filter(F.transform(words(F.col("text")), F.lower), lambda t: (F.length(t) >= 7) & t.rlike(pattern) & ~t.isin(lx.NOMINAL_ALLOWED))
    low = F.lower("text")
    some = F.lit(False)
    for suffix in lx.NOMINAL_SUFFIXES:
        some = some | F.contains(low, F.lit(suffix))
    return some & (F.size(found) >= least), F.col("start"), F.col("end"), F.col("text")


def _naked(before: int = 18) -> Said:
    """'This' and a listed verb, after a sentence of ``before`` words or more."""
    w = words(F.col("text"))
    speaks = F.col("text").rlike("This") & (F.size(w) >= 3) & (F.try_element_at(w, F.lit(1)) == "This") & F.lower(F.try_element_at(w, F.lit(2))).isin(lx.NAKED_THIS_VERBS) & (F.col("prev") >= before)
    begin = F.col("start") + F.instr("text", "This") - 1
    found = F.regexp_extract("text", r"This[^A-Za-z0-9]+[A-Za-z]+", 0)
    return speaks, begin, begin + F.length(found), found


def _adversative() -> Said:
    """An adversative opener within two sentences of an earlier one."""
    opener = F.regexp_extract("text", _ci(lx.ADVERSATIVE), 1)
    begin = F.col("start") + F.instr("text", opener) - 1
    return (opener != "") & F.col("earlier"), begin, begin + F.length(opener), opener


def _numeral() -> Said:
    """Sentences that begin with a counting numeral: no year, no list mark, five words or more."""
    w = F.filter(F.split("text", r"\s+"), lambda t: t != "")
    first, second = F.try_element_at(w, F.lit(1)), F.try_element_at(w, F.lit(2))
    plain = F.size(F.filter(w, lambda t: t.rlike(r"^[A-Za-z]+[.,;:!?]?$")))
    numbers = F.size(F.filter(w, lambda t: t.rlike(r"^[0-9][0-9.,]*$")))
    begins = F.col("text").rlike(r"^\s*[0-9]")
    good = begins & (F.size(w) >= 4) & first.rlike(r"^[0-9]+(?:[.,][0-9]+)*$") & ~first.rlike(r"^(1[89]|20)[0-9]{2}$") & second.rlike("^[a-z]+$") & (plain >= 5) & (numbers * 4 <= F.size(w))
    begin = F.col("start") + F.instr("text", first) - 1
    return good, begin, begin + F.length(first), first


#: Sentence rules with at most one finding a sentence.  E702 and E703 look at the sentences before.
SENTENCE_RULES = {
    "E702": _adversative, "E703": _naked, "E704": _consensus, "E705": _novelty, "E707": _display, "G103": _nominal, "G105": _expletive,
    "G106": _overlong, "G108": _stress, "N102": _numeral,
}


def sentence_rule(sents: DataFrame, rule_id: str) -> DataFrame:
    """Findings of one sentence rule."""
    speaks, start, end, text = SENTENCE_RULES[rule_id]()
    return _finding(sents.where(speaks), rule_id, start, end, text)


def _hedge_pairs(text: Column, begin: Column, window: int = 4) -> Column:
    """Spans of two hedges at most ``window`` tokens apart, no clause border or negation between or just
    before; a hedge is the first of one pair at most once, and not if it was the second of another."""
    border, negation = ["that", "which", "whether", "if", "and", "or", "but"], ["not", "never"]
    kind = "array<struct<start:int,end:int,text:string>>"

    def pairs(z: Column) -> Column:
        def step(state: Column, b: Column) -> Column:
            a = state["last"]
            between = F.slice(z["low"], a + 1, F.greatest(b - a - 1, F.lit(0)))
            before = F.slice(z["low"], F.greatest(a - 2, F.lit(1)), b - F.greatest(a - 2, F.lit(1)))
            good = (a > 0) & (b - a <= window) & ~state["used"] & ~F.exists(between, lambda t: t.isin(border)) & ~F.exists(before, lambda t: t.isin(negation) | t.rlike("n['’]t$"))
            return F.struct(b.alias("last"), good.alias("used"), F.when(good, F.concat(state["out"], F.array(F.struct(a.alias("a"), b.alias("b"))))).otherwise(state["out"]).alias("out"))

        start = F.struct(F.lit(0).alias("last"), F.lit(False).alias("used"), F.array().cast("array<struct<a:int,b:int>>").alias("out"))
        at = F.filter(F.transform(z["low"], lambda t, i: F.when(t.isin(lx.HEDGES), i + 1)), lambda i: i.isNotNull())

        def span(p: Column) -> Column:
            first, last = F.element_at(z["w"], p["a"])["start"], F.element_at(z["w"], p["b"])["end"]
            return F.struct((begin + first).alias("start"), (begin + last).alias("end"), F.substring(text, first + 1, last - first).alias("text"))

        return F.transform(F.aggregate(at, start, step)["out"], span)

    def lowered(w: Column) -> Column:
        return once(F.struct(w.alias("w"), F.transform(w, lambda t: F.lower(t["text"])).alias("low")), pairs)

    several = F.size(F.regexp_extract_all(text, F.lit(_ci(any_of(lx.HEDGES))), F.lit(0))) > 1
    return F.when(several, once(matches(text, WORD), lowered)).otherwise(F.array().cast(kind))


def hedge_stacks(sents: DataFrame) -> DataFrame:
    found = sents.select("doc_id", F.explode(_hedge_pairs(F.col("text"), F.col("start"))).alias("p"))
    return _finding(found, "C301", F.col("p.start"), F.col("p.end"), F.col("p.text"))


#: At least this much of a rule's tests holds in a sentence of which it speaks.
_HINTS = {
    "E702": _ci(lx.ADVERSATIVE), "E703": "This", "E704": lx.CONSENSUS, "E705": _ci(lx.NOVELTY), "E707": lx.FIGURE_OPENER, "G105": _ci(lx.EXPLETIVE),
    "G108": _ci(either(p.removesuffix("$") for p in lx.TRAILING_QUALIFIERS)), "N102": r"^\s*[0-9]", "C301": _ci(any_of(lx.HEDGES)),
}
_NOMINAL_ENDS = rf"(?i){by_letter(lx.NOMINAL_SUFFIXES)}s?(?![A-Za-z])"


def hinted(rule_id: str, text: Column) -> Column:
    """Whether a rule may speak of a sentence, by the cues of its row and the hints."""
    if rule_id == "G103":
        return (F.length(text) >= 23) & (F.size(F.regexp_extract_all(text, F.lit(_NOMINAL_ENDS), F.lit(0))) >= 3)
    if rule_id == "G106":
        return (F.length(text) > 2 * LONG) & (F.size(words(text)) > LONG)
    hint = text.rlike(_HINTS[rule_id])
    return cued(rule_id) & hint if rule_id in CUES else hint


def hinted_sentences(docs: DataFrame, rule_ids: list[str]) -> DataFrame:
    """``sentences`` with their context, but only those that some of the rules may speak of leave the row.  ``docs`` have
    sections and cues."""
    text = F.col("text")
    rows = settled(docs, F.split(text, SENTENCE_GAP, -1).alias("_bodies"), F.regexp_extract_all(text, F.lit(SENTENCE_GAP), F.lit(0)).alias("_gaps"))
    rows = settled(rows, F.transform("_bodies", lambda b, i: F.concat(b, F.coalesce(F.left(F.try_element_at("_gaps", i + 1), F.lit(1)), F.lit("")))).alias("_own"))

    def may(t: Column, i: Column) -> Column:
        out = F.lit(False)
        for rule_id in rule_ids:
            out = out | hinted(rule_id, t)
        return F.when(out, i)

    rows = settled(rows, F.filter(F.transform("_own", may), lambda i: i.isNotNull()).alias("_at")).where(F.size("_at") > 0)

    def one(i: Column, start: Column) -> Column:
        own = F.element_at("_own", i + 1)
        prev = F.when(i > 0, F.when(cued("E703"), F.size(words(F.element_at("_own", F.greatest(i, F.lit(1))))))).otherwise(0)
        earlier = cued("E702") & F.exists(F.slice("_own", F.greatest(i - 1, F.lit(1)), F.least(i, F.lit(2))), lambda s: s.rlike(_ci(lx.ADVERSATIVE)))
        return F.struct(i.alias("sent"), start.alias("start"), (start + F.length(own)).alias("end"), own.alias("text"), section_in(F.col("sections"), start).alias("section"), prev.alias("prev"), earlier.alias("earlier"))

    begins = ends_of(F.col("_bodies"), F.col("_gaps"), F.transform("_at", lambda i: i - 1))
    return rows.select("doc_id", F.explode(F.zip_with("_at", begins, one)).alias("s")).select("doc_id", "s.*")


def sentence_findings(sents: DataFrame, rule_ids: list[str] | None = None) -> DataFrame:
    """Findings of all sentence rules (or some) in one pass: each is one expression over the row.  ``sents``
    come with context."""
    chosen = [r for r in [*SENTENCE_RULES, "C301"] if rule_ids is None or r in rule_ids]
    own = ["doc_id", *(["section"] if "section" in sents.columns else [])]
    single = []
    for rule_id in [r for r in chosen if r != "C301"]:
        speaks, start, end, text = SENTENCE_RULES[rule_id]()
        single.append(F.when(speaks, F.struct(F.lit(rule_id).alias("rule_id"), start.cast("int").alias("start"), end.cast("int").alias("end"), text.alias("text"))))
    found = F.array_compact(F.array(*single)) if single else None
    if "C301" in chosen:
        pairs = F.transform(_hedge_pairs(F.col("text"), F.col("start")), lambda p: F.struct(F.lit("C301").alias("rule_id"), p["start"].alias("start"), p["end"].alias("end"), p["text"].alias("text")))
        found = pairs if found is None else F.concat(found, pairs)
    out = sents.select(*own, F.explode(found).alias("f"))
    return out.select("doc_id", "f.rule_id", "f.start", "f.end", "f.text", F.lit(None).cast("string").alias("replacement"), *own[1:])


#: A whole run of one word; runs of exactly two are slips, longer ones are flattened tables.
DOUBLED = r"(?i)\b([A-Za-z]++)(?:[ \t]++\1\b)+"


def doubled_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """A word twice in a row on one line: not 'had' or 'that', not columns (a gap of three blanks or
    more), no single letter but 'a', not part of a longer run."""
    found = docs.select("doc_id", F.explode(matches(F.col(text_col), DOUBLED)).alias("m")).select("doc_id", "m.*")
    parts = F.split("text", r"[ \t]+")
    word = F.lower(F.try_element_at(parts, F.lit(1)))
    gap = F.length("text") - F.length(F.regexp_replace("text", r"[ \t]", ""))
    good = (F.size(parts) == 2) & ~word.isin("had", "that") & (gap < 3) & ((F.length(word) > 1) | (word == "a"))
    return _finding(found.where(good), "W207", F.col("start"), F.col("end"), F.col("text"), F.try_element_at(parts, F.lit(1)))


def variant_consistency(docs: DataFrame, pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """Both spellings of a pair in one document: the first use of the rarer one (of the first, if even)."""
    pairs = pairs or lx.VARIANT_PAIRS
    spark = docs.sparkSession
    table = spark.createDataFrame([(k, f, a) for k, (a, b) in enumerate(pairs) for f, a in ((0, a), (1, b))], "pair int, form int, word string")
    words_of = sorted({w for p in pairs for w in p})
    docs = with_cues(docs).where(cued("W210")) if pairs is lx.VARIANT_PAIRS else docs
    found = docs.select("doc_id", F.explode(matches(F.col("text"), _ci(any_of(words_of)))).alias("m")).select("doc_id", "m.start", "m.end", F.lower("m.text").alias("word"), F.col("m.text").alias("text"))
    used = found.join(F.broadcast(table), "word").groupBy("doc_id", "pair", "form").agg(F.count("*").alias("n"), F.min(F.struct("start", "end", "text")).alias("first"))
    both = used.groupBy("doc_id", "pair").agg(F.count("*").alias("forms"), F.min_by("first", F.struct("n", "form")).alias("f")).where("forms = 2")
    return _finding(both, "W210", F.col("f.start"), F.col("f.end"), F.col("f.text"))


ACRONYM = lx.ACRONYM


def undefined_acronyms(docs: DataFrame) -> DataFrame:
    """First use of an acronym that is neither allowed, listed, a Roman numeral, a label with a number, an
    author's initials, inside display capitals or a run of three capitalised words, nor defined in brackets
    here or before.  All is decided in the row; only short rows of places are shuffled."""
    text = F.col("text")
    some = settled(docs.where(text.rlike("[A-Z]{2}")).select("doc_id", "text"), F.regexp_extract_all(text, F.lit(lx.LISTED_ACRONYM), F.lit(1)).alias("listed"))
    rows = some.select("doc_id", "text", "listed", F.explode(matches(text, ACRONYM)).alias("m"))
    rows = rows.withColumns({"start": F.col("m.start"), "end": F.col("m.end"), "acr": F.regexp_extract("m.text", "^[A-Z]+", 0)})
    # what stands near is cut out of the text once
    lead, size = F.least(F.col("start"), F.lit(80)), F.col("end") - F.col("start")
    rows = settled(rows, F.substring(text, F.col("start") - lead + 1, lead + size + 80).alias("_near"), lead.alias("_lead"))
    near, lead = F.col("_near"), F.col("_lead")
    reach = F.least(lead, F.lit(45))
    window = F.regexp_replace(F.substring(near, lead - reach + 1, reach + size + 45), r"[^A-Za-z]", "")
    capitals = F.length(F.regexp_replace(window, "[^A-Z]", ""))
    after2 = F.substring(near, lead + size + 1, F.lit(2))
    initials = (F.length("acr") <= 3) & back(near, lead, 20).rlike(r"[A-Z][a-z]{2,}\s+$") & (after2.rlike(r"^\s*[,.;]") | (after2 == ""))
    ahead = F.size(F.split(F.regexp_extract(back(near, lead, 80), rf"(?:\b{lx.CAPITAL_WORD}[ \t]+)+$", 0), r"[ \t]+")) - 1
    behind = F.size(F.split(F.regexp_extract(F.substring(near, lead + size + 1, F.lit(80)), rf"^(?:[ \t]+{lx.CAPITAL_WORD}\b)+", 0), r"[ \t]+")) - 1
    kept = rows.where(
        ~F.col("acr").isin(lx.ACRONYMS_ALLOWED)
        & ~F.array_contains("listed", F.col("acr"))
        & ~F.col("acr").rlike(lx.ROMAN)
        & (capitals <= 0.55 * F.length(window))
        & ~after2.rlike(r"^(?:\.[0-9]|\([0-9])")
        & ~initials
        & (ahead + behind < 2)
    )
    opened = back(near, lead, 2).rlike(r"\( ?$")
    before = F.substring(text, F.lit(1), F.col("start"))
    defined = F.contains(before, F.concat(F.lit("("), F.col("acr"), F.lit(")"))) | F.contains(before, F.concat(F.lit("("), F.col("acr"), F.lit("s)")))
    uses = kept.select("doc_id", "acr", F.struct("start", "end", (opened | defined).alias("known")).alias("use"))
    first = uses.groupBy("doc_id", "acr").agg(F.min("use").alias("use")).where("not use.known")
    return _finding(first, "F601", F.col("use.start"), F.col("use.end"), F.col("acr"))


DEFINED = r"\([A-Z][A-Za-z0-9-]{1,9}s?\)"


def definitions(docs: DataFrame) -> DataFrame:
    """(doc_id, acr, start, end, nth): abbreviations in brackets whose letters are found, right to left,
    in the words before, the first at the start of a word."""
    text = F.col("text")
    rows = docs.select("doc_id", "text", F.explode(matches(text, DEFINED)).alias("m")).withColumn("acr", F.regexp_extract("m.text", r"^\((.*?)s?\)$", 1))
    rows = rows.where((F.length(F.regexp_replace("acr", "[^A-Z]", "")) >= 2) & ~F.col("acr").isin(lx.ACRONYMS_ALLOWED) & (F.col("m.start") > 0))
    reach = F.length("acr") * 12 + 20
    before = F.substring(text, F.greatest(F.col("m.start") - reach + 1, F.lit(1)), F.least(F.col("m.start"), reach))
    rows = rows.withColumn("before", before).where(F.col("before").rlike(r"\s$"))
    letters = F.array_join(F.filter(F.split(F.lower(F.regexp_replace("acr", "[^A-Za-z0-9]", "")), ""), lambda c: c != ""), ".*")
    # the letters in order, the first at a word's start
    spelled = F.regexp_like(F.lower(F.rtrim("before")), F.concat(F.lit(r"(?s)(?:^|[^a-z0-9])"), letters))
    found = rows.where(spelled).select("doc_id", "acr", (F.col("m.start") + 1).alias("start"), (F.col("m.start") + 1 + F.length("acr")).alias("end"))
    return found.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "acr").orderBy("start")))


def defined_twice(docs: DataFrame, within: int = 20_000) -> DataFrame:
    order = Window.partitionBy("doc_id", "acr").orderBy("start")
    again = definitions(docs).withColumn("before", F.lag("start").over(order)).where(F.col("start") - F.col("before") <= within)
    return _finding(again, "F612", F.col("start"), F.col("end"), F.col("acr"))


def rarely_used(docs: DataFrame) -> DataFrame:
    """Abbreviations used once or never after their first definition, further definitions apart."""
    first = definitions(docs).groupBy("doc_id", "acr").agg(F.min(F.struct("start", "end")).alias("at"), F.count("*").alias("defs"))
    tokens = dense_matches(docs.where(F.col("text").rlike(DEFINED)), r"(?<![\w-])[A-Z][A-Za-z0-9-]*(?![\w-])")
    tokens = tokens.select("doc_id", F.regexp_replace("text", r"s$", "").alias("acr"), F.col("start").alias("use"))
    uses = first.join(tokens, ["doc_id", "acr"], "left").groupBy("doc_id", "acr", "at", "defs").agg(F.count_if(F.col("use") >= F.col("at.end")).alias("n"))
    return _finding(uses.where(F.col("n") - (F.col("defs") - 1) <= 1), "F613", F.col("at.start"), F.col("at.end"), F.col("acr"))


UNIT_USE = r"(?<![\w.])\d+(?:[.,]\d+)? ?(?:" + "|".join(sorted(lx.UNITS, key=lambda u: (-len(u), u))) + r")(?![A-Za-z])"


def unit_spacing(docs: DataFrame) -> DataFrame:
    """A unit written with and without a blank: the first use of the rarer form (without, if even)."""
    found = docs.select("doc_id", F.explode(matches(F.col("text"), UNIT_USE)).alias("m")).select("doc_id", "m.*")
    unit = F.replace(F.lower(F.regexp_replace("text", r"^[0-9.,]+ ?", "")), F.lit("μ"), F.lit("µ"))
    used = found.withColumn("unit", unit).withColumn("spaced", F.contains("text", F.lit(" ")))
    counts = used.groupBy("doc_id", "unit").agg(F.count_if("spaced").alias("s"), F.count("*").alias("n"), F.min(F.when(F.col("spaced"), F.struct("start", "end", "text"))).alias("a"), F.min(F.when(~F.col("spaced"), F.struct("start", "end", "text"))).alias("b")).where("s > 0 and s < n")
    f = F.when(F.col("s") < F.col("n") - F.col("s"), F.col("a")).otherwise(F.col("b"))
    return _finding(counts.withColumn("f", f), "N101", F.col("f.start"), F.col("f.end"), F.col("f.text"))


def compounds_two_ways(docs: DataFrame) -> DataFrame:
    """A word also written as two ("data set", "data-set"): first use of the rarer form."""
    # of a text only the words that may be part of such a pair leave the row, with their places
    rows = with_cues(docs).select("doc_id", F.explode("compounds").alias("m")).select("doc_id", "m.*")
    rows = rows.withColumn("end", F.col("start") + F.length("w"))
    two = rows.where("w2 is not null and not contains(w, '-') and not contains(w2, '-') and length(w) >= 3 and length(w2) >= 3")
    opened = two.select("doc_id", F.concat("w", "w2").alias("joined"), "start", (F.col("end") + 1 + F.length("w2")).alias("end"))
    hyphened = rows.where("contains(w, '-')").select("doc_id", F.replace("w", F.lit("-")).alias("joined"), "start", "end")
    split = opened.unionByName(hyphened).where("length(joined) >= 6").groupBy("doc_id", "joined").agg(F.count("*").alias("n_split"), F.min(F.struct("start", "end")).alias("split"))
    closed = rows.where("not contains(w, '-') and length(w) >= 6").groupBy("doc_id", F.col("w").alias("joined")).agg(F.count("*").alias("n_closed"), F.min(F.struct("start", "end")).alias("closed"))
    both = split.join(closed, ["doc_id", "joined"]).withColumn("f", F.when(F.col("n_closed") < F.col("n_split"), F.col("closed")).otherwise(F.col("split")))
    return _finding(both, "W211", F.col("f.start"), F.col("f.end"), F.col("joined"))


_LIGHT = [f for v in lx.LIGHT_VERBS for f in (v, v + "s", v + "ed", v.rstrip("e") + "ing", v.rstrip("e") + "ed")] + ["made", "did", "does", "done", "carried", "carries", "undertook"]
BURIED = rf"(?i)\b(?:{'|'.join(sorted(set(_LIGHT), key=lambda v: (-len(v), v)))}) (?:[a-z]+ ){{0,2}}(?:{'|'.join(sorted(lx.NOMINAL_VERBS, key=lambda v: (-len(v), v)))})\b"


def buried_actions(docs: DataFrame) -> DataFrame:
    """A light verb, up to two words, and an action noun: the verb the noun hides."""
    found = with_cues(docs).where(cued("G102")).select("doc_id", F.explode(matches(F.col("text"), BURIED)).alias("m")).select("doc_id", "m.*")
    table = F.create_map(*[F.lit(x) for p in lx.NOMINAL_VERBS.items() for x in p])
    return _finding(found, "G102", F.col("start"), F.col("end"), F.col("text"), F.try_element_at(table, F.lower(F.regexp_extract("text", "[A-Za-z]+$", 0))))


def missing_niche(docs: DataFrame, headings: DataFrame, least: int = 600) -> DataFrame:
    """Introductions of ``least`` characters or more without both a contrast and a gap word."""
    intro = headings.where("section = 'introduction'").groupBy("doc_id").agg(F.min(F.struct("start", "title")).alias("h"))
    later = headings.where("section <> 'introduction'").select("doc_id", F.col("start").alias("stop"))
    bounds = intro.join(later, "doc_id", "left").groupBy("doc_id", "h").agg(F.min(F.when(F.col("stop") > F.col("h.start"), F.col("stop"))).alias("stop"))
    body = docs.join(bounds, "doc_id").withColumn("body", F.substring("text", F.col("h.start") + 1, F.coalesce("stop", F.length("text")) - F.col("h.start")))
    lacks = ~(F.col("body").rlike(_ci(lx.CONTRAST)) & F.col("body").rlike(_ci(lx.GAP)))
    return _finding(body.where((F.length("body") >= least) & lacks), "D902", F.col("h.start"), F.col("h.start") + F.length("h.title"), F.col("h.title"))


DOCUMENT_RULES = {
    "W207": doubled_words, "W210": variant_consistency, "W211": compounds_two_ways, "G102": buried_actions, "F601": undefined_acronyms,
    "F612": defined_twice, "F613": rarely_used, "N101": unit_spacing,
}
#: Document rules that speak of few texts.
_WIDE = ["W210", "G102", "F601", "F612", "F613", "N101"]


def all_findings(docs: DataFrame, disabled: list[str] | None = None) -> DataFrame:
    """Findings of every rule that needs no markup, with their section; disabled rules do not run.

    ``docs`` (doc_id, text) are read as they are, so callers mask first; ``sections``, where given, are taken
    instead of the text's own headings.  Pattern rules share one scan,
    sentence rules one split into sentences; document rules have scans of their own.
    """
    off = set(disabled or [])
    own = ["doc_id", "text", *(c for c in ("sections", "cues", "compounds", "wide") if c in docs.columns)]
    placed = with_cues(docs.select(own) if "sections" in docs.columns else with_sections(docs.select(own)))
    out = pattern_findings(placed, [r.rule_id for r in RULES if r.pattern and r.rule_id not in off])
    spoken = [r for r in [*SENTENCE_RULES, "C301"] if r not in off]
    if spoken:
        out = out.unionByName(sentence_findings(hinted_sentences(placed, spoken), spoken))
    wide = None
    for rule_id, operator in DOCUMENT_RULES.items():
        if rule_id not in off:
            found = operator(placed.where("wide") if rule_id in _WIDE else placed)
            wide = found if wide is None else wide.unionByName(found)
    if wide is None:
        return out
    # these findings have left their row: a document's short list of headings meets them
    listed = placed.where(F.size("sections") > 0).select("doc_id", "sections")
    wide = wide.join(listed, "doc_id", "left").withColumn("sections", F.coalesce("sections", F.array().cast(SECTIONS)))
    return out.unionByName(wide.withColumn("section", section_in(F.col("sections"), F.col("start"))).drop("sections"))
