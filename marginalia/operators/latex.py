r"""Reading LaTeX: what a reader sees as prose stays in its place, all else becomes blanks of the same length.

A machine over tokens walks each source once with a stack of what is open (groups, environments, captions,
titles) and gives masked text, headings and items (floats, captions, labels, references, citations, equations)
with their places.  It runs in Arrow-fed tasks, one row at a time, and keeps nothing between rows.  Everything
around it is columns: the preamble's own commands are found before, and after it the reading is chosen: the
strict one; where that fails a lenient one, if it keeps enough of the words that masking by patterns leaves;
else the patterns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import tex
from marginalia.operators.masks import masked as masked_by_patterns

ITEM = "struct<kind:string,start:int,end:int,label:string>"
HEADING = "struct<start:int,end:int,title:string,level:int>"
READING = f"ok boolean, at int, masked string, headings array<{HEADING}>, items array<{ITEM}>, atoms array<struct<start:int,end:int>>"
_TOKEN = re.compile(
    r"(?P<comment>%[^\n]*)|\\(?P<edge>begin|end)\s*\{(?P<env>[^{}\n]*)\}|\\(?P<word>[A-Za-z@]+)|\\(?P<symbol>.)"
    r"|(?P<dollar>\$\$?)|(?P<brace>[{}])|(?P<tie>[~&])|(?P<text>[^\\%${}~&]+)|(?P<odd>.)",
    re.S,
)
_DIMENSION = re.compile(rf"\s*=?\s*{tex.NUMBER}\s*{tex.UNIT}?(?:\s*(?:plus|minus)\s*{tex.NUMBER}\s*{tex.UNIT})*")
_LABEL = re.compile(r"\\label\s*\{([^{}]+)\}")
_DOCUMENT = re.compile(r"^[^%\n]*?\\begin\s*\{document\}", re.M)
_SPACE = re.compile(r"[ \t\n]*")
_FI = re.compile(r"\\fi(?![A-Za-z@])")
_ENDS = {"$": re.compile(r"(?:[^\\$]|\\.)*?\$", re.S), "$$": re.compile(r".*?\$\$", re.S), "[": re.compile(r".*?\\\]", re.S), "(": re.compile(r".*?\\\)", re.S)}
_NAMES = {n: role for role, names in (("cite", tex.CITATIONS), ("heading", tex.LEVELS), ("caption", tex.CAPTIONS), ("ref", tex.REFERENCES), ("definition", tex.DEFINITIONS)) for n in names}
_WHOLE, _DIMENSIONS, _NO_PROSE = set(tex.WHOLE), set(tex.DIMENSIONS), set(tex.NO_PROSE)


class _Broken(Exception):
    pass


class _Reading:
    """One walk over one source.  An open frame is [closing, prose, item that labels name, place, what to do]."""

    def __init__(self, text: str, code: list[str], refs: dict[str, str], lenient: bool):
        self.text, self.lenient = text, lenient
        self.code, self.refs = {*tex.CODE, *code}, dict.fromkeys(tex.STYLE_REFERENCES, "") | refs
        self.kept: list[tuple[int, int]] = []
        self.headings: list[dict] = []
        self.items: list[dict] = []
        self.atoms: list[dict] = []
        self.captions: list[tuple[dict, dict]] = []
        self.stack: list[list] = []

    def fail(self, at: int) -> None:
        if not self.lenient:
            raise _Broken(at)

    def balanced(self, at: int) -> int:
        """End of the group or option that opens at ``at``; where it does not close, an error or ``at`` + 1."""
        closing, depth = ("{", "}") if self.text[at] == "{" else ("[", "]"), 0
        for m in re.compile(r"\\.|[\[\]]|[{}]", re.S).finditer(self.text, at):
            depth += (m[0] == closing[0]) - (m[0] == closing[1])
            if depth == 0:
                return m.end()
        self.fail(at)
        return at + 1

    def arguments(self, at: int, spec: str) -> tuple[int, list[tuple[int, int]]]:
        """End of a command's arguments, and the places of its groups."""
        text, groups = self.text, []
        for kind in spec:
            p = at if kind == "v" else _SPACE.match(text, at).end()
            c = text[p : p + 1]
            if kind == "*":
                at = p + 1 if c == "*" else at
            elif kind == "[":
                at = self.balanced(p) if c == "[" else at
            elif kind == "{" and c == "{":
                at = self.balanced(p)
                groups.append((p + 1, at - 1))
            elif kind in "{c" and c == "\\":
                m = _TOKEN.match(text, p)
                at = m.end()
                if kind == "c":
                    at = text.find("{", at) if "{" in text[at:] else at
            elif kind == "f":
                m = _FI.search(text, at)
                at = m.end() if m else len(text)
                if not m:
                    self.fail(p)
            elif kind == "v":
                p += text[p : p + 1] == "*"
                p = self.balanced(p) if text[p : p + 1] == "[" else p
                if text[p : p + 1] == "{":
                    at = self.balanced(p)
                else:
                    stop = text.find(text[p : p + 1], p + 1) if p < len(text) else -1
                    if stop < 0:
                        self.fail(p)
                    at = stop + 1 if stop >= 0 else p
        return at, groups

    def item(self, kind: str, start: int, end: int, label: str | None = None) -> dict:
        self.items.append({"kind": kind, "start": start, "end": end, "label": label})
        return self.items[-1]

    def squeezed(self, span: tuple[int, int]) -> str:
        return " ".join(self.text[span[0] : span[1]].split())

    def inner_label(self, start: int, end: int) -> str | None:
        m = _LABEL.search(self.text, start, end)
        return m[1].strip() if m else None

    def run(self) -> None:
        m = _DOCUMENT.search(self.text)
        at, stop = (m.end(), len(self.text)) if m else (0, len(self.text))
        if m:
            self.stack.append(["document", True, None, at, None])
        while at < stop:
            m = _TOKEN.match(self.text, at)
            prose, sink = (self.stack[-1][1], self.stack[-1][2]) if self.stack else (True, None)
            at = m.end()
            if m["text"]:
                if prose:
                    self.kept.append(m.span())
            elif m["edge"] == "end" and m["env"] == "document" and self.closes("document", m.start()):
                break
            elif m["edge"]:
                at = self.environment(m, prose, sink) if m["edge"] == "begin" else self.ended(m)
            elif m["word"]:
                at = self.command(m["word"], m.start(), at, prose, sink)
            elif m["symbol"] and m["symbol"] in "[(" or m["dollar"]:
                at = self.maths(m["dollar"] or m["symbol"], m.start(), at, prose)
            elif m["symbol"] == "\\" and self.text[at : at + 1] == "[":
                at = self.balanced(at)
            elif m["symbol"] and m["symbol"] in tex.ESCAPED and prose:
                self.kept.append(m.span())
            elif m["brace"] == "{":
                self.stack.append(["}", prose, sink, m.start(), None])
            elif m["brace"] and self.closes("}", m.start()):
                frame = self.stack.pop()
                if frame[4]:
                    frame[4](m.end())
        if self.stack and self.stack[-1][0] != "document":
            self.fail(self.stack[-1][3])
        elif self.stack and not self.text.startswith("\\end", m.start()):
            self.fail(self.stack[-1][3])
        while self.stack:
            frame = self.stack.pop()
            if frame[4]:
                frame[4](stop)
        for caption, owner in self.captions:
            caption["label"] = caption["label"] or owner["label"]

    def closes(self, what: str, at: int) -> bool:
        """Whether the innermost open frame closes here.  A lenient reading closes what stands open inside it."""
        if self.stack and self.stack[-1][0] == what:
            return True
        self.fail(at)
        if what != "}" and any(f[0] == what for f in self.stack):
            while self.stack[-1][0] != what:
                frame = self.stack.pop()
                if frame[4]:
                    frame[4](at)
            return True
        return False

    def ended(self, m: re.Match) -> int:
        if self.closes(m["env"], m.start()):
            frame = self.stack.pop()
            if frame[4]:
                frame[4](m.end())
        return m.end()

    def maths(self, opening: str, start: int, at: int, prose: bool) -> int:
        m = _ENDS[opening].match(self.text, at)
        if not m:
            self.fail(start)
            return at
        if prose:
            self.atoms.append({"start": start, "end": m.end()})
        if opening in ("$$", "["):
            self.item("equation", start, m.end(), self.inner_label(at, m.end()))
        return m.end()

    def skipped(self, name: str, at: int) -> int:
        """End of an environment nothing of which is read."""
        depth = 1
        for m in re.compile(rf"\\(begin|end)\s*\{{{re.escape(name)}\}}").finditer(self.text, at):
            depth += 1 if m[1] == "begin" else -1
            if depth == 0:
                return m.end()
        self.fail(at)
        return len(self.text) if not self.lenient else at

    def environment(self, m: re.Match, prose: bool, sink: dict | None) -> int:
        name, start, at = m["env"], m.start(), m.end()
        if name in tex.VERBATIM:
            stop = self.text.find(f"\\end{{{name}}}", at)
            if stop < 0:
                self.fail(start)
                return at
            return stop + len(name) + 6
        if name.rstrip("*") in tex.MATHS:
            end = self.skipped(name, at)
            if name.rstrip("*") != "math":
                self.item("equation", start, end, self.inner_label(at, end))
            return end
        floating = name in tex.FIGURES or name in tex.TABLES
        if name in _NO_PROSE:
            end = self.skipped(name, at)
            if prose and name in tex.TABULAR:
                self.item("table", start, end, self.inner_label(at, end))
            return end
        at = self.arguments(at, tex.ENVIRONMENT_ARGUMENTS.get(name, ""))[0]
        at = self.balanced(at) if self.text[at : at + 1] == "[" else at
        if floating and prose:
            own = self.item("figure" if name in tex.FIGURES else "table", start, start)
            self.stack.append([name, False, own, start, lambda end: own.update(end=end)])
        elif not prose and (floating or name in tex.PANELS):
            self.stack.append([name, False, {"label": None}, start, None])
        else:
            if name == "abstract" and prose:
                self.headings.append({"start": start, "end": start, "title": "Abstract", "level": None})
            self.stack.append([name, prose, sink, start, None])
        return at

    def command(self, name: str, start: int, at: int, prose: bool, sink: dict | None) -> int:
        text, role = self.text, _NAMES.get(name)
        if role == "heading" or role == "caption":
            at, _ = self.arguments(at, "*{[" if name == "captionof" else "*[")
            p = _SPACE.match(text, at).end()
            if text[p : p + 1] != "{" or role == "heading" and not prose:
                return self.arguments(at, "{")[0]
            if role == "caption":
                own = self.item("caption", start, start)
                if sink is not None:
                    self.captions.append((own, sink))
                self.stack.append(["}", True, sink, p, lambda end: own.update(end=end)])
            else:
                self.stack.append(["}", True, None, p, self.titled(name, start, len(self.kept))])
            return p + 1
        if name == "label":
            end, groups = self.arguments(at, "{")
            key = self.squeezed(groups[0]) if groups else ""
            if key:
                if sink is not None and sink["label"] is None:
                    sink["label"] = key
                self.item("label", start, end, key)
            return end
        if role == "cite":
            end, groups = self.arguments(at, "*[[{")
            if prose:
                self.atoms.append({"start": start, "end": end})
                self.item("citation", start, end, (self.squeezed(groups[0]) if groups else "") or None)
            return end
        if role == "ref" or name in self.refs:
            end, groups = self.arguments(at, "*{")
            if prose:
                self.atoms.append({"start": start, "end": end})
            for key in self.squeezed(groups[0]).split(",") if groups else []:
                if key.strip():
                    self.item("ref", start, end, self.refs.get(name, "") + key.strip())
            return end
        if role == "definition":
            for _ in range(4):
                p = re.compile(r"[ \t\n*]*").match(text, at).end()
                if text[p : p + 1] != "{":
                    break
                at = self.balanced(p)
            return at
        if name in _DIMENSIONS and text[at : at + 1] not in ("{", "*"):
            m = _DIMENSION.match(text, at)
            return m.end() if m else at
        if name in _WHOLE or name in self.code:
            end, _ = self.arguments(at, tex.ARGUMENTS.get(name, "*[{"))
            if prose and (name in tex.WORD_COMMANDS or name in self.code and name not in _WHOLE):
                self.atoms.append({"start": start, "end": end})
            return end
        if name in tex.LAST_ARGUMENT:
            return self.arguments(at, "[" + "{" * tex.LAST_ARGUMENT[name])[0]
        at += text[at : at + 1] == "*"
        return self.balanced(at) if text[at : at + 1] == "[" else at

    def titled(self, name: str, start: int, kept: int):
        def done(end: int) -> None:
            title = " ".join(_blanked(self.text, self.kept[kept:], self.kept[kept][0], end).split()) if len(self.kept) > kept else ""
            del self.kept[kept:]
            if title:
                self.headings.append({"start": start, "end": end, "title": title, "level": tex.LEVELS[name]})

        return done


def _blanked(text: str, kept: list[tuple[int, int]], start: int, end: int) -> str:
    out, at = [], start
    for a, b in kept:
        out += [re.sub(r"[^\n]", " ", text[at:a]), text[a:b]]
        at = b
    return "".join([*out, re.sub(r"[^\n]", " ", text[at:end])])


def read(text: str | None, code: list[str], refs: dict[str, str], lenient: bool = False) -> tuple:
    """(ok, place of the error, masked, headings, items, atoms) of one source."""
    if text is None:
        return True, None, None, [], [], []
    r = _Reading(text, code, refs, lenient)
    try:
        r.run()
    except _Broken as broken:
        return False, broken.args[0], None, [], [], []
    return True, None, _blanked(text, r.kept, 0, len(text)), sorted(r.headings, key=lambda h: h["start"]), sorted(r.items, key=lambda i: i["start"]), r.atoms


#: Rows, and characters unless one row has more, whose readings are held at once.
PART_ROWS, PART_CHARS = 64, 1 << 20


def _parts(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """A batch in parts: a reading is many times its text, so those of a whole batch are too much for a task."""
    first, chars = 0, 0
    for k, text in enumerate(batch["text"]):
        n = len(text) if text is not None else 0
        if k > first and (k - first >= PART_ROWS or chars + n > PART_CHARS):
            yield batch.iloc[first:k]
            first, chars = k, 0
        chars += n
    if first < len(batch):
        yield batch.iloc[first:]


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in READING.split(", ")]
    for batch in (part for whole in batches for part in _parts(whole)):
        rows = []
        for text, code, refs in zip(batch["text"], batch["code"], batch["refs"], strict=True):
            refs = dict(refs) if refs is not None else {}
            done = read(text, list(code), refs)
            rows.append((*done, None, True) if done[0] else (False, done[1], *read(text, list(code), refs, lenient=True)[2:], None, False))
        found = pd.DataFrame([r[:6] for r in rows], columns=columns)
        yield pd.concat([batch[["_row", "text"]].reset_index(drop=True), found], axis=1)


def preamble_commands(text: Column) -> tuple[Column, Column]:
    """Commands that the preamble defines around code (array), and around references (map to the label prefix)."""
    preamble = F.nullif(F.regexp_extract(text, r"(?s)\A(.*?)\\begin\s*\{document\}", 1), F.lit(""))
    pattern = tex.NEW_COMMAND + rf"(?=([^\n]{{0,{tex.BODY_CHARS}}}))"
    names, bodies = (F.coalesce(F.regexp_extract_all(preamble, F.lit(pattern), F.lit(k)), F.array().cast("array<string>")) for k in (1, 2))
    both = F.arrays_zip(names.alias("name"), bodies.alias("body"))
    code = F.transform(F.filter(both, lambda x: x["body"].rlike(tex.CODE_BODY)), lambda x: x["name"])
    refs = F.filter(both, lambda x: x["body"].rlike(tex.REFERENCE_BODY))
    # of several definitions of one name the last one holds
    last = F.filter(refs, lambda x, i: ~F.exists(F.slice(refs, i + 2, F.size(refs)), lambda y: y["name"] == x["name"]))
    return code, F.map_from_entries(F.transform(last, lambda x: F.struct(x["name"], F.regexp_extract(x["body"], tex.REFERENCE_BODY, 1))))


def latex_documents(docs: DataFrame) -> DataFrame:
    """doc_id, text, masked, reader ('parsed', 'lenient' or 'patterns'), error_at, headings, items, atoms.

    ``masked`` is as long as ``text``, so every place holds in the source.  With a ``\\begin{document}`` only its
    body is read.  A null text gives null; an empty one is read as empty.  Sources of any length are walked once.
    Other columns are not read."""
    code, refs = preamble_commands(F.col("text"))
    rows = docs.select(F.struct("doc_id").alias("_row"), F.col("text").cast("string").alias("text"), code.alias("code"), refs.alias("refs"))
    row_type = rows.schema["_row"].dataType.simpleString()
    found = rows.mapInPandas(_read, f"_row {row_type}, text string, {READING}")

    def words(masked: Column) -> Column:
        return F.size(F.regexp_extract_all(masked, F.lit(tex.LENIENT_WORD), F.lit(0)))

    patterns = masked_by_patterns(F.col("text"), "latex")
    reader = F.when(F.col("ok"), "parsed").when(words(F.col("masked")) >= tex.LENIENT_SHARE * words(patterns), "lenient").otherwise("patterns")
    found = found.withColumn("reader", reader)

    def unless(column: str) -> Column:
        return F.when(F.col("reader") == "patterns", F.array()).otherwise(F.col(column)).alias(column)

    masked = F.when(F.col("reader") == "patterns", patterns).otherwise(F.col("masked"))
    return found.select("_row.doc_id", "text", masked.alias("masked"), "reader", F.col("at").alias("error_at"), unless("headings"), unless("items"), unless("atoms"))


def items(read_docs: DataFrame) -> DataFrame:
    """(doc_id, kind, start, end, label), one row an item."""
    return read_docs.select("doc_id", F.explode("items").alias("i")).select("doc_id", "i.*")


def headings(read_docs: DataFrame) -> DataFrame:
    """Headings as ``sections.resolve_sections`` takes them."""
    from marginalia.operators.sections import classify_heading

    rows = read_docs.select("doc_id", F.explode("headings").alias("h")).select("doc_id", "h.start", "h.title", "h.level")
    return rows.withColumn("keyword", classify_heading(F.col("title"))).select("doc_id", "start", "title", "keyword", "level")
