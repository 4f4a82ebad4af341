"""Reading manuscripts: text files, Word files, zipped projects; writing findings.

Every reader gives rows with an error column instead of failing on a bad file.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = {"md": "markdown", "qmd": "markdown", "rmd": "markdown", "markdown": "markdown", "tex": "latex", "ltx": "latex", "txt": "plain", "docx": "word", "zip": "project"}
MOST_CHARS = 1_000_000
#: Limits on zipped input: entries, bytes unpacked, ratio of unpacked to packed.
ZIP_ENTRIES, ZIP_BYTES, ZIP_RATIO = 200, 50 << 20, 100
INCLUDE_DEPTH = 10
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def kind_of(path: Column) -> Column:
    """Kind by suffix; null for files that are not read."""
    table = F.create_map(*[F.lit(x) for p in KINDS.items() for x in p])
    return F.try_element_at(table, F.lower(F.substring_index(path, ".", -1)))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, text, content, error) of all files under a path; text is decoded UTF-8 without mark."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    rows = files.withColumn("kind", kind_of(F.col("path")))
    plain = F.col("kind").isin("markdown", "latex", "plain")
    text = F.when(plain, F.regexp_replace(F.try_validate_utf8("content"), "^\ufeff", ""))
    error = (
        F.when(F.col("kind").isNull(), "unsupported_file")
        .when(plain & F.col("text").isNull(), "not_utf8")
        .when(F.length("text") > MOST_CHARS, "too_long")
    )
    return rows.withColumn("text", text).withColumn("error", error).withColumn("text", F.when(F.col("error").isNull(), F.col("text")))


def safe_entries(data: bytes) -> tuple[dict[str, bytes], str | None]:
    """Files of an archive, or why it is refused."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        return {}, "bad_zip"
    entries = archive.infolist()
    total = sum(e.file_size for e in entries)
    if len(entries) > ZIP_ENTRIES:
        return {}, "too_many_entries"
    if total > ZIP_BYTES or total > ZIP_RATIO * max(1, sum(e.compress_size for e in entries)):
        return {}, "too_large"
    for e in entries:
        outside = e.filename.startswith(("/", "\\")) or ".." in e.filename.replace("\\", "/").split("/")
        if outside or e.flag_bits & 1 or (e.external_attr >> 16) & 0o170000 == 0o120000:
            return {}, "unsafe_entry"
    return {e.filename: archive.read(e) for e in entries if not e.is_dir()}, None


def docx_paragraphs(data: bytes) -> tuple[list[tuple[str, str, str]], str | None]:
    """(text, style, body or table) in order; deleted and hidden text left out, insertions kept."""
    files, error = safe_entries(data)
    if error or "word/document.xml" not in files:
        return [], error or "not_a_document"
    try:
        root = ElementTree.fromstring(files["word/document.xml"])
    except ElementTree.ParseError:
        return [], "bad_xml"
    cells = {id(p) for t in root.iter(f"{_W}tbl") for p in t.iter(f"{_W}p")}
    out = []
    for p in root.iter(f"{_W}p"):
        gone = {id(r) for d in p.iter(f"{_W}del") for r in d.iter(f"{_W}r")}
        parts = []
        for run in p.iter(f"{_W}r"):
            hidden = run.find(f"{_W}rPr/{_W}vanish") is not None
            if id(run) not in gone and not hidden:
                parts += [(n.text or "") if n.tag == f"{_W}t" else "\t" if n.tag == f"{_W}tab" else " " if n.tag == f"{_W}br" else "" for n in run]
        style = p.find(f"{_W}pPr/{_W}pStyle")
        out.append(("".join(parts), style.get(f"{_W}val", "") if style is not None else "", "table" if id(p) in cells else "body"))
    return out, None


def docx_styles(data: bytes) -> list[tuple[str, str | None, str | None, str | None]]:
    """(style id, name, outline level as written, style it is based on) of a file's styles; none of a bad file."""
    files, error = safe_entries(data)
    if error or "word/styles.xml" not in files:
        return []
    try:
        root = ElementTree.fromstring(files["word/styles.xml"])
    except ElementTree.ParseError:
        return []

    def val(style, path):
        found = style.find(path)
        return None if found is None else found.get(f"{_W}val")

    styles = root.iter(f"{_W}style")
    return [(s.get(f"{_W}styleId"), val(s, f"{_W}name"), val(s, f"{_W}pPr/{_W}outlineLvl"), val(s, f"{_W}basedOn")) for s in styles if s.get(f"{_W}styleId")]


def expand_project(files: dict[str, str]) -> tuple[str, list[tuple[str, int, int, int]], str | None]:
    """Main file with its inputs put in place, and segments (path, start, end, start in that file)."""
    mains = [p for p, t in files.items() if p.endswith(".tex") and "\\documentclass" in t]
    if not mains:
        return "", [], "no_main_file"
    include = re.compile(r"\\(?:input|include|subfile)\{([^{}]+)\}")
    main = max(mains, key=lambda p: (len(include.findall(files[p])), len(files[p]), -p.count("/"), p))
    text: list[str] = []
    segments: list[tuple[str, int, int, int]] = []
    size = 0

    def put(path: str, a: int, b: int) -> None:
        nonlocal size
        if b > a:
            text.append(files[path][a:b])
            segments.append((path, size, size + b - a, a))
            size += b - a

    def walk(path: str, open_: tuple[str, ...]) -> None:
        at = 0
        for m in include.finditer(files[path]):
            found = None
            for base in (posixpath.dirname(main), posixpath.dirname(path)):
                target = posixpath.normpath(posixpath.join(base, m[1].strip()))
                found = found or next((p for p in (target + ".tex", target) if p in files and not p.startswith("..")), None)
            if found and found not in open_ and len(open_) < INCLUDE_DEPTH:
                put(path, at, m.start())
                walk(found, (*open_, found))
                at = m.end()
        put(path, at, len(files[path]))

    walk(main, (main,))
    return "".join(text), segments, None


def word_paragraphs(files: DataFrame) -> DataFrame:
    """(path, idx, text, style, kind, start, error) of Word files; start counts two characters between
    paragraphs."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                paragraphs, error = docx_paragraphs(bytes(content))
                at = 0
                for k, (text, style, kind) in enumerate(paragraphs):
                    rows.append((path, k, text, style, kind, at, None))
                    at += len(text) + 2
                if error:
                    rows.append((path, None, None, None, None, None, error))
            yield pd.DataFrame(rows, columns=["path", "idx", "text", "style", "kind", "start", "error"]).astype({"idx": "Int32", "start": "Int64"})

    return files.where("kind = 'word'").select("path", "content").mapInPandas(parse, "path string, idx int, text string, style string, kind string, start long, error string")


def word_styles(files: DataFrame) -> DataFrame:
    """(path, style_id, name, level, based_on) of Word files, as ``operators.styles`` takes them."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(path, *s) for path, content in zip(batch["path"], batch["content"], strict=True) for s in docx_styles(bytes(content))]
            yield pd.DataFrame(rows, columns=["path", "style_id", "name", "level", "based_on"])

    return files.where("kind = 'word'").select("path", "content").mapInPandas(parse, "path string, style_id string, name string, level string, based_on string")


def projects(files: DataFrame) -> DataFrame:
    """(path, text, segments, error) of zipped LaTeX projects."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                entries, error = safe_entries(bytes(content))
                text, segments = "", []
                if not error:
                    texts = {p: b.decode("utf-8", "replace") for p, b in entries.items() if p.endswith((".tex", ".ltx"))}
                    text, segments, error = expand_project(texts)
                rows.append((path, text, [{"path": p, "start": a, "end": b, "source_start": s} for p, a, b, s in segments], error))
            yield pd.DataFrame(rows, columns=["path", "text", "segments", "error"])

    return files.where("kind = 'project'").select("path", "content").mapInPandas(parse, "path string, text string, segments array<struct<path:string,start:int,end:int,source_start:int>>, error string")


def jsonl_events(spark: SparkSession, path: str, schema: str = "t double, event string, rule string, section string, source string, n long") -> DataFrame:
    """Event lines; lines that do not parse are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def labels_json(spark: SparkSession, path: str) -> DataFrame:
    """Verdict files, read strictly: a file with an unknown field is refused."""
    schema = "version int, labels array<struct<paragraph:int,rule_id:string,category:string,section:string,verdict:string>>"
    raw = spark.read.text(path, wholetext=True)
    known = F.array(F.lit("version"), F.lit("labels"))
    strict = raw.withColumn("ok", F.size(F.array_except(F.json_object_keys("value"), known)) == 0).withColumn("doc", F.from_json("value", schema, {"mode": "FAILFAST"}))
    return strict.withColumn("doc", F.when(F.col("ok"), F.col("doc")).otherwise(F.raise_error(F.lit("unknown field in a verdict file")))).select(F.explode("doc.labels").alias("l")).select("l.*")


def edited_sentences(text: DataFrame) -> DataFrame:
    """(before, after) of <sentence> elements with <del> and <ins> marks."""
    s = text.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<sentence[^>]*>(.*?)</sentence>"), F.lit(1))).alias("s"))
    before = F.regexp_replace(F.regexp_replace("s", r"(?s)<ins>.*?</ins>", ""), r"</?del>", "")
    after = F.regexp_replace(F.regexp_replace("s", r"(?s)<del>.*?</del>", ""), r"</?ins>", "")
    return s.select(before.alias("before"), after.alias("after"), F.size(F.regexp_extract_all("s", F.lit(r"<(?:del|ins)>"), F.lit(0))).alias("n_edits"))


def write_findings(findings: DataFrame, path: str, form: str = "parquet") -> None:
    """Findings as parquet or JSON lines, one folder a rule."""
    findings.write.mode("overwrite").partitionBy("rule_id").format(form).save(path)
