"""What an edit changed, as segments of words kept, taken out and put in.

Texts are split into words and what lies between.  What both share at their ends is set aside by columns; the rest,
as long as the edit and not as the text, is compared in an Arrow-fed task by furthest reaching paths, whose work and
memory grow with its length times the number of changes.  The kept words are a longest common subsequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = r"\s+|[^\s\w]|\w+"
SEGMENTS = "array<struct<op:string,text:string>>"


def steps(a: list[str], b: list[str]) -> list[tuple[str, int]]:
    """Operations from ``a`` to ``b``: ('same' or 'del', place in a) and ('ins', place in b)."""
    n, m, reach, trace = len(a), len(b), {1: 0}, []
    for d in range(n + m + 1):
        trace.append(dict(reach))
        for k in range(-d, d + 1, 2):
            down = k == -d or (k != d and reach[k - 1] < reach[k + 1])
            x = reach[k + 1] if down else reach[k - 1] + 1
            while x < n and x - k < m and a[x] == b[x - k]:
                x += 1
            reach[k] = x
            if x >= n and x - k >= m:
                return _back(a, b, trace, d)
    return []


def _back(a: list[str], b: list[str], trace: list[dict[int, int]], d: int) -> list[tuple[str, int]]:
    x, y, out = len(a), len(b), []
    for step in range(d, -1, -1):
        reach, k = trace[step], x - y
        down = k == -step or (k != step and reach[k - 1] < reach[k + 1])
        px = reach[k + 1] if down else reach[k - 1]
        py = px - (k + 1 if down else k - 1)
        while x > max(px, 0) and y > max(py, 0) and (x, y) != ((px, py + 1) if down else (px + 1, py)):
            x, y = x - 1, y - 1
            out.append(("same", x))
        if step:
            out.append(("ins", py) if down else ("del", px))
            x, y = px, py
    return out[::-1]


def segments(a: list[str], b: list[str]) -> list[dict[str, str]]:
    """Neighbouring words of one operation are one segment; where words are replaced, those taken out come first."""
    out: list[dict[str, str]] = []
    gone, come = "", ""

    def flush() -> None:
        nonlocal gone, come
        out.extend({"op": o, "text": t} for o, t in (("del", gone), ("ins", come)) if t)
        gone = come = ""

    for op, at in steps(a, b):
        if op == "same":
            flush()
            if out and out[-1]["op"] == "same":
                out[-1]["text"] += a[at]
            else:
                out.append({"op": op, "text": a[at]})
        elif op == "del":
            gone += a[at]
        else:
            come += b[at]
    flush()
    return out


def _compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        done = [segments(list(a), list(b)) for a, b in zip(frame["_a"], frame["_b"], strict=True)]
        yield pd.DataFrame({"_key": frame["_key"], "segments": done, "_n": [sum(o == "same" for o, _ in steps(list(a), list(b))) for a, b in zip(frame["_a"], frame["_b"], strict=True)]})


def diffed(rows: DataFrame, key: str, word: str = WORD) -> DataFrame:
    """``rows`` (key, before, after) to key, segments (op: same, del or ins; text), n_before, n_after, n_kept (words).

    Segments kept and taken out spell ``before``, kept and put in ``after``.  Null texts are empty; rows that share a
    key are compared each, and come back with it."""
    parts = [F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(word), F.lit(0)).alias(n) for c, n in (("before", "a"), ("after", "b"))]
    r = rows.select(key, *parts)
    unlike = F.array_position(F.transform(F.arrays_zip("a", "b"), lambda z: z["a"].eqNullSafe(z["b"])), F.lit(False))
    r = r.withColumn("head", F.when(unlike == 0, F.size("a")).otherwise(unlike - 1).cast("int"))
    a, b = (F.slice(c, F.col("head") + 1, F.size(c)) for c in "ab")
    r = r.withColumns({"a2": a, "b2": b})
    unlike = F.array_position(F.transform(F.arrays_zip(F.reverse("a2").alias("a"), F.reverse("b2").alias("b")), lambda z: z["a"].eqNullSafe(z["b"])), F.lit(False))
    r = r.withColumn("tail", F.when(unlike == 0, F.size("a2")).otherwise(unlike - 1).cast("int"))
    ends = F.struct(F.col(key), F.array_join(F.slice("a", F.lit(1), F.col("head")), "").alias("head"), F.array_join(F.slice("a", F.size("a") - F.col("tail") + 1, F.col("tail")), "").alias("tail"), F.size("a").alias("n_before"), F.size("b").alias("n_after"), (F.col("head") + F.col("tail")).alias("n"))
    middle = r.select(ends.alias("_key"), F.slice("a2", F.lit(1), F.size("a2") - F.col("tail")).alias("_a"), F.slice("b2", F.lit(1), F.size("b2") - F.col("tail")).alias("_b"))
    found = middle.mapInPandas(_compare, f"_key {middle.schema['_key'].dataType.simpleString()}, segments {SEGMENTS}, _n int")
    edge = [F.filter(F.array(F.struct(F.lit("same").alias("op"), F.col(f"_key.{c}").alias("text"))), lambda s: s["text"] != "") for c in ("head", "tail")]
    return found.select(F.col(f"_key.{key}").alias(key), F.concat(edge[0], "segments", edge[1]).alias("segments"), F.col("_key.n_before").alias("n_before"), F.col("_key.n_after").alias("n_after"), (F.col("_key.n") + F.col("_n")).alias("n_kept"))
