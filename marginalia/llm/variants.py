"""Spelling variants: words one edit apart, found over a reduced alphabet.

Letters are hashed to ``SYMBOLS`` symbols, so a word becomes a short string over few symbols.  Two words that
are one edit apart have reduced words that are equal or one edit apart; the one-edit neighbourhood over few
symbols is small enough to write out in full.  Every pair is made from one side: the word with the lesser
symbol writes the substitutions, the longer word the deletions (its partner would write the insertions), and
equal reduced words meet under the word itself.  Neighbours meet the reduced vocabulary in one equi-join on a
64-bit key; what meets is only a candidate and is verified on the original strings.

Counting is a map over whole texts with numpy and one combinable aggregation by word.  A frequent word is one
row from there on, so no group grows with its occurrences.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.bytewords import _LOWER, U64, as_text, bytes_of, hash_spans, mix, slices
from marginalia.llm.store import cut

SYMBOLS = 8
MIN_CHARS, MIN_COUNT = 5, 3
SHARE, EVERY = 2, 97  # a form has at least twice the count; one run in 97 loses a letter
SLICE = 6 << 20  # bytes of text counted at once

_ASCII = np.zeros(256, dtype=bool)
_ASCII[65:91] = _ASCII[97:123] = True
_CRC = np.array([zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)], dtype=np.uint32)
_BASE = U64(0x9E3779B97F4A7C15)


def letter_runs(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of [A-Za-z\\u00C0-\\u00FF] in UTF-8 rows: starts, ends, row numbers."""
    lead = data == 0xC3  # U+00C0 to U+00FF are C3 and one byte more; no other character holds a C3
    solid = _ASCII[data] | lead
    solid[1:] |= lead[:-1]
    before, after = np.zeros(len(solid), dtype=bool), np.zeros(len(solid), dtype=bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    before[edges[:-1][edges[:-1] < len(before)]] = False
    after[edges[1:][edges[1:] > 0] - 1] = False
    start, end = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    return start, end, np.searchsorted(edges, start, side="right") - 1


def crc_spans(data: np.ndarray, start: np.ndarray, length: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of each span, carried on from a crc32 of what stands before it."""
    out = state.astype(np.uint32)
    live, done = np.flatnonzero(length <= 64), 0
    c = out[live] ^ np.uint32(0xFFFFFFFF)
    while len(live):
        c = _CRC[(c ^ data[start[live] + done]) & np.uint32(255)] ^ (c >> np.uint32(8))
        done += 1
        over = length[live] == done
        out[live[over]] = c[over] ^ np.uint32(0xFFFFFFFF)
        live, c = live[~over], c[~over]
    for i in np.flatnonzero(length > 64):
        out[i] = zlib.crc32(data[start[i] : start[i] + length[i]].tobytes(), int(out[i]))
    return out


def _tally(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct span, and how often it stands; spans are told apart by 128 bits."""
    one = hash_spans(data, start, length)
    two = hash_spans(data ^ np.uint8(0x5A), start, length)
    order = np.argsort(one, kind="stable")
    a, b = one[order], two[order]
    new = np.concatenate([[True], (a[1:] != a[:-1])])
    if ((b[1:] != b[:-1]) & ~new[1:]).any():
        order = np.lexsort((two, one))
        a, b = one[order], two[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    lead = np.flatnonzero(new)
    return order[lead], np.diff(np.append(lead, len(order)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = as_text(batch.column(1))
        at, raw = bytes_of(text)
        prefix = np.array([zlib.crc32(f"{i}:".encode()) for i in batch.column(0).fill_null("").to_pylist()], dtype=np.uint32)
        for rows in slices(at, SLICE):
            base = int(at[rows.start])
            data = _LOWER[np.concatenate([raw[base : int(at[rows.stop])], np.full(8, 32, np.uint8)])]
            start, end, row = letter_runs(data[:-8], at[rows.start : rows.stop + 1] - base)
            if not len(start):
                continue
            crc = crc_spans(data, start, end - start, prefix[rows.start + row])
            wide = np.concatenate([[0], np.cumsum(data == 0xC3)])
            chars = end - start - (wide[end] - wide[start])
            struck = crc % np.uint32(EVERY) == 0
            found: Counter[str] = Counter()
            for i in np.flatnonzero(struck & (chars > MIN_CHARS)):
                run, k = data[start[i] : end[i]].tobytes().decode(), int(crc[i]) % int(chars[i])
                found[run[:k] + run[k + 1 :]] += 1
            whole = np.flatnonzero(~struck & (chars >= MIN_CHARS))
            first, n = _tally(data, start[whole], (end - start)[whole]) if len(whole) else (whole, whole)
            first = whole[first]
            words = [data[a:b].tobytes().decode() for a, b in zip(start[first], end[first], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([*words, *found], pa.string()), pa.array([*n.tolist(), *found.values()], pa.int64())], names=["word", "n"])


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: letter runs of all texts (A-Z lower-cased; one run in 97 loses a letter, by the contract's
    crc32) of at least five code points that occur at least three times."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    return rows.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def symbols(codes: np.ndarray, count: int = SYMBOLS) -> np.ndarray:
    """The symbol of each letter, 1 to ``count``."""
    return (mix(codes.astype(U64) + U64(77)) % U64(count)).astype(np.int64) + 1


def _key(codes: np.ndarray, power: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of a word, and what each adds to the word's key."""
    s = symbols(codes, count)
    return s, s.astype(U64) * power[: len(s)]


def neighbourhood(codes: np.ndarray, power: np.ndarray, count: int = SYMBOLS) -> np.ndarray:
    """Keys of a reduced word (first), of all its substitutions by a greater symbol, and of all its deletions.  A key is
    a polynomial of the symbols modulo 2**64 with the length mixed in, so each neighbour costs one addition."""
    s, part = _key(codes, power, count)
    total, n = part.sum(dtype=U64), len(s)
    more = np.arange(1, count, dtype=U64)
    put = (total + power[:n, None] * more[None, :])[s[:, None] + np.arange(1, count)[None, :] <= count]
    upto = np.concatenate([np.zeros(1, U64), np.cumsum(part, dtype=U64)])
    tail = np.concatenate([np.cumsum((s[1:].astype(U64) * power[: n - 1])[::-1], dtype=U64)[::-1], np.zeros(1, U64)]) if n > 1 else np.zeros(1, U64)
    own = mix(total[None] ^ U64(n))
    return np.concatenate([own, mix(put ^ U64(n)), np.unique(mix((upto[:n] + tail) ^ U64(n - 1)))])


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, _BASE, U64), dtype=U64)


def _codes(word: str) -> np.ndarray:
    return np.frombuffer(word.encode("utf-32-le"), np.uint32)


def _reduced(count: int):
    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = _powers(64)
        for batch in batches:
            keys = []
            for w in batch.column(0).to_pylist():
                codes = _codes(w)
                power = power if len(power) >= len(codes) else _powers(2 * len(codes))
                keys.append(mix(_key(codes, power, count)[1].sum(dtype=U64) ^ U64(len(codes))))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, U64).view(np.int64)), *batch.columns], names=["key", *batch.schema.names])

    return reduced


def _neighbours(count: int):
    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = _powers(64)
        for batch in batches:
            for some in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                keys = []
                for w in some.column(0).to_pylist():
                    codes = _codes(w)
                    power = power if len(power) >= len(codes) else _powers(2 * len(codes))
                    keys.append(neighbourhood(codes, power, count))
                sizes = np.array([len(k) for k in keys])
                ids = np.repeat(some.column(1).to_numpy(), sizes)
                own = np.zeros(len(ids), dtype=bool)
                own[np.cumsum(sizes) - sizes] = True
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(ids), pa.array(own)], names=["key", "a_id", "own"])

    return neighbours


def near_pairs(words: DataFrame, count: int = SYMBOLS) -> DataFrame:
    """a, a_n, b, b_n: all ordered pairs of words (word, n) exactly one edit apart."""
    words = words.select("word", "n")
    named = words.withColumn("a_id", F.xxhash64("word"))
    probes = named.select("word", "a_id").mapInArrow(_neighbours(count), "key long, a_id long, own boolean")
    seats = words.mapInArrow(_reduced(count), "key long, word string, n long")
    met = probes.join(seats, "key").select("a_id", "own", F.col("word").alias("b"), F.col("n").alias("b_n"))
    # two words of one a_id would both be held against b, so the id decides nothing alone
    pairs = met.join(named.select("a_id", F.col("word").alias("a"), F.col("n").alias("a_n")), "a_id").where(_one_edit("a", "b"))
    # words of equal reduced words meet from both sides, all others from one
    pairs = pairs.where("not own or a < b")
    both = F.array(F.struct("a", "a_n", "b", "b_n"), F.struct(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))
    return pairs.select(F.explode(both).alias("p")).select("p.*")


def _one_edit(a: str, b: str) -> Column:
    return F.levenshtein(F.col(a), F.col(b), 1) == 1


def variant_forms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count: int = SYMBOLS) -> DataFrame:
    """One row per word of ``vocabulary``: word, n, form (the near word of largest n, ties to the smallest in
    code-point order, if its n is at least twice the word's; else null), form_n, n_near, root (forms followed to
    the last; the word itself without one).

    Null and empty texts hold no words; a null id counts as the empty text; repeated rows count each.  A run of
    any length is a word; its neighbours cost a key each.  An empty table gives an empty one.  Other columns of
    ``docs`` are not read, whatever their names.
    """
    words = cut(vocabulary(docs, id_col, text_col))
    best = near_pairs(words, count).groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("m"), "b")).alias("top"))
    found = words.join(best, F.col("word") == F.col("a"), "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("top.m") >= SHARE * F.col("n"), F.col("top.b")).alias("form"),
        F.when(-F.col("top.m") >= SHARE * F.col("n"), -F.col("top.m")).alias("form_n"),
    )
    found = cut(found)
    return found.join(_roots(found.where("form is not null").select("word", "form")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def _roots(steps: DataFrame) -> DataFrame:
    """word, root of a table of steps without cycles (counts double along it): pointers jump, so rounds are
    logarithmic in the longest way."""
    steps = steps.select("word", F.col("form").alias("root"))
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = cut(steps.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not steps.where("moved").limit(1).count():
            return steps.select("word", "root")
        steps = steps.select("word", "root")
