"""Language identification by prediction by partial matching (PPM) over bytes.

Each language has a byte context tree of order ``ORDER``: per context the counts of the bytes that follow
it and, as escape probability, its distinct bytes d over n + d (method C, without exclusion).  A byte's
code length in a language is that of the longest context in which it was seen, plus the escapes of the
longer contexts that were seen without it; below order 0 every byte costs eight bits.  Statistics are
frozen after fitting, so a byte's code length depends on the ``ORDER`` bytes before it only: fitting
tabulates it for every gram seen, and scoring is one lookup a byte, with escapes for grams never seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.bytewords import U64, as_text, bytes_of, slices
from marginalia.llm.sample import share_of

ORDER = 4
#: A model is fitted on about this many documents and bytes a language at most, and on this many languages,
#: the most frequent; a rarer language is never predicted.  The model's size grows with the languages.
FIT_DOCS, FIT_BYTES, FIT_LANGS = 400, 2_000_000, 256
UNKNOWN = "und"
_C = U64(0x9E3779B97F4A7C15)


class Table:
    """Gram -> row of costs, by open addressing; row 0 stands for grams not in the table."""

    def __init__(self, grams: np.ndarray, costs: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(len(grams), 1) * 2.5))))
        self.keys = np.zeros(1 << self.bits, U64)
        self.rows = np.zeros(1 << self.bits, np.int32)
        self.costs = np.vstack([np.zeros((1, costs.shape[1]), np.float32), costs.astype(np.float32)])
        self.probes = 0
        left = np.arange(len(grams))
        slot = self._slot(grams)
        while len(left):
            self.probes += 1
            free = self.rows[slot[left]] == 0
            at, one = np.unique(slot[left][free], return_index=True)
            won = left[free][one]
            self.keys[at], self.rows[at] = grams[won], won + 1
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        return ((grams * _C) >> U64(64 - self.bits)).astype(np.int64)

    def find(self, grams: np.ndarray) -> np.ndarray:
        slot = self._slot(grams)
        row = np.where(self.keys[slot] == grams, self.rows[slot], 0)
        open_ = np.flatnonzero((row == 0) & (self.rows[slot] != 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            here = slot[open_]
            hit = self.keys[here] == grams[open_]
            row[open_[hit]] = self.rows[here[hit]]
            open_ = open_[~hit & (self.rows[here] != 0)]
        return row


@dataclass
class Model:
    langs: list[str]
    seen: list[Table]  # by order: code lengths of (context, byte), resolved for every language
    escape: list[Table]  # by order: escape cost of a context, 0 where a language has not seen it

    def lengths(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Bits of each text in each language; text r is data[bounds[r]:bounds[r + 1]].  Every text is
        read as if ORDER blanks stood before it."""
        out = np.zeros((len(bounds) - 1, len(self.langs)))
        if not len(data):
            return out
        code = grams_of(data, bounds, ORDER)
        total = np.zeros((len(data), len(self.langs)), np.float32)
        todo = np.arange(len(data))
        for k in range(ORDER, -1, -1):
            gram = code[todo] & U64((1 << (8 * (k + 1))) - 1)
            row = self.seen[k].find(gram)
            hit = row != 0
            total[todo[hit]] += self.seen[k].costs[row[hit]]
            todo, gram = todo[~hit], gram[~hit]
            if not len(todo):
                break
            total[todo] += self.escape[k].costs[self.escape[k].find(gram >> U64(8))]
        total[todo] += 8.0
        full = np.flatnonzero(np.diff(bounds) > 0)
        out[full] = np.add.reduceat(total, bounds[full], axis=0, dtype=np.float64)
        return out


def grams_of(data: np.ndarray, bounds: np.ndarray, order: int) -> np.ndarray:
    """Each byte and the `order` bytes before it as one number, the byte itself lowest."""
    code = data.astype(U64)
    begin = np.repeat(bounds[:-1], np.diff(bounds))
    place = np.arange(len(data)) - begin
    for k in range(1, order + 1):
        back = np.full(len(data), 32, np.uint8)
        back[k:] = data[:-k] if len(data) > k else data[:0]
        back[place < k] = 32
        code |= back.astype(U64) << U64(8 * k)
    return code


def fit(texts: dict[str, list[bytes]]) -> Model:
    langs = sorted(texts)
    counts: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(ORDER + 1)]
    for lang in langs:
        data = np.frombuffer(b"".join(texts[lang]), np.uint8)
        bounds = np.cumsum([0, *map(len, texts[lang])])
        code = grams_of(data, bounds, ORDER)
        for k in range(ORDER + 1):
            counts[k].append(np.unique(code & U64((1 << (8 * (k + 1))) - 1), return_counts=True))
    seen: list[Table] = []
    escape: list[Table] = []
    for k in range(ORDER + 1):
        grams = np.unique(np.concatenate([g for g, _ in counts[k]])) if langs else np.zeros(0, U64)
        contexts = np.unique(grams >> U64(8))
        leave = np.zeros((len(contexts), len(langs)))
        # what a gram costs where this order has not seen it: the escape, then the order below
        below = np.full((len(grams), len(langs)), 8.0)
        if k:
            row = seen[k - 1].find(grams & U64((1 << (8 * k)) - 1))
            below = seen[k - 1].costs[row].astype(np.float64)
        cost = np.zeros((len(grams), len(langs)))
        for j in range(len(langs)):
            g, n = counts[k][j]
            ctx, first, which = np.unique(g >> U64(8), return_index=True, return_inverse=True)
            total = np.add.reduceat(n, first) if len(g) else np.zeros(0)
            kinds = np.diff(np.append(first, len(g)))
            leave[np.searchsorted(contexts, ctx), j] = np.log2((total + kinds) / np.maximum(kinds, 1))
            cost[:, j] = below[:, j] + leave[np.searchsorted(contexts, grams >> U64(8)), j]
            cost[np.searchsorted(grams, g), j] = np.log2((total + kinds)[which] / n)
        seen.append(Table(grams, cost))
        escape.append(Table(contexts, leave))
    return Model(langs, seen, escape)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", per_lang: int = FIT_DOCS, max_langs: int = FIT_LANGS, max_bytes: int = FIT_BYTES) -> Model:
    """Fit on whole documents of each language, about ``per_lang`` of them and ``max_bytes`` bytes, chosen by
    a hash of the row; documents that are longer alone are not among them.

    A language is learned if it is not null, is among the ``max_langs`` most frequent (ties: the first in
    code point order) and has a text that is not empty.
    """
    rows = docs.select(F.col(key_col).alias("k"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    size = F.octet_length("text")
    rows = rows.where(F.col("lang").isNotNull() & (size > 0) & (size <= max_bytes))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).orderBy(F.desc("n"), "lang").limit(max_langs).collect()
    share = F.lit(None).cast("double")
    for lang, n, total in counts:
        share = F.when(F.col("lang") == lang, min(1.0, per_lang / n, max_bytes / total)).otherwise(share)
    chosen = rows.where(share_of([F.col("k"), F.col("lang"), F.col("text")], share, 29))
    # rows alike in every column are chosen together, and teach as one
    texts: dict[str, list[bytes]] = {}
    for lang, text in chosen.distinct().orderBy("k", "text").select("lang", "text").toLocalIterator():
        texts.setdefault(lang, []).append(text.encode())
    return fit(texts)


def _predict(model):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for batch in batches:
            text = as_text(batch.column("text"))
            at, raw = bytes_of(text)
            langs: list[str] = []
            score: list[np.ndarray] = []
            for rows in slices(at, 1 << 20):
                base = int(at[rows.start])
                bounds = at[rows.start : rows.stop + 1] - base
                bits = m.lengths(raw[base : int(at[rows.stop])], bounds)
                best = bits.argmin(axis=1)
                with np.errstate(under="ignore"):
                    odds = np.exp2(bits.min(axis=1, keepdims=True) - bits)
                langs += [m.langs[b] for b in best]
                score.append(1.0 / odds.sum(axis=1))
            letter = batch.column("letter").to_numpy(zero_copy_only=False).astype(bool)
            named = [lang if ok else UNKNOWN for lang, ok in zip(langs, letter, strict=True)]
            value = np.where(letter, np.concatenate(score) if score else np.zeros(0), 0.0)
            keep = [n for n in batch.schema.names if n not in ("text", "letter")]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], pa.array(named, pa.string()), pa.array(value, pa.float64())], names=[*keep, "lang_pred", "score"])

    return predict


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id as doc_id, lang_pred, and score, the posterior under equal priors.

    ``und`` with score 0 where the text is null or has no letter, or where nothing was learned.  Equal
    code lengths: the first language in code point order.  Whole texts are read; other columns are not.
    """
    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    if not model.langs:
        return source.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    known = docs.sparkSession.sparkContext.broadcast(model)  # bounded by FIT_LANGS * FIT_BYTES
    id_type = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(_predict(known), f"doc_id {id_type}, lang_pred string, score double")
