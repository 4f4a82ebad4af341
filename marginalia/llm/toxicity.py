"""Toxicity scores by a convolutional text classifier trained in numpy.

Tokens are lower-cased letter runs.  A word's vector is the sum of hashed embeddings of the word and of
its first 4, 5 and 6 bytes, so inflected forms share what their stem has learned.  Filters of widths 1, 2
and 3 slide over whole texts, each keeps its largest answer, and a logistic unit weighs those.  Scores
come from the text alone; the thresholds calibrated by language only say what to reject.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.bytewords import LETTERS, U64, hash_spans, mix, word_batches
from marginalia.llm.sample import bounded
from marginalia.llm.store import cut, unused

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 15, 16, (1, 2, 3), 8
PREFIXES = (4, 5, 6)
#: Labelled rows the weights are fitted on at most, passes over them, and characters a text has at most to
#: be fitted on (longer labelled texts are only scored).
FIT_ROWS, EPOCHS, FIT_CHARS = 4000, 12, 100_000
#: One labelled id in CALIBRATE is set aside for thresholds.
CALIBRATE = 5
#: A language's threshold starts from all languages' scores, which weigh as much as this many positive rows.
PRIOR = 15
_PAD = max(WIDTHS) - 1


def _tokens(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Rows, bucket ids of their words (one column a view of the word), and each row's first word."""
    for part in word_batches(column, lower=True, limit=limit, solid_bytes=LETTERS):
        # capital letters of two bytes, U+00C0 to U+00DE, to their small forms
        data = part.data
        capital = np.zeros(len(data), dtype=bool)
        capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        data = np.where(capital, data + 0x20, data).astype(np.uint8)
        length = part.end - part.start
        views = [hash_spans(data, part.start, np.minimum(length, n)) for n in PREFIXES] + [hash_spans(data, part.start, length)]
        ids = np.column_stack([mix(v + U64(k)) % U64(BUCKETS) for k, v in enumerate(views)]).astype(np.uint16)
        yield part.rows, ids, part.first


@dataclass
class Model:
    """Frozen weights; ``thresholds`` by language, ``threshold`` for all others."""

    table: np.ndarray
    filters: list[np.ndarray]  # by width: (width, DIM, FILTERS)
    offsets: list[np.ndarray]
    weights: np.ndarray
    bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5

    def vectors(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word vectors with _PAD blank words after each text (one at least), where texts begin, and
        which places are words."""
        n = np.diff(first)
        begin = np.concatenate([[0], np.cumsum(np.maximum(n, 1) + _PAD)])
        x = np.zeros((begin[-1], DIM), np.float32)
        real = np.zeros(begin[-1], dtype=bool)
        at = np.arange(len(ids)) + np.repeat(begin[:-1] - first[:-1], n)
        for k in range(ids.shape[1]):
            x[at] += self.table[ids[:, k]]
        real[at] = True
        real[begin[:-1]] = True
        return x, begin, real

    def answers(self, x: np.ndarray, real: np.ndarray) -> Iterator[np.ndarray]:
        for w, offset in zip(self.filters, self.offsets, strict=True):
            z = x @ w[0]
            for k in range(1, len(w)):
                z[:-k] += x[k:] @ w[k]
            z += offset
            z[~real] = -np.inf
            yield z

    def scores(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        if len(first) < 2:
            return np.zeros(0)
        x, begin, real = self.vectors(ids, first)
        pooled = [np.maximum(np.maximum.reduceat(z, begin[:-1], axis=0), 0) for z in self.answers(x, real)]
        logit = np.concatenate(pooled, axis=1) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -30, 30)))


def fit(texts: list[np.ndarray], labels: np.ndarray, seed: int = 5, epochs: int = EPOCHS) -> Model:
    """Adagrad on the logistic loss, classes weighed alike.  Labels of one class only teach nothing: all
    texts get one score, and no threshold is ever reached."""
    rng = np.random.default_rng(seed)
    model = Model(
        rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32),
        [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32),
        0.0,
    )
    if not len(texts) or labels.min() == labels.max():
        model.weights[:] = 0
        model.bias = float(np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5))) if len(labels) else -5.0
        model.threshold = float("inf")
        return model
    used = rng.permutation(len(texts))
    balance = np.where(labels == 1, 0.5 / max(labels[used].mean(), 1e-3), 0.5 / max(1 - labels[used].mean(), 1e-3))
    table_sq = np.full(BUCKETS, 1e-2, np.float32)
    squares = [np.full(w.shape, 1e-2, np.float32) for w in model.filters] + [np.full(model.weights.shape, 1e-2, np.float32)]
    rate = 0.05
    for _ in range(epochs):
        rng.shuffle(used)
        for k in range(0, len(used), 32):
            batch = used[k : k + 32]
            first = np.cumsum([0, *(len(texts[i]) for i in batch)])
            ids = np.concatenate([texts[i] for i in batch])
            x, begin, real = model.vectors(ids, first)
            pooled, places = [], []
            for z in model.answers(x, real):
                spot = np.stack([z[a:b].argmax(axis=0) + a for a, b in zip(begin[:-1], begin[1:], strict=True)])
                places.append(spot)
                pooled.append(np.take_along_axis(z, spot, axis=0))
            top = np.concatenate(pooled, axis=1)
            hidden = np.maximum(top, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ model.weights + model.bias, -30, 30)))
            error = ((p - labels[batch]) * balance[batch] / len(batch)).astype(np.float32)
            back = error[:, None] * model.weights[None, :] * (top > 0)
            grad_x = np.zeros_like(x)
            for j, (w, spot) in enumerate(zip(model.filters, places, strict=True)):
                g = back[:, j * FILTERS : (j + 1) * FILTERS]
                step = np.zeros_like(w)
                for s in range(len(w)):
                    at = np.minimum(spot + s, len(x) - 1)
                    step[s] = np.einsum("bf,bfd->df", g, x[at])
                    np.add.at(grad_x, at.ravel(), (g[:, :, None] * w[s].T[None]).reshape(-1, DIM))
                squares[j] += step**2
                w -= rate * step / np.sqrt(squares[j])
                model.offsets[j] -= rate * g.sum(axis=0)
            step = hidden.T @ error
            squares[-1] += step**2
            model.weights -= rate * step / np.sqrt(squares[-1])
            model.bias -= rate * float(error.sum())
            n = np.diff(first)
            at = np.arange(len(ids)) + np.repeat(begin[:-1] - first[:-1], n)
            hot = np.flatnonzero(np.abs(grad_x[at]).sum(axis=1) > 0)
            rows = ids[hot].ravel().astype(np.int64)
            step = np.repeat(grad_x[at[hot]], ids.shape[1], axis=0)
            np.add.at(table_sq, rows, (step**2).mean(axis=1))
            np.add.at(model.table, rows, -rate * step / np.sqrt(table_sq[rows])[:, None])
    return model


def calibrate(model: Model, counts: dict[tuple[str | None, int], np.ndarray]) -> None:
    """Thresholds from score histograms: counts[language, label] has 100 bins of 0.01.  A threshold is the
    best F1's; of several as good, the one nearest 0.5."""
    if model.threshold == float("inf"):
        return

    def of(label: int, lang: str | None = None, every: bool = False) -> np.ndarray:
        return sum((c for (name, y), c in counts.items() if y == label and (every or name == lang)), np.zeros(100))

    def best(toxic: np.ndarray, clean: np.ndarray) -> float:
        if not toxic.sum():
            return 0.5
        above = np.cumsum(toxic[::-1])[::-1]
        f1 = (2 * above / (above + np.cumsum(clean[::-1])[::-1] + toxic.sum()))[5:96]
        good = np.arange(5, 96)[f1 >= f1.max() - 1e-9] / 100
        return float(good[np.abs(good - 0.5).argmin()])

    toxic, clean = of(1, every=True), of(0, every=True)
    model.threshold = best(toxic, clean)
    share = PRIOR / max(1.0, toxic.sum())
    for lang in {name for name, _ in counts if name is not None}:
        model.thresholds[lang] = best(of(1, lang) + share * toxic, of(0, lang) + share * clean)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, ids, first in _tokens(batch.column("text")):
            packed = pa.array([ids[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())
            n = rows.stop - rows.start
            yield pa.RecordBatch.from_arrays([batch.column("k").slice(rows.start, n), batch.column("lang").slice(rows.start, n), batch.column("label").slice(rows.start, n), packed], names=["k", "lang", "label", "ids"])


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Weights fitted on at most ``rows`` labelled documents, thresholds on all labelled ids set aside (a hash of
    the id says which are which).

    Labels are those of rows of ``labels`` (doc_id, toxic) with toxic 0 or 1; an id labelled both ways or
    more than once counts by its largest label.  Ids without a document and null ids teach nothing.
    """
    marked = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    aside = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(CALIBRATE)) == 0
    text = docs.select(F.col("doc_id").alias("k"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))

    def of(some: DataFrame) -> DataFrame:
        return text.join(some, text["k"] == some["doc_id"]).select("k", "lang", "label", "text")

    chosen = bounded(cut(of(F.broadcast(bounded(marked.where(~aside), rows))).where(F.coalesce(F.length("text"), F.lit(0)) <= FIT_CHARS)), rows)
    encoded = chosen.select(F.col("k").cast("long").alias("k"), "lang", "label", "text").mapInArrow(_encode, "k long, lang string, label int, ids binary")
    found = sorted(encoded.toLocalIterator(), key=lambda r: (r["k"], bytes(r["ids"])))
    texts = [np.frombuffer(r["ids"], np.uint16).reshape(-1, len(PREFIXES) + 1) for r in found]
    model = fit(texts, np.array([r["label"] for r in found]))
    scores = scored(of(marked.where(aside)), model)
    bins = scores.groupBy("lang", "label", F.least(F.floor(F.col("_score") * 100), F.lit(99)).cast("int").alias("bin")).count()
    counts: dict[tuple[str | None, int], np.ndarray] = {}
    for lang, label, at, n in bins.collect():  # 200 rows a language at most
        counts.setdefault((lang, label), np.zeros(100))[at] += n
    calibrate(model, counts)
    return model


def _score(model, score_col: str):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *kept, text = batch.columns  # by place: names may clash
            found = [model.value.scores(ids, first) for _, ids, first in _tokens(text)]
            values = pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*kept, values], names=[*batch.schema.names[:-1], score_col])

    return score


def scored(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "_score") -> DataFrame:
    """All columns of ``docs``, and ``score_col`` (0 to 1), which replaces a column of that name.  Null and
    empty texts get the score of a text without words.  Whole texts are read; an empty table stays empty."""
    known = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: BUCKETS * DIM floats
    names = [c for c in docs.columns if c.lower() != score_col.lower()]
    source = docs.select(*(F.col(f"`{c}`") for c in names), F.col(text_col).cast("string").alias(unused("text_", docs)))
    fields = [docs.schema[c] for c in names]
    schema = T.StructType([*fields, T.StructField(score_col, T.DoubleType())])
    return source.mapInArrow(_score(known, score_col), schema)


def threshold(model: Model, lang_col: str = "lang"):
    """The calibrated threshold of a row's language."""
    out = F.lit(model.threshold)
    for lang, t in sorted(model.thresholds.items()):
        out = F.when(F.col(lang_col) == lang, t).otherwise(out)
    return out
