"""Exact removal of repeated word windows by recompression.

Words are parsed in rounds: the first names runs of one word, each further one names pairs of
neighbouring symbols, the left one from one half of the symbols and the right one from the other.
Names are hashes of what they stand for, so a symbol has the same name in every task without a
dictionary, and the parsing rounds run in one pass.  Each symbol carries the range of words its parse
depends on; symbols whose range lies within a window are parsed alike wherever that window occurs.  The
last naming step names runs of ``SPAN`` symbols, about seven words each; a window's anchor is the least
of those high symbols inside it, so equal windows have equal anchors at equal places.

Two Spark rounds follow.  The first finds the high symbols that stand at more than one place: only
windows around a shared one can repeat.  The second verifies those windows: they meet by anchor, offset
and a hash of their words, 96 bits in all, and all but the earliest go.  In both rounds what meets is a
single name or window, never all that surrounds it, and what is alike within one batch is told there and
sent once, so a passage that millions of documents share is one entry a batch.  Entries travel packed by
bucket; buckets grow in number with the text, and a task holds the distinct entries of one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.bytewords import U64, grams, join2, mix, word_batches
from marginalia.llm.rowkeys import keyed
from marginalia.llm.store import cut

WINDOW, PAIR_ROUNDS, SPAN = 20, 2, 4
#: Bytes of text for which there is one bucket of entries, and one group of documents that places are told to.
BUCKET_BYTES, HOME_BYTES = 8 << 20, 16 << 20


def _runs(words, row):
    """Round 0: a maximal run of one word becomes one symbol.  It depends on the word on each side."""
    head = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]) | (row[1:] != row[:-1])]))
    size = np.diff(np.append(head, len(words)))
    name = np.where(size == 1, words[head], join2(words[head], size.astype(U64)))
    return name, head, head - 1, head + size, row[head]


def _dependent(left, right, row, first):
    """A symbol depends on what both neighbours depend on.  At a text's ends it depends on the place
    beyond, which lies in no window; so both bounds rise from symbol to symbol, over texts too."""
    same = row[1:] == row[:-1]
    new_left, new_right = first[row] - 1, first[row + 1]
    new_left[1:][same] = left[:-1][same]
    new_right[:-1][same] = right[1:][same]
    return new_left, new_right


def _pairs(name, start, left, right, row, first, seed: int):
    """A pair round: neighbours become one symbol if the first is of the left half, the second not."""
    dep_left, dep_right = _dependent(left, right, row, first)
    half = (mix(name ^ mix(np.array([seed], U64))) & U64(1)).astype(bool)
    joins = np.zeros(len(name), dtype=bool)
    joins[:-1] = half[:-1] & ~half[1:] & (row[1:] == row[:-1])
    stays = np.ones(len(name), dtype=bool)
    stays[1:] = ~joins[:-1]
    at = np.flatnonzero(stays)
    last = at + joins[at]
    named = name[at].copy()
    two = joins[at]
    named[two] = join2(name[at[two]], name[last[two]])
    return named, start[at], dep_left[at], dep_right[last], row[at]


def anchors(words: np.ndarray, first: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window that lies in one text: its first word, its anchor's name and first word."""
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(words), dtype=np.int64)
    window = place[: max(0, len(words) - width + 1)]
    window = window[row[window] == row[window + width - 1]] if len(window) else window
    if not len(window):
        return window, np.zeros(0, U64), window
    symbols = _runs(words, row)
    for k in range(PAIR_ROUNDS):
        symbols = _pairs(*symbols, first, seed=k + 1)
    name, start, left, right, _ = symbols
    fallback = grams(words, width)[window]
    if len(name) < SPAN:
        return window, fallback, window
    long_name = grams(name, SPAN)
    left, right, start = left[: len(long_name)], right[SPAN - 1 :], start[: len(long_name)]
    lo = np.searchsorted(left, window, side="left")
    hi = np.searchsorted(right, window + width - 1, side="right") - 1
    size = hi - lo + 1
    rank = mix(long_name ^ U64(0x51ED270B))
    at = np.zeros(len(window), np.int64)
    least, span = np.arange(len(rank)), 1  # place of the least rank in each stretch of `span` symbols

    def lesser(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(rank[b] < rank[a], b, a)

    while True:
        here = (size >= span) & (size < 2 * span)
        at[here] = lesser(least[lo[here]], least[hi[here] - span + 1])
        if 2 * span > size.max(initial=0):
            break
        least = lesser(least[:-span], least[span:])
        span *= 2
    found = size > 0
    return window, np.where(found, long_name[at], fallback), np.where(found, start[at], window)


def _runs_of(window: np.ndarray, name: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where a new anchor begins among the windows."""
    return np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (name[1:] != name[:-1]) | (np.diff(window) != 1)]))


#: One row: a bucket's entries of one batch, packed (8 bytes a key, 4 a check, 8 a document, 4 a place), or
#: places already ``told``, whose bucket is that of their documents.
_ENTRIES = "bucket int, told boolean, keys binary, checks binary, docs binary, places binary"


def _packed(bucket: np.ndarray, told: bool, *columns: np.ndarray | None) -> pa.RecordBatch:
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    head = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    ends = np.append(head, len(bucket))

    def blob(column: np.ndarray | None) -> pa.Array:
        if column is None:
            return pa.array([b""] * len(head), pa.binary())
        data = np.ascontiguousarray(column[order])
        return pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer((ends * data.itemsize).astype(np.int32)), pa.py_buffer(data)])

    cols = [pa.array(bucket[head].astype(np.int32)), pa.array(np.full(len(head), told)), *(blob(c) for c in columns)]
    return pa.RecordBatch.from_arrays(cols, names=["bucket", "told", "keys", "checks", "docs", "places"])


def _unpacked(column: pa.Array, rows: np.ndarray, kind: type) -> np.ndarray:
    """The values of these rows, one row's after the other's."""
    return np.concatenate([np.frombuffer(column[int(r)].as_buffer(), kind) for r in rows]) if len(rows) else np.zeros(0, kind)


def _home(doc: np.ndarray, homes: int) -> np.ndarray:
    return (mix(doc.view(U64)) % U64(homes)).astype(np.int64)


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(key + U64(5)) % U64(buckets)).astype(np.int64)


def _told(doc: np.ndarray, place: np.ndarray, homes: int) -> pa.RecordBatch:
    return _packed(_home(doc, homes), True, None, None, doc.astype(np.int64), place.astype(np.uint32))


def _windows(batch: pa.RecordBatch, width: int):
    """Of each stretch of texts: row and first word of every window, its anchor's name and place from the
    window's first word, where anchors change, and the stretch's words."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    for part in word_batches(batch.column(1)):
        window, name, at = anchors(part.words, part.first, width)
        if not len(window):
            continue
        begin = part.first[:-1]
        row = np.repeat(np.arange(len(begin)), np.diff(part.first))[window]
        head = _runs_of(window, name, at)
        yield part, row + part.rows.start, ids[part.rows][row], window, window - begin[row], name, at - window, head


def _by_id(batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch.take(pc.sort_indices(batch.column(0)))  # earlier documents first


def _reveal(width: int, buckets: int, homes: int):
    """Every anchor by its name; its place is the first window that has it."""

    def reveal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, doc, _, own, name, _, head in _windows(_by_id(batch), width):
                _, lead, group, count = np.unique(name[head], return_index=True, return_inverse=True, return_counts=True)
                one = head[np.sort(lead)]
                yield _packed(_bucket(name[one], buckets), False, name[one], None, doc[one], own[one].astype(np.uint32))
                more = head[count[group] > 1]
                yield _told(doc[more], own[more], homes)

    return reveal


def _send(width: int, buckets: int, homes: int):
    """The windows around shared anchors."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = _by_id(batch)
            shared = [np.frombuffer(v.as_buffer(), "<u4").reshape(-1, 2) if v.is_valid else np.zeros((0, 2), np.uint32) for v in batch.column(2)]
            for part, row, doc, window, own, name, offset, head in _windows(batch, width):
                size = np.diff(np.append(head, len(window)))
                # a row's shared places as ranges of one long line of places, to look all up at once
                base = np.cumsum([0, *(int(part.first[k + 1] - part.first[k]) for k in range(len(part.first) - 1))])
                line = base[row[head] - part.rows.start] + own[head]
                spans = [r.astype(np.int64) + b for r, b in zip(shared[part.rows], base[:-1], strict=True) if len(r)]
                spans = np.concatenate(spans) if spans else np.zeros((0, 2), np.int64)
                before = np.searchsorted(spans[:, 0], line, side="right") - 1
                inside = (before >= 0) & (line < spans[np.maximum(before, 0), 1]) if len(spans) else np.zeros(len(head), bool)
                use = np.flatnonzero(np.repeat(inside, size))
                if not len(use):
                    continue
                whole = grams(part.words, width)[window[use]]
                key = join2(join2(name[use], whole), offset[use].astype(U64))
                doc_, own_ = doc[use], own[use]
                _, lead, group = np.unique(key, return_index=True, return_inverse=True)
                first = lead[group]
                again = (doc_ != doc_[first]) | (own_ != own_[first])  # a repeated row of one document is not later
                one = np.sort(lead)
                yield _packed(_bucket(key[one], buckets), False, key[one], (whole[one] >> U64(32)).astype(np.uint32), doc_[one], own_[one].astype(np.uint32))
                yield _told(doc_[again], own_[again], homes)

    return send


def _meet(every: bool, homes: int):
    """Rows come ordered by bucket.  Tells the places of equal entries: all of them if ``every``, else all
    but the earliest.  Of the last bucket in a batch the distinct entries are carried on."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        held = (np.zeros(0, U64), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, bool))
        for batch in batches:
            told = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            if told.any():
                yield batch.filter(pa.array(told)).select(["bucket", "docs", "places"])
            rows = np.flatnonzero(~told)
            if not len(rows):
                continue
            which = batch.column(0).to_numpy()[rows].astype(np.int64)
            key, doc, place = (_unpacked(batch.column(c), rows, t) for c, t in ((2, U64), (4, np.int64), (5, np.uint32)))
            count = np.array([len(batch.column(4)[int(r)].as_buffer()) // 8 for r in rows])
            check = _unpacked(batch.column(3), rows, np.uint32)
            check = check if len(check) == len(key) else np.zeros(len(key), np.uint32)
            bucket, said = np.repeat(which, count), np.zeros(len(key), bool)
            if last is not None:
                bucket = np.concatenate([np.full(len(held[0]), last), bucket])
                key, check, doc, place, said = (np.concatenate(c) for c in zip(held, (key, check, doc, place, said), strict=True))
            order = np.lexsort((place, doc, check, key, bucket))
            bucket, key, check, doc, place, said = (c[order] for c in (bucket, key, check, doc, place, said))
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (check[1:] != check[:-1]) | (bucket[1:] != bucket[:-1])])
            head = np.flatnonzero(new)
            chief = np.repeat(head, np.diff(np.append(head, len(key))))
            other = (doc != doc[chief]) | (place != place[chief])
            if every:
                often = np.repeat(np.logical_or.reduceat(other | said, head), np.diff(np.append(head, len(key)))) if len(head) else other
                tell, said = often & ~said, often
            else:
                tell = other
            at = _home(doc[tell], homes)
            yield _packed(at, True, None, None, doc[tell], place[tell]).select(["bucket", "docs", "places"])
            last = which[-1]
            keep = head[bucket[head] == last]
            held = tuple(c[keep] for c in (key, check, doc, place, said))

    return meet


def _ranges(place: np.ndarray) -> np.ndarray:
    """Sorted places as [begin, end) pairs."""
    head = np.flatnonzero(np.concatenate([[True], np.diff(place) != 1])) if len(place) else np.zeros(0, np.int64)
    return np.column_stack([place[head], np.append(place[head[1:] - 1], place[-1]) + 1]).astype("<u4") if len(place) else np.zeros((0, 2), "<u4")


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by bucket: the places told of each document, as ranges."""

    def out(pairs: np.ndarray) -> pa.RecordBatch:
        doc, place = pairs["d"], pairs["p"].astype(np.int64)
        head = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
        blobs = [_ranges(place[a:b]).tobytes() for a, b in zip(head, np.append(head[1:], len(doc)), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(doc[head]), pa.array(blobs, pa.binary())], names=["doc_id", "ranges"])

    last, held = None, np.zeros(0, [("d", np.int64), ("p", np.uint32)])
    for batch in batches:
        if not batch.num_rows:
            continue
        which = batch.column(0).to_numpy()
        for bucket in np.unique(which):
            rows = np.flatnonzero(which == bucket)
            docs, places = _unpacked(batch.column(1), rows, np.int64), _unpacked(batch.column(2), rows, np.uint32)
            pairs = np.zeros(len(docs), held.dtype)
            pairs["d"], pairs["p"] = docs, places
            if bucket != last and last is not None:
                yield out(held)
                held = held[:0]
            last = bucket
            held = np.concatenate([held, pairs])
            order = np.lexsort((held["p"], held["d"]))
            held = held[order]
            held = held[np.concatenate([[True], held[1:] != held[:-1]])] if len(held) else held
    if last is not None:
        yield out(held)


_KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def _apply(width: int, with_text: bool):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text, lists in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                n = len(words)
                if lists.is_valid:
                    pairs = np.frombuffer(lists.as_buffer(), "<u4").reshape(-1, 2).astype(np.int64)
                    hit = np.zeros(n + 1, np.int64)
                    np.add.at(hit, pairs[:, 0], 1)
                    np.add.at(hit, np.minimum(pairs[:, 1] + width - 1, n), -1)
                    words = [w for w, k in zip(words, np.cumsum(hit)[:n] == 0, strict=True) if k]
                kept = b" ".join(words)
                out.append((key.as_py(), n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 3 + [pa.string()] * 2, strict=True)] if out else [pa.array([], t) for t in [pa.int64()] * 3 + [pa.string()] * 2], names=names)

    return apply


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW, with_text: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 and kept_text (the words that stay,
    joined by one space; null unless ``with_text``).

    A word goes if a window of ``width`` words covers it whose words also start earlier: in a document
    of smaller id, or earlier in the same one.  Null or empty texts have no words; texts of any length are
    read whole; an empty table gives an empty one.  Rows of null id come last.  Rows of one id (or of none)
    with different texts are documents of their own, in the order of a hash of their texts; rows alike in
    both are one document at the same places: neither is the earlier one.  Other columns of ``docs`` are
    not read.
    """
    spark = docs.sparkSession
    source, names = keyed(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    source = source.withColumnRenamed("key", "doc_id")
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(-(-size // BUCKET_BYTES), 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    homes = max(-(-size // HOME_BYTES), 1)

    def told(entries: DataFrame, every: bool) -> DataFrame:
        met = entries.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_meet(every, homes), "bucket int, docs binary, places binary")
        return cut(met.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_gather, "doc_id long, ranges binary"))

    shared = told(source.mapInArrow(_reveal(width, buckets, homes), _ENTRIES), True)
    later = told(source.join(shared, "doc_id").select("doc_id", "text", "ranges").mapInArrow(_send(width, buckets, homes), _ENTRIES), False)
    kept = source.join(later, "doc_id", "left").select("doc_id", "text", "ranges").mapInArrow(_apply(width, with_text), _KEPT)
    return kept if names is None else kept.withColumnRenamed("doc_id", "key").join(names, "key").select("doc_id", *kept.columns[1:])
