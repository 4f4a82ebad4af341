"""Words of Arrow text columns as 64-bit hashes, computed over whole batches with numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_K1, _K2, _K3 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the public splitmix64 finaliser)."""
    x = (x ^ (x >> U64(30))) * _K2
    x = (x ^ (x >> U64(27))) * _K3
    return x ^ (x >> U64(31))


def join2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(a * _K1 + (b ^ (b >> U64(29))) * _K3 + U64(1))


@dataclass
class Words:
    """Words of consecutive rows.  Row r owns words[first[r]:first[r + 1]]."""

    rows: slice
    words: np.ndarray
    first: np.ndarray
    start: np.ndarray  # byte positions in data
    end: np.ndarray
    data: np.ndarray


def as_text(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.cast(pa.large_string())


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets per row, and all bytes (null rows own none)."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:  # a null slot may own stray bytes
        filled = column.fill_null("")
        return bytes_of(filled)
    return at, raw


def slices(at: np.ndarray, limit: int) -> Iterator[slice]:
    """Row ranges of about `limit` bytes; a longer row stands alone."""
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        yield slice(i, min(j, n))
        i = min(j, n)


def hash_spans(padded: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; eight bytes a step, so short words take one or two."""
    lanes = np.ndarray(shape=(len(padded) - 7,), dtype="<u8", buffer=padded.data, strides=(1,))
    out = mix(length.astype(U64) * _K1 + U64(7))
    live = np.arange(len(start))
    done = 0
    while len(live):
        left = length[live] - done
        lane = lanes[start[live] + done].astype(U64)
        short = left < 8
        keep = np.where(short, (U64(1) << (np.minimum(left, 7).astype(U64) * U64(8))) - U64(1), ~U64(0))
        out[live] = join2(out[live], lane & keep)
        done += 8
        live = live[left > 8]
    return out


#: Letters by byte: ASCII letters and every byte of a longer UTF-8 sequence.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True


def word_batches(column: pa.Array, lower: bool = False, limit: int = 3 << 20, solid_bytes: np.ndarray = ~_SPACE) -> Iterator[Words]:
    """Words ([^\\x20\\x09-\\x0D]+, or runs of other bytes) of a text column, a few megabytes at a time."""
    column = as_text(column)
    at, raw = bytes_of(column)
    for rows in slices(at, limit):
        base, stop = int(at[rows.start]), int(at[rows.stop])
        data = np.concatenate([raw[base:stop], np.full(8, 32, np.uint8)])
        if lower:
            data = _LOWER[data]
        edges = (at[rows.start : rows.stop + 1] - base).astype(np.int64)
        solid = solid_bytes[data]
        before = np.empty(len(solid), dtype=bool)
        before[0] = False
        before[1:] = solid[:-1]
        before[edges[:-1]] = False  # a row's first byte has nothing before it
        after = np.empty(len(solid), dtype=bool)
        after[-1] = False
        after[:-1] = solid[1:]
        inner = edges[1:][edges[1:] > 0] - 1
        after[inner] = False
        start = np.flatnonzero(solid & ~before)
        end = np.flatnonzero(solid & ~after) + 1
        first = np.searchsorted(start, edges)
        yield Words(rows, hash_spans(data, start, end - start), first, start, end, data)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words (over row borders too; callers drop those)."""
    if len(words) < n:
        return np.zeros(0, U64)
    power, have, parts, at = words, 1, [], 0
    left = n
    while left:
        if left & 1:
            parts.append((power, at))
            at += have
        left >>= 1
        if left:
            power = join2(power[:-have], power[have:])
            have *= 2
    count = len(words) - n + 1
    out = parts[0][0][parts[0][1] : parts[0][1] + count]
    for part, shift in parts[1:]:
        out = join2(out, part[shift : shift + count])
    return out
