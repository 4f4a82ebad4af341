"""Media columns: what bytes are, whatever they are declared to be.

An Aho-Corasick automaton finds the magic bytes of all known formats in one pass; a validator per format
then reads its structure and lengths, and says how many bytes belong to the object.  An object at offset
0 that validates gives the detected type; validated objects further in are carved as embedded media.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Found = tuple[str, int, int]  # format, begin, end
UNIT, RATE = 192, 8000


def _png(b: bytes, at: int) -> int:
    p = at + 8
    while p + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        if p + 12 + n > len(b) or zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return 0
        if p == at + 8 and (kind != b"IHDR" or n != 13):
            return 0
        p += 12 + n
        if kind == b"IEND":
            return p
    return 0


def _jpeg(b: bytes, at: int) -> int:
    p, scanned = at + 2, False
    while p + 4 <= len(b) and b[p] == 0xFF:
        mark = b[p + 1]
        if mark == 0xD9:
            return p + 2 if scanned else 0
        if 0xD0 <= mark <= 0xD7 or mark == 0x01:
            p += 2
            continue
        n = struct.unpack_from(">H", b, p + 2)[0]
        if n < 2 or p + 2 + n > len(b):
            return 0
        p += 2 + n
        if mark == 0xDA:  # entropy-coded bytes run to the next marker
            scanned = True
            while True:
                p = b.find(b"\xff", p)
                if p < 0 or p + 1 >= len(b):
                    return 0
                if b[p + 1] != 0 and not 0xD0 <= b[p + 1] <= 0xD7:
                    break
                p += 2
    return p + 2 if scanned and b[p : p + 2] == b"\xff\xd9" else 0


def _gif(b: bytes, at: int) -> int:
    if at + 13 > len(b):
        return 0
    flags = b[at + 10]
    p = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)

    def blocks(q: int) -> int:
        while q < len(b) and b[q]:
            q += 1 + b[q]
        return q + 1 if q < len(b) else 0

    while p < len(b):
        if b[p] == 0x3B:
            return p + 1
        if b[p] == 0x21:
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 < len(b):
            local = b[p + 9]
            p = blocks(p + 11 + (3 << ((local & 7) + 1) if local & 0x80 else 0))
        else:
            return 0
        if not p:
            return 0
    return 0


def _riff(kind: bytes) -> Callable[[bytes, int], int]:
    def riff(b: bytes, at: int) -> int:
        if at + 12 > len(b) or b[at + 8 : at + 12] != kind:
            return 0
        end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
        if end > len(b):
            return 0
        p, seen = at + 12, 0
        while p + 8 <= end:
            n = struct.unpack_from("<I", b, p + 4)[0]
            p, seen = p + 8 + n + n % 2, seen + 1
        return end if seen and p - 1 <= end <= p else 0

    return riff


def _bmp(b: bytes, at: int) -> int:
    if at + 30 > len(b):
        return 0
    size, zero, offset, header = struct.unpack_from("<IIII", b, at + 2)
    fits = zero == 0 and header in (12, 40, 52, 56, 108, 124) and 14 + header <= offset <= size and at + size <= len(b)
    return at + size if fits else 0


@functools.lru_cache(maxsize=8)
def _marks(b: bytes, mark: bytes) -> list[int]:
    """All places of a closing mark: looked up once a content, however often its opening mark stands there."""
    out, at = [], b.find(mark)
    while at >= 0:
        out.append(at)
        at = b.find(mark, at + 1)
    return out


def _next(b: bytes, mark: bytes, at: int) -> int:
    places = _marks(b, mark)
    k = bisect.bisect_left(places, at)
    return places[k] if k < len(places) else -1


def _pdf(b: bytes, at: int) -> int:
    if not b[at + 5 : at + 8].replace(b".", b"").isdigit():
        return 0
    end = _next(b, b"%%EOF", at)
    return end + 5 if 0 <= _next(b, b"startxref", at) < end else 0


@functools.lru_cache(maxsize=2)
def _zip_ends(b: bytes) -> dict[int, int]:
    """Where an archive begins by its closing records, and where it then ends: the first that fits."""
    out: dict[int, int] = {}
    for end in _marks(b, b"PK\x05\x06"):
        if end + 22 <= len(b):
            entries, size, offset, note = struct.unpack_from("<xxxxxxxxxxHIIH", b, end)
            if entries and end + 22 + note <= len(b):
                out.setdefault(end - size - offset, end + 22 + note)
    return out


def _zip(b: bytes, at: int) -> int:
    return _zip_ends(b).get(at, 0)


def _gzip(b: bytes, at: int) -> int:
    if at + 18 > len(b) or b[at + 2] != 8 or b[at + 3] & 0xE0:
        return 0
    d = zlib.decompressobj(31)
    try:
        view, total = memoryview(b)[at:], 0
        while not d.eof and total < len(view):
            piece = view[total : total + 65536]
            left = len(d.decompress(piece, 1 << 20))
            while d.unconsumed_tail and left:
                left = len(d.decompress(d.unconsumed_tail, 1 << 20))
            total += len(piece)
    except zlib.error:
        return 0
    return at + total - len(d.unused_data) if d.eof else 0


def _flac(b: bytes, at: int) -> int:
    if at + 42 > len(b) or b[at + 4] & 0x7F or int.from_bytes(b[at + 5 : at + 8]) != 34:
        return 0
    p = at + 4
    while p + 4 <= len(b):
        last, n = b[p] & 0x80, int.from_bytes(b[p + 1 : p + 4])
        p += 4 + n
        if last:
            return len(b) if p + 2 <= len(b) and b[p] == 0xFF and b[p + 1] & 0xFC == 0xF8 else 0
    return 0


def _ogg(b: bytes, at: int) -> int:
    p, serial = at, b[at + 14 : at + 18]
    while b[p : p + 4] == b"OggS" and p + 27 <= len(b) and b[p + 4] == 0 and b[p + 14 : p + 18] == serial:
        n = b[p + 26]
        last = b[p + 5] & 4
        p += 27 + n + sum(b[p + 27 : p + 27 + n])
        if p > len(b):
            return 0
        if last:
            return p
    return 0


def _mp4(b: bytes, at: int) -> int:
    """``at`` is the size before the ftyp mark; boxes follow one another."""
    p, kinds = at, []
    while p + 8 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        if n < 8 or p + n > len(b) or not kind.isalnum():
            break
        kinds.append(kind)
        p += n
    return p if kinds[:1] == [b"ftyp"] and (b"moov" in kinds or b"mdat" in kinds) else 0


#: Formats, their magic bytes, where in the object those stand, and validators.
FORMATS: list[tuple[str, bytes, int, Callable[[bytes, int], int]]] = [
    ("image/png", b"\x89PNG\r\n\x1a\n", 0, _png),
    ("image/jpeg", b"\xff\xd8\xff", 0, _jpeg),
    ("image/gif", b"GIF87a", 0, _gif),
    ("image/gif", b"GIF89a", 0, _gif),
    ("image/bmp", b"BM", 0, _bmp),
    ("image/webp", b"RIFF", 0, _riff(b"WEBP")),
    ("audio/wav", b"RIFF", 0, _riff(b"WAVE")),
    ("video/avi", b"RIFF", 0, _riff(b"AVI ")),
    ("audio/flac", b"fLaC", 0, _flac),
    ("audio/ogg", b"OggS", 0, _ogg),
    ("video/mp4", b"ftyp", 4, _mp4),
    ("application/pdf", b"%PDF-", 0, _pdf),
    ("application/zip", b"PK\x03\x04", 0, _zip),
    ("application/gzip", b"\x1f\x8b\x08", 0, _gzip),
]


def automaton() -> ahocorasick.Automaton:
    """Magic bytes, each byte as the character of its number, with the formats that begin so."""
    found = ahocorasick.Automaton()
    for magic in {m for _, m, _, _ in FORMATS}:
        found.add_word(magic.decode("latin-1"), (len(magic), [(name, back, check) for name, m, back, check in FORMATS if m == magic]))
    found.make_automaton()
    return found


def sniff(content: bytes, machine: ahocorasick.Automaton) -> list[Found]:
    """Validated objects in order of their begin; what lies within another object is not listed again,
    but for what lies within a container of the whole content."""
    out: list[Found] = []
    free = 0
    for last, (length, kinds) in machine.iter(content.decode("latin-1")):
        for name, back, check in kinds:
            begin = last - length + 1 - back
            if begin < 0 or (begin < free and begin > 0):
                continue
            end = check(content, begin)
            if end:
                out.append((name, begin, end))
                if begin:
                    free = end
                break
    return out


def to_wav(payload: bytes) -> bytes:
    """8-bit mono samples, one a byte."""
    head = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8) + struct.pack("<4sI", b"data", len(payload))
    pad = b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(head) + len(payload) + len(pad)) + b"WAVE" + head + payload + pad


def from_wav(content: bytes, begin: int = 0) -> bytes:
    """The samples of a validated WAV object."""
    p = begin + 12
    while content[p : p + 4] != b"data":
        p += 8 + struct.unpack_from("<I", content, p + 4)[0] + struct.unpack_from("<I", content, p + 4)[0] % 2
    return content[p + 8 : p + 8 + struct.unpack_from("<I", content, p + 4)[0]]


_SNIFFED = "detected string, corrected boolean, bytes long, embedded array<struct<kind:string,begin:long,end:long>>"


def sniffed(df: DataFrame, content_col: str = "content", declared_col: str = "declared") -> DataFrame:
    """All columns of ``df`` with: detected (type of the object at offset 0, else that declared, else
    application/octet-stream), corrected (detected is not what was declared), bytes (length of that
    object, or of the content), embedded (objects carved further in, as kind, begin, end).

    Null contents: detected as declared, 0 bytes, nothing embedded.  Empty ones likewise.  New columns
    replace those of the same name.
    """
    names = ["detected", "corrected", "bytes", "embedded"]
    kept = df.drop(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields) + ", " + _SNIFFED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        kinds = [pa.string(), pa.bool_(), pa.int64(), pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64())]))]
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for content, said in zip(batch.column(content_col), batch.column(declared_col), strict=True):
                raw, declared = content.as_py() or b"", said.as_py()
                found = sniff(raw, machine)
                own = next((f for f in found if f[1] == 0), None)
                detected = own[0] if own else declared or "application/octet-stream"
                row = (detected, detected != declared, own[2] if own else len(raw), [{"kind": k, "begin": a, "end": b} for k, a, b in found if a])
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, t) for v, t in zip(out, kinds, strict=True))], names=[*batch.schema.names, *names])

    return kept.mapInArrow(run, schema)


_STORED = "doc_id {id}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def text_media(docs: DataFrame, declared: str = "image/png", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every whole text as 8-bit WAV samples under a wrong declared type, sniff it, and read it back.

    Text bytes are followed by blanks up to a positive multiple of UNIT.  ``feature`` names the detected
    and declared type, the form, the length, and what is embedded.  Null: the empty text.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column("text"):
                raw = text.as_buffer().to_pybytes()
                stored = to_wav(raw + b" " * (-len(raw) % UNIT or (0 if raw else UNIT)))
                found = sniff(stored, machine)
                kind, begin, end = next(f for f in found if f[1] == 0)
                payload = from_wav(stored, begin)
                inside = ",".join(f"{k}@{a}-{b}" for k, a, b in found if a)
                feature = f"{kind};declared={declared};corrected={kind != declared};pcm_u8/1ch/{RATE}Hz;bytes={end};embedded=[{inside}]"
                out.append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature))
            columns = list(zip(*out, strict=True)) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return source.mapInArrow(run, _STORED.format(id=source.schema["doc_id"].dataType.simpleString()))
