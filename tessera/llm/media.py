"""Media columns by signature sniffing.

``to_wave`` stores bytes losslessly as 8-bit mono samples of a RIFF/WAVE file. ``sniff`` finds
all magic bytes of a stored file, and the marks that end some formats, in one pass of an
Aho-Corasick automaton and lets a format validator confirm each signature: structure and
lengths must hold, so that letters which merely look like one don't count. A validator looks
marks up rather than searching for them, and walks a chain of blocks that it has met before
only once, so many false signatures don't cost a pass over the file each. The confirmed segment at the start corrects the declared type,
and segments inside others are carved by offset and length.

A null payload or text is empty. Rows are independent: ids may be null or repeat, equal texts
give equal values, an empty table gives an empty result, and other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import free_name, table

BLOCK = 64
RATE = 8000
DECLARED = "application/octet-stream"
#: The magic bytes of each type that has a validator.
MAGIC = {
    "audio/wav": b"RIFF",
    "image/png": b"\x89PNG\r\n\x1a\n",
    "image/gif": b"GIF8",
    "image/jpeg": b"\xff\xd8\xff",
    "image/bmp": b"BM",
    "application/zip": b"PK\x03\x04",
    "application/gzip": b"\x1f\x8b\x08",
    "audio/flac": b"fLaC",
    "application/pdf": b"%PDF-",
}
#: What ends a PDF file, a ZIP file's directory and a JPEG image.
MARKS = (b"%%EOF", b"PK\x05\x06", b"\xff\xd9")


class Media:
    """A file's bytes, the places of MARKS in it, and the ends of block chains that were walked."""

    def __init__(self, data: bytes):
        self.data = data
        self.marks: dict[bytes, list[int]] = {m: [] for m in MARKS}
        self.walked: dict[tuple[str, int], int] = {}

    def mark(self, which: bytes, at: int) -> int:
        """The first place of a mark from an offset on, or -1."""
        found = self.marks[which]
        k = bisect_left(found, at)
        return found[k] if k < len(found) else -1

    def walk(self, kind: str, pos: int, step: Callable[[int], tuple[int, bool]]) -> int:
        """Where a chain of blocks that starts at pos ends, or 0: step(pos) is (next block or end, whether that's the end), (0, True) for a fault."""
        seen, done = [], False
        while not done and (kind, pos) not in self.walked:
            seen.append(pos)
            pos, done = step(pos)
        end = pos if done else self.walked[kind, pos]
        for x in seen:
            self.walked[kind, x] = end
        return end


def payload_of(text: str | None) -> tuple[int, bytes]:
    """(UTF-8 length, the bytes with zeros up to a positive multiple of BLOCK)."""
    raw = (text or "").encode("utf-8", "replace")
    return len(raw), raw.ljust(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK), b"\0")


def to_wave(payload: bytes) -> bytes:
    """A RIFF/WAVE file whose 8-bit mono samples are the payload; chunks are padded to even lengths."""
    data = payload + b"\0" * (len(payload) % 2)
    head = b"WAVE" + b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(payload))
    return b"RIFF" + struct.pack("<I", len(head) + len(data)) + head + data


def wave_samples(data: bytes, at: int = 0) -> bytes:
    """The samples of the RIFF/WAVE file that starts at an offset."""
    end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    pos = at + 12
    while pos + 8 <= end:
        name, size = data[pos : pos + 4], struct.unpack_from("<I", data, pos + 4)[0]
        if name == b"data":
            return data[pos + 8 : pos + 8 + size]
        pos += 8 + size + size % 2
    raise ValueError("no data chunk")


def _wav(m: Media, at: int) -> int:
    d = m.data
    if d[at + 8 : at + 12] != b"WAVE":
        return 0
    size = 8 + struct.unpack_from("<I", d, at + 4)[0]
    pos, end, seen = at + 12, at + size, set()
    if end > len(d):
        return 0
    while pos + 8 <= end:
        seen.add(d[pos : pos + 4])
        held = struct.unpack_from("<I", d, pos + 4)[0]
        pos += 8 + held + held % 2
    return size if pos == end and {b"fmt ", b"data"} <= seen else 0


def _png(m: Media, at: int) -> int:
    d = m.data

    def chunk(pos: int) -> tuple[int, bool]:
        if pos + 12 > len(d):
            return 0, True
        size, kind = struct.unpack_from(">I", d, pos)[0], d[pos + 4 : pos + 8]
        if pos + 12 + size > len(d) or not kind.isalpha() or zlib.crc32(memoryview(d)[pos + 4 : pos + 8 + size]) != struct.unpack_from(">I", d, pos + 8 + size)[0]:
            return 0, True
        return pos + 12 + size, kind == b"IEND"

    if d[at + 8 : at + 16] != b"\0\0\0\rIHDR":
        return 0
    return max(0, m.walk("png", at + 8, chunk) - at)


def _gif(m: Media, at: int) -> int:
    d = m.data
    table_bytes = lambda flags: 3 << ((flags & 7) + 1) if flags & 0x80 else 0

    def block(pos: int) -> tuple[int, bool]:
        if pos >= len(d):
            return 0, True
        kind = d[pos]
        if kind == 0x3B:
            return pos + 1, True
        if kind == 0x21:
            return pos + 2, False
        if kind == 0x2C and pos + 11 <= len(d):
            return pos + 11 + table_bytes(d[pos + 9]), False
        return 0, True

    def step(pos: int) -> tuple[int, bool]:
        # Even steps are blocks, odd ones the sub-blocks that follow.
        at, inner = pos >> 1, pos & 1
        if not inner:
            end, done = block(at)
            return (end, True) if done else (end << 1 | 1, False)
        if at >= len(d):
            return 0, True
        return (at + 1 + d[at] << 1 | 1, False) if d[at] else (at + 1 << 1, False)

    if d[at + 4 : at + 6] not in (b"7a", b"9a") or at + 13 > len(d):
        return 0
    return max(0, m.walk("gif", at + 13 + table_bytes(d[at + 10]) << 1, step) - at)


def _jpeg(m: Media, at: int) -> int:
    d = m.data

    def segment(pos: int) -> tuple[int, bool]:
        if pos + 4 > len(d) or d[pos] != 0xFF:
            return 0, True
        size = struct.unpack_from(">H", d, pos + 2)[0]
        if size < 2:
            return 0, True
        return pos + 2 + size, d[pos + 1] == 0xDA

    scan = m.walk("jpeg", at + 2, segment)
    end = m.mark(b"\xff\xd9", scan) if scan else -1
    return end + 2 - at if end >= 0 else 0


def _bmp(m: Media, at: int) -> int:
    d = m.data
    if at + 54 > len(d):
        return 0
    size, zero, offset, head = struct.unpack_from("<IIII", d, at + 2)
    planes, bits = struct.unpack_from("<HH", d, at + 26)
    fits = not zero and head in (12, 40, 52, 56, 108, 124) and 14 + head <= offset <= size and at + size <= len(d)
    return size if fits and planes == 1 and bits in (1, 4, 8, 16, 24, 32) else 0


def _zip(m: Media, at: int) -> int:
    d, end = m.data, m.mark(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(d):
        return 0
    size, offset, note = struct.unpack_from("<IIH", d, end + 12)
    whole = end + 22 + note - at
    return whole if at + offset + size == end and at + whole <= len(d) else 0


def _gzip(m: Media, at: int) -> int:
    reader, pos, d = zlib.decompressobj(31), at, memoryview(m.data)
    try:
        while pos < len(d) and not reader.eof:
            reader.decompress(d[pos : pos + 16_384])
            pos += 16_384
    except zlib.error:
        return 0
    return min(pos, len(d)) - at - len(reader.unused_data) if reader.eof else 0


def _flac(m: Media, at: int) -> int:
    d = m.data

    def block(pos: int) -> tuple[int, bool]:
        if pos + 4 > len(d):
            return 0, True
        end = pos + 4 + int.from_bytes(d[pos + 1 : pos + 4], "big")
        return (0, True) if end > len(d) else (end, bool(d[pos] & 0x80))

    if at + 42 > len(d) or d[at + 4] & 0x7F or d[at + 5 : at + 8] != b"\0\0\x22":
        return 0
    return len(d) - at if m.walk("flac", at + 4, block) else 0


def _pdf(m: Media, at: int) -> int:
    d, end = m.data, m.mark(b"%%EOF", at)
    return end + 5 - at if end >= 0 and d[at + 5 : at + 6].isdigit() and b"startxref" in d[max(at, end - 64) : end] else 0


VALIDATORS = {"audio/wav": _wav, "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "image/bmp": _bmp, "application/zip": _zip, "application/gzip": _gzip, "audio/flac": _flac, "application/pdf": _pdf}


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, magic in MAGIC.items():
        found.add_word(magic.decode("latin-1"), (kind, len(magic)))
    for mark in MARKS:
        found.add_word(mark.decode("latin-1"), (mark, len(mark)))
    found.make_automaton()
    return found


def sniff(data: bytes) -> tuple[int, list[tuple[str, int, int]]]:
    """(signatures met, confirmed segments (type, offset, length) by offset)."""
    file, found, out = Media(data), [], []
    for last, (kind, size) in _automaton().iter(data.decode("latin-1")):
        at = last + 1 - size
        if kind in file.marks:
            file.marks[kind].append(at)
        else:
            found.append((at, kind))
    for at, kind in found:
        try:
            length = VALIDATORS[kind](file, at)
        except (struct.error, IndexError):
            length = 0
        if length:
            out.append((kind, at, length))
    return len(found), out


def corrected_type(declared: str, segments: list[tuple[str, int, int]]) -> str:
    """The type of the segment at offset 0, else what was declared."""
    return next((kind for kind, at, _ in segments if at == 0), declared)


def inspect_media(media: DataFrame) -> DataFrame:
    """(…, media binary, declared string) with type, met and segments array<struct<type, offset, length>>, which replace columns of these names."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for data, declared in batches:
            rows = []
            for d, kind in zip(data, declared):
                met, segments = sniff(d or b"")
                rows.append((corrected_type(kind, segments), met, [{"type": k, "offset": a, "length": n} for k, a, n in segments]))
            yield pd.DataFrame(rows, columns=["type", "met", "segments"])

    found = F.pandas_udf(run, "type string, met long, segments array<struct<type:string, offset:long, length:long>>")
    name, held = free_name(media, "found"), [c for c in media.columns if c not in ("type", "met", "segments")]
    return media.withColumn(name, found("media", "declared")).select(*held, f"{name}.*")


def carve(data: bytes, segment: tuple[str, int, int]) -> bytes:
    """The bytes of a confirmed segment."""
    return data[segment[1] : segment[1] + segment[2]]


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media, declared): each text's padded bytes as a wave file, declared as unknown bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            held = [payload_of(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_bytes": [n for n, _ in held], "media": [to_wave(p) for _, p in held], "declared": DECLARED})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_bytes long, media binary, declared string")


def digests(media: DataFrame) -> DataFrame:
    """Read stored media back: digests of the samples that ``inspect_media`` confirmed, and a feature."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, n, data, kind, met, segments in zip(pdf["doc_id"].astype("Int64"), pdf["n_bytes"], pdf["media"], pdf["type"], pdf["met"], pdf["segments"]):
                samples = wave_samples(data) if kind == "audio/wav" else data
                inner = ",".join(f"{s['type']}@{s['offset']}+{s['length']}" for s in segments)
                rows.append((doc_id, n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-BLOCK:]), len(data), hashlib.sha256(data).hexdigest(), f"{DECLARED}>{kind};signatures={met};{inner}"))
            out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
            yield out.astype({"doc_id": "Int64"})

    return media.mapInPandas(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as media, sniffed, and read back."""
    return digests(inspect_media(store_texts(table(spark, sf_dir, "documents"))))
