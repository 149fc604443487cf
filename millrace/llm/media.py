"""Media columns: signature sniffing.

One Aho-Corasick automaton over the magic bytes of all formats finds every place in a payload where a medium may start;
a validator of the format then walks its structure (chunk lengths and checksums, headers, trailers) and gives its length, or
rejects it. The medium at offset 0 that covers most of the payload corrects a declared type; every other valid medium
that lies outside one already found is carved.

Each row is worked on alone, in one pass with no shuffle. A payload and its working copies must fit in a task's memory. What
validators search for up to the payload's end (trailers of ZIP and PDF) is found once for a payload, and places from which a JPEG
can't be read are remembered, so that many false magic bytes cost no more than a pass each.

Edge cases: a null or empty payload has type null and nothing to carve; a payload that no validator accepts keeps its declared
type; repeated rows each get a row; other columns are dropped, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Magic bytes by format (fixed values).
MAGIC = {
    "image/png": [b"\x89PNG\r\n\x1a\n"],
    "image/jpeg": [b"\xff\xd8\xff"],
    "image/gif": [b"GIF87a", b"GIF89a"],
    "image/bmp": [b"BM"],
    "riff": [b"RIFF"],
    "audio/ogg": [b"OggS"],
    "application/pdf": [b"%PDF-"],
    "application/zip": [b"PK\x03\x04"],
    "application/gzip": [b"\x1f\x8b\x08"],
}
RIFF_TYPES = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}
SIDE = 64
FOUND = "array<struct<type:string,start:bigint,length:bigint>>"


@cache
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, magics in MAGIC.items():
        for m in magics:
            a.add_word(m.decode("latin-1"), (kind, len(m)))
    a.make_automaton()
    return a


class Payload:
    """A payload's bytes, and what is found in them once."""

    def __init__(self, b: bytes) -> None:
        self.b, self.places, self.dead, self.ends = b, {}, set(), None
        #: Of GIF: places from which no end can be reached, and where the sub-blocks at a place end.
        self.gif_dead, self.gif_ends = set(), {}

    def at(self, mark: bytes) -> list[int]:
        """All places of mark."""
        if mark not in self.places:
            self.places[mark] = [m.start() for m in re.finditer(re.escape(mark), self.b)]
        return self.places[mark]

    def zip_ends(self) -> dict[int, int]:
        """Start of each ZIP file that an end record can have, and the file's end."""
        if self.ends is None:
            self.ends, b = {}, self.b
            for end in self.at(b"PK\x05\x06"):
                if end + 22 <= len(b):
                    size, start, note = struct.unpack_from("<IIH", b, end + 12)
                    at = end - size - start
                    if at >= 0 and b[at + start : at + start + 4] in (b"PK\x01\x02", b"PK\x05\x06") and end + 22 + note <= len(b):
                        self.ends.setdefault(at, end + 22 + note)
        return self.ends


#: The checksum of an Ogg page: CRC-32 with polynomial 0x04C11DB7, not reflected, from 0.
@cache
def _ogg_table() -> list[int]:
    out = []
    for i in range(256):
        r = i << 24
        for _ in range(8):
            r = (r << 1 ^ (0x04C11DB7 if r & 0x80000000 else 0)) & 0xFFFFFFFF
        out.append(r)
    return out


def ogg_crc(page: bytes) -> int:
    table, r = _ogg_table(), 0
    for x in page:
        r = (r << 8 & 0xFFFFFFFF) ^ table[r >> 24 ^ x]
    return r


def _png(payload: Payload, at: int) -> int | None:
    b = payload.b
    p, first = at + 8, True
    while p + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        if p + 12 + n > len(b) or first != (kind == b"IHDR") or zlib.crc32(memoryview(b)[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return None
        p, first = p + 12 + n, False
        if kind == b"IEND":
            return p - at
    return None


def _riff(payload: Payload, at: int) -> int | None:
    b = payload.b
    if len(b) < at + 12 or b[at + 8 : at + 12] not in RIFF_TYPES:
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    p, chunks = at + 12, 0
    while p + 8 <= min(end, len(b)):
        p += 8 + (n := struct.unpack_from("<I", b, p + 4)[0]) + n % 2
        chunks += 1
    return end - at if end <= len(b) and p in (end, end + 1) and chunks else None


def _bmp(payload: Payload, at: int) -> int | None:
    b = payload.b
    if len(b) < at + 54:
        return None
    size, _, start, head, width, height, planes, bits, packed = struct.unpack_from("<IIIIiiHHI", b, at + 2)
    if head not in (40, 108, 124) or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or start < 14 + head or at + size > len(b):
        return None
    return size if packed or start + (width * bits + 31) // 32 * 4 * abs(height) == size else None


def _gif(payload: Payload, at: int) -> int | None:
    b, dead, ends = payload.b, payload.gif_dead, payload.gif_ends

    def blocks(p: int) -> int:
        way = []
        while p < len(b) and b[p] and p not in ends:
            way.append(p)
            p += 1 + b[p]
        end = ends.get(p, p + 1)
        ends.update(dict.fromkeys(way, end))
        return end

    if len(b) < at + 14:
        return None
    p, seen = at + 13 + (3 << (b[at + 10] & 7) + 1) * (b[at + 10] >> 7), []
    while p < len(b) and p not in dead:
        seen.append(p)
        if b[p] == 0x3B:
            return p + 1 - at
        if b[p] == 0x21:
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 < len(b):
            p = blocks(p + 11 + (3 << (b[p + 9] & 7) + 1) * (b[p + 9] >> 7))
        else:
            break
    dead.update(seen)
    return None


def _jpeg(payload: Payload, at: int) -> int | None:
    b = payload.b
    p, seen = at + 2, []
    while p + 4 <= len(b) and b[p] == 0xFF and p not in payload.dead:
        seen.append(p)
        mark = b[p + 1]
        n = struct.unpack_from(">H", b, p + 2)[0]
        if n < 2 or not 0xC0 <= mark <= 0xFE:
            break
        p += 2 + n
        if mark == 0xDA:
            while True:  # entropy-coded data, up to a marker other than a restart
                p = b.find(b"\xff", p)
                if p < 0 or p + 1 >= len(b):
                    payload.dead.update(seen)
                    return None
                if b[p + 1] != 0 and not 0xD0 <= b[p + 1] <= 0xD7:
                    break
                p += 2
            if b[p + 1] == 0xD9:
                return p + 2 - at
    payload.dead.update(seen)
    return None


def _ogg(payload: Payload, at: int) -> int | None:
    b = payload.b
    p, serial, ended = at, None, False
    while b[p : p + 4] == b"OggS" and p + 27 <= len(b) and not ended:
        table = b[p + 27 : p + 27 + b[p + 26]]
        if b[p + 4] or serial not in (None, b[p + 14 : p + 18]) or serial is None and not b[p + 5] & 2:
            return None
        serial, ended = b[p + 14 : p + 18], bool(b[p + 5] & 4)
        end = p + 27 + len(table) + sum(table)
        if end > len(b) or ogg_crc(b[p : p + 22] + bytes(4) + b[p + 26 : end]) != struct.unpack_from("<I", b, p + 22)[0]:
            return None
        p = end
    return p - at if ended and p <= len(b) else None


def _pdf(payload: Payload, at: int) -> int | None:
    b = payload.b
    if not b[at + 5 : at + 8].replace(b".", b"").isdigit():
        return None
    starts, ends, refs = payload.at(b"%PDF-"), payload.at(b"%%EOF"), payload.at(b"startxref")
    i = bisect_left(starts, at + 5)
    stop = starts[i] if i < len(starts) else len(b)
    j = bisect_left(ends, stop - 4) - 1  # the last one before the next file
    if j < 0 or ends[j] < at:
        return None
    k = bisect_left(refs, at)
    return ends[j] + 5 - at if k < len(refs) and refs[k] + 9 <= ends[j] else None


def _zip(payload: Payload, at: int) -> int | None:
    end = payload.zip_ends().get(at)
    return end - at if end else None


def _gzip(payload: Payload, at: int) -> int | None:
    b = payload.b
    if len(b) < at + 18 or b[at + 3] & 0xE0:
        return None
    d, p = zlib.decompressobj(31), at
    try:
        while p < len(b) and not d.eof:  # in pieces, so that nothing inflated is kept
            rest = b[p : p + (1 << 16)]
            p += len(rest)
            d.decompress(rest, 1 << 20)
            while d.unconsumed_tail and not d.eof:
                d.decompress(d.unconsumed_tail, 1 << 20)
    except zlib.error:
        return None
    return p - len(d.unused_data) - at if d.eof else None


VALID = {"image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "image/bmp": _bmp, "riff": _riff, "audio/ogg": _ogg, "application/pdf": _pdf, "application/zip": _zip, "application/gzip": _gzip}


def sniff(payload: bytes) -> list[tuple[str, int, int]]:
    """(type, start, length) of each valid medium that lies outside those before it."""
    out, done, whole = [], 0, Payload(payload)
    for end, (kind, n) in automaton().iter(payload.decode("latin-1")):
        at = end - n + 1
        if at >= done and (length := VALID[kind](whole, at)):
            out.append((RIFF_TYPES[payload[at + 8 : at + 12]] if kind == "riff" else kind, at, length))
            done = at + length
    return out


def sniffed(df: DataFrame, row_id: str, content: str, declared: str | None = None) -> DataFrame:
    """Per row: row_id, declared, type (corrected), corrected, carved (type, start, length), and media, their bytes."""
    kind = df.schema[row_id].dataType.simpleString()

    def run(batches):
        for b in batches:
            was = b.column(2).to_pylist()
            found = [sniff(x) if x else [] for x in b.column(1).to_pylist()]
            main = [next((t for t, at, _ in f if at == 0), None) or d for f, d in zip(found, was, strict=True)]
            carved = [[{"type": t, "start": a, "length": n} for t, a, n in f if a] for f in found]
            cut = [[x[c["start"] : c["start"] + c["length"]] for c in cs] for x, cs in zip(b.column(1).to_pylist(), carved, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(main, pa.string()), pa.array([m is not None and m != d for m, d in zip(main, was, strict=True)]), pa.array(carved, pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))), pa.array(cut, pa.list_(pa.binary()))], ["row_id", "declared", "type", "corrected", "carved", "media"])

    src = df.select(F.col(row_id).alias("row_id"), F.col(content).cast("binary").alias("content"), (F.col(declared) if declared else F.lit(None)).cast("string").alias("declared"))
    return src.mapInArrow(run, f"row_id {kind}, declared string, type string, corrected boolean, carved {FOUND}, media array<binary>")


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % 64 if text else 64)


#: What a stored medium is declared to be; its bytes may tell otherwise.
DECLARED = ("audio/wav", "image/bmp", "image/png", "text/plain")


def declared(payload: bytes) -> str:
    return DECLARED[(zlib.crc32(payload) >> 8) % len(DECLARED)]


def stored(payload: bytes) -> bytes:
    """The payload, a multiple of 64 bytes, as one of three lossless media of 8-bit samples, or as the third of these inside a
    multipart body, from which it is to be carved; its checksum picks which."""
    pick = zlib.crc32(payload) % 4
    if pick < 3:
        return _medium(payload, pick)
    edge = b"--part\r\n"
    return edge + b"Content-Type: application/octet-stream\r\n\r\n" + _medium(payload, 2) + b"\r\n" + edge


def _medium(payload: bytes, pick: int) -> bytes:
    n = len(payload)
    if pick == 0:
        return b"RIFF" + struct.pack("<I4s4sIHHIIHH4sI", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", n) + payload
    if pick == 1:  # rows of SIDE pixels from the top, one byte each
        grey = b"".join(bytes((i, i, i, 0)) for i in range(256))
        return b"BM" + struct.pack("<IIIIiiHHIIiiII", 1078 + n, 0, 1078, 40, SIDE, -(n // SIDE), 1, 8, 0, n, 2835, 2835, 256, 0) + grey + payload
    rows = np.zeros((n // SIDE, SIDE + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, SIDE)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", SIDE, n // SIDE, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def samples(media: bytes, kind: str) -> bytes:
    """The 8-bit samples of a stored medium, read from its own headers."""
    if kind == "audio/wav":
        p = 12
        while media[p : p + 4] != b"data":
            p += 8 + struct.unpack_from("<I", media, p + 4)[0]
        return media[p + 8 : p + 8 + struct.unpack_from("<I", media, p + 4)[0]]
    if kind == "image/bmp":
        start, _, width, height = struct.unpack_from("<IIii", media, 10)
        return media[start : start + width * abs(height)]
    width, height = struct.unpack_from(">II", media, 16)
    p, data = 8, b""
    while p < len(media):
        n, name = struct.unpack_from(">I4s", media, p)
        data += media[p + 8 : p + 8 + n] if name == b"IDAT" else b""
        p += 12 + n
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def as_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes (of the text's UTF-8), declared (a type that may be wrong), media (its padded bytes, stored)."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts = [x or b"" for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array([declared(padded(x)) for x in texts]), pa.array([stored(padded(x)) for x in texts], pa.binary())], ["doc_id", "n_bytes", "declared", "media"])

    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    return src.mapInArrow(run, f"doc_id {kind}, n_bytes long, declared string, media binary")


def read_back(media: DataFrame) -> DataFrame:
    """Per row of as_media(): sizes and checksums of the samples and of the stored bytes; feature: each medium found (type, place,
    length), mean and spread of the samples, and media inside them; declared, type (corrected), corrected, and the place of the carved
    medium that holds the samples (0: nothing had to be carved)."""
    kind = media.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "type", "corrected", "carved_at")}
            for m, was in zip(b.column("media").to_pylist(), b.column("declared").to_pylist(), strict=True):
                found = sniff(m)
                name, at, size = found[0]
                payload = samples(m[at : at + size], name)
                s = np.frombuffer(payload, np.uint8)
                more = [f"{t}:{a}+{n}" for t, a, n in found]
                inner = [f"{t}:{a}+{n}" for t, a, n in sniff(payload)]
                kept = name if at == 0 else was
                values = len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), f"{','.join(more)};mean={s.mean():.3f};spread={s.std():.3f};inside={','.join(inner)}", kept, kept != was, at
                for k, v in zip(rows, values, strict=True):
                    rows[k].append(v)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), b.column("declared"), *[pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True)]], ["doc_id", "n_bytes", "declared", *rows])

    return media.mapInArrow(run, f"doc_id {kind}, n_bytes long, declared string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, type string, corrected boolean, carved_at long")
