"""Media columns: store bytes as a medium, find media by signature, validate, correct and carve.

An Aho-Corasick automaton locates magic bytes; for each place a validator of that format follows
its structure and gives the medium's length, or nothing if the structure or the lengths don't
hold. The medium at offset 0 corrects a wrong declared type; those further on are carved.

Null bytes and texts count as empty; a row gives a row; only the named columns are read, so other
columns may have any names. A row needs nothing of other rows: no shuffle.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, slices, texts_of

# Signatures of public formats.
SIGNATURES = (
    (b"\x89PNG\r\n\x1a\n", "image/png"),
    (b"GIF87a", "image/gif"),
    (b"GIF89a", "image/gif"),
    (b"\xff\xd8\xff", "image/jpeg"),
    (b"BM", "image/bmp"),
    (b"RIFF", "riff"),
    (b"%PDF-", "application/pdf"),
    (b"PK\x03\x04", "application/zip"),
    (b"\x1f\x8b\x08", "application/gzip"),
    (b"MThd", "audio/midi"),
)
RIFF_FORMS = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}
UNKNOWN = "application/octet-stream"
#: Samples per second that stored payloads declare.
RATE = 8000
#: Bytes that are inflated at once.
STEP = 1 << 16
#: Payloads are padded to a positive multiple of this.
BLOCK = 64


def wave(samples: bytes) -> bytes:
    """A mono 8-bit PCM file of these samples (an even number of them)."""
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8)
    body = b"WAVE" + form + struct.pack("<4sI", b"data", len(samples)) + samples
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def riff_chunks(data: bytes, at: int):
    """(id, start, length) of each chunk of the RIFF file there; None where lengths don't hold."""
    end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
    place = at + 12
    if end > len(data) or place > end:
        return None
    out = []
    while place < end:
        if place + 8 > end:
            return None
        length = int.from_bytes(data[place + 4 : place + 8], "little")
        if place + 8 + length > end:
            return None
        out.append((data[place : place + 4], place + 8, length))
        place += 8 + length + length % 2
    return out


def _riff(data: bytes, at: int):
    kind = RIFF_FORMS.get(data[at + 8 : at + 12])
    chunks = riff_chunks(data, at) if kind else None
    if not chunks or kind == "audio/wav" and [c[0] for c in chunks[:1]] != [b"fmt "]:
        return None
    return kind, 8 + int.from_bytes(data[at + 4 : at + 8], "little")


def _png(data: bytes, at: int):
    place, first = at + 8, True
    while place + 12 <= len(data):
        length = int.from_bytes(data[place : place + 4], "big")
        kind = data[place + 4 : place + 8]
        if place + 12 + length > len(data) or first and (kind != b"IHDR" or length != 13):
            return None
        if zlib.crc32(memoryview(data)[place + 4 : place + 8 + length]) != int.from_bytes(data[place + 8 + length : place + 12 + length], "big"):
            return None
        place, first = place + 12 + length, False
        if kind == b"IEND":
            return "image/png", place - at
    return None


def _gif(data: bytes, at: int):
    if at + 13 > len(data):
        return None
    flags, place = data[at + 10], at + 13
    place += 3 << ((flags & 7) + 1) if flags & 128 else 0
    images = 0
    while place < len(data):
        mark = data[place]
        if mark == 0x3B:
            return ("image/gif", place + 1 - at) if images else None
        if mark == 0x21:
            place += 2
        elif mark == 0x2C and place + 10 <= len(data):
            local = data[place + 9]
            place += 11 + (3 << ((local & 7) + 1) if local & 128 else 0)
            images += 1
        else:
            return None
        while place < len(data) and data[place]:
            place += data[place] + 1
        place += 1
    return None


def _jpeg(data: bytes, at: int):
    place, scans = at + 2, 0
    while place + 4 <= len(data) and data[place] == 0xFF:
        mark = data[place + 1]
        if mark == 0xD9:
            return ("image/jpeg", place + 2 - at) if scans else None
        length = int.from_bytes(data[place + 2 : place + 4], "big")
        if mark < 0xC0 or 0xD0 <= mark <= 0xD8 or length < 2:
            return None
        place += 2 + length
        if mark == 0xDA:
            scans += 1
            while True:  # entropy-coded data: up to a marker that is neither stuffing nor a restart
                place = data.find(b"\xff", place)
                if place < 0 or place + 1 >= len(data):
                    return None
                if data[place + 1] and not 0xD0 <= data[place + 1] <= 0xD7:
                    break
                place += 2
    return ("image/jpeg", place + 2 - at) if scans and data[place : place + 2] == b"\xff\xd9" else None


def _bmp(data: bytes, at: int):
    if at + 30 > len(data):
        return None
    length, reserved, start, header = struct.unpack_from("<IIII", data, at + 2)
    planes, depth = struct.unpack_from("<HH", data, at + 26)
    good = reserved == 0 and header in (40, 52, 56, 108, 124) and 14 + header <= start <= length <= len(data) - at and planes == 1 and depth in (1, 4, 8, 16, 24, 32)
    return ("image/bmp", length) if good else None


def _pdf(data: bytes, at: int):
    """Up to the last end mark before the next header: an updated file has several."""
    if not re.match(rb"%PDF-\d\.\d", data[at : at + 8]):
        return None
    limit = _next(data, b"%PDF-", at + 1)
    end = _last(data, b"%%EOF", limit)
    start = _last(data, b"startxref", end) if end >= 0 else -1
    return ("application/pdf", end + 5 - at) if at < start < end else None


def _zip(data: bytes, at: int):
    for end in _marks(data, b"PK\x05\x06", at):
        if end + 22 <= len(data):
            size, offset, note = struct.unpack_from("<IIH", data, end + 12)
            if at + offset + size == end and end + 22 + note <= len(data):
                return "application/zip", end + 22 + note - at
    return None


def _gzip(data: bytes, at: int):
    """Inflated in steps, none of which is kept: memory doesn't follow what a stream claims to hold."""
    d, view, place = zlib.decompressobj(31), memoryview(data), at
    try:
        while not d.eof:
            if not d.unconsumed_tail:
                part, place = view[place : place + STEP], place + STEP
            else:
                part = d.unconsumed_tail
            if not d.decompress(part, STEP) and not part:
                return None
    except zlib.error:
        return None
    return "application/gzip", min(place, len(data)) - at - len(d.unused_data)


@lru_cache(maxsize=4)
def _places(data: bytes, mark: bytes) -> list[int]:
    """All places of a mark, found once for a medium."""
    return [m.start() for m in re.finditer(re.escape(mark), data)]


def _marks(data: bytes, mark: bytes, at: int) -> list[int]:
    found = _places(data, mark)
    return found[bisect_left(found, at) :]


def _next(data: bytes, mark: bytes, at: int) -> int:
    found = _places(data, mark)
    i = bisect_left(found, at)
    return found[i] if i < len(found) else len(data)


def _last(data: bytes, mark: bytes, before: int) -> int:
    found = _places(data, mark)
    i = bisect_left(found, before)
    return found[i - 1] if i else -1


def _midi(data: bytes, at: int):
    if at + 14 > len(data):
        return None
    length, form, tracks, _ = struct.unpack_from(">IHHH", data, at + 4)
    if length != 6 or form > 2 or not tracks:
        return None
    place = at + 14
    for _ in range(tracks):
        if data[place : place + 4] != b"MTrk":
            return None
        place += 8 + int.from_bytes(data[place + 4 : place + 8], "big")
        if place > len(data):
            return None
    return "audio/midi", place - at


VALIDATORS = {
    "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "image/bmp": _bmp, "riff": _riff,
    "application/pdf": _pdf, "application/zip": _zip, "application/gzip": _gzip, "audio/midi": _midi,
}


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic, kind in SIGNATURES:
        found.add_word(magic.decode("latin-1"), (len(magic), kind))
    found.make_automaton()
    return found


def sniff(data: bytes) -> list[tuple[str, int, int]]:
    """(type, offset, length) of each valid medium in data, by offset; outer ones before those they hold."""
    out = []
    for last, (length, kind) in _automaton().iter(data.decode("latin-1")):
        at = last + 1 - length
        if valid := VALIDATORS[kind](data, at):
            out.append((valid[0], at, valid[1]))
    return sorted(out, key=lambda x: (x[1], -x[2]))


def samples_of(medium: bytes) -> bytes | None:
    """The data chunk of a stored WAV; None if it isn't one."""
    for kind, start, length in riff_chunks(medium, 0) or ():
        if kind == b"data":
            return medium[start : start + length]
    return None


def features(samples: bytes) -> str:
    """Sample count, mean, mean square and crossings of the middle line, in whole numbers."""
    x = np.frombuffer(samples, np.uint8)
    n = max(len(x), 1)
    crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    total = int(x.sum(dtype=np.int64))
    squares = int(np.bincount(x, minlength=256) @ (np.arange(256) ** 2))
    return f"n={len(x)};mean={total // n};ms={squares // n};cross={crossings}"


def store_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, media_type, media): each text's UTF-8 bytes, padded by zeros to a positive multiple of 64, as WAV."""
    kept = docs.select(F.col(id_column), F.col(text_column))
    schema = T.StructType([kept.schema[0], T.StructField("n_bytes", T.LongType()), T.StructField("media_type", T.StringType()), T.StructField("media", T.BinaryType())])
    names = [f.name for f in schema]

    def store(batches):
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, b in slices([len(x) for x in texts], 8 << 20):
                media = [wave(x + bytes(max(BLOCK, -(-len(x) // BLOCK) * BLOCK) - len(x))) for x in texts[a:b]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(x) for x in texts[a:b]], pa.int64()), pa.array(["audio/wav"] * (b - a)), pa.array(media, pa.binary())], names=names)

    return map_batches(kept, store, schema)


def inspect_media(media: DataFrame, keep: list[str], media_column: str = "media", type_column: str = "media_type") -> DataFrame:
    """The ``keep`` columns, then what the stored bytes show.

    detected_type and corrected (declared type was another), carved (type, offset, length of media
    beyond offset 0), media_bytes, media_sha256, and of the samples read back from a WAV (null for
    other media): payload_bytes, payload_sha256, tail_crc32 (of the last 64), feature.
    """
    kept = media.select(*keep, F.col(type_column).alias("_declared"), F.col(media_column).alias("_media"))
    span = T.StructType([T.StructField("type", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())])
    added = T.StructType([
        T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType()),
        T.StructField("detected_type", T.StringType()), T.StructField("corrected", T.BooleanType()), T.StructField("carved", T.ArrayType(span)),
    ])
    schema = T.StructType(kept.schema.fields[: len(keep)] + added.fields)
    kind = pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.list_(kind)]

    def look(batches):
        for batch in batches:
            rows = []
            for declared, data in zip(batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1), strict=True):
                data = data.as_py() or b""
                found = sniff(data)
                first = next((t for t, at, _ in found if at == 0), UNKNOWN)
                samples = samples_of(data) if first == "audio/wav" else None
                own = (None,) * 3 if samples is None else (len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-BLOCK:]))
                carved = [{"type": t, "offset": at, "length": n} for t, at, n in found if at]
                feature = f"{first};" + (features(samples) if samples is not None else f"bytes={len(data)}")
                rows.append((*own, len(data), hashlib.sha256(data).hexdigest(), feature, first, first != declared, carved))
            columns = list(zip(*rows, strict=True)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[f.name for f in schema])

    return map_batches(kept, look, schema)
