"""Media columns: signature sniffing.

One Aho-Corasick pass over a blob locates the magic bytes of all known formats; a format's validator
then confirms structure and lengths at each place. The confirmed format at offset 0 corrects the declared
type; confirmed formats further in are carved as embedded media. Bytes that only look like a
signature fail validation and are ignored.

Supported: RIFF/WAVE, BMP, PNG, GIF, JPEG, gzip, ZIP (local header), PDF.

Edge cases: a null text is an empty one, whose payload is one block of padding. A null blob has no
type. Repeated rows are independent. An empty table gives an empty result. Other columns don't matter.
"""

from __future__ import annotations

import bisect
import functools
import re
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_slices, written

BLOCK = 576
SAMPLE_RATE = 8000
DECLARED = "application/octet-stream"
PIECE = 1 << 16  # bytes that are inflated at a time
SLICE = 1 << 20  # bytes that are worked on at a time

#: The formats' published signatures.
SIGNATURES = {
    b"RIFF": "audio/wav",
    b"BM": "image/bmp",
    b"\x89PNG\r\n\x1a\n": "image/png",
    b"GIF87a": "image/gif",
    b"GIF89a": "image/gif",
    b"\xff\xd8\xff": "image/jpeg",
    b"\x1f\x8b\x08": "application/gzip",
    b"PK\x03\x04": "application/zip",
    b"%PDF-": "application/pdf",
}


class Found(NamedTuple):
    """A confirmed medium: its bytes are ``[start, end)``, its samples or body ``[body, body_end)``."""

    kind: str
    start: int
    end: int
    body: int
    body_end: int


def _wav(b: bytes, at: int) -> tuple[int, int, int] | None:
    if len(b) < at + 44 or b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return None
    p, align = at + 12, 0
    while p + 8 <= end:
        tag, size = b[p : p + 4], struct.unpack_from("<I", b, p + 4)[0]
        if p + 8 + size > end:
            return None
        if tag == b"fmt " and size >= 16:
            kind, channels, rate, per_second, align, bits = struct.unpack_from("<HHIIHH", b, p + 8)
            if not channels or align != channels * ((bits + 7) // 8) or per_second != rate * align:
                return None
        if tag == b"data":
            return (end, p + 8, p + 8 + size) if align and size % align == 0 else None
        p += 8 + size + (size & 1)
    return None


def _bmp(b: bytes, at: int) -> tuple[int, int, int] | None:
    if len(b) < at + 54:
        return None
    size, zero, body, header, width, height, planes, bits, packed = struct.unpack_from("<IIIIiiHHI", b, at + 2)
    if zero or planes != 1 or header < 40 or bits not in (1, 4, 8, 16, 24, 32) or packed or width <= 0 or not height:
        return None
    rows = (width * bits + 31) // 32 * 4 * abs(height)
    if body < 14 + header or body + rows > size or at + size > len(b):
        return None
    return at + size, at + body, at + body + rows


def _png(b: bytes, at: int) -> tuple[int, int, int] | None:
    p, first = at + 8, None
    while p + 12 <= len(b):
        size, tag = struct.unpack_from(">I4s", b, p)
        if p + 12 + size > len(b) or zlib.crc32(b[p + 4 : p + 8 + size]) != struct.unpack_from(">I", b, p + 8 + size)[0]:
            return None
        if first is None:
            if tag != b"IHDR" or size != 13:
                return None
            first = p
        p += 12 + size
        if tag == b"IEND":
            return p, first, p
    return None


def _gif(b: bytes, at: int) -> tuple[int, int, int] | None:
    if len(b) < at + 14:
        return None
    flags = b[at + 10]
    p = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)
    body = p

    def skip(p: int) -> int:
        while p < len(b) and b[p]:
            p += 1 + b[p]
        return p + 1

    while p < len(b):
        if b[p] == 0x3B:
            return p + 1, body, p
        if b[p] == 0x21:
            p = skip(p + 2)
        elif b[p] == 0x2C and p + 11 <= len(b):
            local = b[p + 9]
            p = skip(p + 11 + (3 << (local & 7) + 1 if local & 0x80 else 0))
        else:
            return None
    return None


@functools.lru_cache(maxsize=4)
def _places(b: bytes, mark: bytes) -> list[int]:
    """All places of a trailer: looked for once in a blob, however many magics it holds."""
    return [m.start() for m in re.finditer(b"(?=" + re.escape(mark) + b")", b)]


def _next(b: bytes, mark: bytes, at: int) -> int | None:
    places = _places(b, mark)
    k = bisect.bisect_left(places, at)
    return places[k] if k < len(places) else None


def _jpeg(b: bytes, at: int) -> tuple[int, int, int] | None:
    p = at + 2
    while p + 4 <= len(b) and b[p] == 0xFF:
        mark, size = b[p + 1], struct.unpack_from(">H", b, p + 2)[0]
        if size < 2 or p + 2 + size > len(b):
            return None
        p += 2 + size
        if mark == 0xDA:
            end = _next(b, b"\xff\xd9", p)
            return (end + 2, p, end) if end is not None else None
    return None


def _gzip(b: bytes, at: int) -> tuple[int, int, int] | None:
    try:
        unpack, view, p = zlib.decompressobj(31), memoryview(b), at
        while p < len(b) and not unpack.eof:
            part = view[p : p + PIECE]
            p += len(part)
            while len(part) and not unpack.eof:
                unpack.decompress(part, 1 << 20)
                part = unpack.unconsumed_tail
        end = p - len(unpack.unused_data)
        return (end, at + 10, end - 8) if unpack.eof else None
    except zlib.error:
        return None


def _zip(b: bytes, at: int) -> tuple[int, int, int] | None:
    if len(b) < at + 30:
        return None
    version, _, method = struct.unpack_from("<HHH", b, at + 4)
    packed, name, extra = struct.unpack_from("<I", b, at + 18)[0], *struct.unpack_from("<HH", b, at + 26)
    body = at + 30 + name + extra
    return (body + packed, body, body + packed) if version <= 63 and method in (0, 8, 12, 14, 93) and name and body + packed <= len(b) else None


def _pdf(b: bytes, at: int) -> tuple[int, int, int] | None:
    end = _next(b, b"%%EOF", at)
    if end is None:
        return None
    table = _next(b, b"startxref", at)
    return (end + 5, at + 8, end) if table is not None and table + 9 <= end else None


VALIDATORS = {"audio/wav": _wav, "image/bmp": _bmp, "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "application/gzip": _gzip, "application/zip": _zip, "application/pdf": _pdf}


@functools.cache
def _automaton():
    import ahocorasick

    machine = ahocorasick.Automaton()
    for magic, kind in SIGNATURES.items():
        machine.add_word(magic.decode("latin-1"), (len(magic), kind))
    machine.make_automaton()
    return machine


def sniff(blob: bytes) -> list[Found]:
    """All confirmed media in ``blob`` that don't lie inside an earlier one's body, by offset; what
    lies inside one is found by sniffing that body."""
    out, free = [], 0
    for last, (length, kind) in _automaton().iter(blob.decode("latin-1")):
        at = last + 1 - length
        if at >= free and (spans := VALIDATORS[kind](blob, at)):
            out.append(Found(kind, at, *spans))
            free = spans[0]
    return out


def payload_of(text: bytes) -> bytes:
    """The text, with bytes 255 up to a positive multiple of 576."""
    size = max(BLOCK, -(-len(text) // BLOCK) * BLOCK)
    return text + b"\xff" * (size - len(text))


def as_wav(payload: bytes) -> bytes:
    """8-bit mono PCM; the payload's bytes are its samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8, b"data", len(payload)) + payload


def _encoded(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = [t or b"" for t in batch.column(1).to_pylist()]
    media = pa.array([as_wav(payload_of(t)) for t in texts], pa.binary())
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array([DECLARED] * len(texts), pa.string()), media], ["doc_id", "n_bytes", "declared_type", "media"])


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, declared_type, media: each whole text's payload as 8-bit samples of a WAVE file."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", SLICE):
            yield _encoded(part)

    return _bytes(docs, id_col, text_col).mapInArrow(encode, "doc_id long, n_bytes long, declared_type string, media binary")


def _bytes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


CARVED = "array<struct<type: string, start: long, end: long>>"


def examined(blob: bytes | None, declared: str | None) -> tuple:
    """The corrected type, whether it differs from the declared one, the body that the type's validator
    confirmed, what is embedded in that body (or, without a confirmed type, anywhere), and its features."""
    if blob is None:
        return None, False, None, [], None
    found = sniff(blob)
    own = found[0] if found and found[0].start == 0 else None
    body, carved = blob, found
    if own:
        body = blob[own.body : own.body_end]
        carved = [f._replace(start=f.start + own.body, end=f.end + own.body) for f in sniff(body)] + found[1:]
    kind = own.kind if own else declared
    return kind, kind != declared, body, [{"type": f.kind, "start": f.start, "end": f.end} for f in carved], features(body)


def sniffed(media: DataFrame, keep: tuple[str, ...] = ("doc_id",), media_col: str = "media", declared_col: str = "declared_type") -> DataFrame:
    """``keep`` and, for each blob, type, corrected, body, carved, features as ``examined`` finds them."""
    schema = ", ".join(f"{k} {t}" for k, t in media.select(*keep).dtypes)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, media_col, SLICE):
            out = list(map(examined, part.column(len(keep)).to_pylist(), part.column(len(keep) + 1).to_pylist()))
            columns = [pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.bool_(), pa.binary(), _CARVED, pa.string()))]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *columns], [*keep, "type", "corrected", "body", "carved", "features"])

    return media.select(*keep, media_col, declared_col).mapInArrow(look, f"{schema}, type string, corrected boolean, body binary, carved {CARVED}, features string")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What sniffing finds in the stored media, as lengths and digests: the media table is written and read back."""
    media = written(stored(docs, id_col, text_col), "media")
    media = media.select("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media", "declared_type")
    found = sniffed(media, ("doc_id", "n_bytes", "media_bytes", "media_sha256"))
    carved = F.concat_ws(",", F.transform("carved", lambda c: F.concat_ws(":", c["type"], c["start"], c["end"])))
    return found.select(
        "doc_id",
        "n_bytes",
        F.octet_length("body").cast("long").alias("payload_bytes"),
        F.sha2("body", 256).alias("payload_sha256"),
        F.crc32(F.substring("body", -32, 32)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        F.concat("type", F.lit(";"), "features", F.lit(";carved="), carved).alias("feature"),
    )


_CARVED = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def features(samples: bytes) -> str:
    """Level, energy and entropy of 8-bit samples (unsigned, centre 128)."""
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    n = max(1, len(samples))
    level = np.arange(256) - 128
    share = counts[counts > 0] / n
    return f"mean={int((counts * level).sum()) / n:.4f};rms={(int((counts * level * level).sum()) / n) ** 0.5:.4f};bits={float(-(share * np.log2(share)).sum()) + 0.0:.4f};distinct={len(share)}"


def op1_media_sniff(spark, sf_dir: str) -> DataFrame:
    """Stores each text's payload as a WAVE file declared as plain bytes, and reads back what sniffing confirms."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
