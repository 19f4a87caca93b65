"""Media columns with signature sniffing.

An Aho-Corasick automaton locates every magic number in one pass over a value's bytes. A validator for the format then
confirms structure and length from the bytes themselves. A confirmed match at the start corrects the declared type;
confirmed matches further in are carved out as embedded media. A magic number alone never counts.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexquarry.llm.common import table, text_or_empty, unclashed

UNIT = 64
RATE = 8000
UNKNOWN = "application/octet-stream"

#: Magic numbers of the formats, the place of each within its file, and the media type.
SIGNATURES = [
    (b"RIFF", 0, "audio/wav"),
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"BM", 0, "image/bmp"),
    (b"%PDF-", 0, "application/pdf"),
    (b"PK\x03\x04", 0, "application/zip"),
    (b"fLaC", 0, "audio/flac"),
    (b"ftyp", 4, "video/mp4"),
]


#: What the files of a format end with; without one, no start of such a file needs a look.
TRAILERS = {"application/pdf": b"%%EOF", "application/zip": b"PK\x05\x06"}


class Marks:
    """Where the marks of a value stand. Each kind is looked for once a value, however many starts ask for it."""

    def __init__(self, data: bytes):
        self.data, self.places = data, {}
        self.dead: set[tuple] = set()  # places from which a walk has failed, so no other need come by

    def next(self, mark: bytes, at: int) -> int:
        """The first place of mark from at on, or -1."""
        if mark not in self.places:
            self.places[mark] = [m.start() for m in re.finditer(mark, self.data, re.DOTALL)]
        found = self.places[mark]
        i = bisect_left(found, at)
        return found[i] if i < len(found) else -1


def wav(samples: bytes, rate: int = RATE) -> bytes:
    """Mono 8-bit PCM."""
    odd = len(samples) % 2
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + 8 + len(samples) + odd, b"WAVE") + fmt + struct.pack("<4sI", b"data", len(samples)) + samples + b"\0" * odd


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        yield data[at : at + 4], at + 8, size
        at += 8 + size + size % 2


def wav_parts(data: bytes, at: int = 0, marks: Marks | None = None) -> tuple[int, tuple, int, int] | None:
    """(length, format fields, start and size of the samples) of a whole wave file at this place.

    How a file's chunks go on, up to its end, does not depend on where it began: a walk stops where another with the same
    end, that had met the same kinds, has failed.
    """
    if data[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
    if end > len(data):
        return None
    fmt = samples = None
    dead, walked = marks.dead if marks else set(), []
    for name, start, size in _chunks(data, at + 12, end):
        if start + size > end:
            dead.update(walked)
            return None
        walked.append(("wav", start, bool(fmt), bool(samples), end))
        if walked[-1] in dead:
            dead.update(walked)
            return None
        if name == b"fmt " and size >= 16:
            fmt = struct.unpack_from("<HHIIHH", data, start)
        if name == b"data":
            samples = start, size
    if not fmt or not samples or fmt[0] != 1 or not fmt[1] or fmt[4] != fmt[1] * fmt[5] // 8 or fmt[3] != fmt[2] * fmt[4]:
        dead.update(walked)
        return None
    return end - at, fmt, *samples


def _wav(data: bytes, at: int, marks: Marks) -> int | None:
    found = wav_parts(data, at, marks)
    return found and found[0]


def _png(data: bytes, at: int, marks: Marks) -> int | None:
    i, first, walked = at + 8, True, []
    while i + 12 <= len(data) and ("png", i) not in marks.dead:
        walked += [] if first else [("png", i)]
        size = int.from_bytes(data[i : i + 4], "big")
        kind, end = data[i + 4 : i + 8], i + 12 + size
        if end > len(data) or not kind.isalpha() or first != (kind == b"IHDR") or first and size != 13 or zlib.crc32(data[i + 4 : end - 4]) != int.from_bytes(data[end - 4 : end], "big"):
            break
        if kind == b"IEND":
            return end - at
        i, first = end, False
    marks.dead.update(walked)
    return None


def _gif(data: bytes, at: int, marks: Marks) -> int | None:
    def colours(flags: int) -> int:
        return 3 << ((flags & 7) + 1) if flags & 128 else 0

    if at + 13 > len(data):
        return None
    i, images, walked = at + 13 + colours(data[at + 10]), False, []
    while i < len(data) and ("gif", i, images) not in marks.dead:
        walked.append(("gif", i, images))
        if data[i] == 0x3B:
            if images:
                return i + 1 - at
            break
        if data[i] == 0x2C and i + 10 < len(data):
            i += 11 + colours(data[i + 9])
            images = True
        elif data[i] == 0x21:
            i += 2
        else:
            break
        while i < len(data) and data[i] and ("gif part", i, images) not in marks.dead:
            walked.append(("gif part", i, images))
            i += 1 + data[i]
        if i < len(data) and data[i]:
            break
        i += 1
    marks.dead.update(walked)
    return None


def _jpeg(data: bytes, at: int, marks: Marks) -> int | None:
    i, scans, walked = at + 2, False, []
    while i + 4 <= len(data) and data[i] == 0xFF and ("jpeg", i, scans) not in marks.dead:
        walked.append(("jpeg", i, scans))
        mark, size = data[i + 1], int.from_bytes(data[i + 2 : i + 4], "big")
        if mark == 0xD9:
            break
        if mark == 0xFF:
            i += 1
            continue
        if size < 2 or not 0xC0 <= mark <= 0xFE:
            break
        i += 2 + size
        if mark == 0xDA:  # entropy-coded bytes run up to the next mark that is neither stuffed nor a restart
            scans = True
            if (i := marks.next(b"\xff(?=[^\x00\xd0-\xd7])", i)) < 0:
                break
    if scans and i >= 0 and data[i : i + 2] == b"\xff\xd9":
        return i + 2 - at
    marks.dead.update(walked)
    return None


def _bmp(data: bytes, at: int, marks: Marks) -> int | None:
    if at + 54 > len(data):
        return None
    size, reserved, offset, header = struct.unpack_from("<IIII", data, at + 2)
    width, height, planes, bits = struct.unpack_from("<iiHH", data, at + 18)
    ok = reserved == 0 and header >= 40 and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and width > 0 and height and 54 <= offset < size
    return size if ok and at + size <= len(data) and offset + (width * bits + 31) // 32 * 4 * abs(height) <= size else None


def _pdf(data: bytes, at: int, marks: Marks) -> int | None:
    if not data[at + 5 : at + 8].replace(b".", b"").isdigit():
        return None
    end = marks.next(b"%%EOF", at)
    return end + 5 - at if end >= 0 and 0 <= marks.next(b"startxref", at) <= end - 9 else None


def _zip(data: bytes, at: int, marks: Marks) -> int | None:
    end = marks.next(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(data):
        return None
    size, start, note = struct.unpack_from("<IIH", data, end + 12)
    return end + 22 + note - at if at + start + size == end and end + 22 + note <= len(data) and data[at + start : at + start + 4] == b"PK\x01\x02" else None


def _flac(data: bytes, at: int, marks: Marks) -> int | None:
    i, walked = at + 4, []
    while i + 4 <= len(data) and ("flac", i) not in marks.dead:
        walked += [("flac", i)] if i > at + 4 else []
        last, size = data[i], int.from_bytes(data[i + 1 : i + 4], "big")
        if i == at + 4 and (last & 127 or size != 34):
            return None
        i += 4 + size
        if last & 128:  # frames have no length of their own: they go on to the end
            if i + 2 <= len(data) and data[i] == 0xFF and data[i + 1] & 0xFC == 0xF8:
                return len(data) - at
            break
    marks.dead.update(walked)
    return None


def _mp4(data: bytes, at: int, marks: Marks) -> int | None:
    i, seen, walked = at, set(), []
    while i + 8 <= len(data):
        if b"moov" not in seen:
            if ("mp4", i) in marks.dead:
                break
            walked.append(("mp4", i))
        size, kind = int.from_bytes(data[i : i + 4], "big"), data[i + 4 : i + 8]
        if size < 8 or i + size > len(data) or not kind.isalnum():
            break
        seen.add(kind)
        i += size
    if {b"ftyp", b"moov"} <= seen:
        return i - at
    marks.dead.update(walked)
    return None


VALIDATORS = {"audio/wav": _wav, "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "image/bmp": _bmp, "application/pdf": _pdf, "application/zip": _zip, "audio/flac": _flac, "video/mp4": _mp4}


@lru_cache(1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic, offset, kind in SIGNATURES:
        found.add_word(magic.decode("latin-1"), (len(magic) + offset, kind))
    found.make_automaton()
    return found


def sniff(data: bytes) -> list[tuple[str, int, int]]:
    """(type, start, length) of the confirmed media in data, from the left and without overlaps, but for what a file at
    the start holds within itself, which is listed too."""
    out, free, marks = [], 0, Marks(data)
    looked = {kind for kind in VALIDATORS if kind not in TRAILERS or TRAILERS[kind] in data}
    hits = ((end + 1 - size, kind) for end, (size, kind) in _automaton().iter(data.decode("latin-1")) if kind in looked)
    for start, kind in sorted(hits):
        if start < 0 or start < free:
            continue
        length = VALIDATORS[kind](data, start, marks)
        if length:
            out.append((kind, start, length))
            free = start + length if start else 0
    return out


def features(data: bytes) -> tuple[str, bytes, list[tuple[str, int, int]], str]:
    """(detected type, payload, embedded, feature) of stored bytes; a wave file's payload is its samples."""
    found = sniff(data)
    kind, payload, told = UNKNOWN, data, []
    if found and found[0][1] == 0:
        kind, found = found[0][0], found[1:]
    if kind == "audio/wav":
        _, fmt, start, size = wav_parts(data)
        payload = data[start : start + size]
        level = np.frombuffer(payload, np.uint8)
        told = [f"rate={fmt[2]}", f"bits={fmt[5]}", f"frames={size // max(1, fmt[4])}", f"peak={int(level.max(initial=0))}", f"sum={int(level.sum(dtype=np.int64))}"]
    inside = ",".join(f"{k}@{a}+{n}" for k, a, n in found)
    return kind, payload, found, ";".join([kind, *told, f"embedded={inside or 'none'}"])


def padded(data: bytes, unit: int = UNIT) -> bytes:
    """With bytes 0 up to a positive multiple of unit."""
    return data + b"\0" * (unit - len(data) if not data else -len(data) % unit)


def store(text: Column) -> Column:
    """The text's UTF-8 bytes as a wave file of 8-bit samples."""

    @F.pandas_udf("binary")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([wav(padded(t.encode())) for t in texts], dtype=object)

    return of(F.coalesce(text, F.lit("")))


def inspect(media: DataFrame, data: str = "media", declared: str | None = None) -> DataFrame:
    """media with a struct `sniffed` (renamed if taken): declared, detected, corrected (they differ), payload, embedded, feature.

    Null data: empty bytes, of unknown type. Equal bytes give equal values; nothing else is looked at, so repeated rows,
    null keys and extra columns make no difference.
    """

    @F.pandas_udf("detected string, payload binary, embedded array<struct<type:string,start:long,length:long>>, feature string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for values in batches:
            rows = []
            for value in values:
                kind, payload, found, feature = features(bytes(value))
                rows.append((kind, payload, [{"type": k, "start": a, "length": n} for k, a, n in found], feature))
            yield pd.DataFrame(rows, columns=["detected", "payload", "embedded", "feature"])

    told = F.col(declared) if declared else F.lit(None).cast("string")
    name = unclashed(media, "sniffed")
    seen = media.withColumn(name, of(F.coalesce(F.col(data), F.lit(b""))))
    return seen.withColumn(name, F.struct(told.alias("declared"), (~told.eqNullSafe(F.col(f"{name}.detected"))).alias("corrected"), f"{name}.*"))


def op5(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    stored = docs.select("doc_id", F.octet_length(text_or_empty()).cast("long").alias("n_bytes"), store(F.col("text")).alias("media"), F.lit(UNKNOWN).alias("declared"))
    seen = inspect(stored, "media", "declared")
    payload = F.col("sniffed.payload")
    return seen.select(
        "doc_id",
        "n_bytes",
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -UNIT, UNIT)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.col("sniffed.feature").alias("feature"),
    )
