"""Media columns: payloads as 8-bit audio, and signature sniffing of any binary column.

An Aho-Corasick automaton finds all magic bytes in one pass; a validator of each format walks its structure from there and gives its
length, or nothing. What is valid at offset 0 corrects the declared type; what is valid inside is carved.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left, bisect_right
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import map_batches

UNIT, RATE = 576, 8000


def wav(data: bytes, rate: int = RATE) -> bytes:
    """A RIFF/WAVE file of 8-bit mono samples."""
    pad = b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", 36 + len(data) + len(pad)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(data)) + data + pad


def wav_samples(media: bytes, at: int = 0) -> tuple[int, int] | None:
    """First and end byte of the samples of the WAVE file at an offset; None if its chunks do not fit."""
    if media[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + int.from_bytes(media[at + 4 : at + 8], "little")
    if end > len(media):
        return None
    k, found = at + 12, None
    while k + 8 <= end:
        size = int.from_bytes(media[k + 4 : k + 8], "little")
        if k + 8 + size > end:
            return None
        if media[k : k + 4] == b"data":
            found = (k + 8, k + 8 + size)
        k += 8 + size + size % 2
    return found if k == end else None


def valid_wav(b: bytes, at: int, seen: Seen) -> int | None:
    return 8 + int.from_bytes(b[at + 4 : at + 8], "little") if wav_samples(b, at) else None


def valid_png(b: bytes, at: int, seen: Seen) -> int | None:
    k, first = at + 8, True
    while k + 12 <= len(b):
        size, kind = int.from_bytes(b[k : k + 4], "big"), b[k + 4 : k + 8]
        if k + 12 + size > len(b) or first != (kind == b"IHDR") or zlib.crc32(b[k + 4 : k + 8 + size]) != int.from_bytes(b[k + 8 + size : k + 12 + size], "big"):
            return None
        k, first = k + 12 + size, False
        if kind == b"IEND":
            return k - at
    return None


def gif_blocks(b: bytes, k: int, ends: dict[int, int]) -> int:
    """Behind the terminator of the chain of sub-blocks at k, or behind all bytes; ends remembers the chains of a text."""
    at = []
    while k < len(b) and b[k] and k not in ends:
        at.append(k)
        k += 1 + b[k]
    end = ends.get(k, k + 1)
    ends.update(dict.fromkeys(at, end))
    return end


def valid_gif(b: bytes, at: int, seen: Seen) -> int | None:
    if b[at + 4 : at + 6] not in (b"7a", b"9a") or at + 13 > len(b):
        return None
    k, blocks = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 0x80 else 0), []
    while k < len(b) and k not in seen.gif:
        blocks.append(k)
        if b[k] == 0x2C and k + 10 <= len(b):
            k = gif_blocks(b, k + 11 + (3 << (b[k + 9] & 7) + 1 if b[k + 9] & 0x80 else 0), seen.chains)
        elif b[k] == 0x21:
            k = gif_blocks(b, k + 2, seen.chains)
        else:
            seen.gif[k] = k + 1 if b[k] == 0x3B else None
    end = seen.gif.get(k)
    seen.gif.update(dict.fromkeys(blocks, end))
    return None if end is None else end - at


def valid_jpeg(b: bytes, at: int, seen: Seen) -> int | None:
    k = at + 2
    while k + 4 <= len(b) and b[k] == 0xFF:
        kind, size = b[k + 1], int.from_bytes(b[k + 2 : k + 4], "big")
        if size < 2 or k + 2 + size > len(b):
            return None
        k += 2 + size
        if kind == 0xDA:
            while (k := b.find(b"\xff", k)) >= 0 and k + 1 < len(b):
                if b[k + 1] == 0xD9:
                    return k + 2 - at
                if b[k + 1] == 0 or 0xD0 <= b[k + 1] <= 0xD7 or b[k + 1] == 0xFF:
                    k += 1 if b[k + 1] == 0xFF else 2
                else:
                    break
            if k < 0:
                return None
    return None


def valid_pdf(b: bytes, at: int, seen: Seen) -> int | None:
    """To the last %%EOF of the file, each with a startxref before it; the next header behind an %%EOF begins another file."""
    if not re.match(rb"%PDF-[0-9]\.[0-9][\r\n]", b[at : at + 9]):
        return None
    ends, (started, headed) = seen.places(b"%%EOF"), seen.segments
    if (n := bisect_left(ends, at)) == len(ends):
        return None
    if not seen.between(b"startxref", at, ends[n]):
        if (k := bisect_right(started, n)) == len(started):
            return None
        n = started[k]
    k = bisect_right(headed, n)
    k = bisect_left(started, headed[k] if k < len(headed) else len(ends))
    return ends[max(n, started[k - 1] if k else n)] + 5 - at


def valid_zip(b: bytes, at: int, seen: Seen) -> int | None:
    if at + 30 > len(b) or int.from_bytes(b[at + 8 : at + 10], "little") not in (0, 8):
        return None
    return (end - at) if (end := seen.archives.get(at)) is not None else None


def valid_ogg(b: bytes, at: int, seen: Seen) -> int | None:
    k, pages = at, []
    while k not in seen.ogg:
        pages.append(k)
        n = b[k + 26] if k + 27 <= len(b) else 0
        end = k + 27 + n + sum(b[k + 27 : k + 27 + n])
        if b[k : k + 5] != b"OggS\0" or end > len(b):
            seen.ogg[k] = None
        elif b[k + 5] & 4:
            seen.ogg[k] = end
        else:
            k = end
    end = seen.ogg[k]
    seen.ogg.update(dict.fromkeys(pages, end))
    return None if end is None else end - at


class Seen:
    """What the validators of one text share, so that magic bytes that recur cost no more than one pass: where marks stand, which
    archives end, and how walks that meet go on."""

    def __init__(self, data: bytes):
        self.data, self.marks = data, {}
        self.chains, self.gif, self.ogg = {}, {}, {}

    def places(self, mark: bytes) -> list[int]:
        if mark not in self.marks:
            self.marks[mark] = [m.start() for m in re.finditer(re.escape(mark), self.data)]
        return self.marks[mark]

    def between(self, mark: bytes, a: int, b: int) -> bool:
        """Whether a mark lies wholly in data[a:b]."""
        k = bisect_left(self.places(mark), a)
        return k < len(self.places(mark)) and self.places(mark)[k] + len(mark) <= b

    @cached_property
    def segments(self) -> tuple[list[int], list[int]]:
        """Of the parts between an %%EOF and the next (numbered by the latter), those with a startxref, and those with the head of a file."""
        ends = self.places(b"%%EOF")
        parts = [(n, ends[n - 1] + 5, ends[n]) for n in range(1, len(ends))]
        return [n for n, a, b in parts if self.between(b"startxref", a, b)], [n for n, a, b in parts if self.between(b"%PDF-", a, b)]

    @cached_property
    def archives(self) -> dict[int, int]:
        """Start and end of each archive whose end record fits: the record says where its directory and so where it began. Of several with
        one start the first counts."""
        b, out = self.data, {}
        for k in self.places(b"PK\5\6"):
            if k <= len(b) - 22:
                size, first = struct.unpack("<II", b[k + 12 : k + 20])
                at = k - size - first
                if at >= 0 and b[at + first : at + first + 4] == b"PK\1\2":
                    out.setdefault(at, k + 22 + int.from_bytes(b[k + 20 : k + 22], "little"))
        return out


#: Magic bytes, media type and validator of each format.
FORMATS = {
    b"RIFF": ("audio/wav", valid_wav), b"\x89PNG\r\n\x1a\n": ("image/png", valid_png), b"GIF8": ("image/gif", valid_gif), b"\xff\xd8\xff": ("image/jpeg", valid_jpeg),
    b"%PDF-": ("application/pdf", valid_pdf), b"PK\3\4": ("application/zip", valid_zip), b"OggS": ("audio/ogg", valid_ogg),
}


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for magic in FORMATS:
        a.add_word(magic.decode("latin-1"), magic)
    a.make_automaton()
    return a


def sniff(media: bytes, declared: str | None) -> tuple[str, int, list[tuple[str, int, int]]]:
    """Corrected type, its valid length (0 if none is valid at offset 0), and (type, offset, length) of valid media inside,
    outermost first, none within another. A declared type that no structure contradicts stays; without one it is application/octet-stream.
    Empty bytes hold nothing. Validators share what they find (Seen), so that marks which recur by the thousand do not each search to the end."""
    found, kind, size, done, seen = [], declared or "application/octet-stream", 0, 0, Seen(media)
    for end, magic in automaton().iter(media.decode("latin-1")):
        at = end + 1 - len(magic)
        if at and at < done:
            continue
        name, check = FORMATS[magic]
        if (length := check(media, at, seen)) is not None:
            if at == 0:
                kind, size = name, length
            else:
                found.append((name, at, length))
                done = at + length
    return kind, size, found


def audio_features(samples: np.ndarray) -> str:
    """Exact integer features: count, sum, sum of squares, extremes, crossings of the midline."""
    x = samples.astype(np.int64)
    up = samples >= 128
    return f"n={len(x)};sum={x.sum()};sq={(x * x).sum()};min={x.min()};max={x.max()};cross={int((up[1:] != up[:-1]).sum())}"


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = UNIT) -> DataFrame:
    """id, n_bytes, media (WAVE file of the UTF-8 text and bytes 255 up to a positive multiple of unit), declared.

    Null text counts as empty: one unit of bytes 255. Repeated rows stay; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"))

    def run(batches):
        for batch in batches:
            data = batch.column("data").to_pylist()
            media = [wav(d + b"\xff" * (-len(d) % unit if d else unit)) for d in data]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(d) for d in data], pa.int64()), pa.array(media, pa.binary()), pa.array(["application/octet-stream"] * len(data))], names=["id", "n_bytes", "media", "declared"])

    return map_batches(rows, run, "id long, n_bytes long, media binary, declared string").withColumnRenamed("id", id_col)


def read_media(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Sniff the stored bytes and read the samples back: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, media_type, carved (array of type, offset, length).

    Null media: empty bytes of the declared type without samples. Media that hold no WAVE file are their own payload.
    """
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_type", "carved"]
    carved_type = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), carved_type]

    def run(batches):
        for batch in batches:
            out = []
            for id_, n, media, declared in zip(*(batch.column(c).to_pylist() for c in ("id", "n_bytes", "media", "declared")), strict=True):
                media = media or b""
                kind, size, inside = sniff(media, declared)
                a, b = (wav_samples(media) if kind == "audio/wav" and size else None) or (0, len(media))
                payload = media[a:b]
                feature = f"{kind};{audio_features(np.frombuffer(payload, np.uint8)) if payload else 'n=0'};inside={len(inside)}"
                out.append((id_, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, kind, [dict(zip(("type", "offset", "length"), x, strict=True)) for x in inside]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    schema = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string, carved array<struct<type:string,offset:long,length:long>>"
    return map_batches(stored.select(F.col(id_col).cast("long").alias("id"), "n_bytes", "media", "declared"), run, schema).withColumnRenamed("id", id_col)
