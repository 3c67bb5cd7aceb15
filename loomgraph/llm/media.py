"""Media columns: types found by signature, confirmed by structure, and embedded files carved out.

An Aho-Corasick automaton finds magic bytes; a format's validator then follows the declared lengths to the file's end,
or rejects the hit.  What a confirmed file spans is not searched again, so samples that happen to hold magic bytes
mislead nothing.  Null or empty media give no findings; wrong declared types are corrected; a truncated file is not
confirmed.  Texts: null counts as empty, repeated rows are stored each, other columns are not read."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stages, table
from .text import slices

#: Payloads are padded with bytes 255 to a multiple of this: rows of an image as well as blocks of samples.
UNIT = 576


class Found(NamedTuple):
    kind: str
    start: int
    end: int


# Validators: the end of the file that starts at `at`, or None.


def _png(b: bytes, at: int) -> int | None:
    i, seen = at + 8, False
    while i + 12 <= len(b):
        n, name = struct.unpack(">I4s", b[i : i + 8])
        if i + 12 + n > len(b) or zlib.crc32(b[i + 4 : i + 8 + n]) != struct.unpack(">I", b[i + 8 + n : i + 12 + n])[0] or (not seen and name != b"IHDR"):
            return None
        seen, i = True, i + 12 + n
        if name == b"IEND":
            return i
    return None


def _riff(form: bytes) -> Callable[[bytes, int], int | None]:
    def check(b: bytes, at: int) -> int | None:
        if at + 20 > len(b) or b[at + 8 : at + 12] != form:
            return None
        end = at + 8 + struct.unpack("<I", b[at + 4 : at + 8])[0]
        i = at + 12
        while i + 8 <= end <= len(b):
            i += 8 + (n := struct.unpack("<I", b[i + 4 : i + 8])[0]) + n % 2
        return end if end <= len(b) and i == end else None

    return check


def _au(b: bytes, at: int) -> int | None:
    if at + 24 > len(b):
        return None
    start, size, encoding, rate, channels = struct.unpack(">5I", b[at + 4 : at + 24])
    end = at + start + size
    return end if 24 <= start <= 4096 and 1 <= encoding <= 27 and rate and 0 < channels < 256 and end <= len(b) else None


def _bmp(b: bytes, at: int) -> int | None:
    if at + 54 > len(b):
        return None
    size, zero, offset, head, width, height, planes, bits = struct.unpack("<IIIIiiHH", b[at + 2 : at + 30])
    if zero or head not in (40, 108, 124) or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or not height:
        return None
    packed = struct.unpack("<I", b[at + 30 : at + 34])[0] == 0
    return at + size if at + size <= len(b) and (not packed or offset + (width * bits + 31) // 32 * 4 * abs(height) == size) else None


def _pgm(b: bytes, at: int) -> int | None:
    head = b[at : at + 64].split(b"\n", 3)
    try:
        width, height = map(int, head[1].split())
        end = at + len(head[0]) + len(head[1]) + len(head[2]) + 3 + width * height
        return end if len(head) == 4 and head[0] == b"P5" and head[2] == b"255" and width > 0 and height > 0 and end <= len(b) else None
    except (ValueError, IndexError):
        return None


def _gif(b: bytes, at: int) -> int | None:
    if at + 13 > len(b):
        return None
    flags = b[at + 10]
    i = at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0)
    while i < len(b):
        if b[i] == 0x3B:
            return i + 1
        if b[i] == 0x2C and i + 10 < len(b):
            i += 10 + (3 << (b[i + 9] & 7) + 1 if b[i + 9] & 128 else 0) + 1
        elif b[i] == 0x21:
            i += 2
        else:
            return None
        while i < len(b) and b[i]:
            i += b[i] + 1
        i += 1
    return None


def _jpeg(b: bytes, at: int) -> int | None:
    i = at + 2
    while i + 4 <= len(b) and b[i] == 0xFF:
        mark, n = b[i + 1], struct.unpack(">H", b[i + 2 : i + 4])[0]
        if n < 2 or mark in (0, 0xFF, 0xD8):
            return None
        i += 2 + n
        if mark == 0xDA:  # samples up to a mark that is neither stuffing nor a restart
            while (i := b.find(b"\xff", i)) >= 0 and i + 1 < len(b) and (b[i + 1] == 0 or 0xD0 <= b[i + 1] <= 0xD7):
                i += 2
            if i < 0 or i + 1 >= len(b):
                return None
            if b[i + 1] == 0xD9:
                return i + 2
    return None


def _ogg(b: bytes, at: int) -> int | None:
    i, last = at, None
    while b[i : i + 4] == b"OggS" and i + 27 <= len(b) and b[i + 4] == 0:
        n = b[i + 26]
        i += 27 + n + sum(b[i + 27 : i + 27 + n])
        if i > len(b):
            return None
        last = i
    return last


#: The formats' signatures, media types and validators.
FORMATS: dict[str, tuple[bytes, Callable[[bytes, int], int | None]]] = {
    "image/png": (b"\x89PNG\r\n\x1a\n", _png),
    "image/jpeg": (b"\xff\xd8\xff", _jpeg),
    "image/gif": (b"GIF8", _gif),
    "image/bmp": (b"BM", _bmp),
    "image/x-portable-graymap": (b"P5\n", _pgm),
    "image/webp": (b"RIFF", _riff(b"WEBP")),
    "audio/wav": (b"RIFF", _riff(b"WAVE")),
    "audio/basic": (b".snd", _au),
    "application/ogg": (b"OggS", _ogg),
}


class Sniffer:
    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        kinds: dict[bytes, list[str]] = {}
        for kind, (magic, _) in FORMATS.items():
            kinds.setdefault(magic, []).append(kind)
        for magic, names in kinds.items():
            self.automaton.add_word(magic.decode("latin-1"), (len(magic), names))
        self.automaton.make_automaton()

    def find(self, blob: bytes) -> list[Found]:
        """Confirmed files from left to right; none lies in another."""
        out: list[Found] = []
        text, at = blob.decode("latin-1"), 0
        while at < len(text):
            for last, (n, kinds) in self.automaton.iter(text, at):
                start = last - n + 1
                if start >= at and (got := next((Found(k, start, e) for k in kinds if (e := FORMATS[k][1](blob, start)) is not None), None)):
                    out.append(got)
                    at = got.end
                    break
            else:
                break
        return out

    def sniff(self, blob: bytes, declared: str | None) -> tuple[str, list[Found]]:
        """The true type (octet-stream for a carrier, the declared one if nothing is known) and what it holds."""
        found = self.find(blob)
        if found and found[0].start == 0 and found[0].end == len(blob):
            return found[0].kind, found
        return ("application/octet-stream" if found else declared or "application/octet-stream"), found


# Writers and readers of 8-bit samples.


def _chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def write_wav(p: bytes) -> bytes:
    return b"RIFF" + struct.pack("<I", 36 + len(p)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(p)) + p


def write_au(p: bytes) -> bytes:
    return b".snd" + struct.pack(">5I", 24, len(p), 2, 8000, 1) + p


def write_bmp(p: bytes) -> bytes:
    palette = bytes(x for i in range(256) for x in (i, i, i, 0))
    return b"BM" + struct.pack("<IIIIiiHHIIiiII", 1078 + len(p), 0, 1078, 40, UNIT, len(p) // UNIT, 1, 8, 0, len(p), 2835, 2835, 256, 256) + palette + p


def write_pgm(p: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (UNIT, len(p) // UNIT) + p


def write_png(p: bytes) -> bytes:
    rows = np.zeros((len(p) // UNIT, UNIT + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(p, np.uint8).reshape(-1, UNIT)
    head = struct.pack(">IIBBBBB", UNIT, len(p) // UNIT, 8, 0, 0, 0, 0)
    return FORMATS["image/png"][0] + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + _chunk(b"IEND", b"")


def read_samples(b: bytes, kind: str) -> bytes:
    """The 8-bit samples of a file that one of the writers made."""
    if kind == "audio/wav":
        i = 12
        while b[i : i + 4] != b"data":
            i += 8 + (n := struct.unpack("<I", b[i + 4 : i + 8])[0]) + n % 2
        return b[i + 8 : i + 8 + struct.unpack("<I", b[i + 4 : i + 8])[0]]
    if kind == "audio/basic":
        start, size = struct.unpack(">II", b[4:12])
        return b[start : start + size]
    if kind == "image/bmp":
        return b[struct.unpack("<I", b[10:14])[0] :]
    if kind == "image/x-portable-graymap":
        return b.split(b"\n", 3)[3]
    if kind == "image/png":
        i, body, width = 8, b"", 0
        while i < len(b):
            n, name = struct.unpack(">I4s", b[i : i + 8])
            body += b[i + 8 : i + 8 + n] if name == b"IDAT" else b""
            width = struct.unpack(">I", b[i + 8 : i + 12])[0] if name == b"IHDR" else width
            i += 12 + n
        rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(-1, width + 1)
        if rows[:, 0].any():
            raise ValueError("a PNG row with a filter")
        return rows[:, 1:].tobytes()
    raise ValueError(f"no samples of 8 bits can be read from {kind}")


WRITERS = {"audio/wav": write_wav, "audio/basic": write_au, "image/bmp": write_bmp, "image/x-portable-graymap": write_pgm, "image/png": write_png}


def pad(data: bytes) -> bytes:
    """Bytes 255 are appended up to a positive multiple of UNIT."""
    return data + b"\xff" * (-len(data) % UNIT if data else UNIT)


def store(payload: bytes) -> tuple[str, bytes]:
    """(declared type, media).  The payload's checksum picks the format, whether the declared type is right, and
    whether the file lies within a carrier: the state in which media columns of crawled data come."""
    kinds, crc = list(WRITERS), zlib.crc32(payload)
    kind = kinds[crc % 5]
    media = WRITERS[kind](payload)
    if crc // 5 % 4 == 0:
        return "application/octet-stream", b"\x00carrier\x00" + bytes(crc // 20 % 64) + media + b"\x00trailer"
    return kinds[(crc + (crc // 5 % 4 == 1)) % 5], media


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, declared, media for every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, bounds in slices(batches):
            made = [store(pad(data[a:b].tobytes())) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.record_batch([part.column(0), pa.array(np.diff(bounds)), pa.array([d for d, _ in made], pa.string()), pa.array([m for _, m in made], pa.binary())], names=["doc_id", "n_bytes", "declared", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, declared string, media binary")


def feature(payload: bytes) -> str:
    """Mean, spread and crossings of the middle of the samples, and their distinct values; whole numbers only."""
    x = np.frombuffer(payload, np.uint8)
    n, total = len(x), int(x.sum(dtype=np.int64))
    square = int((x.astype(np.int32) ** 2).sum(dtype=np.int64))
    high = x >= 128
    return f"mean={total * 1000 // n} var={(square * n - total * total) * 1000 // (n * n)} cross={int((high[1:] != high[:-1]).sum())} values={int((np.bincount(x, minlength=256) > 0).sum())}"


#: What carve() gives for each confirmed file.
FILE = {"kind": pa.string(), "start": pa.int64(), "end": pa.int64(), "bytes": pa.binary(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "feature": pa.string()}


def carve(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media_bytes, media_sha256, declared, detected, files for each media value.  files: every
    confirmed file from left to right with its span, its bytes, and its samples' digests and features."""
    kind_of = pa.list_(pa.struct(list(FILE.items())))
    out = ["doc_id", "n_bytes", "media_bytes", "media_sha256", "declared", "detected", "files"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sniffer = Sniffer()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part, rows = batch.slice(i, 256), []
                for declared, blob in zip(part.column(2), part.column(3), strict=True):
                    declared, blob = declared.as_py(), blob.as_py() or b""
                    kind, found = sniffer.sniff(blob, declared)
                    files = []
                    for f in found:
                        own = blob[f.start : f.end]
                        try:
                            payload = read_samples(own, f.kind)
                        except (ValueError, struct.error, zlib.error):
                            payload = b""
                        files.append(dict(zip(FILE, (*f, own, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), f"{f.kind} {feature(payload)}" if payload else f.kind), strict=True)))
                    rows.append((len(blob), hashlib.sha256(blob).hexdigest(), declared, kind, files))
                types = [pa.int64(), pa.string(), pa.string(), pa.string(), kind_of]
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.record_batch([part.column(0), part.column(1), *cols], names=out)

    files = "array<struct<kind: string, start: long, end: long, bytes: binary, payload_bytes: long, payload_sha256: string, tail_crc32: long, feature: string>>"
    return media.select("doc_id", "n_bytes", "declared", "media").mapInArrow(run, f"doc_id long, n_bytes long, media_bytes long, media_sha256 string, declared string, detected string, files {files}")


def describe(media: DataFrame) -> DataFrame:
    """carve(), and the first file's digests and features in columns of their own (null where there is no file)."""
    f = F.get("files", F.lit(0))
    own = [f["payload_bytes"].alias("payload_bytes"), f["payload_sha256"].alias("payload_sha256"), f["tail_crc32"].alias("tail_crc32")]
    return carve(media).select("doc_id", "n_bytes", *own, "media_bytes", "media_sha256", f["feature"].alias("feature"), "declared", "detected", f["kind"].alias("carved"), f["start"].alias("at"), "files")


def op6_signature_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = Stages(spark, "media")
    return describe(stages.write(to_media(table(spark, sf_dir, "documents")))).drop("files")


QUERIES = {"op6_signature_media": op6_signature_media}
SQL: dict[str, str] = {}
