"""Web archives: legacy ARC files parsed by their version's header line and declared lengths, and rewritten as WARC.

Identifiers are made from what the ARC record says (so a second conversion gives the same ones), timestamps are
rewritten in WARC's form, types follow from URL scheme and content, digests are computed.  Payloads that another
record holds become revisits of it.

Null html is an empty payload; a null URL gets one made of the id; repeated rows with the largest id of their payload
are responses alike; a URL of any scheme, filedesc too, is a page's; very long pages come in archives of their own; an
empty table gives empty archives; other columns are not read."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stages, skew_join, table
from .text import slices

#: Bytes of payload after which the next archive begins.
ARCHIVE = 8 << 20
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # URLs, RFC 4122
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The fields of a record's header line in each version of ARC.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}


class ArcRecord(NamedTuple):
    fields: dict[str, str]
    offset: int
    block: bytes
    truncated: bool
    version_block: bool = False


def b32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- ARC


def arc_start(name: str, date: str, version: int) -> bytes:
    body = f"{version} 0 archive\n{FIELDS[version]}\n\n".encode()
    more = f" 200 - - 0 {name}" if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{more} {len(body)}\n".encode() + body + b"\n"


def arc_record(name: str, version: int, offset: int, url: str, date: str, kind: str, block: bytes) -> bytes:
    more = f" 200 - - {offset} {name}" if version == 2 else ""
    return f"{url} 0.0.0.0 {date} {kind}{more} {len(block)}\n".encode() + block + b"\n"


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC file.  Its first record, if of the scheme filedesc, is the version block, whose second line tells
    the fields; behind that such a URL is one as any other.  A line is split from its right, for old URLs may hold
    spaces.  A block that is shorter than declared is given as far as it goes, as truncated."""
    at, names, begun = 0, FIELDS[1].split(), False
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        stop = data.find(b"\n", at)
        if stop < 0:
            raise ValueError(f"ARC: no end of the header line at {at}")
        line = data[at:stop].decode("utf-8", "replace").rstrip("\r")
        first, begun = not begun and line.startswith("filedesc://"), True
        parts = line.rsplit(" ", (4 if line.count(" ") == 4 else 9) if first else len(names) - 1)
        if not parts[-1].isdigit():
            raise ValueError(f"ARC: no length in the header line at {at}")
        length = int(parts[-1])
        block = data[stop + 1 : stop + 1 + length]
        if first:
            lines = block.decode("utf-8", "replace").split("\n")
            names = lines[1].split() if len(lines) > 1 and lines[1].strip() else FIELDS[int(lines[0].split()[0])].split()
        if not first and len(parts) != len(names):
            raise ValueError(f"ARC: {len(parts)} fields, not {len(names)}, in the header line at {at}")
        own = FIELDS[1 if len(parts) == 5 else 2].split() if first else names
        yield ArcRecord(dict(zip(own, parts, strict=True)), at, block, len(block) < length, first)
        at = stop + 1 + length


# --- WARC


def http_split(block: bytes) -> tuple[bytes, bytes]:
    """Head (with its empty line) and entity of an HTTP message."""
    i = block.find(b"\r\n\r\n")
    return (block[: i + 4], block[i + 4 :]) if i >= 0 else (block, b"")


def header(head: bytes, name: bytes) -> str | None:
    m = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*([^\r\n]*)", head)
    return m[1].decode("utf-8", "replace") if m else None


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, ' '.join(map(str, parts)))}>"


def iso(date: str) -> str:
    """ARC's digits (8 to 14 of them; missing ones are zero) as WARC's form."""
    d = (date + "000000")[:14] if len(date) >= 8 and date.isdigit() else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_bytes(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def convert(records: Iterable[ArcRecord], archive: str, revisits: dict[str, tuple[str, str]] | None = None) -> Iterator[bytes]:
    """WARC records for ARC records.  revisits: for the id in X-Record-Key, the key and URL of the record that holds
    the same payload."""
    for r in records:
        url, date = r.fields["URL"], iso(r.fields["Archive-date"])
        common = [("WARC-Date", date), *([("WARC-Truncated", "length")] if r.truncated else [])]
        if r.version_block:
            yield warc_bytes([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(archive, 0)), *common, ("WARC-Filename", archive), ("Content-Type", "application/warc-fields")], f"software: ARC conversion\r\nsource: {url}\r\n".encode())
            continue
        is_http = r.block.startswith(b"HTTP/")
        head, payload = http_split(r.block) if is_http else (b"", r.block)
        key = header(head, b"X-Record-Key") if is_http else None
        rid = record_id("key", key) if key is not None else record_id(archive, r.offset, url, date)
        common += [("WARC-Record-ID", rid), ("WARC-Target-URI", url), ("WARC-IP-Address", r.fields["IP-address"]), ("WARC-Payload-Digest", f"sha1:{b32(payload)}")]
        known = (revisits or {}).get(key) if key is not None else None
        if known:
            yield warc_bytes([("WARC-Type", "revisit"), *common, ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id("key", known[0])), ("WARC-Refers-To-Target-URI", known[1]), ("X-Refers-To-Key", known[0]), ("Content-Type", "application/http;msgtype=response"), ("WARC-Block-Digest", f"sha1:{b32(head)}")], head)
        else:
            kind = "application/http;msgtype=response" if is_http else "text/dns" if url.startswith("dns:") else r.fields["Content-type"]
            yield warc_bytes([("WARC-Type", "response" if is_http else "resource"), *common, ("Content-Type", kind), ("WARC-Block-Digest", f"sha1:{b32(r.block)}")], r.block)


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of a WARC file of gzip members."""
    at, view = 0, memoryview(data)
    while at < len(data):
        d, parts, fed = zlib.decompressobj(31), [], at
        while not d.eof and fed < len(data):
            parts.append(d.decompress(view[fed : fed + 65536]))
            fed = min(fed + 65536, len(data))
        if not d.eof:
            raise ValueError(f"WARC: the gzip member at {at} breaks off")
        at = fed - len(d.unused_data)
        raw = b"".join(parts)
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("WARC: a member without a version line")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        n = int(fields["Content-Length"])
        if rest[n:] != b"\r\n\r\n":
            raise ValueError("WARC: a record's length is wrong")
        yield fields, rest[:n]


# --- tables


def page_arc(name: str, version: int, rows: Iterable[tuple[int, str, bytes]], date: str = "20240101000000") -> bytes:
    """Pages as an ARC file of the given version."""
    out = [arc_start(name, date, version)]
    at = len(out[0])
    for key, url, payload in rows:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\nX-Record-Key: {key}\r\n\r\n".encode() + payload
        out.append(arc_record(name, version, at, url, date, "text/html", block))
        at += len(out[-1])
    return b"".join(out)


def safe_url(url: str | None, key: object) -> str:
    """One that fits in a header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"http://unknown.invalid/{key}"


def archives(pages: DataFrame, least: int = 0) -> DataFrame:
    """archive, records, warc (bytes of a file of gzip members) with every page once.

    Of pages with equal payloads of at least `least` bytes the one with the largest id is the response.  Which one that
    is comes from an aggregate over digests; it reaches the pages by a join that hot payloads don't overload."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("_sha", F.sha1(F.col("html").cast("binary"))).withColumn("_sha", F.when(F.octet_length("html") >= least, F.col("_sha")))
    small = rows.select("page_id", "url", "_sha").where("_sha is not null")
    groups = small.groupBy("_sha").agg(F.max(F.struct("page_id", "url")).alias("_of"), F.count("*").alias("_n"))
    dup = groups.where("_n > 1").select("_sha", F.col("_of.page_id").alias("of_id"), F.col("_of.url").alias("of_url"), "_n")
    total = pages.count()
    joined = skew_join(rows, dup, "_sha", "_n", total, scatter=["page_id"]).drop("_n")
    joined = joined.withColumn("of_id", F.when(F.col("of_id") != F.col("page_id"), F.col("of_id"))).select("page_id", "url", "html", "of_id", "of_url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, (part, data, bounds) in enumerate(slices(batches, "html", ARCHIVE)):
            ids, urls, of_ids, of_urls = (part.column(i).to_pylist() for i in (0, 1, 3, 4))
            name = f"pages-{hashlib.md5(repr((n, ids)).encode()).hexdigest()}.arc"
            arc = page_arc(name, 1 + n % 2, ((k, safe_url(u, k), data[a:b].tobytes()) for k, u, a, b in zip(ids, urls, bounds[:-1], bounds[1:], strict=True)))
            known = {str(k): (str(o), safe_url(u, o)) for k, o, u in zip(ids, of_ids, of_urls, strict=True) if o is not None}
            out = []
            for x in convert(parse_arc(arc), name, known):
                z = zlib.compressobj(1, zlib.DEFLATED, 31)
                out.append(z.compress(x) + z.flush())
            yield pa.record_batch([pa.array([name]), pa.array([part.num_rows], pa.int64()), pa.array([b"".join(out)], pa.binary())], names=["archive", "records", "warc"])

    return joined.mapInArrow(run, "archive string, records long, warc binary")


def read_archives(files: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, target_uri, archive, computed_digest
    of every response and revisit."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "target_uri", "archive"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                rows = []
                for fields, block in read_warc(data.as_py()):
                    if (kind := fields["WARC-Type"]) not in ("response", "revisit"):
                        continue
                    head, payload = http_split(block)
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and digest != b32(payload):
                        raise ValueError(f"WARC: a payload of {fields['WARC-Record-ID']} doesn't match its digest")
                    size = len(payload) if kind == "response" else int(header(head, b"Content-Length") or 0)
                    key = header(head, b"X-Record-Key")
                    refers = fields.get("X-Refers-To-Key")
                    rows.append((None if key in (None, "None") else int(key), size, digest, kind, None if refers is None else int(refers), fields["WARC-Record-ID"], fields["WARC-Target-URI"], name.as_py()))
                if rows:
                    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return files.select("archive", "warc").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, target_uri string, archive string")


def op9_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = Stages(spark, "warc")
    out = read_archives(stages.write(archives(table(spark, sf_dir, "pages")), codec="none"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op9_arc_to_warc": op9_arc_to_warc}
SQL = {
    "op9_arc_to_warc": """with p as (select page_id, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as h from pages), m as (select h, max(page_id) as of_id from p group by 1),
b as (select p.*, of_id, array_to_string(list_transform(range(1, 41), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', p.h[i])]), '') as bits from p join m on p.h = m.h)
select page_id, n::bigint as payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * bits[5 * i + 1]::int + 8 * bits[5 * i + 2]::int + 4 * bits[5 * i + 3]::int + 2 * bits[5 * i + 4]::int + bits[5 * i + 5]::int]), '') as payload_digest,
case when page_id = of_id then 'response' else 'revisit' end as record_type, case when page_id <> of_id then of_id end as refers_to from b"""
}
