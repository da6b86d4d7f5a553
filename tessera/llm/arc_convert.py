"""Conversion of legacy ARC archives to WARC records.

An ARC file is a chain of records, each a header line followed by as many bytes
as the line's last field declares and a line feed. The first, filedesc://, says
by its version line which fields the header lines have: version 1 has URL, IP
address, date, content type and length; version 2 adds result code, checksum,
location, offset and file name before the length. Where a record begins is
known only from the lengths before it, so an archive is parsed in one task, and
archives in parallel; a gzipped one (one member a record, or one for all) is
unpacked first.

Each record becomes a WARC record of equal content: filedesc:// is warcinfo, a
block that begins with HTTP/ is response, anything else resource. WARC-Date is
the ARC date; WARC-Record-ID is a UUID made of the MD5 of archive, offset, URL
and date, so converting again gives the same; the block digest, and for
responses the digest of what follows the HTTP header, are SHA-1 in base 32.

Defined results: every archive gives at least one row, and nothing is lost
without one. A null or empty content gives one with error "empty archive". A
damaged gzip member gives one with "bad gzip" after what could be unpacked of
it, and the next member goes on. A header line whose fields can't be told apart,
or with a length that isn't a number, gives "bad header", and reading goes on at
the next line that is a sound header with a date. A URL or content type may hold
blanks: the fields are then found from the right, around address and date. A block cut
short by the end gives "truncated" with the digests of what is there; a date
that isn't 14 digits (12 and 8 are filled up with zeros) or no date of the
calendar gives "bad date" and a null date. A null name is an empty one. Rows
with errors have no record. Offsets count unpacked bytes. Repeated rows are
converted each, very long records in batches of their own; other columns play no part.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

FIELDS = {1: 5, 2: 10}
ARCHIVE_PAGES = 50
SCHEMA = "archive string, offset long, version int, type string, record_id string, target_uri string, ip string, date string, content_type string, length long, block_digest string, payload_digest string, error string, record binary"


BATCH_BYTES = 64 << 20
#: Address and date tell the fields apart where there are more blanks than fields.
_FIELDS = {
    1: re.compile(r"(.+) ([0-9A-Fa-f.:]{2,45}|-) (\d{14}|\d{12}|\d{8}) (.+) (\d+)"),
    2: re.compile(r"(.+) ([0-9A-Fa-f.:]{2,45}|-) (\d{14}|\d{12}|\d{8}) (.+) (\S+) (\S+) (\S+) (\d+|-) (\S+) (\d+)"),
}
_LINE = re.compile(rb"(?m)^[A-Za-z][A-Za-z0-9+.\-]*:[^\n]*$")


def unpacked(data: bytes) -> Iterator[tuple[bytes, bool]]:
    """What successive sound members of a gzip file hold, with whether a damaged one ends it; other data as it is."""
    if data[:2] != b"\x1f\x8b":
        yield data, False
        return
    out: list[bytes] = []
    while data:
        d, sound = zlib.decompressobj(31), True
        try:
            # In pieces, so that what stands before the damage is there.
            for at in range(0, len(data), 1 << 16):
                out.append(d.decompress(data[at : at + (1 << 16)]))
                if d.eof:
                    data = d.unused_data + data[at + (1 << 16) :]
                    break
            else:
                out.append(d.flush())
                sound = False
        except zlib.error:
            sound = False
        if sound:
            if data[:2] != b"\x1f\x8b" and data.strip(b"\0\n\r"):
                sound = False
            elif not data.strip(b"\0\n\r"):
                break
        if not sound:
            yield b"".join(out), True
            out = []
            at = data.find(b"\x1f\x8b\x08", 1)
            data = data[at:] if at > 0 else b""
    if out:
        yield b"".join(out), False


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(archive: str, offset: int, url: str, date: str) -> str:
    h = hashlib.md5(f"{archive}|{offset}|{url}|{date}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def iso_date(arc: str) -> str | None:
    if not re.fullmatch(r"\d{8}|\d{12}|\d{14}", arc):
        return None
    d = arc.ljust(14, "0") if len(arc) > 8 else arc + "000000"
    try:
        return datetime.strptime(d, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ").zfill(20)
    except ValueError:
        return None


def header(line: str, version: int) -> list[str] | None:
    """The fields of a header line, or None."""
    f = line.split(" ")
    if len(f) == FIELDS[version] and all(f) and f[-1].isdecimal():
        return f
    m = _FIELDS[version].fullmatch(line)
    return list(m.groups()) if m else None


def next_header(data: bytes, at: int, version: int) -> int:
    """Where the next line begins, after at, that is a sound header with a date; the end if none is."""
    for m in _LINE.finditer(data, at + 1):
        f = header(m.group().decode("utf-8", "replace").rstrip("\r"), version)
        if f and iso_date(f[2]):
            return m.start()
    return len(data)


def payload(block: bytes) -> bytes:
    """What follows the HTTP header."""
    ends = [(at, n) for sep, n in ((b"\r\n\r\n", 4), (b"\n\n", 2)) if (at := block.find(sep)) >= 0]
    if not ends:
        return b""
    at, n = min(ends)
    return block[at + n :]


def warc(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def records(archive: str, data: bytes) -> Iterator[tuple]:
    fault = lambda at, version, what: (archive, at, version, *[None] * 9, what, None)
    base, version, any_ = 0, 1, False
    for part, damaged in unpacked(data):
        if part.strip():
            any_ = True
            for version, row in part_records(archive, part, base, version):
                yield row
        base += len(part)
        if damaged:
            any_ = True
            yield fault(base, version, "bad gzip")
    if not any_:
        yield fault(0, None, "empty archive")


def part_records(archive: str, data: bytes, base: int, version: int) -> Iterator[tuple[int, tuple]]:
    """The version and a row for each record of a sound stretch of an archive that begins base bytes in."""
    at = 0
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace").rstrip("\r")
        first = line.startswith("filedesc://")
        if first:
            # Its own version decides how its header line reads.
            v = data[end + 1 : end + 3].split(b" ")[0] if end >= 0 else b""
            version = 2 if v == b"2" else 1
        f = header(line, version) if end >= 0 else None
        if f is None:
            yield version, (archive, base + at, version, *[None] * 9, "bad header", None)
            at = next_header(data, at, version)
            continue
        size = int(f[-1])
        block = data[end + 1 : end + 1 + size]
        url, ip, day, kind = f[:4]
        date = iso_date(day)
        error = "truncated" if len(block) < size else None if date else "bad date"
        http = block.startswith(b"HTTP/")
        what = "warcinfo" if first else "response" if http else "resource"
        ident = record_id(archive, base + at, url, day)
        content = "application/http; msgtype=response" if http else kind
        bd = digest(block)
        pd = digest(payload(block)) if http else None
        head = [("WARC-Type", what), ("WARC-Record-ID", ident), ("WARC-Date", date), ("WARC-Target-URI", None if first else url), ("WARC-Filename", url[11:] if first else None), ("WARC-IP-Address", ip if ip not in ("-", "0.0.0.0") else None), ("WARC-Block-Digest", bd), ("WARC-Payload-Digest", pd), ("Content-Type", content)]
        yield version, (archive, base + at, version, what, ident, url, ip, date, content, len(block), bd, pd, error, None if error else warc(head, block))
        at = end + 1 + size


def converted(archives: DataFrame) -> DataFrame:
    """The records of archives (name, content), as SCHEMA says."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int32(), *[pa.string()] * 6, pa.int64(), *[pa.string()] * 3, pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("name"), b.column("content")):
                rows: list[tuple] = []
                held = 0
                for r in records(name.as_py() or "", content.as_py() or b""):
                    rows.append(r)
                    held += len(r[-1] or b"")
                    if len(rows) == 1000 or held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)

    return archives.select("name", "content").mapInArrow(run, SCHEMA)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(name, content) of the ARC files under path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.arc*").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def archived(pages: DataFrame, archive_pages: int = ARCHIVE_PAGES) -> DataFrame:
    """(name, content): pages as ARC archives of archive_pages successive page_ids, by turns of version 1 and 2. For tests and for the query."""
    n = F.expr(f"page_id div {archive_pages}")
    name = F.format_string("part-%06d.arc", n)
    body = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"), F.coalesce("html", F.lit("")))
    url = F.coalesce(F.replace(F.col("url"), F.lit(" "), F.lit("%20")), F.lit("-"))
    day = F.date_format(F.expr("timestampadd(MINUTE, page_id, timestamp_ntz'2024-01-01 00:00:00')"), "yyyyMMddHHmmss")
    ip = F.concat_ws(".", F.lit("10"), F.expr("page_id div 65536 % 256"), F.expr("page_id div 256 % 256"), F.expr("page_id % 256"))
    middle = F.when(n % 2 == 0, F.lit("")).otherwise(F.concat(F.lit(" 200 - - 0 "), name))
    head = F.concat_ws(" ", url, ip, day, F.concat(F.lit("text/html"), middle), F.octet_length(body))
    # One row for each page; null page_ids have no place in an archive.
    rows = pages.where("page_id is not null").select(name.alias("name"), "page_id", F.concat(head, F.lit("\n"), body, F.lit("\n")).alias("r"), (n % 2 + 1).alias("v"))
    info = F.when(F.col("v") == 1, F.lit("1 0 Tessera\nURL IP-address Archive-date Content-type Archive-length\n")).otherwise(F.lit("2 0 Tessera\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"))
    more = F.when(F.col("v") == 1, F.lit("")).otherwise(F.concat(F.lit(" 200 - - 0 "), F.col("name")))
    desc = F.concat(F.lit("filedesc://"), F.col("name"), F.lit(" 0.0.0.0 20240101000000 text/plain"), more, F.lit(" "), F.octet_length(info), F.lit("\n"), info, F.lit("\n"))
    whole = rows.groupBy("name", "v").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "r"))), lambda x: x["r"]), "").alias("rs"))
    return whole.select("name", F.encode(F.concat(desc, F.col("rs")), "utf-8").alias("content"))


def op2_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The record as text: the pages are UTF-8.
    return converted(archived(table(spark, sf_dir, "pages"))).withColumn("record", F.col("record").cast("string"))


def _base32(hex_digest: str) -> str:
    return f"list_aggregate(list_transform(range(8), lambda g: list_aggregate(list_transform(range(4), lambda q: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr({hex_digest}, 1 + 5 * g::int, 5))::int >> (15 - 5 * q::int)) % 32, 1)), 'string_agg', '')), 'string_agg', '')"


QUERIES = {"op2_arc_to_warc": op2_arc_to_warc}
SQL = {
    "op2_arc_to_warc": rf"""
with src as (select page_id, page_id // {ARCHIVE_PAGES} as n, coalesce(replace(url, ' ', '%20'), '-') as url, 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || chr(13) || chr(10) as h, coalesce(html, '') as html from pages where page_id is not null),
named as (select *, printf('part-%06d.arc', n) as archive, (n % 2 + 1)::int as version, strftime(timestamp '2024-01-01' + to_minutes(page_id), '%Y%m%d%H%M%S') as day, concat_ws('.', 10, page_id // 65536 % 256, page_id // 256 % 256, page_id % 256) as ip, h || html as block from src),
heads as (select archive, version, page_id, url, ip, day, block, html, concat_ws(' ', url, ip, day, 'text/html' || case version when 1 then '' else ' 200 - - 0 ' || archive end, strlen(block)) as head, 'response' as type, 'application/http; msgtype=response' as content_type from named),
infos as (select distinct archive, version, case version when 1 then '1 0 Tessera' || chr(10) || 'URL IP-address Archive-date Content-type Archive-length' || chr(10) else '2 0 Tessera' || chr(10) || 'URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length' || chr(10) end as block from named),
descs as (select archive, version, -1 as page_id, 'filedesc://' || archive as url, '0.0.0.0' as ip, '20240101000000' as day, block, null as html, concat_ws(' ', 'filedesc://' || archive, '0.0.0.0', '20240101000000', 'text/plain' || case version when 1 then '' else ' 200 - - 0 ' || archive end, strlen(block)) as head, 'warcinfo' as type, 'text/plain' as content_type from infos),
laid as (select *, coalesce(sum(strlen(head) + strlen(block) + 2) over (partition by archive order by page_id, head rows between unbounded preceding and 1 preceding), 0)::bigint as place from (select * from descs union all by name select * from heads)),
hashed as (select *, md5(archive || '|' || place || '|' || url || '|' || day) as m, sha1(block) as s, sha1(html) as p, substr(day, 1, 4) || '-' || substr(day, 5, 2) || '-' || substr(day, 7, 2) || 'T' || substr(day, 9, 2) || ':' || substr(day, 11, 2) || ':' || substr(day, 13, 2) || 'Z' as date from laid),
made as (select *, '<urn:uuid:' || m[1:8] || '-' || m[9:12] || '-' || m[13:16] || '-' || m[17:20] || '-' || m[21:32] || '>' as record_id, 'sha1:' || {_base32("s")} as block_digest, case when html is not null then 'sha1:' || {_base32("p")} end as payload_digest, chr(13) || chr(10) as nl from hashed)
select archive, place as "offset", version, type, record_id, url as target_uri, ip, date, content_type, strlen(block) as length, block_digest, payload_digest, null::varchar as error,
  'WARC/1.0' || nl || 'WARC-Type: ' || type || nl || 'WARC-Record-ID: ' || record_id || nl || 'WARC-Date: ' || date || nl
  || case type when 'warcinfo' then 'WARC-Filename: ' || archive || nl else 'WARC-Target-URI: ' || url || nl || 'WARC-IP-Address: ' || ip || nl end
  || 'WARC-Block-Digest: ' || block_digest || nl || coalesce('WARC-Payload-Digest: ' || payload_digest || nl, '') || 'Content-Type: ' || content_type || nl || 'Content-Length: ' || strlen(block) || nl || nl || block || nl || nl as record from made"""
}
