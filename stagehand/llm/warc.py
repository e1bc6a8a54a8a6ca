"""Operator 2: WARC records in ZIP-packaged archives, read back by ranges.

An archive is a ZIP file whose members are stored, not compressed:
``archive/data.warc.gz`` (one gzip member per record) and ``indexes/index.cdxj``
(offset and length of every record). The reader takes the end of the file,
follows the end-of-central-directory record or its ZIP64 form, reads the
central directory, finds the data of the stored members and range-reads single
records; nothing is extracted. It reads packages of other writers as well: any
number of record members under ``archive/``, CDXJ lines with or without key and
time (a line belongs to the member that its ``filename`` names), indexes packed
by gzip or by ZIP, records of any type. A record member without an index is streamed.

Scale: payloads meet once, to decide which record is the response (one narrow
aggregate by digest, then a join on the digest that adaptive execution splits
for a hot payload). Tasks write archives of at most ``max_archive_bytes`` to the
shared folder under fresh names and return them in a manifest; a lost task
writes new files and the manifest lists only those of committed tasks. Reading
is spread over (archive, record range), not over archives.

Defined results: null html is empty; of equal payloads of at least
``revisit_min_bytes`` bytes all but the largest id are revisits; rows that tie at
the largest id are all responses; a null id is below every other and its record
has no page in its name; null urls have no target; an empty table gives no
archive and no rows; other columns are ignored.
"""
from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagehand.llm.common import slices
from stagehand.session import materialize, scratch_path

RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
MANIFEST = "path string, n_records long, n_bytes long"
READ = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
        "target_uri string, payload binary")
_NO_DATE = "1970-01-01T00:00:00Z"


# --- records -------------------------------------------------------------------------------

def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(name: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(m[1]) if m else None


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit of ``refers_to``, which holds the HTTP header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {_NO_DATE}",
            f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http; msgtype=response",
            f"Content-Length: {len(block)}"]
    if url is not None:  # control characters would end the header line
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Refers-To: {_name(refers_to)}",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(["WARC/1.1", *head]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Record(NamedTuple):
    page_id: int | None
    payload_bytes: int
    payload_digest: str
    record_type: str
    refers_to: int | None
    target_uri: str | None
    payload: bytes | None


def decode_record(raw: bytes) -> Record:
    """Parses one record; raises ``ValueError`` if it is cut or its payload does not match its digest."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not sep or not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[:int(fields["content-length"])]
    if len(block) != int(fields["content-length"]):
        raise ValueError(f"{fields.get('warc-record-id')}: the record is cut")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^content-length:[ \t]*(\d+)", http)
    named = fields.get("warc-payload-digest", "")
    kind = fields.get("warc-type", "")
    if kind not in ("response", "revisit"):  # warcinfo, request, metadata: no page
        return Record(None, 0, "", kind, None, fields.get("warc-target-uri"), None)
    digest = named.removeprefix("sha1:").upper() if named.startswith("sha1:") else payload_digest(payload) if kind == "response" else named
    if kind == "response" and payload_digest(payload) != digest and not re.search(rb"(?im)^transfer-encoding:", http):
        raise ValueError(f"{fields.get('warc-record-id')}: the payload does not match its digest")
    return Record(_page(fields.get("warc-record-id")), int(length[1]) if length else len(payload), digest, kind,
                  _page(fields.get("warc-refers-to")), fields.get("warc-target-uri"), payload if kind == "response" else None)


# --- ZIP directories -----------------------------------------------------------------------

class Member(NamedTuple):
    name: str
    method: int
    size: int
    header_offset: int


def read_directory(read, size: int) -> list[Member]:
    """Members of a ZIP file from its central directory. ``read(offset, n)`` returns bytes."""
    tail_at = max(0, size - 65_557)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0 or len(tail) < at + 22:
        raise ValueError("no end of central directory: not a ZIP file")
    _, _, _, count, length, offset, _ = struct.unpack("<4H2LH", tail[at + 4:at + 22])
    if 0xFFFF in (count,) or 0xFFFFFFFF in (length, offset):
        where = tail_at + at - 20
        locator = read(where, 20) if where >= 0 else b""
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        end = read(struct.unpack("<Q", locator[8:16])[0], 56)
        if end[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, offset = struct.unpack("<3Q", end[32:56])
    data, out, p = read(offset, length), [], 0
    for _ in range(count):
        if data[p:p + 4] != b"PK\x01\x02":
            raise ValueError("bad central directory")
        flags, method = struct.unpack("<2H", data[p + 8:p + 12])
        packed, plain, n, m, k = struct.unpack("<2L3H", data[p + 20:p + 34])
        header = struct.unpack("<L", data[p + 42:p + 46])[0]
        name = data[p + 46:p + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        extra, q = data[p + 46 + n:p + 46 + n + m], 0
        while q + 4 <= len(extra):
            tag, size_ = struct.unpack("<2H", extra[q:q + 4])
            if tag == 1:  # the fields that did not fit, in this order
                values = iter(struct.unpack(f"<{size_ // 8}Q", extra[q + 4:q + 4 + size_ // 8 * 8]))
                plain = next(values) if plain == 0xFFFFFFFF else plain
                packed = next(values) if packed == 0xFFFFFFFF else packed
                header = next(values) if header == 0xFFFFFFFF else header
            q += 4 + size_
        out.append(Member(name, method, packed, header))
        p += 46 + n + m + k
    return out


def data_offset(read, member: Member) -> int:
    """Where a stored member's bytes begin (its local header has lengths of its own)."""
    head = read(member.header_offset, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"{member.name}: bad local header")
    if member.method != 0:
        raise ValueError(f"{member.name}: compressed, only stored members can be read by ranges")
    n, m = struct.unpack("<2H", head[26:30])
    return member.header_offset + 30 + n + m


def pack_archive(records: list[bytes], index: list[str], force_zip64: bool = False) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        for name, data in ((RECORDS, b"".join(records)), (INDEX, "".join(index).encode())):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=force_zip64) as f:
                f.write(data)
    return out.getvalue()


# --- Spark jobs ----------------------------------------------------------------------------

def with_roles(pages: DataFrame, id_col: str, url_col: str, html_col: str, revisit_min_bytes: int) -> DataFrame:
    """(page_id, url, payload, refers_to); ``refers_to`` is null for responses.
    Payloads are equal if their SHA-256 and their length are."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                        F.unhex(F.sha2(html, 256)).alias("_key"), F.octet_length(html).alias("_n"), html.alias("_text"))
    keepers = rows.groupBy("_key", "_n").agg(F.max("page_id").alias("_keeper"))
    same = rows.join(keepers, ["_key", "_n"])
    revisit = (F.col("_n") >= revisit_min_bytes) & F.col("_keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_keeper"))
    return same.select("page_id", "url", "_text", F.when(revisit, F.col("_keeper")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   revisit_min_bytes: int = 0, max_archive_bytes: int = 32 << 20) -> DataFrame:
    """Writes every page as a record; returns the manifest (schema ``MANIFEST``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        records: list[bytes] = []
        index: list[str] = []
        size = 0

        def flush() -> pa.RecordBatch:
            fs.create_dir(root, recursive=True)
            name, data = f"pages-{uuid.uuid4().hex}.wacz", pack_archive(records, index)
            with fs.open_output_stream(f"{root}/{name}") as f:
                f.write(data)
            return pa.record_batch({"path": [f"{folder}/{name}"], "n_records": [len(records)], "n_bytes": [len(data)]})

        for b in slices(batches, 2000):
            for page_id, url, text, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                packed = gzip.compress(encode_record(page_id, url, text.encode(), refers_to), 5, mtime=0)
                index.append(json.dumps({"url": url, "offset": size, "length": len(packed)}) + "\n")
                records.append(packed)
                size += len(packed)
                if size >= max_archive_bytes:
                    yield flush()
                    records, index, size = [], [], 0
        if records:
            yield flush()

    rows = with_roles(pages, id_col, url_col, html_col, revisit_min_bytes)
    return materialize(rows.mapInArrow(run, MANIFEST), "warc-manifest")


def _filesystem(uri: str):
    """The file system of a folder or file, and its path there. Spark's names of the S3 scheme are S3."""
    return pa.fs.FileSystem.from_uri(re.sub(r"\As3[an]://", "s3://", uri))


def _opened(path: str):
    fs, inner = _filesystem(path)
    f = fs.open_input_file(inner)

    def read(offset: int, n: int) -> bytes:
        f.seek(offset)
        return f.read(n)

    return f, read


def _whole(read, m: Member) -> bytes:
    """A member's content: stored or deflated in the ZIP file, packed by gzip or not."""
    stored = m if m.method == 0 else m._replace(method=0)
    data = read(data_offset(read, stored), m.size)
    if m.method == 8:
        data = zlib.decompressobj(-15).decompress(data)
    elif m.method:
        raise ValueError(f"{m.name}: compression {m.method} is unknown")
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def index_lines(data: bytes) -> Iterator[tuple[str | None, int, int]]:
    """(file name, offset, length) of CDXJ lines: bare JSON, or JSON behind a key and
    a time; header lines and lines without a range are left out."""
    for line in data.decode().splitlines():
        at = line.find("{")
        if at < 0 or line.startswith("!"):
            continue
        x = json.loads(line[at:])
        if "offset" in x and "length" in x:
            yield x.get("filename"), int(x["offset"]), int(x["length"])


def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Archive paths -> (path, offset, length) of every indexed record; a record
    member that no index line names gives one range over the whole member."""
    for b in batches:
        for path in b.column(0).to_pylist():
            f, read = _opened(path)
            with f:
                members = read_directory(read, f.size())
                records = {m.name.rsplit("/", 1)[-1]: m for m in members if m.name.startswith("archive/") and not m.name.endswith("/")}
                only = next(iter(records)) if len(records) == 1 else None
                spans: dict[str, list[tuple[int, int]]] = {n: [] for n in records}
                for m in members:
                    if m.name.startswith("indexes/") and m.name.endswith((".cdxj", ".cdx", ".cdxj.gz", ".cdx.gz")):
                        for name, offset, length in index_lines(_whole(read, m)):
                            name = only if name is None else name.rsplit("/", 1)[-1]
                            if name in spans:
                                spans[name].append((offset, length))
                for name, m in records.items():
                    base = data_offset(read, m)
                    found = [(base + o, n) for o, n in sorted(set(spans[name]))] or [(base, m.size)]
                    yield pa.record_batch({"path": pa.array([path] * len(found), pa.string()),
                                           "offset": pa.array([x[0] for x in found], pa.int64()),
                                           "length": pa.array([x[1] for x in found], pa.int64())})


def _members_of(read, offset: int, length: int, step: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a byte range, read step by step."""
    at, end, waiting = offset, offset + length, b""
    while at < end or waiting:
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if not waiting:
                waiting = read(at, min(step, end - at))
                at += len(waiting)
                if not waiting:
                    raise ValueError("the record member is cut")
            parts.append(z.decompress(waiting))
            waiting = z.unused_data
        yield b"".join(parts)


def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Record ranges -> records (schema ``READ``)."""
    f = read = opened = None
    names = [x.split()[0] for x in READ.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def batch(out: list[Record]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    try:
        for b in batches:
            out: list[Record] = []
            size = 0
            for path, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if path != opened:
                    if f is not None:
                        f.close()
                    (f, read), opened = _opened(path), path
                for raw in _members_of(read, offset, length):
                    out.append(decode_record(raw))
                    size += len(raw)
                    if size > 8 << 20:
                        yield batch(out)
                        out, size = [], 0
            if out:
                yield batch(out)
    finally:
        if f is not None:
            f.close()


def read_archives(manifest: DataFrame) -> DataFrame:
    """Every record of the archives named in the column ``path``."""
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    paths = manifest.select("path").repartition(parts)
    spans = paths.mapInArrow(locate, "path string, offset long, length long")
    return spans.repartitionByRange(parts, "path", "offset").sortWithinPartitions("path", "offset").mapInArrow(fetch, READ)


def round_trip(pages: DataFrame, revisit_min_bytes: int = 0) -> DataFrame:
    folder = scratch_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, revisit_min_bytes=revisit_min_bytes))
