"""WARC records in ZIP packages: written per task, read back through the ZIP directories by ranges.

Each package is a ZIP of stored members: ``archive/data.warc.gz`` (one gzip member per WARC record),
``indexes/index.cdxj`` (one line per record with its offset and length inside the archive member) and
``datapackage.json``. The reader parses the end record, the ZIP64 end record and its locator, the central directory
with ZIP64 extra fields, and the members' local headers, then reads the index and each record by its byte range; no
member is unpacked as a whole.

Records of payloads that occur more than once and have ``MIN_REVISIT`` bytes or more are revisits of the record with
the largest page_id, which alone holds the payload. Cases: a null html is an empty payload; null urls are written as
``urn:page:`` addresses; a null page_id is never a response that others refer to, and is a response itself unless
its payload occurs under some id; repeated rows of the referred page are all responses; an empty table gives no rows;
extra columns are ignored.

Files go through ``pyarrow.fs`` to the shared folder. A package's name has the task attempt's own number and only
packages in the materialised manifest are read, so a lost or repeated task leaves nothing behind that is read.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, shared_path

MIN_REVISIT = 1000
#: Payload bytes after which a task begins another package.
PACKAGE_BYTES = 64 << 20
#: Repeated payloads up to which their table is broadcast (about 60 bytes each); beyond it Spark joins by shuffle.
BROADCAST_DIGESTS = 500_000
CRAWL_DATE = "1970-01-01T00:00:00Z"
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"


def decide(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, payload, digest, refers_to: which rows are revisits, and of which page."""
    base = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload")).withColumn("digest", F.sha1("payload"))
    repeated = materialise(
        base.where(F.octet_length("payload") >= MIN_REVISIT).groupBy("digest").agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("n")).where("n > 1 and response_id is not null").drop("n"),
        "digests",
    )
    small = repeated.count() <= BROADCAST_DIGESTS
    joined = base.join(F.broadcast(repeated) if small else repeated, "digest", "left")
    return joined.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("response_id")), F.col("response_id"))).drop("response_id")


def record_bytes(record_id: str, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record, uncompressed. A revisit keeps the HTTP head with the payload's length, not the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if refers_to is None else b"")
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", CRAWL_DATE), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """WARC fields, HTTP head and payload of one uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def sort_key(url: str) -> str:
    """SURT-like key of the index: host labels reversed, then the path."""
    parts = urlsplit(url) if url.startswith(("http://", "https://")) else None
    if not parts or not parts.hostname:
        return quote(url, safe=":/")
    return quote(",".join(reversed(parts.hostname.split("."))) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else ""), safe="/,)?=&:;%")


class PackageWriter:
    """One package: records are streamed into the stored archive member, then the index is added."""

    def __init__(self, path: str):
        self.path, (where, name) = path, pafs.FileSystem.from_uri(path)
        where.create_dir(name.rpartition("/")[0], recursive=True)
        self.sink = where.open_output_stream(name)
        self.zip = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)
        self.lines: list[str] = []
        self.at = self.payload = 0

    def add(self, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> None:
        record_id = f"urn:page:{page_id}"
        target = re.sub(r"\s", lambda m: quote(m[0]), url or record_id)
        packed = zlib.compressobj(1, zlib.DEFLATED, 31)
        data = packed.compress(record_bytes(record_id, target, payload, digest, refers_to)) + packed.flush()
        self.member.write(data)
        fields = {"url": target, "mime": "text/html" if refers_to is None else "warc/revisit", "digest": f"sha1:{digest}", "offset": self.at, "length": len(data), "filename": ARCHIVE.rpartition("/")[2]}
        self.lines.append(f"{sort_key(target)} {re.sub('[^0-9]', '', CRAWL_DATE)} {json.dumps(fields)}\n")
        self.at += len(data)
        self.payload += len(payload)

    def close(self) -> tuple[str, int]:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(sorted(self.lines)))
        self.zip.writestr(zipfile.ZipInfo("datapackage.json"), json.dumps({"profile": "data-package", "resources": [{"path": ARCHIVE, "bytes": self.at}, {"path": INDEX}]}))
        self.zip.close()
        self.sink.close()
        return self.path, len(self.lines)


def write_packages(records: DataFrame, folder: str) -> DataFrame:
    """Write ``decide()``'s rows as packages; the materialised manifest (path, n_records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, writer = [], None
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                writer = writer or PackageWriter(f"{folder}/{uuid.uuid4().hex}.wacz")
                writer.add(*row)
                if writer.payload >= PACKAGE_BYTES:
                    made.append(writer.close())
                    writer = None
        if writer:
            made.append(writer.close())
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], names=["path", "n_records"])

    return materialise(records.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "path string, n_records long"), "manifest")


# The signatures and record layouts of the ZIP format.
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"


def zip_members(source) -> dict[str, tuple[int, int]]:
    """Stored members of a ZIP (a seekable file with ``size()``): name to (first byte of its data, length)."""
    size = source.size()
    tail_at = max(0, size - 65_557)
    tail = _range(source, tail_at, size - tail_at)
    k = tail.rfind(END)
    if k < 0:
        raise ValueError("no end of central directory")
    many, length, start = struct.unpack_from("<HII", tail, k + 10)
    if k >= 20 and tail[k - 20 : k - 16] == LOCATOR64:
        at = struct.unpack_from("<Q", tail, k - 12)[0]
        end64 = _range(source, at, 56)
        if end64[:4] != END64:
            raise ValueError("no ZIP64 end of central directory")
        many, length, start = struct.unpack_from("<QQQ", end64, 32)
    directory, at, members = _range(source, start, length), 0, {}
    for _ in range(many):
        if directory[at : at + 4] != CENTRAL:
            raise ValueError("broken central directory")
        method, packed, plain, n_name, n_extra, n_comment = *struct.unpack_from("<H", directory, at + 10), *struct.unpack_from("<IIHHH", directory, at + 20)
        local = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + n_name].decode()
        extra, e = directory[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while e + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, e)
            if kind == 1:  # 8-byte values for those that are all ones above, in this order
                values = iter(struct.unpack_from(f"<{n // 8}Q", extra, e + 4))
                plain = next(values) if plain == 0xFFFFFFFF else plain
                packed = next(values) if packed == 0xFFFFFFFF else packed
                local = next(values) if local == 0xFFFFFFFF else local
            e += 4 + n
        at += 46 + n_name + n_extra + n_comment
        if method != 0:
            continue  # only stored members can be read by range
        header = _range(source, local, 30)
        if header[:4] != LOCAL:
            raise ValueError(f"broken local header of {name}")
        n_name, n_extra = struct.unpack_from("<HH", header, 26)
        members[name] = (local + 30 + n_name + n_extra, packed)
    return members


def _range(source, at: int, n: int) -> bytes:
    source.seek(at)
    return source.read(n)


def read_package(path: str) -> Iterator[dict]:
    """The records of a package, each read by the range that the index gives, in the archive's order."""
    where, name = pafs.FileSystem.from_uri(path)
    with where.open_input_file(name) as source:
        members = zip_members(source)
        start, length = members[INDEX]
        entries = sorted((json.loads(line.split(" ", 2)[2]) for line in _range(source, start, length).decode().splitlines()), key=lambda x: x["offset"])
        archive, total = members[ARCHIVE]
        for entry in entries:
            if entry["offset"] + entry["length"] > total:
                raise ValueError(f"an index entry points outside {ARCHIVE}")
            fields, http, payload = parse_record(zlib.decompress(_range(source, archive + entry["offset"], entry["length"]), 31))
            told = fields["WARC-Payload-Digest"].removeprefix("sha1:")
            own = re.search(rb"Content-Length: (\d+)", http)
            if fields["WARC-Type"] == "response" and hashlib.sha1(payload).hexdigest() != told:
                raise ValueError(f"{path}: a payload doesn't have its digest")
            ids = [fields[k][len("<urn:page:") : -1] if k in fields else None for k in ("WARC-Record-ID", "WARC-Refers-To")]
            yield {
                "page_id": None if ids[0] == "None" else int(ids[0]),
                "url": fields["WARC-Target-URI"],
                "payload": payload if fields["WARC-Type"] == "response" else None,
                "payload_bytes": int(own[1]),
                "payload_digest": told,
                "record_type": fields["WARC-Type"],
                "refers_to": int(ids[1]) if ids[1] else None,
            }


RECORDS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_packages(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the manifest's packages; a task per package, up to 10,000 tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                for record in read_package(path):
                    if not payloads:
                        record["payload"] = None
                    rows.append(record)
                    held += len(record["payload"] or b"") + 200
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    many = max(1, min(10_000, manifest.count()))
    return manifest.select("path").repartition(many).mapInArrow(run, RECORDS)


ORACLE_OP5 = f"""
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
q as (select page_id, octet_length(b) as n, sha1(b) as d from p),
r as (select d, max(page_id) as m from q where n >= {MIN_REVISIT} group by d having count(*) > 1)
select q.page_id, cast(q.n as bigint) as payload_bytes, q.d as payload_digest,
  case when r.m is null or r.m = q.page_id then 'response' else 'revisit' end as record_type,
  case when r.m is not null and r.m <> q.page_id then r.m end as refers_to
from q left join r on q.d = r.d
"""


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    manifest = write_packages(decide(pages), shared_path(spark, "warc"))
    return read_packages(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
