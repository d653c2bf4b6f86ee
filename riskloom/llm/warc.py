"""Operator 4: WARC records in ZIP packages, read by ranges.

Writing: every task packs its pages into archives of bounded size, streamed to the shared folder as ZIP
files with stored members: ``archive/data.warc.gz`` (one gzip member per record) and
``indexes/index.cdxj`` (page, offset in the member, length). Only the archives that the committed
manifest names are read, so what a lost or repeated task left behind doesn't count.

Reading: an archive's end record, its ZIP64 records if there are any, and the central directory are
fetched by ranges; they locate the stored members; the index member is read in pieces, and the records
are fetched by ranges of neighbouring records. No member is extracted.

Of records with equal payloads of at least ``LEAST`` bytes the one with the smallest page_id is a
response, the others revisit it (header only); smaller ones are responses.

Defined results: null html is an empty payload; pages of one payload that share the smallest page_id
are all responses; pages without an identifier are responses unless an identified page has their
payload; an empty table gives no rows.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.registry import query, saved, table
from riskloom.session import checkpoint_dir, scratch_path

LEAST = 100
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 4 << 20
WARC, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"


def filesystem(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and path of a folder given as Spark gives it (``file:/x``, ``hdfs://...``)."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return arrow_fs.FileSystem.from_uri(path) if "://" in path else (arrow_fs.LocalFileSystem(), path)


def _text(value) -> str:
    """A header value on one line."""
    return "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in str(value))


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record as a gzip member."""
    http = b"" if refers_to is not None else (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                                              f"Content-Length: {len(payload)}\r\n\r\n").encode() + payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{page_id}>"),
            ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if url is not None:
        head.append(("WARC-Target-URI", _text(url)))
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"),
                 ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(http))]
    return gzip.compress(b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + http + b"\r\n\r\n", 1, mtime=0)


def parse_record(member: bytes) -> tuple[int | None, str, bytes, int | None, str]:
    """page_id, type, payload, refers_to and stated payload digest of one gzip member."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    body = rest[:int(fields["Content-Length"])]
    number = lambda v: None if v is None or v[10:-1] == "None" else int(v[10:-1])  # noqa: E731  <urn:page:N>
    payload = body.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else b""
    return number(fields["WARC-Record-ID"]), fields["WARC-Type"], payload, number(fields.get("WARC-Refers-To")), fields["WARC-Payload-Digest"].partition(":")[2]


class Archive:
    """An archive being written; the ZIP bytes are streamed and the index is kept until the end."""

    def __init__(self, folder: str):
        self.fs, base = filesystem(folder)
        self.path = f"{base.rstrip('/')}/{uuid.uuid4().hex}.wacz"
        self.uri = f"{folder.rstrip('/')}/{self.path.rsplit('/', 1)[1]}"
        self.fs.create_dir(base, recursive=True)
        self.out = self.fs.open_output_stream(self.path)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member, self.at, self.index = self.zip.open(WARC, "w", force_zip64=True), 0, []

    def add(self, page_id, data: bytes) -> None:
        self.member.write(data)
        self.index.append(json.dumps({"page": page_id, "offset": self.at, "length": len(data)}))
        self.at += len(data)

    def close(self) -> tuple[str, int]:
        self.member.close()
        with self.zip.open(INDEX, "w", force_zip64=True) as index:
            for line in self.index:
                index.write(line.encode() + b"\n")
        self.zip.close()
        self.out.close()
        return self.uri, len(self.index)


class Package:
    """Directory of a ZIP file, read by ranges."""

    def __init__(self, uri: str):
        self.fs, path = filesystem(uri)
        self.file = self.fs.open_input_file(path)
        size = self.file.size()
        tail_at = max(0, size - 65_535 - 22 - 20)
        tail = self.range(tail_at, size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        if end < 0:
            raise ValueError(f"no end of central directory in {uri}")
        count, length, start = struct.unpack("<HII", tail[end + 10:end + 20])
        if end >= 20 and tail[end - 20:end - 16] == b"PK\x06\x07":
            at = struct.unpack("<Q", tail[end - 12:end - 4])[0]
            far = self.range(at, 56)
            if far[:4] != b"PK\x06\x06":
                raise ValueError(f"no ZIP64 end record in {uri}")
            count, length, start = struct.unpack("<QQQ", far[32:56])
        self.members = dict(self._entries(self.range(start, length), count))

    def range(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at)

    @staticmethod
    def _entries(directory: bytes, count: int):
        at = 0
        for _ in range(count):
            if directory[at:at + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            method, = struct.unpack("<H", directory[at + 10:at + 12])
            packed, full, names, extras, comment = struct.unpack("<IIHHH", directory[at + 20:at + 34])
            header, = struct.unpack("<I", directory[at + 42:at + 46])
            name = directory[at + 46:at + 46 + names].decode()
            extra, x = directory[at + 46 + names:at + 46 + names + extras], 0
            while x + 4 <= len(extra):
                kind, n = struct.unpack("<HH", extra[x:x + 4])
                if kind == 1:                             # ZIP64: the fields that are all ones, in this order
                    wide = iter(struct.unpack(f"<{n // 8}Q", extra[x + 4:x + 4 + n // 8 * 8]))
                    full = next(wide) if full == 0xFFFFFFFF else full
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    header = next(wide) if header == 0xFFFFFFFF else header
                x += 4 + n
            yield name, (method, header, packed)
            at += 46 + names + extras + comment

    def stored(self, name: str) -> tuple[int, int]:
        """Offset and length of a stored member's bytes."""
        method, header, length = self.members[name]
        if method != zipfile.ZIP_STORED:
            raise ValueError(f"{name} is not stored")
        names, extras = struct.unpack("<HH", self.range(header, 30)[26:30])
        return header + 30 + names + extras, length

    def lines(self, name: str, piece: int = 1 << 20) -> Iterator[bytes]:
        at, length = self.stored(name)
        rest = b""
        for i in range(0, length, piece):
            *whole, rest = (rest + self.range(at + i, min(piece, length - i))).split(b"\n")
            yield from whole
        if rest:
            yield rest


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
                   least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES, broadcast_rows: int = 200_000) -> DataFrame:
    """Write ``pages`` as archives under ``folder``; returns the manifest: ``path, records``."""
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = (pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("html"))
            .withColumn("digest", F.sha2("html", 256)))
    shared = (rows.where(F.octet_length("html") >= least).groupBy("digest")
              .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL").drop("n"))
    shared = saved(shared, "warc-shared")
    marked = (rows.join(F.broadcast(shared) if shared.count() <= broadcast_rows else shared, "digest", "left")
              .select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, done = None, []
        for b in batches:
            for i in range(len(b)):
                page, address, text, digest, refers_to = (c[i].as_py() for c in b.columns)
                archive = archive or Archive(folder)
                archive.add(page, record(page, address, text.encode(), digest, refers_to))
                if archive.at >= archive_bytes:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        yield pa.record_batch({"path": pa.array([p for p, _ in done], pa.string()), "records": pa.array([n for _, n in done], pa.int64())})

    return saved(marked.mapInArrow(pack, "path string, records long"), "warc-manifest")


def read_archives(manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All records of the archives at ``path``: ``page_id, record_type, refers_to, payload_bytes,
    payload_digest``; a revisit has the payload figures of the response it refers to."""
    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                package = Package(path)
                base, _ = package.stored(WARC)
                found = [(path, base + r["offset"], r["length"]) for r in map(json.loads, package.lines(INDEX))]
                for i in range(0, len(found), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found[i:i + 10_000])], ["path", "at", "length"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, path = None, None
        for b in batches:
            paths, at, length = (c.to_pylist() for c in b.columns)
            out, i = [], 0
            while i < len(paths):
                j, end = i + 1, at[i] + length[i]           # neighbours in one read
                while j < len(paths) and paths[j] == paths[i] and at[j] == end and end - at[i] < range_bytes:
                    end, j = end + length[j], j + 1
                if paths[i] != path:
                    path = paths[i]
                    store, name = filesystem(path)
                    package = store.open_input_file(name)
                data = package.read_at(end - at[i], at[i])
                for k in range(i, j):
                    page, kind, payload, refers_to, digest = parse_record(data[at[k] - at[i]:at[k] - at[i] + length[k]])
                    full = kind == "response"
                    out.append((page, kind, refers_to, len(payload) if full else None, hashlib.sha256(payload).hexdigest() if full else digest))
                i = j
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))],
                                             ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest"])

    spots = manifest.select("path").repartition("path").mapInArrow(locate, "path string, at long, length long")
    piece = F.floor(F.col("at") / range_bytes)
    records = saved(spots.repartition("path", piece).sortWithinPartitions("path", "at").mapInArrow(
        fetch, "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string"), "warc-records")
    # an identifier may have several payloads: the response is the one with the digest that the revisit states
    target = ["refers_to", "payload_digest"]
    targets = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("target_bytes"))
    wanted = records.where("record_type = 'revisit'").select(*target).distinct()
    targets = saved(targets.join(wanted, target, "left_semi").dropDuplicates(target), "warc-targets")
    return (records.join(targets, target, "left")
            .select("page_id", F.coalesce("payload_bytes", "target_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"))


@query("op4_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
FROM f
""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    checkpoint_dir(spark)
    return read_archives(write_archives(table(spark, sf_dir, "pages"), scratch_path(spark, "warc")))
