"""Operator 7: WARC archives, one gzip member a record, written and read sequentially.

A payload that another record has too is written once, with the record of the
largest page_id; the others are revisits that carry the HTTP head
and name that record. The reader inflates one member after another from
a stream, frames records by Content-Length, and verifies block and payload digests.

Defined results: null html is an empty payload, null url an empty target; rows
that tie for the largest page_id of a payload are all responses; a null page_id
counts as the smallest and comes back as null; payloads under `min_bytes`
are always responses; an empty table writes no archive and gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfuse.llm import common

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A fixed date: the same pages give the same archives.
DATE = "2024-01-01T00:00:00Z"
ARCHIVE_BYTES = 256 << 20
READ_BYTES = 1 << 16


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, url: str, page_id: int | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, not compressed. A revisit's block is the HTTP head alone, whose Content-Length tells the payload's size."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if kind == "response":
        block += payload
    target = url.replace("\r", "%0D").replace("\n", "%0A")
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", DATE), ("WARC-Target-URI", target), ("Content-Type", "application/http; msgtype=response")]
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def members(stream, size: int = READ_BYTES) -> Iterator[bytes]:
    """The contents of each gzip member of a stream, inflated piece by piece."""
    inflate, parts, data = zlib.decompressobj(31), [], stream.read(size)
    while data:
        parts.append(inflate.decompress(data))
        if inflate.eof:
            yield b"".join(parts)
            data = inflate.unused_data or stream.read(size)
            inflate, parts = zlib.decompressobj(31), []
        else:
            data = stream.read(size)
    if any(parts):
        raise ValueError("an archive ends inside a record")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Named fields (lower-cased names) and block; raises if the framing or a digest is wrong."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.decode().partition(":") for x in lines[1:])}
    n = int(fields["content-length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != b"\r\n\r\n":
        raise ValueError("Content-Length doesn't frame the record")
    if fields.get("warc-block-digest", "sha1:" + base32_sha1(block)) != "sha1:" + base32_sha1(block):
        raise ValueError("the block's digest differs")
    if fields["warc-type"] == "response" and fields["warc-payload-digest"] != "sha1:" + base32_sha1(block.partition(b"\r\n\r\n")[2]):
        raise ValueError("the payload's digest differs")
    return fields, block


def resolve_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to): refers_to is null for responses. Only repeated payloads' digests are joined."""
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1(F.encode("payload", "utf-8")))
    repeated = rows.filter(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1").drop("n")
    joined = rows.join(repeated, "digest", "left")
    revisit = F.col("last").isNotNull() & (F.coalesce("page_id", F.col("last") - 1) != F.col("last"))
    return joined.select("page_id", "url", "payload", F.when(revisit, F.col("last")).alias("refers_to"))


def write_archives(rows: DataFrame, folder: str, *, level: int = 6, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes rows of `resolve_revisits`; returns the manifest (path, n_records) of the attempts that succeeded."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = common.filesystem(folder)
        out, name, n, at, done = None, "", 0, 0, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "refers_to")), common.texts(batch.column("payload")), strict=True):
                page_id, url, refers_to, payload = row
                if out is None:
                    fs.create_dir(top, recursive=True)
                    name = f"pages-{common.task_number()}.warc.gz"
                    out, n, at = fs.open_output_stream(f"{top}/{name}", compression=None), 0, 0
                data = gzip_member(record("response" if refers_to is None else "revisit", url, page_id, payload, base32_sha1(payload), refers_to), level)
                out.write(data)
                n, at = n + 1, at + len(data)
                if at >= archive_bytes:
                    out.close()
                    done.append((f"{folder}/{name}", n))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done]), pa.array([d[1] for d in done], pa.int64())], ["path", "n_records"])

    return common.cut(rows.mapInArrow(write, "path string, n_records long"), "archives")[0]


def read_archives(manifest: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of every record; payload is null for revisits."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        number = lambda field: None if "None" in field else int(field.rstrip(">").rpartition(":")[2])
        for path in (p for batch in batches for p in batch.column("path").to_pylist()):
            fs, at = common.filesystem(path)
            held, size = [], 0
            with fs.open_input_stream(at, compression=None) as stream:
                for data in members(stream):
                    fields, block = parse(data)
                    head, _, payload = block.partition(b"\r\n\r\n")
                    length = next(int(x[15:]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    revisit = fields["warc-type"] == "revisit"
                    held.append((number(fields["warc-record-id"]), fields["warc-target-uri"], length, fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"], number(fields["warc-refers-to"]) if revisit else None, None if revisit else payload.decode()))
                    size += len(data)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)
                        held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)

    return manifest.repartition(common.tasks(manifest), "path").mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.as_table(common.read(spark, sf_dir, "pages"), "page_id", "url", "html")
    manifest = write_archives(resolve_revisits(pages), common.new_path(spark, "warc"))
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
