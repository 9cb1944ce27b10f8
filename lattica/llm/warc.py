"""Deterministic sharded WARC writer and reader.

Records are ordered by payload digest and then by falling page_id, so that the response of
a group of equal payloads stands before its revisits. A part of the order holds a range of
digests; SHA-1 is uniform, so the ranges need no sampling. A digest that more than
max(HOT_ROWS, rows / 4096) pages share (so at most 4096 of them: they are fetched and
broadcast) has its rows spread over all parts by page_id and url, its revisits without payload.
Payloads are exchanged once. Each part rolls to a new file beyond `roll_bytes` of compressed
data; every record is a gzip member of its own, with headers and digests made anew.

Files are written under a temporary name and renamed when whole. Names and bytes follow from
the input alone, so a task that runs again replaces its files by equal ones: a file that is already there is removed
before the renaming, as some file systems refuse to rename onto one. The manifest
(a table of file, records, bytes, sha1) is committed last; readers open what it lists. Folders are local, on HDFS or
in an object store (names of Spark's connectors, s3a and gs, are taken for s3 and gs).

Defined results: a null html is the empty payload, and empty payloads form a group as any
other; a null url is written as an empty target; a null page_id comes last in its group; of
rows that repeat a page_id and payload the first is the response. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path

HOT_ROWS = 64
HOT_GROUPS = 4096
ROWS_PER_PART, PART_BYTES = 20_000, 128 << 20
ROLL_BYTES = 64 << 20
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "part int, file string, records long, bytes long, sha1 string"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def _base32(raw: bytes) -> str:
    return base64.b32encode(raw).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record_bytes(page_id, url, payload: bytes | None, digest: str, size: int, refers_to: tuple | None) -> bytes:
    """One WARC record. digest: base32 of the payload. refers_to: (page_id,) of the response, for a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    head.append("WARC-Target-URI: " + "".join((url or "").split()))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to[0], digest)}"]
        if refers_to[0] is not None:
            head.append(f"X-Refers-To-Page-Id: {refers_to[0]}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{_base32(hashlib.sha1(block).digest())}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    for ours, theirs in (("s3a://", "s3://"), ("s3n://", "s3://")):
        if folder.startswith(ours):
            folder = theirs + folder.removeprefix(ours)
    return fs.FileSystem.from_uri(folder)


class _Shard:
    """A file that grows under a temporary name and gets its own when closed."""

    def __init__(self, folder: str, part: int, number: int, level: int):
        self.store, self.folder = _opened(folder)
        self.name, self.part = f"shard-{part:06d}-{number:04d}.warc.gz", part
        self.temporary = f"{self.folder}/.tmp-{self.name}-{uuid.uuid4().hex}"
        self.store.create_dir(self.folder, recursive=True)
        self.out, self.sha, self.size, self.records = self.store.open_output_stream(self.temporary, compression=None), hashlib.sha1(), 0, 0
        info = f"software: lattica\r\nformat: WARC File Format 1.1\r\nfilename: {self.name}\r\n".encode()
        self.add(_member(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, self.name)}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n", level))
        self.records = 0

    def add(self, member: bytes) -> None:
        self.out.write(member)
        self.sha.update(member)
        self.size, self.records = self.size + len(member), self.records + 1

    def close(self) -> dict:
        self.out.close()
        own = f"{self.folder}/{self.name}"
        if self.store.get_file_info(own).type != fs.FileType.NotFound:
            self.store.delete_file(own)
        self.store.move(self.temporary, own)
        return {"part": self.part, "file": self.name, "records": self.records, "bytes": self.size, "sha1": self.sha.hexdigest()}


def _write_parts(folder: str, roll_bytes: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, done = None, 0, []
        part = digest = hexed = response = None
        responded = False
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for at, sha, page_id, url, payload, size, hot, hot_response in zip(*columns):
                if at != part:
                    if shard:
                        done.append(shard.close())
                    shard, number, part, hexed = None, 0, at, None
                if sha != hexed:
                    hexed, digest, responded = sha, _base32(bytes.fromhex(sha)), False
                    response = hot_response if hot else page_id
                first = not responded and page_id == response
                responded |= first
                if shard and shard.size >= roll_bytes:
                    done.append(shard.close())
                    shard, number = None, number + 1
                shard = shard or _Shard(folder, part, number, level)
                shard.add(_member(record_bytes(page_id, url, payload, digest, size, None if first else (response,)), level))
        if shard:
            done.append(shard.close())
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("part", pa.int32()), ("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string())]))

    return run


def write_archives(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, level: int = 6) -> DataFrame:
    """Write pages(page_id, url, html) as WARC files into folder; returns the committed manifest."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    records = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).select("*", F.sha1("payload").alias("sha"), F.octet_length("payload").cast("long").alias("size"))
    rows, size = records.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).head()
    parts = max(4 * spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_PART), -(-size // PART_BYTES))
    hot = records.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("response")).where((F.col("n") > max(HOT_ROWS, rows // HOT_GROUPS)) & F.col("response").isNotNull()).select("sha", "response").collect()
    if hot:
        known = F.broadcast(spark.createDataFrame(hot, "sha string, response long").withColumn("hot", F.lit(True)))
        records = records.join(known, "sha", "left")
    else:
        records = records.withColumns({"response": F.lit(None).cast("long"), "hot": F.lit(None).cast("boolean")})
    here = F.conv(F.substring("sha", 1, 8), 16, 10).cast("long") * parts
    placed = records.select(
        F.when(F.col("hot"), F.pmod(F.xxhash64("page_id", "url"), F.lit(parts))).otherwise(F.shiftright(here, 32)).cast("int").alias("part"),
        "sha", "page_id", "url",
        F.when(F.col("hot").isNull() | (F.col("page_id") == F.col("response")), F.col("payload")).alias("payload"),
        "size", F.coalesce("hot", F.lit(False)).alias("hot"), "response",
    )
    ordered = placed.repartition(parts, "part").sortWithinPartitions("part", "sha", F.col("page_id").desc_nulls_last())
    ordered.mapInArrow(_write_parts(folder, roll_bytes, level), MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def parse_records(data) -> Iterator[tuple[dict, bytes]]:
    """(headers, block) of each record; data: an open binary file of gzip members."""
    z, rest, text = zlib.decompressobj(31), b"", bytearray()
    while True:
        chunk = rest or data.read(1 << 18)
        if not chunk:
            break
        text += z.decompress(chunk)
        rest = z.unused_data
        if not z.eof:
            continue
        end = text.index(b"\r\n\r\n")
        lines = text[:end].decode().split("\r\n")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        yield head, bytes(text[end + 4 : end + 4 + int(head["Content-Length"])])
        z, text = zlib.decompressobj(31), bytearray()
    if text:
        raise ValueError("an archive ends within a record")


def _read_files(folder: str, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _opened(folder)
        number = lambda head, key: int(head[key]) if key in head else None
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for name in batch.column(0).to_pylist():
                found: list[tuple] = []
                with store.open_input_stream(f"{path}/{name}", compression=None) as data:
                    for head, block in parse_records(data):
                        if head["WARC-Type"] == "warcinfo":
                            continue
                        end = block.index(b"\r\n\r\n") + 4
                        payload, stated = block[end:], head["WARC-Payload-Digest"].removeprefix("sha1:")
                        revisit = head["WARC-Type"] == "revisit"
                        size = int(block[:end].rpartition(b"Content-Length: ")[2]) if revisit else len(payload)
                        digest = stated if revisit else _base32(hashlib.sha1(payload).digest())
                        if digest != stated:
                            raise ValueError(f"{name}: a payload does not match its digest")
                        found.append((number(head, "X-Page-Id"), size, digest, head["WARC-Type"], number(head, "X-Refers-To-Page-Id"), head["WARC-Target-URI"], payload if with_payload and not revisit else None))
                        if len(found) == 1000:
                            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found), schema)], schema=schema)
                            found = []
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found), schema)], schema=schema)

    return run


def read_archives(manifest: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records of the files that the manifest lists, digests checked."""
    files = manifest.select("file")
    spread = files.repartition(max(2 * files.sparkSession.sparkContext.defaultParallelism, 1), "file")
    return spread.mapInArrow(_read_files(folder, with_payload), READ)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write all pages into a new archive folder and read them back."""
    folder = new_path(pages.sparkSession, "warc")
    manifest = write_archives(pages, folder)
    return read_archives(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
