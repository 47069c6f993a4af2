"""WARC archives as seekable Zstandard bundles.

An archive is a row of independent Zstandard frames, each with some records, and a skippable frame
with the seek table (compressed and decompressed size of every frame) at its end, after the public
seekable format. The index maps a record's identifier to its archive, its frame, and its offset in
the decompressed frame, so that a record is read with one range of bytes and one small frame.

Archives are written by the tasks under names of their own, renamed when whole, and named only by
the index rows that the same task commits: the files of a task that was lost are never referred to.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import new_dir, qualified, stored

FRAME_BYTES = 1 << 20
ARCHIVE_BYTES = 256 << 20
#: Decompressed bytes that one task reads back, about.
READ_BYTES = 16 << 20
#: Payloads of at least so many bytes are stored once.
REVISIT_BYTES = 1000
#: Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "record_id string, page_id long, archive string, frame int, frame_start long, frame_bytes long, record_start long, record_bytes long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
FRAMES = "archive string, frame int, frame_start long, frame_bytes long, text_bytes long"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(uri)


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record; with ``refers_to``, a revisit without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}"]
    head += [f"X-Page-ID: {page_id}"] * (page_id is not None)
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[int | None, int, str, str, int | None, str | None]]:
    """The records of a decompressed frame as rows of RECORDS; a payload that its digest denies is an error."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
        start = end + 4
        at = start + int(head["Content-Length"])
        split = data.index(b"\r\n\r\n", start, at) + 4
        http = dict(x.split(": ", 1) for x in data[start : split - 4].decode().split("\r\n")[1:])
        digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        if head["WARC-Type"] == "response" and hashlib.sha1(data[split:at]).hexdigest() != digest:
            raise ValueError(f"damaged record {head['WARC-Record-ID']}")
        number = lambda k: int(head[k]) if k in head else None
        url = head.get("WARC-Target-URI")
        yield number("X-Page-ID"), int(http["Content-Length"]), digest, head["WARC-Type"], number("X-Refers-To-Page-ID"), url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
        at += 4


class Archive:
    """A seekable archive that is being written."""

    def __init__(self, directory: str):
        self.fs, self.directory = file_system(directory)
        self.fs.create_dir(self.directory, recursive=True)
        self.uri = f"{directory}/{uuid.uuid4().hex}.warc.zst"
        self.path = f"{self.directory}/{self.uri.rpartition('/')[2]}"
        self.out = self.fs.open_output_stream(self.path + ".part")
        self.size, self.frames, self.text, self.waiting, self.rows = 0, [], bytearray(), [], []

    def add(self, page_id: int | None, digest: str, data: bytes) -> None:
        self.waiting.append((record_id(page_id, digest), page_id, len(self.text), len(data)))
        self.text += data
        if len(self.text) >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        import zstandard

        if self.text:
            packed = zstandard.ZstdCompressor(level=3).compress(bytes(self.text))
            self.rows += [(i, p, self.uri, len(self.frames), self.size, len(packed), a, n) for i, p, a, n in self.waiting]
            self.out.write(packed)
            self.frames.append((len(packed), len(self.text)))
            self.size += len(packed)
            self.text, self.waiting = bytearray(), []

    def close(self) -> list[tuple]:
        self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.out.close()
        self.fs.move(self.path + ".part", self.path)
        return self.rows


def seek_table(uri: str) -> list[tuple[int, int, int, int]]:
    """(frame, start, bytes, decompressed bytes) of an archive, from the table at its end."""
    fs, path = file_system(uri)
    with fs.open_input_file(path) as f:
        size = f.size()
        n, _, magic = struct.unpack("<IBI", f.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{uri} has no seek table")
        entries = struct.iter_unpack("<II", f.read_at(8 * n, size - 9 - 8 * n))
        out, at = [], 0
        for k, (packed, text) in enumerate(entries):
            out.append((k, at, packed, text))
            at += packed
        return out


def read_frame(uri: str, start: int, size: int) -> bytes:
    import zstandard

    fs, path = file_system(uri)
    with fs.open_input_file(path) as f:
        return zstandard.ZstdDecompressor().decompress(f.read_at(size, start))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """``page_id, digest, refers_to`` of every page; of equal payloads of ``least`` bytes, the largest page_id is referred to."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    narrow = pages.select(F.col("page_id").cast("long"), F.sha1(payload).alias("digest"), F.length(payload).alias("n"))
    kept = narrow.where(F.col("n") >= least).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    first = F.when(F.col("page_id").eqNullSafe(F.col("last")), F.lit(None)).otherwise(F.col("last"))
    return narrow.distinct().join(kept, "digest", "left").select("page_id", "digest", first.alias("refers_to"))


def write_archives(pages: DataFrame, directory: str, least: int = REVISIT_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes a record for every row of ``pages`` (page_id, url, html) to archives under ``directory``; gives the index.

    A null html is an empty payload, a null page_id or url is left out of the record. Of records with
    equal payloads of at least ``least`` bytes, those with the largest page_id are responses (all
    of them, if rows repeat it, under one record identifier) and others revisit it; page_id null counts as
    smaller than any. Other columns are ignored; an empty table writes no archive.
    """
    directory = qualified(pages.sparkSession, directory)  # without a scheme, tasks would write to their own disks
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    whole = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("html"), F.sha1(payload.cast("binary")).alias("digest"))
    plan = revisits(pages, least).withColumnsRenamed({"page_id": "p", "digest": "d"})
    rows = whole.join(plan, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left").select(*whole.columns, "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        for batch in batches:
            for page, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                archive = archive or Archive(directory)
                archive.add(page, digest, record(page, url, html.encode(), digest, refers_to, date))
                if archive.size >= ARCHIVE_BYTES:
                    yield _batch(archive.close(), INDEX)
                    archive = None
        if archive:
            yield _batch(archive.close(), INDEX)

    return stored(rows.mapInArrow(write, INDEX), "warc-index")


def read_archives(spark: SparkSession, archives: DataFrame) -> DataFrame:
    """All records of the archives in column ``archive``, found by their seek tables."""

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows = [(uri, *x) for x in seek_table(uri)]
                if rows:
                    yield _batch(rows, FRAMES)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, _, start, size, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield _batch(list(parse(read_frame(uri, start, size))), RECORDS)

    frames = stored(archives.select("archive").distinct().mapInArrow(tables, FRAMES), "warc-frames")
    # rows of frames are tiny: their number of partitions follows from the bytes that they stand for
    size = frames.agg(F.sum("text_bytes")).first()[0] or 0
    return frames.repartition(1 + int(size) // READ_BYTES, "archive", "frame").mapInArrow(records, RECORDS)


def read_record(entry) -> tuple:
    """One record by its row of the index: one range of bytes, one frame."""
    text = read_frame(entry["archive"], entry["frame_start"], entry["frame_bytes"])
    return next(parse(text[entry["record_start"] : entry["record_start"] + entry["record_bytes"]]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: all pages written to archives and read back from them."""
    index = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), new_dir(spark, "warc"))
    return read_archives(spark, index).drop("url")


QUERIES = {"op4_seekable_warc": query}
ORACLE_SQL = {
    "op4_seekable_warc": """
with p as (select page_id, sha1(coalesce(html, '')) as d, strlen(coalesce(html, '')) as n from pages),
k as (select d, max(page_id) as last from p where n >= 1000 group by d)
select page_id, cast(n as bigint) as payload_bytes, d as payload_digest,
  case when page_id < last then 'revisit' else 'response' end as record_type,
  case when page_id < last then last end as refers_to
from p left join k using (d)
"""
}
