"""Token ids in files of directly addressable codes: any token is found without decoding a block.

An id is split into chunks of bits, the lowest first. Level 0 has the first chunk of every id and
level k + 1 the next chunk of those that have one, in their order; a bitmap at each level marks the ids
that go on. The number of marks before a place, from a rank directory of one counter for 512 bits and the
bits behind it, is the id's place in the next level: so one token costs a few bytes at each level. The widths of the
levels are those with the fewest bits for the ids at hand, found by dynamic programming over their lengths in bits.

A file is a row of segments of some million ids, each with its header, documents and levels. Tasks write
files in ascending order of doc_id under names of their own, rename them when whole, and name them only in
the rows of the manifest that the same task commits: what a lost task left is never referred to.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .packing import encoder, tokenizer_path
from .scratch import new_dir, qualified, stored
from .warc import file_system

MAGIC = b"DAC1"
HEAD = struct.Struct("<4sIQQ")
#: Of a level: width in bits, ids in it, and the places of its chunks, bitmap and rank directory.
LEVEL = struct.Struct("<IIQQQQ")
#: A segment is closed when it has so many ids; a longer text makes a longer one.
SEGMENT_IDS = 1 << 22
#: Segments that one task reads back, about.
READ_SEGMENTS = 4
#: Bits of a bitmap for each counter of its rank directory.
RANK_BITS = 512
#: Widths that a level may have: a word of 64 bits holds eight such chunks, or four, in whole bytes.
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16)
#: Files of the manifest that one group of the running sum holds.
GROUPED = 1000
MANIFEST = "part int, file string, segment int, place long, n_bytes long, n_ids long, n_docs long"


def level_widths(ids: np.ndarray) -> list[int]:
    """The widths of the levels that take the fewest bits, a continuation bit for each id of all but the last level included."""
    bits = max(int(ids.max()).bit_length(), 1) if len(ids) else 1
    over = [len(ids)] + [int(np.count_nonzero(ids >= np.uint32(1 << k))) for k in range(1, bits)]  # ids with more than k bits
    best: list[tuple[int, int]] = [(0, 0)] * bits + [(0, 0)] * WIDTHS[-1]
    for a in reversed(range(bits)):
        best[a] = min((over[a] * (w + (a + w < bits)) + best[a + w][0], w) for w in WIDTHS)
    out, a = [], 0
    while a < bits:
        out.append(best[a][1])
        a += out[-1]
    return out


def _bits(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of each value, one after the other."""
    each = 8 if width <= 8 else 4  # chunks of a word
    padded = np.zeros(-(-len(values) // each) * each, np.uint64)
    padded[: len(values)] = values
    rows = padded.reshape(-1, each)
    word = rows[:, 0].copy()
    for k in range(1, each):
        word |= rows[:, k] << np.uint64(k * width)
    return word.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : each * width // 8].tobytes()


def _n_bytes(n: int, width: int) -> int:
    each = 8 if width <= 8 else 4
    return -(-n // each) * each * width // 8


def _values(body: bytes, n: int, width: int) -> np.ndarray:
    each = 8 if width <= 8 else 4
    raw = np.frombuffer(body, np.uint8).reshape(-1, each * width // 8)
    words = np.zeros((len(raw), 8), np.uint8)
    words[:, : raw.shape[1]] = raw
    word = words.view("<u8").ravel()
    out = np.empty((len(raw), each), np.uint32)
    for k in range(each):
        out[:, k] = word >> np.uint64(k * width) & np.uint64((1 << width) - 1)
    return out.ravel()[:n]


def _directory(marks: np.ndarray) -> bytes:
    """The marks before each block of bits."""
    blocks = np.add.reduceat(marks, np.arange(0, len(marks), RANK_BITS), dtype=np.int64)
    return np.concatenate([[0], np.cumsum(blocks)]).astype("<u4").tobytes()


def segment_bytes(docs: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """A segment: the documents' ids, whether they have one, their ends, and the levels of all token ids."""
    body: list[bytes] = [
        np.array([d or 0 for d in docs], "<i8").tobytes(), np.array([d is not None for d in docs], np.uint8).tobytes(), np.concatenate([[0], np.cumsum(sizes)]).astype("<u8").tobytes()
    ]
    widths = level_widths(ids)
    at = HEAD.size + LEVEL.size * len(widths) + sum(map(len, body))
    levels, rest = [], ids.astype(np.uint32)
    for k, width in enumerate(widths):
        chunks = _bits(rest & np.uint32((1 << width) - 1), width)
        more = rest >> np.uint32(width)
        last = k + 1 == len(widths)
        goes = more > 0
        marks = b"" if last else np.packbits(goes, bitorder="little").tobytes()
        counts = b"" if last else _directory(goes)
        levels.append(LEVEL.pack(width, last, len(rest), at, at + len(chunks), at + len(chunks) + len(marks)))
        at += len(chunks) + len(marks) + len(counts)
        body += [chunks, marks, counts]
        rest = more[goes]
    return b"".join([HEAD.pack(MAGIC, len(widths), len(ids), len(docs)), *levels, *body])


class Segment:
    """A segment of a file, read by ``read(place, n_bytes)``: single tokens by a few bytes each, or all of it."""

    def __init__(self, read: Callable[[int, int], bytes]):
        self.read = read
        magic, n, self.n_ids, self.n_docs = HEAD.unpack(read(0, HEAD.size))
        if magic != MAGIC:
            raise ValueError("this is no segment of token ids")
        self.levels = list(LEVEL.iter_unpack(read(HEAD.size, LEVEL.size * n)))
        self.first = HEAD.size + LEVEL.size * n

    def token(self, at: int) -> int:
        """The id at a place, by its chunk, its mark and the rank of the mark at every level that it reaches."""
        if not 0 <= at < self.n_ids:
            raise IndexError(at)
        value = shift = 0
        for width, last, _, chunks, marks, counts in self.levels:
            a, b = at * width // 8, ((at + 1) * width + 7) // 8
            value |= (int.from_bytes(self.read(chunks + a, b - a), "little") >> at * width % 8 & (1 << width) - 1) << shift
            if last:
                break
            block = at // RANK_BITS
            bits = int.from_bytes(self.read(marks + block * RANK_BITS // 8, at // 8 - block * RANK_BITS // 8 + 1), "little")
            if not bits >> at % RANK_BITS & 1:
                break
            shift += width
            before = int.from_bytes(self.read(counts + 4 * block, 4), "little")
            at = before + (bits & (1 << at % RANK_BITS) - 1).bit_count()
        return value

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """The documents' ids, and n+1 places of their first tokens."""
        n = self.n_docs
        body = self.read(self.first, 17 * n + 8)
        known = np.frombuffer(body, np.uint8, n, 8 * n).tolist()
        docs = [d if k else None for d, k in zip(np.frombuffer(body, "<i8", n).tolist(), known)]
        return docs, np.frombuffer(body, "<u8", n + 1, 9 * n).astype(np.int64)

    def ids(self) -> np.ndarray:
        """All token ids."""
        out, own, shift = np.zeros(0, np.uint32), np.arange(self.n_ids), 0
        for k, (width, last, n, chunks, marks, _) in enumerate(self.levels):
            found = _values(self.read(chunks, _n_bytes(n, width)), n, width) << np.uint32(shift)
            if k:
                out[own] |= found
            else:
                out = found
            if not last:
                own = own[np.unpackbits(np.frombuffer(self.read(marks, (n + 7) // 8), np.uint8), count=n, bitorder="little").astype(bool)]
            shift += width
        return out


class TokenWriter:
    """A file that is being written, segment by segment."""

    def __init__(self, directory: str, part: int):
        self.fs, folder = file_system(directory)
        self.fs.create_dir(folder, recursive=True)
        name = f"{part:06d}-{uuid.uuid4().hex}.dac"
        self.uri, self.path, self.part = f"{directory}/{name}", f"{folder}/{name}", part
        self.out = self.fs.open_output_stream(self.path + ".part")
        self.rows: list[tuple] = []
        self.place, self.waiting, self.n_waiting = 0, [], 0

    def add(self, docs: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> None:
        self.waiting.append((docs, sizes, ids))
        self.n_waiting += len(ids)
        if self.n_waiting >= SEGMENT_IDS:
            self.flush()

    def flush(self) -> None:
        if self.waiting:
            docs = [d for x in self.waiting for d in x[0]]
            body = segment_bytes(docs, *(np.concatenate([x[k] for x in self.waiting]) for k in (1, 2)))
            self.out.write(body)
            self.rows.append((self.part, self.uri, len(self.rows), self.place, len(body), self.n_waiting, len(docs)))
            self.place += len(body)
            self.waiting, self.n_waiting = [], 0

    def close(self) -> list[tuple]:
        self.flush()
        self.out.close()
        self.fs.move(self.path + ".part", self.path)
        return self.rows


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def with_starts(segments: DataFrame) -> DataFrame:
    """``segments`` with ``start``: the ids of all segments before. Files sum up in groups, so that no task holds them all."""
    order = Window.partitionBy("_group").orderBy("part", "segment")
    own = segments.withColumn("_group", F.floor(F.col("part") / GROUPED)).withColumn("_own", F.sum("n_ids").over(order) - F.col("n_ids"))
    sums = segments.groupBy(F.floor(F.col("part") / GROUPED).alias("_group")).agg(F.sum("n_ids").alias("_n"))  # a row for a thousand files
    before = sums.select("_group", (F.sum("_n").over(Window.orderBy("_group")) - F.col("_n")).alias("_before"))
    return own.join(before, "_group").withColumn("start", F.col("_before") + F.col("_own")).drop("_group", "_own", "_before")


def write_tokens(docs: DataFrame, directory: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0) -> DataFrame:
    """Writes the ids of all documents, each with ``end_id`` behind it, in ascending order of doc_id; returns the manifest.

    ``docs`` needs doc_id and text; other columns are ignored. A null or empty text is the end id alone. Rows
    without a doc_id come first; rows with one doc_id follow each other in an order of their texts' hashes, and repeated rows are
    written each. An empty table writes no file and has an empty manifest. The rows of the manifest are segments: file,
    place and bytes in it, ids and documents in it, and ``start``, the ids before it in all files.
    """
    directory = qualified(docs.sparkSession, directory)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_encoder, out = encoder(tokenizer_path(tokenizer)), None
        for batch in batches:
            for part, raw, off in W.chunks(batch):
                ids, at = own_encoder.encode(raw, off)
                out = out or TokenWriter(directory, TaskContext.get().partitionId())
                # np.insert puts the end id before the place of the next document's first
                out.add(part.column(0).to_pylist(), np.diff(at) + 1, np.insert(ids, at[1:], np.uint32(end_id)))
        if out:
            yield _batch(out.close(), MANIFEST)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    key = [F.col("doc_id"), F.xxhash64("text")]
    # ranges of (doc_id, hash), so that very many rows with one doc_id are still dealt out
    ordered = rows.repartitionByRange(*key).sortWithinPartitions(*key)
    return stored(with_starts(stored(ordered.mapInArrow(write, MANIFEST), "token-segments")), "token-manifest")


def _reader(file) -> Callable[[int], Callable[[int, int], bytes]]:
    return lambda place: lambda at, n: file.read_at(n, place + at)


def read_documents(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files; a task reads whole segments."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, uri, segment, place, n_bytes, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, path = file_system(uri)
                with fs.open_input_file(path) as f:
                    body = f.read_at(n_bytes, place)
                found = Segment(lambda at, n: body[at : at + n])
                docs, first = found.documents()
                ids = found.ids().astype("<u4")
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start + first[:-1]), pa.array(np.diff(first)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = manifest.select("part", "file", "segment", "place", "n_bytes", "start")
    n = manifest.count()  # rows are tiny, but each stands for megabytes
    return spread.repartition(1 + n // READ_SEGMENTS, "part", "segment").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_at(manifest: DataFrame, positions: DataFrame) -> DataFrame:
    """``position, token`` for every row of ``positions`` (column position, counted over all files), by single reads.

    Positions outside of the files and nulls are left out; repeated ones are answered each.
    """

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[tuple, list] = {}
            for position, uri, place, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.setdefault((uri, place, start), []).append(position)
            for (uri, place, start), wanted in rows.items():
                fs, path = file_system(uri)
                with fs.open_input_file(path) as f:
                    found = Segment(_reader(f)(place))
                    yield pa.RecordBatch.from_arrays([pa.array(wanted, pa.int64()), pa.array([found.token(p - start) for p in wanted], pa.int64())], ["position", "token"])

    cell = lambda c: F.floor(c / SEGMENT_IDS)
    cells = manifest.where("n_ids > 0").withColumn("_cell", F.explode(F.sequence(cell(F.col("start")), cell(F.col("start") + F.col("n_ids") - 1))))
    asked = positions.select(F.col("position").cast("long")).where("position >= 0").withColumn("_cell", cell(F.col("position")))
    met = asked.join(cells, "_cell").where("position >= start and position < start + n_ids")
    return met.select("position", "file", "place", "start").mapInArrow(look_up, "position long, token long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: the ids of all documents written to files and read back from them."""
    manifest = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), new_dir(spark, "tokens"))
    return read_documents(manifest)


QUERIES = {"op11_token_store": query}
