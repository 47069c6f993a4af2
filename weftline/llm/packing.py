"""Best-fit packing of tokenised documents by minimum bin slack.

A bin starts with the longest piece left; a subset-sum over the lengths that are left, kept as a
bitset, finds the fullest combination for its rest, and the combination is taken out as often as the
counts allow. The search needs the counts by length alone, one row for each possible length whatever
the input's size, so it runs over that table; the pieces themselves are ranked within their length
and looked up in the resulting plan where they are.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .scratch import stored

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"
#: Distinct words that a task remembers with their ids, and ids of them; beyond either, it starts anew.
REMEMBERED, REMEMBERED_IDS = 1_250_000, 16 << 20
#: Places of the table that finds a word by its hash; a text with very many new words doubles it.
PLACES = 1 << 22
#: Pieces of one length that are ranked together.
RANKED = 10_000


def tokenizer_path(name: str) -> str:
    """A path as it is; another name is a file of the installed public vocabularies."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


_SOLID = np.array([0x20 < b != 0x7F for b in range(256)])
#: Not after a space that may start a longer run of spaces: lead bytes of non-ASCII spaces.
_AFTER = _SOLID & ~np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])
_PUNCTUATION = np.array([0x20 < b < 0x7F and not chr(b).isalnum() for b in range(256)])


def breaks(raw: np.ndarray) -> np.ndarray:
    """Places where byte-level pre-tokenisation surely breaks, whatever stands around them.

    They are: before a lone space between solid characters, between a letter and ASCII punctuation,
    and after a lone line feed between ASCII punctuation and an ASCII letter.
    """
    if len(raw) < 3:
        return np.zeros(0, np.int64)
    a, b, c = raw[:-2], raw[1:-1], raw[2:]
    before = (b == 0x20) & _SOLID[a] & _AFTER[c]
    letter = _LETTER[b] | ((a == 0xC3) & (b >= 0x80) & (b != 0x97) & (b != 0xB7))
    after = letter & _PUNCTUATION[c] | (b == 0x0A) & _PUNCTUATION[a] & _LETTER[c]
    mark = np.zeros(len(raw), bool)
    mark[1:-1] = before
    mark[2:] |= after
    return np.flatnonzero(mark)


_encoders: dict = {}


def encoder(path: str) -> WordwiseEncoder:
    """The Python worker's own encoder, which keeps what earlier tasks have learnt."""
    if path not in _encoders:
        _encoders[path] = WordwiseEncoder(path)
    return _encoders[path]


class WordwiseEncoder:
    """A byte-level tokenizer's ids of many texts; a word that was seen before costs a lookup by its 64-bit hash.

    The ids of the parts between places where pre-tokenisation breaks, joined, are the ids of the whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.special = re.compile(b"|".join(re.escape(x.content.encode()) for x in self.tokenizer.get_added_tokens_decoder().values()) or b"(?!)")
        self._forget()

    def _forget(self) -> None:
        self.known = 0
        self.keys, self.slots = np.zeros(PLACES, np.uint64), np.zeros(PLACES, np.int32)
        self.ids, self.used = np.zeros(1 << 20, np.uint32), 0
        self.first, self.count = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64)

    def _places(self, hashes: np.ndarray) -> np.ndarray:
        """Where each hash stands in the table, or the empty place where it belongs."""
        mask = len(self.keys) - 1
        at = (hashes >> np.uint64(24)).astype(np.int64) & mask
        key = self.keys[at]
        live = np.flatnonzero((key != hashes) & (key != 0))
        while len(live):
            at[live] = (at[live] + 1) & mask
            key = self.keys[at[live]]
            live = live[(key != hashes[live]) & (key != 0)]
        return at

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """Keeps the ids of words with different hashes that are not in the table."""
        found = [x.ids for x in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        n = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for x in found for i in x), np.uint32, int(n.sum()))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.known + len(n) > len(self.first):
            self.first, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count))
        self.ids[self.used : self.used + len(flat)] = flat
        self.first[self.known : self.known + len(n)] = self.used + np.cumsum(n) - n
        self.count[self.known : self.known + len(n)] = n
        if 2 * (self.known + len(n)) > len(self.keys):
            there = np.flatnonzero(self.keys)
            keys, slots = self.keys[there], self.slots[there]
            size = 1 << (4 * (self.known + len(n))).bit_length()
            self.keys, self.slots = np.zeros(size, np.uint64), np.zeros(size, np.int32)
            self._insert(keys, slots)
        self._insert(hashes, self.known + np.arange(len(n)))
        self.known += len(n)
        self.used += len(flat)

    def _insert(self, hashes: np.ndarray, slots: np.ndarray) -> None:
        left = np.arange(len(hashes))
        while len(left):
            _, one = np.unique(places := self._places(hashes[left]), return_index=True)  # of those that want the same place, one gets it
            self.keys[places[one]], self.slots[places[one]] = hashes[left[one]], slots[left[one]]
            left = np.delete(left, one)

    def encode(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and n+1 offsets of the texts' ids."""
        if self.known > REMEMBERED or self.used > REMEMBERED_IDS:
            self._forget()
        whole, cut = raw.tobytes(), breaks(raw)
        for m in self.special.finditer(whole):
            cut = cut[(cut <= m.start()) | (cut >= m.end())]
        mark = np.zeros(len(raw) + 1, bool)
        mark[cut] = mark[off] = True
        edges = np.flatnonzero(mark)
        if len(edges) < 2:
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        hashes = np.maximum(W.span_hashes(raw, edges[:-1], edges[1:]), np.uint64(1))  # 0 is an empty place
        place = self._places(hashes)
        new = np.flatnonzero(self.keys[place] == 0)
        if len(new):
            own, first = np.unique(hashes[new], return_index=True)
            at = new[first]
            self._learn(own, [whole[a:b] for a, b in zip(edges[at].tolist(), edges[at + 1].tolist())])
            place = self._places(hashes)  # the table may have grown
        slot = self.slots[place]
        n = self.count[slot]
        before = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.repeat(self.first[slot] - before[:-1], n) + np.arange(before[-1])]
        return ids, before[np.searchsorted(edges, off)]


def cut_points(n: int, most: int) -> list[int]:
    """Starts of the pieces of ``n`` ids and their end: full pieces after a first one that may be shorter."""
    return [0, *range(n % most or min(n, most), n, most), n] if n > most else [0, n]


def pieces(docs: DataFrame, most: int = 1024, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2) -> DataFrame:
    """Every document's ids and ``end_id``, cut into pieces of at most ``most`` ids; a null text is empty."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_encoder = encoder(tokenizer_path(tokenizer))
        for batch in batches:
            rows: list[tuple] = []
            for part, raw, off in W.chunks(batch):
                ids, at = own_encoder.encode(raw, off)
                for k, doc in enumerate(part.column(0).to_pylist()):
                    own = np.append(ids[at[k] : at[k + 1]], np.uint32(end_id)).astype("<u4")
                    cuts = cut_points(len(own), most)
                    rows += [(doc, j, a, b - a, zlib.crc32(own[a:b].tobytes())) for j, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths, longest first, of the fullest combination of at most ``room``, by a bitset of reachable sums."""
    reach, steps = 1, []
    mask = (1 << room + 1) - 1
    for n in sorted((n for n, c in counts.items() if c and n <= room), reverse=True):
        for _ in range(min(counts[n], room // n)):
            more = (reach | reach << n) & mask
            if more == reach:
                break
            steps.append((n, reach))
            reach = more
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, []
    for n, before in reversed(steps):
        if not before >> total & 1:
            out.append(n)
            total -= n
    return sorted(out, reverse=True)


def plan(counts: dict[int, int], most: int = 1024) -> list[tuple[int, int, int, int, int]]:
    """Rows ``(length, first rank, copies of the length in a bin, first bin, offset of the first copy)``.

    Piece ``r`` of a length, from the row's first rank on, goes to bin ``first + (r - rank) // copies``.
    """
    left = {n: c for n, c in counts.items() if c}
    rank = dict.fromkeys(left, 0)
    out, bins = [], 0
    while left:
        longest = max(left)
        left[longest] -= 1
        combination = [longest, *fullest(left, most - longest)]
        left[longest] += 1
        need = {n: combination.count(n) for n in combination}
        times = min(left[n] // m for n, m in need.items())
        offset = 0
        for n, m in need.items():
            out.append((n, rank[n], m, bins, offset))
            rank[n] += m * times
            offset += m * n
            left[n] -= m * times
            if not left[n]:
                del left[n]
        bins += times
    return sorted(out)


def pack(cut: DataFrame, most: int = 1024) -> DataFrame:
    """The rows of ``pieces`` with sequence_id and offset; no row is lost, rows may repeat."""
    cut = stored(cut, "pieces")
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most ``most`` rows
    entries = np.array(plan(counts, most), np.int64).reshape(-1, 5)
    groups = 1 + sum(counts.values()) // RANKED
    cut = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    before = cut.groupBy("length", "part").count().withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")).drop("count")
    own = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = cut.withColumn("own", own - 1).join(before, ["length", "part"])
    names = PIECES.replace(",", "").split()[::2]
    ranked = ranked.select(*names, (F.col("before") + F.col("own")).alias("rank"))
    far = 1 << 44

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = entries[:, 0] * far + entries[:, 1]
        for b in batches:
            n, r = (b.column(b.schema.get_field_index(x)).to_numpy() for x in ("length", "rank"))
            e = entries[np.searchsorted(keys, n * far + r, "right") - 1]
            copy, slot = np.divmod(r - e[:, 1], np.maximum(e[:, 2], 1))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(e[:, 3] + copy), pa.array(e[:, 4] + slot * n)], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, PACKED)


def best_fit_pack(docs: DataFrame, most: int = 1024, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2) -> DataFrame:
    """All documents packed into sequences of at most ``most`` tokens, a row for each piece.

    ``docs`` needs doc_id and text; other columns are ignored. Null and empty texts are the end
    token alone; null ids and repeated rows are packed like others; an empty table gives no rows.
    """
    return pack(pieces(docs, most, tokenizer, end_id), most)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: all documents in sequences of at most 1024 tokens."""
    return best_fit_pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_best_fit_packing": query}
