"""Benchmark decontamination by spaced seeds.

Words are runs of letters, digits and non-ASCII bytes, A-Z lower-cased. A seed is a fixed mask over
word positions; its hash covers the marked positions and ignores the rest. The masks are such that
all aligned stretches of eight words or more with at least 80 % of them equal hold a seed of equal
words (a test goes through all cases). Seeds that a document shares with an item fix a diagonal, and
along it the overlap is the longest stretch of which at least 80 % of the words are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

MASKS = ("111011", "11010011", "11111")
MIN_WORDS = 10
#: An item of fewer words than MIN_WORDS counts as a whole, from this size on with up to 20 % of substitutions.
LEAST_FUZZY = 8
#: A still shorter item counts when all of its words stand in a row; under this, it never counts unless asked for.
LEAST_ITEM = 5
#: Pairs of runs of seeds that are expanded at once.
PAIRS = 1 << 20
MISMATCH = -4
#: Words of items that one pass over the documents looks for; more items take more passes.
BLOCK_WORDS = 500_000
HITS = "doc_id long, item_id long, n_matched int, n_words int, doc_word int, item_word int"


def seeds(hashes: np.ndarray, at: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Seed hashes at all positions whose span stays in one text, and these positions."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    where = np.flatnonzero(text[:n] == text[len(mask) - 1 :])
    h = np.full(n, len(mask) * 31 + mask.count("1"), np.uint64)
    for k in (k for k, x in enumerate(mask) if x == "1"):
        h = (h ^ hashes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(2 * k + 1)
    return W.scramble(h[where]), where


def best_stretch(equal: np.ndarray, least: int) -> tuple[int, int]:
    """Start and end of the longest stretch with 80 % of equal words, the first on ties.

    Unequal words at its ends are left out as far as ``least`` words stay.
    """
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, MISMATCH))])
    start = np.searchsorted(-np.minimum.accumulate(total), -total, "left")  # the first place that is no higher
    b = int(np.argmax(np.arange(len(total)) - start))
    a = int(start[b])
    while b - a > least and not equal[b - 1]:
        b -= 1
    while b - a > least and not equal[a]:
        a += 1
    return a, b


def seed_runs(h: np.ndarray, pos: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of one seed hash at neighbouring places of a text begin, and their lengths; the rows are in the order of text and place, or of hash, text and place."""
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (pos[1:] != pos[:-1] + 1) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(h)))


class Items:
    """The items of one pass: word hashes and a sorted table of runs of seeds for each mask."""

    def __init__(self, ids: np.ndarray, texts: pa.Array, least_item: int = LEAST_ITEM, least_fuzzy: int = LEAST_FUZZY, min_words: int = MIN_WORDS):
        raw, off = W.bytes_of(texts)
        self.ids, self.least_item, self.least_fuzzy, self.min_words = ids, least_item, least_fuzzy, min_words
        self.hashes, _, _, self.at = W.word_hashes(raw, off, W.PLAIN)
        self.count = np.diff(self.at)
        self.tables = []
        text = np.repeat(np.arange(len(self.count)), self.count)
        # items of fewer words than the masks' stretch of equal words are looked up whole
        for mask in (*MASKS, *("1" * n for n in range(max(least_item, 1), len(MASKS[-1])))):
            h, pos = seeds(self.hashes, self.at, mask)
            if mask not in MASKS:
                whole = self.count[text[pos]] == len(mask)
                h, pos = h[whole], pos[whole]
            order = np.argsort(h, kind="stable")
            h, pos = h[order], pos[order]
            first, n = seed_runs(h, pos, text[pos])
            h, item = h[first], text[pos[first]]
            self.tables.append((mask, h, pos[first] - self.at[item], n, item, self._bits(h)))

    @staticmethod
    def _bits(h: np.ndarray) -> np.ndarray:
        bits = np.zeros(1 << 22, bool)
        bits[h >> np.uint64(42)] = True
        return bits

    def _diagonals(self, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Distinct rows ``text, item, shift`` on which a seed is common.

        Where a seed stands m times in a row in a text and n times in an item, these are m + n - 1 shifts, not m times n. They are made in pieces
        of a bounded size, of which only the distinct ones stay: there are never more than a text's and an item's words together.
        """
        text = np.repeat(np.arange(len(at) - 1), np.diff(at))
        found = np.zeros((0, 3), np.int64)
        for mask, table, item_word, item_n, item, bits in self.tables:
            h, pos = seeds(hashes, at, mask)
            near = bits[h >> np.uint64(42)]
            h, pos = h[near], pos[near]
            first, runs = seed_runs(h, pos, text[pos])
            h, pos = h[first], pos[first]
            a, n = np.searchsorted(table, h, "left"), np.searchsorted(table, h, "right")
            n -= a
            some = np.flatnonzero(n)
            upto = np.cumsum(n[some])
            for k in range(0, int(upto[-1]) if len(upto) else 0, PAIRS):
                pair = np.arange(k, min(k + PAIRS, int(upto[-1])))
                row = np.searchsorted(upto, pair, "right")
                hit = a[some[row]] + pair - (upto[row] - n[some[row]])
                mine = some[row]
                d = text[pos[mine]]
                # from the text's first place against the item's last to the other way round
                low = pos[mine] - at[d] - item_word[hit] - item_n[hit] + 1
                size = runs[mine] + item_n[hit] - 1
                for x, y in _pieces(size):
                    shift = np.repeat(low[x:y], size[x:y]) + np.arange(int(size[x:y].sum())) - np.repeat(np.cumsum(size[x:y]) - size[x:y], size[x:y])
                    rows = np.stack([np.repeat(d[x:y], size[x:y]), np.repeat(item[hit[x:y]], size[x:y]), shift], 1)
                    found = _distinct(np.concatenate([found, _distinct(rows)]))
        return found

    def in_texts(self, hashes: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(text, item, matched, words, first word in the text, first word in the item), the best of each text and item."""
        best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        for d, i, shift in self._diagonals(hashes, at).tolist():
            mine, own = hashes[at[d] : at[d + 1]], self.hashes[self.at[i] : self.at[i + 1]]
            lo, hi = max(0, -shift), min(len(own), len(mine) - shift)
            equal = own[lo:hi] == mine[lo + shift : hi + shift]
            least = min(self.min_words, len(own))
            if best.get((d, i), (0,))[0] > hi - lo or hi - lo < least:
                continue  # it can't be better
            a, b = best_stretch(equal, least)
            matched = int(equal[a:b].sum())
            if b - a >= least and (least >= self.least_fuzzy or matched == least >= self.least_item):
                best[d, i] = max(best.get((d, i), (0, 0, 0, 0)), (matched, -(b - a), -(lo + a + shift), -(lo + a)))
        for (d, i), (matched, n, at_doc, at_item) in best.items():
            yield d, i, matched, -n, -at_doc, -at_item


def _pieces(size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about PAIRS elements, or one larger row."""
    upto, a = np.cumsum(size), 0
    while a < len(size):
        before = int(upto[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(upto, before + PAIRS, "right")))
        yield a, b
        a = b


def _distinct(rows: np.ndarray) -> np.ndarray:
    """Distinct rows in order; np.unique over an axis compares bytes and is slower."""
    if len(rows) < 2:
        return rows
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    keep = np.ones(len(rows), bool)
    keep[1:] = (rows[1:] != rows[:-1]).any(1)
    return rows[keep]


def overlaps(docs: DataFrame, items: DataFrame, least_item: int = LEAST_ITEM, least_fuzzy: int = LEAST_FUZZY, min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each document and benchmark item that overlap: ``doc_id, item_id, n_matched, n_words, doc_word, item_word``.

    ``docs`` needs doc_id and text, ``items`` item_id and text; other columns are ignored. An overlap
    has ``min_words`` or more, or all of a shorter item, of which 80 % are equal; an item of under ``least_fuzzy``
    words stands in it unchanged, and one of under ``least_item`` never counts (from 1 on, all items with words do). Seeds are
    sure to meet in stretches of eight words with substitutions and of any number without: ``least_fuzzy`` is 8 at least.
    Null and empty texts overlap with nothing, a null id stays null, repeated rows give repeated
    overlaps on the side of ``docs``, and once on the side of ``items``. Items go to the tasks in
    blocks of a bounded number of words, each a pass over the documents.
    """
    if least_fuzzy < LEAST_FUZZY or least_item < 1 or min_words < 1:
        raise ValueError("these bounds are too low for the seeds")
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null").distinct()
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + int(size) // (5 * BLOCK_WORDS)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).orderBy("item_id", "text").toArrow() if blocks > 1 else items.orderBy("item_id", "text").toArrow()
        sent = spark.sparkContext.broadcast((block.column(0).combine_chunks(), block.column(1).combine_chunks()))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, texts = sent.value
            here = Items(np.arange(len(ids)), texts, least_item, least_fuzzy, min_words)
            for batch in batches:
                for part, raw, off in W.chunks(batch):
                    h, _, _, at = W.word_hashes(raw, off, W.PLAIN)
                    rows = list(here.in_texts(h, at))
                    if rows:
                        d, i, *rest = (np.array(x) for x in zip(*rows, strict=True))
                        yield pa.RecordBatch.from_arrays(
                            [part.column(0).take(pa.array(d)), ids.take(pa.array(i)), *(pa.array(x, pa.int32()) for x in rest)],
                            ["doc_id", "item_id", "n_matched", "n_words", "doc_word", "item_word"],
                        )

        found = docs.mapInArrow(search, HITS)
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text overlaps with a benchmark item; all columns stay.

    It is decided row by row: a null doc_id spares no text, and other texts of an id stay.
    """
    row = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    bad = overlaps(docs.select(row.alias("doc_id"), "text"), items).select(F.col("doc_id").alias("row")).distinct()
    # the row stands as one value beside its key, so that no column of its own can clash with it
    return docs.select(F.struct("*").alias("doc"), row.alias("row")).join(bad, "row", "left_anti").select("doc.*")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: every overlap between all documents and all benchmark items."""
    return overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op3_benchmark_decontamination": query}
