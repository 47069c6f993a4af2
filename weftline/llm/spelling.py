"""Spelling variants: words of a corpus that differ by one code point, grouped under their most frequent form.

Words are counted where the texts are and summed by word. Near words come from a positional q-gram inverted index,
dealt to tasks in shards. Two words that differ by one edit, the shorter of m code points, agree in the
first m // 2 of them or in the last m - m // 2: each word goes to the shards of its halves, for m its own length and the length
before. Within a shard the words' rests are indexed by their grams of two code points with their places, counted from
the shared half. One edit changes two grams of the longer rest at most and moves the others by one place: the postings
of a word's grams, at the same place or one beside and of a fitting length, are merged by a heap, and words that come
out often enough are verified. Shards with very many words are dealt out once more, by gram and place.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .scratch import discard, stored

#: Code points of the shortest word, and its least occurrences.
LEAST_POINTS, LEAST_COUNT = 6, 5
#: In a run whose hash is divisible by this, one code point is deleted.
EVERY = 199
#: A word's form is at least so many times as frequent.
FORM_TIMES = 5
#: Distinct words that a task counts before it hands them on.
REMEMBERED = 1_000_000
#: Shards of more words are dealt out by gram and place.
HOT = 20_000
#: Words in the shards of one task, about.
DEALT = 50_000
#: Runs of more bytes are hashed one by one.
LONG = 64
MAX_ROUNDS = 40
COUNTS = "word string, n long"
NEAR = "word string, n long, other string, other_n long"

_LETTERS = np.array([b < 128 and chr(b).isalpha() for b in range(256)])


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ np.where(table & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))  # the polynomial of crc32, reflected
    return table


_CRC = _crc_table()


def run_hashes(low: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray) -> np.ndarray:
    """crc32 of each run, carried on from ``state``, the crc32 of what stands before it."""
    crc = state ^ np.uint32(0xFFFFFFFF)
    live = np.flatnonzero(end - start <= LONG)
    for k in range(LONG):
        live = live[start[live] + k < end[live]]
        if not len(live):
            break
        old = crc[live]
        crc[live] = _CRC[(old ^ low[start[live] + k]) & np.uint32(0xFF)] ^ (old >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    for k in np.flatnonzero(end - start > LONG).tolist():
        crc[k] = zlib.crc32(low[start[k] : end[k]].tobytes(), int(state[k]))
    return crc


def words_of(docs: list[int | None], raw: np.ndarray, off: np.ndarray, every: int = EVERY, least: int = LEAST_POINTS) -> Iterator[tuple[bytes, int]]:
    """Words of at least ``least`` code points with their occurrences in these texts; a word may come more than once."""
    low = W.LOWER[raw]
    lead = raw == 0xC3  # of U+00C0 to U+00FF
    solid = _LETTERS[raw] | lead
    solid[1:] |= lead[:-1]
    start, end, at = W.spans(solid, off)
    inner = np.concatenate([[0], np.cumsum((raw & 0xC0) == 0x80)])
    points = end - start - inner[end] + inner[start]
    keep = points >= least  # a deletion never makes a run longer
    doc = np.repeat(np.arange(len(docs)), np.diff(at))[keep]
    start, end, points = start[keep], end[keep], points[keep]
    before = np.array([zlib.crc32(f"{'' if d is None else d}:".encode()) for d in docs], np.uint32)
    crc = run_hashes(low, start, end, before[doc]) if len(start) else np.zeros(0, np.uint32)
    changed = crc.astype(np.int64) % every == 0
    _, first, n = np.unique(W.span_hashes(low, start, end)[~changed], return_index=True, return_counts=True)
    a, b = start[~changed][first].tolist(), end[~changed][first].tolist()
    whole = low.tobytes()
    for x, y, count in zip(a, b, n.tolist()):
        yield whole[x:y], count
    for x, y, size, h in zip(*(v[changed].tolist() for v in (start, end, points, crc))):
        if size > least:
            word = whole[x:y].decode()
            yield (word[: h % size] + word[h % size + 1 :]).encode(), 1


def word_counts(docs: DataFrame, least_count: int = LEAST_COUNT, every: int = EVERY) -> DataFrame:
    """``word, n``: words of at least six code points that occur ``least_count`` times or more.

    ``docs`` needs doc_id and text; other columns are ignored. A null text has no words, a null doc_id counts as
    empty text before the colon, repeated rows count each, an empty table gives no rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, int] = {}
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
        for batch in batches:
            for part, raw, off in W.chunks(batch):
                for word, n in words_of(part.column(0).to_pylist(), raw, off, every):
                    found[word] = found.get(word, 0) + n
            if len(found) > REMEMBERED:
                yield rows()
                found = {}
        if found:
            yield rows()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count, COUNTS).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _half(word: str, side: str, m: int) -> tuple[str, str]:
    """The shared half that a shard stands for, and the rest from its last code point on, with an end, read away from the half."""
    if side == "s":
        word, size = word[::-1], m - m // 2
    else:
        size = m // 2
    return word[:size], word[size - 1 :] + "\0"


def grams(rest: str) -> list[str]:
    return [a + b for a, b in pairwise(rest)]


def one_edit(a: str, b: str) -> bool:
    """Whether two different words differ by one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


class Shard:
    """The positional inverted index of a shard: words of length m, met by these and by words one longer."""

    def __init__(self, side: str, m: int, gram: str | None = None, place: int = 0):
        self.side, self.m, self.gram, self.place = side, m, gram, place
        self.postings: dict[tuple[str, int], list[int]] = {}
        self.words: list[tuple[str, int]] = []
        self.size: list[int] = []

    def add(self, word: str, n: int, own: list[str]) -> None:
        for k, g in enumerate(own):
            self.postings.setdefault((g, k), []).append(len(self.words))
        self.words.append((word, n))
        self.size.append(len(own))

    def near(self, word: str, own: list[str]) -> Iterator[tuple[str, int]]:
        """Indexed words one edit from ``word`` that are reported here and in no other shard."""
        lists = [x for k, g in enumerate(own) for place in (k - 1, k, k + 1) if (x := self.postings.get((g, place)))]
        seen, times = -1, 0
        for k in [*heapq.merge(*lists), -1]:
            if k == seen:
                times += 1
                continue
            # all grams of the longer rest but two are common
            if seen >= 0 and times >= max(len(own), self.size[seen]) - 2 and self._reported(*self.words[seen], word, own):
                yield self.words[seen]
            seen, times = k, 1

    def _reported(self, other: str, n: int, word: str, own: list[str]) -> bool:
        if self.side == "s" and other[: self.m // 2] == word[: self.m // 2] or not one_edit(other, word):
            return False
        if self.gram is None:
            return True
        theirs = grams(_half(other, self.side, self.m)[1])
        return next((g, k) for k, g in enumerate(theirs) if g in own[max(k - 1, 0) : k + 2]) == (self.gram, self.place)


def near_pairs(counts: DataFrame, hot: int = HOT) -> DataFrame:
    """``word, n, other, other_n`` both ways for all words one edit apart."""
    size = F.char_length("word")
    each = counts.select("word", "n", F.explode(F.array(*(F.struct(F.lit(s).alias("side"), (size - d).alias("m"), F.lit(d).alias("longer")) for s in "ps" for d in (0, 1)))).alias("x")).select("word", "n", "x.*")
    each = each.where(F.col("m") >= LEAST_POINTS)
    half = F.floor(F.col("m") / 2).cast("int")
    known = F.when(F.col("side") == "p", F.substr("word", F.lit(1), half)).otherwise(F.right("word", F.col("m") - half))
    each = each.select(F.concat_ws(":", "side", F.col("m").cast("string"), known).alias("key"), "longer", "word", "n", "side", "m")
    # a shard without words of length m, or with one word alone, has no pairs
    sizes = stored(each.groupBy("key").agg(F.count("*").alias("size"), F.min("longer").alias("least")).where("size > 1 and least = 0").select("key", "size"), "shards")
    each = each.join(sizes, "key")
    plain = each.where(F.col("size") <= hot).select("key", "longer", "word", "n", (F.col("longer") == 0).alias("indexed"), F.lit(True).alias("asked"))
    rest = F.when(F.col("side") == "p", F.substr("word", half)).otherwise(F.reverse(F.left("word", size - (F.col("m") - half) + 1)))
    ended = F.concat(rest, F.lit("\0"))
    gram = F.transform(F.sequence(F.lit(0), F.char_length(ended) - 2), lambda k: F.struct(ended.substr(k + 1, F.lit(2)).alias("gram"), k.alias("place")))
    large = each.where(F.col("size") > hot).withColumn("at", F.explode(gram))
    dealt = lambda place: F.concat_ws(":", "key", F.col("at.gram"), place.cast("string"))
    kept = large.where("longer = 0").select(dealt(F.col("at.place")).alias("key"), "longer", "word", "n", F.lit(True).alias("indexed"), F.lit(False).alias("asked"))
    asked = large.withColumn("beside", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).where("at.place + beside >= 0")
    asked = asked.select(dealt(F.col("at.place") + F.col("beside")).alias("key"), "longer", "word", "n", F.lit(False).alias("indexed"), F.lit(True).alias("asked")).distinct()
    rows = plain.unionByName(kept).unionByName(asked)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, shard, split = None, None, False
        for batch in batches:
            out: list[tuple] = []
            for own_key, word, n, indexed, asked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own_key != key:
                    key = own_key
                    side, m, _, *by = key.split(":")
                    shard, split = Shard(side, int(m), *((by[0], int(by[1])) if by else ())), bool(by)
                own = grams(_half(word, shard.side, shard.m)[1])
                if asked:
                    for other, other_n in shard.near(word, own):
                        if not split or len(word) > shard.m or other < word:  # there, two words of length m meet twice
                            out += [(word, n, other, other_n), (other, other_n, word, n)]
                if indexed:
                    shard.add(word, n, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int64()) * 2, strict=True)], ["word", "n", "other", "other_n"])

    # those that are indexed come first, so that only they are kept
    order = [F.col("key"), F.col("longer"), F.col("asked"), F.col("word")]
    n = sizes.agg(F.sum("size")).first()[0] or 0
    # rows are few bytes each, but take long: their number says how many tasks there are
    dealt_out = rows.repartition(1 + n // DEALT, "key").sortWithinPartitions(*order)
    return dealt_out.select("key", "word", "n", "indexed", "asked").mapInArrow(search, NEAR)


def _root(forms: DataFrame) -> DataFrame:
    """``word, root`` of words that have a form: forms are followed by doubling, in as many rounds as the longest chain has doublings.

    A form is five times as frequent, so chains are short, and only words within few edits share a root.
    """
    up = stored(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(MAX_ROUNDS):
        over = up.select(F.col("word").alias("root"), F.col("root").alias("_root"))
        jumped = up.join(over, "root", "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved"))
        jumped = stored(jumped, "roots", up)
        if jumped.where("moved").isEmpty():
            return jumped.drop("moved")
        up = jumped.drop("moved")
    raise RuntimeError("the chains of forms did not end")


def spelling_variants(docs: DataFrame, least_count: int = LEAST_COUNT, every: int = EVERY, times: int = FORM_TIMES, hot: int = HOT) -> DataFrame:
    """``word, form, root, n, n_near, form_n``, a row for each word of ``word_counts``.

    ``form`` is the most frequent of the words one edit away (the first in code-point order of equally frequent ones) if it is at
    least ``times`` times as frequent, ``root`` the last word when forms are followed. ``docs`` is taken as ``word_counts`` takes it.
    """
    counts = stored(word_counts(docs, least_count, every), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word")))
    near = near_pairs(counts, hot).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    is_form: Column = -F.col("best.n") >= times * F.col("n")
    found = counts.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, -F.col("best.n")).alias("form_n")
    )
    found = stored(found, "forms")
    discard(counts)
    roots = _root(found.where("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: the words of all documents under their most frequent spelling."""
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op13_spelling_variants": query}
ORACLE_SQL = {
    "op13_spelling_variants": """
with recursive bits as (
  select b, b as c, 0 as k from (select unnest(range(0, 256)) as b)
  union all select b, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bits where k < 8),
crc as materialized (select list(c order by b) as t from bits where k = 8),
runs as materialized (
  select doc_id, run, count(*) as times from (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{00C0}-\\x{00FF}]+')) as run from documents)
  where length(run) >= 6 group by all),
hashed as materialized (
  select run, times, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(coalesce(doc_id::varchar, '') || ':' || run) + 1),
    lambda i: (('0x' || substr(hex(encode(coalesce(doc_id::varchar, '') || ':' || run)), 2 * i - 1, 2))::bigint))),
    lambda s, b: xor(s >> 8, crc.t[xor(s & 255, b) + 1]))) as h from runs, crc),
changed as (select case when h % 199 = 0 then left(run, (h % length(run))::integer) || substr(run, (h % length(run))::integer + 2) else run end as word, times from hashed),
counted as materialized (select word, sum(times)::bigint as n from changed where length(word) >= 6 group by word having sum(times) >= 5),
cuts as materialized (select word, n, i, left(word, i - 1) || substr(word, i + 1) as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from counted)),
pairs as (
  select distinct a.word, a.n, b.word as other, b.n as other_n from cuts a join cuts b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select c.word, c.n, w.word, w.n from cuts c join counted w on w.word = c.rest
  union select w.word, w.n, c.word, c.n from cuts c join counted w on w.word = c.rest),
best as (select word, count(*) as n_near, arg_min(other, (-other_n, other)) as other, max(other_n) as other_n from pairs group by word),
formed as materialized (
  select c.word, c.n, coalesce(n_near, 0) as n_near, case when other_n >= 5 * c.n then other end as form, case when other_n >= 5 * c.n then other_n end as form_n
  from counted c left join best on best.word = c.word),
followed as (
  select word, word as root, 0 as k from formed
  union all select r.word, f.form, k + 1 from followed r join formed f on f.word = r.root where f.form is not null)
select f.word, form, r.root, n, n_near, form_n from formed f join (select word, arg_max(root, k) as root from followed group by word) r on r.word = f.word
"""
}
