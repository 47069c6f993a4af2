"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct n-word shingles. A parity sketch has ``m`` segments of bits;
every shingle flips one bit, so the Hamming distance of two sketches is at most the size of the sets'
symmetric difference, which a Jaccard similarity bounds by ``D``. With more than ``D`` segments, two
similar sets agree in a whole segment (pigeonhole). Sets are sketched per band of sizes, those near a
band's end in the next one too. Of the m segments, a set gives out the D + 1 that come last by weight
(shingles in it) and content; as that order depends on content alone, similar sets still share one.

Equal segments make candidates; in each group they pair with one member only, and groups whose
members are not yet linked are taken up again. Large ones are split first: by the shingles of their
members that are rarest among them, as many of each as similar sets must share one of, and by how
many a member has alone. So a passage that is common to many texts makes no pairs of them. Candidates pass a Hamming test on narrower sketches,
then their exact sets of shingles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .components import bucket_components, rare_members
from .scratch import stored

SETS = "doc_id long, row long, n_shingles long, set_id long, segments array<long>, sketch array<long>"
#: Steps of the similarity that a band of sizes spans.
SPAN = 3
SPARE = 1.3
#: Bits of the filter that tells which rows' sets are wanted. It has this size for any input; rows that it lets through needlessly cost time only.
FILTER_BITS = 1 << 24
LATE = (1 << 63) - 1


class Bands:
    """Bands of set sizes for a similarity of ``num`` / ``den``, and what holds for each."""

    def __init__(self, num: int, den: int, most: int):
        self.num, self.den = num, den
        low = [1]
        while low[-1] <= most:
            low.append(max(low[-1] + 1, int(low[-1] * (den / num) ** SPAN)))
        self.low = np.array(low)
        self.differ = 2 * (self.low[1:] - 1) * (den - num) // (den + num)
        self.segments = np.maximum(self.differ + 1, (SPARE * (self.differ + 1)).astype(np.int64))

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, sizes, "right") - 1

    def in_next(self, sizes: np.ndarray) -> np.ndarray:
        """Whether a larger similar set may stand in the next band."""
        return sizes * self.den >= self.low[self.of(sizes) + 1] * self.num


def narrow_bits(size: int, num: int, den: int) -> int:
    """Bits of the sketch for the Hamming test: a power of two, eight times the difference at least."""
    return 1 << max(6, int(16 * size * (den - num) // (den + num)).bit_length())


def segment_keys(h: np.ndarray, off: np.ndarray, bands: Bands, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the segments that each set gives out in its ``band`` (-1: none), and n+1 offsets."""
    count = np.where(band >= 0, np.diff(off), 0)
    m = np.where(count > 0, bands.segments[band], 0)
    base = np.concatenate([[0], np.cumsum(m)])
    doc = np.repeat(np.arange(len(count)), count)
    h = h[np.repeat(off[:-1] - np.concatenate([[0], np.cumsum(count)])[:-1], count) + np.arange(len(doc))]
    place = base[doc] + (h >> np.uint64(32)).astype(np.int64) % np.maximum(m[doc], 1)
    order = np.argsort(place, kind="stable")
    place, bits = place[order], W.scramble(h[order] & np.uint64(0xFFFFFF))
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, np.int64)
    content, weight = np.zeros(base[-1], np.uint64), np.zeros(base[-1], np.int64)
    if len(first):
        content[place[first]] = np.bitwise_xor.reduceat(bits, first)  # a bit that is set, as a hash; an even number of flips leaves nothing
        weight[place[first]] = np.diff(np.append(first, len(place)))
    own = np.repeat(np.arange(len(count)), m)
    order = np.lexsort((content, -weight, own))
    rank = np.arange(len(own)) - base[own]
    take = order[rank <= bands.differ[band[own]]]
    own, where = own[take], take - base[own[take]]
    salt = (band[own].astype(np.uint64) << np.uint64(32)) + where.astype(np.uint64)
    return W.scramble(content[take] ^ W.scramble(salt)), np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(count)))])


def set_hashes(raw: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingle hashes of every text in ascending order, n+1 offsets of them, and an id of each set."""
    hashes, _, _, at = W.word_hashes(raw, off)
    h, so = W.doc_sets(*W.shingle_hashes(hashes, at, n))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.scramble(h + np.uint64(n)))])
    return h, so, W.scramble(sums[so[1:]] - sums[so[:-1]] + np.diff(so).astype(np.uint64)).view(np.int64)


def sketches(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """``doc_id, row, n_shingles, set_id, segments, sketch`` of every document (doc_id, row, text), set_id null for an empty set."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den, 1)
        for batch in batches:
            for part, raw, off in W.chunks(batch):
                h, so, ids = set_hashes(raw, off, n)
                size = np.diff(so)
                if len(size) and size.max() >= bands.low[-2]:
                    bands = Bands(num, den, int(size.max()) * 2)
                band = np.where(size > 0, bands.of(size), -1)
                more = np.where((size > 0) & bands.in_next(np.maximum(size, 1)), band + 1, -1)
                # sets that may not differ at all are equal to those that they are similar to
                band, more = (np.where((x >= 0) & (bands.differ[x] > 0), x, -1) for x in (band, more))
                keys, ko = segment_keys(h, so, bands, band)
                more, mo = segment_keys(h, so, bands, more)
                own = np.concatenate([np.repeat(np.arange(len(size)), np.diff(ko)), np.repeat(np.arange(len(size)), np.diff(mo))])
                order = np.argsort(own, kind="stable")
                keys = np.concatenate([keys, more])[order].view(np.int64)
                offsets = np.concatenate([[0], np.cumsum(np.diff(ko) + np.diff(mo))])
                narrow = [np.zeros(0, np.int64)]
                for k in range(len(size)):
                    bits = narrow_bits(int(size[k]), num, den)
                    odd = (np.bincount((h[so[k] : so[k + 1]] % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(bool)
                    narrow.append(np.packbits(odd).view(np.int64) if size[k] else narrow[0])
                words = pa.ListArray.from_arrays(pa.array(np.cumsum([len(x) for x in narrow]), pa.int32()), pa.array(np.concatenate(narrow)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(size), pa.array(ids, mask=size == 0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys)), words],
                    ["doc_id", "row", "n_shingles", "set_id", "segments", "sketch"],
                )

    return docs.mapInArrow(sketch, SETS)


def close_traits(num: int, den: int) -> Callable[[Column, Column], Column]:
    """Whether sizes ``n`` and sketches ``w`` of two sets allow the similarity: a bit that differs takes a shingle that only one has.

    Sketches are residues modulo their bits, a power of two: the longer one is folded to half by XOR. Sizes that allow the
    similarity have sketches of one length, or one of twice the other's.
    """

    def test(x: Column, y: Column) -> Column:
        low, high = F.least(x["n"], y["n"]), F.greatest(x["n"], y["n"])
        m = F.least(F.size(x["w"]), F.size(y["w"]))
        folded = lambda t, i: F.when(F.size(t["w"]) > m, F.get(t["w"], i).bitwiseXOR(F.get(t["w"], i + m))).otherwise(F.get(t["w"], i))
        apart = F.aggregate(F.sequence(F.lit(0), m - 1), F.lit(0), lambda s, i: s + F.bit_count(folded(x, i).bitwiseXOR(folded(y, i))))
        return (low * den >= high * num) & (apart * (den + num) <= (x["n"] + y["n"]) * (den - num))

    return test


def exact_links(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Of rows ``a, b, h_a, h_b`` with sorted hash lists, the pairs that are similar."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            x, y = batch.column(2), batch.column(3)
            for k in range(batch.num_rows):
                u, v = x[k].values.to_numpy(), y[k].values.to_numpy()
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(both * den >= (len(u) + len(v) - both) * num)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    return pairs.mapInArrow(test, "a long, b long")


def row_filter(rows: DataFrame) -> np.ndarray:
    """FILTER_BITS bits, in which those of all values of ``row`` are set."""
    at = F.pmod("row", F.lit(FILTER_BITS))
    bits = rows.select(F.shiftright(at, 5).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 32).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    got = bits.toArrow()  # at most FILTER_BITS / 32 rows
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    out[got["word"].to_numpy()] = got["bits"].to_numpy().astype(np.uint32)
    return out


def shingle_sets(docs: DataFrame, wanted: np.ndarray, n: int) -> DataFrame:
    """``set_id, hashes`` of all documents (row, text) whose row the filter ``wanted`` holds, and few others."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)  # FILTER_BITS bits

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy() % FILTER_BITS
            batch = batch.filter(pa.array((sent.value[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool)))
            for _, raw, off in W.chunks(batch):
                h, so, ids = set_hashes(raw, off, n)
                lists = pa.ListArray.from_arrays(pa.array(so, pa.int32()), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(ids), lists], ["set_id", "hashes"]).filter(pa.array(np.diff(so) > 0))

    return docs.mapInArrow(sets, "set_id long, hashes array<long>")


def _components(docs: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Rows ``doc_id, row, n_shingles, set_id``, and ``set_id, row, doc_id`` of the first document of each set's component.

    Only sets that stand for others or are another's have a row in the latter, if any has.
    """
    docs = docs.select(F.col("doc_id").cast("long"), row_key(docs).alias("row"), F.col("text").cast("string"))
    rows = stored(sketches(docs, n, num, den), "sketches")
    order = F.struct(F.coalesce("doc_id", F.lit(LATE)), "row")
    classes = rows.where("set_id is not null").groupBy("set_id").agg(F.min_by(F.struct("doc_id", "row", "n_shingles", "sketch", "segments"), order).alias("x"))
    classes = stored(classes.select("set_id", "x.*"), "classes")
    rows = stored(rows.select("doc_id", "row", "n_shingles", "set_id"), "rows", rows)
    spread = classes.select(F.col("set_id").alias("id"), F.explode(F.array_distinct("segments")).alias("key"))

    def traits_of(ids: DataFrame) -> DataFrame:
        own = classes.select(F.col("set_id").alias("id"), F.struct(F.col("n_shingles").alias("n"), F.col("sketch").alias("w")).alias("trait"))
        return stored(own.join(ids, "id", "left_semi"), "traits")

    def linked(near: DataFrame) -> DataFrame:
        sets = sets_of(near.select(F.col("a").alias("set_id")).unionByName(near.select(F.col("b").alias("set_id"))).distinct())
        h_a, h_b = (sets.select(F.col("set_id").alias(x), F.col("hashes").alias(f"h_{x}")) for x in "ab")
        return stored(exact_links(near.join(h_b, "b").join(h_a, "a").select("a", "b", "h_a", "h_b"), num, den), "links", sets)

    def sets_of(wanted: DataFrame) -> DataFrame:
        found = shingle_sets(docs.select("row", "text"), row_filter(classes.join(wanted, "set_id")), n)
        return stored(found.join(wanted, "set_id", "left_semi").dropDuplicates(["set_id"]), "sets")

    def refine(members: DataFrame) -> DataFrame:
        sets = sets_of(members.select(F.col("id").alias("set_id")).distinct())
        return rare_members(sets.select(F.col("set_id").alias("id"), F.col("hashes").alias("set")), num, den)

    found = bucket_components(spread, linked, refine, traits_of, close_traits(num, den))
    own = classes.select("set_id", "doc_id", "row")
    if found is not None:
        own = own.join(found.withColumnRenamed("id", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
        first = stored(own.groupBy("component").agg(F.min_by(F.struct("doc_id", "row"), order).alias("first")), "firsts")
        own = own.select("set_id", "component").join(first, "component").select("set_id", "first.*")
    return rows, stored(own, "firsts", classes, *([first, found] if found is not None else []))


def row_key(docs: DataFrame) -> Column:
    """A hash of a row's doc_id and text; rows that repeat both share it."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def similar_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id``, a row for each row of ``docs``.

    Documents link when ``den * |A & B| >= num * |A | B|``; component_id is the smallest doc_id
    reachable. ``docs`` needs doc_id and text; other columns are ignored. Null texts and texts without
    words have no shingles and link with nothing; texts of fewer than n words are one shingle. Rows
    that repeat a doc_id are documents of their own with that id; a null id is never the smallest,
    and component_id is null where all of a component's ids are. An empty table gives no rows.
    """
    rows, own = _components(docs, n, num, den)
    out = rows.join(own.select("set_id", F.col("doc_id").alias("component_id")), "set_id", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id, a null id coming last.

    It is decided row by row: other rows of an id stay or go by their own texts, and of rows that
    repeat both id and text one stays. Documents without words link with nothing, and all stay.
    """
    every, own = _components(docs, n, num, den)
    rows = every.where("set_id is not null")
    gone = rows.join(own.select("set_id", F.col("row").alias("first")), "set_id").where("row != first").select("row").distinct()
    left = docs.select(F.struct("*").alias("doc"), row_key(docs).alias("row")).join(stored(gone, "gone", own), "row", "left_anti")
    again = stored(rows.groupBy("row").count().where("count > 1").select("row"), "again", every)
    if again.isEmpty():
        return left.select("doc.*")
    return left.join(again, "row", "left_anti").unionByName(left.join(again, "row", "left_semi").dropDuplicates(["row"])).select("doc.*")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: components of all documents by 3-word shingles at a similarity of 0.9."""
    return similar_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 90, 100)


QUERIES = {"op2_ngram_jaccard_join": query}
ORACLE_SQL = {
    "op2_ngram_jaccard_join": r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as t
  from documents
), s as (
  select doc_id, case when len(t) = 0 then [] when len(t) < 3 then [array_to_string(t, ' ')]
    else list_distinct(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) end as g
  from w
), e as (select doc_id, unnest(g) as g from s),
p as (
  select a.doc_id as a, b.doc_id as b, count(*) as shared from e a join e b on a.g = b.g and a.doc_id <> b.doc_id group by all
), l as (
  select a, b from p join s x on x.doc_id = a join s y on y.doc_id = b where 100 * shared >= 90 * (len(x.g) + len(y.g) - shared)
), r as (
  select doc_id as a, doc_id as b from s union select r.a, l.b from r join l on r.b = l.a
)
select s.doc_id, cast(len(any_value(s.g)) as bigint) as n_shingles, min(r.b) as component_id from s join r on s.doc_id = r.a group by s.doc_id
"""
}
