"""Source divergence audit: how the terms of each source differ from those of its language's other sources.

Terms are counted in byte tries. A task's trie is held in preorder: each leaf is the number of bytes that it shares with the leaf before
(the depth of the node where they part) and its own rest, and has counters for the (lang, source) groups that it
occurs in. UTF-8 order is preorder, so tries cut at the same terms are merged range by range, walking them side by side, and
what is read from a trie comes with ties in order already.

Ranges are cut at terms sampled from the blocks that tasks write, so that they are about equally large; a term that stands in
very many blocks is merged in two steps, and the counters for one range never need more than one task's memory.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .blobs import packed, unpacked
from .scratch import discard, stored

#: Documents of a language that a term must occur in; what is added to each count; the scale of shares; the places reported.
LEAST_DOCS, ADDED, SCALE, PLACES = 30, 5, 1_000_000_000, 50
#: A task hands its trie on when it has so many bytes of terms or counters.
TRIE_BYTES, TRIE_COUNTERS = 32 << 20, 2_000_000
#: Counters of a block, and about how many a range has.
BLOCK_COUNTERS, RANGE_COUNTERS = 50_000, 1_000_000
#: Block starts that are sampled to cut ranges: this bounds what the driver gets. Any cuts are right; they balance the work only.
SAMPLED = 20_000
#: Blocks of a range that are merged at once; more of them merge in two steps.
FAN_IN = 256
#: Cells of a matrix of shares that is in memory at once.
CELLS = 2_000_000
#: Groups that a task numbers in one trie.
GROUP_BITS = 24
GROUPS = pa.list_(pa.struct([("lang", pa.string()), ("source", pa.string())]))
BLOCKS = "first binary, n_counters long, groups array<struct<lang string, source string>>, body binary"
PIECES = "range int, n_counters long, groups array<struct<lang string, source string>>, body binary"
KEPT = "lang string, n_terms long, sources array<string>, sums array<long>, body binary"
FOUND = "lang string, source string, item string, value long, part string"

_TERM = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])

Group = tuple[str, str]


class Trie:
    """Terms in preorder, and for each the groups that it occurs in with its occurrences and documents there."""

    def __init__(self, terms: list[bytes], at: np.ndarray, group: np.ndarray, count: np.ndarray, docs: np.ndarray, names: list[Group]):
        self.terms, self.at, self.group, self.count, self.docs, self.names = terms, at, group, count, docs, names

    @classmethod
    def of(cls, terms: list[bytes], term: np.ndarray, group: np.ndarray, count: np.ndarray, docs: np.ndarray, names: list[Group]) -> Trie:
        """From counters ``(term, group)``, in any order and repeated; terms may come in any order, and more than once."""
        order = sorted(range(len(terms)), key=terms.__getitem__)  # runs that are sorted are merged, not sorted anew
        terms = [terms[k] for k in order]
        new = np.ones(len(terms), bool)
        new[1:] = [a != b for a, b in pairwise(terms)]
        place = np.empty(len(terms), np.int64)
        place[order] = np.cumsum(new) - 1
        key, own = np.unique(place[term] << GROUP_BITS | group, return_inverse=True)
        terms = [t for t, first in zip(terms, new.tolist()) if first]
        total = lambda x: _sums(own, x, len(key))
        return cls(terms, np.searchsorted(key >> GROUP_BITS, np.arange(len(terms) + 1)), key & ((1 << GROUP_BITS) - 1), total(count), total(docs), names)

    @classmethod
    def merged(cls, tries: Iterable[Trie]) -> Trie:
        """All counters of all tries; a walk over the terms of all of them in order."""
        names: dict[Group, int] = {}
        parts, terms = [], []
        for t in tries:
            number = np.array([names.setdefault(n, len(names)) for n in t.names], np.int64)
            parts.append((np.repeat(np.arange(len(t.terms)) + len(terms), np.diff(t.at)), number[t.group], t.count, t.docs))
            terms += t.terms
        return cls.of(terms, *(np.concatenate(x) for x in zip(*parts)), list(names))

    def cut(self, a: int, b: int) -> Trie:
        """The terms from the a-th to before the b-th."""
        x, y = self.at[a], self.at[b]
        return Trie(self.terms[a:b], self.at[a : b + 1] - x, self.group[x:y], self.count[x:y], self.docs[x:y], self.names)

    def body(self) -> tuple[list[dict], bytes]:
        """The groups that occur, and the trie in bytes."""
        used, group = np.unique(self.group, return_inverse=True)
        names = [dict(zip(("lang", "source"), self.names[k])) for k in used.tolist()]
        return names, packed(*front_coded(self.terms), np.diff(self.at), group.astype(np.int64), self.count, self.docs)

    @classmethod
    def read(cls, names: list[dict], body: bytes) -> Trie:
        shared, size, rest, n, group, count, docs = unpacked(body)
        return cls(whole_terms(shared, size, rest), np.concatenate([[0], np.cumsum(n)]), group, count, docs, [(x["lang"], x["source"]) for x in names])


def _sums(own: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, own, values)
    return out


def front_coded(terms: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes shared with the term before, bytes of the rest, and all rests, of terms in order."""
    size = np.fromiter(map(len, terms), np.int64, len(terms))
    raw = np.frombuffer(b"".join(terms) or b"\0", np.uint8)
    start = np.cumsum(size) - size
    shared = np.zeros(len(terms), np.int64)
    live = np.arange(1, len(terms))
    while len(live):
        k = shared[live]
        live, k = (x[(k < size[live]) & (k < size[live - 1])] for x in (live, k))
        live = live[raw[start[live] + k] == raw[start[live - 1] + k]]
        shared[live] += 1
    rest = size - shared
    before = np.cumsum(rest) - rest
    return shared, rest, raw[np.repeat(start + shared - before, rest) + np.arange(rest.sum())]


def whole_terms(shared: np.ndarray, size: np.ndarray, rest: np.ndarray) -> list[bytes]:
    data, at, term, out = rest.astype(np.uint8).tobytes(), 0, b"", []
    for k, n in zip(shared.tolist(), size.tolist()):
        term = term[:k] + data[at : at + n]
        at += n
        out.append(term)
    return out


class Counter:
    """The trie of a task's texts, as it grows."""

    def __init__(self):
        self.slots: dict[bytes, int] = {}
        self.names: dict[Group, int] = {}
        self.bytes, self.waiting, self.n_waiting = 0, [], 0

    def add(self, groups: list[Group], raw: np.ndarray, off: np.ndarray) -> None:
        """Counts the terms of texts, each of a group."""
        low = W.LOWER[raw]
        start, end, at = W.spans(_TERM[raw], off)
        if not len(start):
            return
        group = np.array([self.names.setdefault(g, len(self.names)) for g in groups], np.int64)
        _, first, term = np.unique(W.span_hashes(low, start, end), return_index=True, return_inverse=True)
        n, doc = len(groups), np.repeat(np.arange(len(groups)), np.diff(at))
        pair, count = np.unique(term * n + doc, return_counts=True)
        whole, slots, known = low.tobytes(), self.slots, len(self.slots)
        found = [whole[a:b] for a, b in zip(start[first].tolist(), end[first].tolist())]
        slot = np.fromiter((slots.setdefault(t, len(slots)) for t in found), np.int64, len(found))
        self.bytes += sum(len(t) for t, k in zip(found, slot.tolist()) if k >= known)
        self._keep(slot[pair // n] << GROUP_BITS | group[pair % n], count, np.ones(len(pair), np.int64))
        if self.n_waiting > 2 * TRIE_COUNTERS:
            rows = [np.concatenate(x) for x in zip(*self.waiting)]
            self.waiting, self.n_waiting = [], 0
            self._keep(*rows)

    def _keep(self, key: np.ndarray, count: np.ndarray, docs: np.ndarray) -> None:
        key, own = np.unique(key, return_inverse=True)
        self.waiting.append((key, _sums(own, count, len(key)), _sums(own, docs, len(key))))
        self.n_waiting += len(key)

    def full(self) -> bool:
        return self.bytes > TRIE_BYTES or self.n_waiting > TRIE_COUNTERS

    def trie(self) -> Trie:
        key, count, docs = (np.concatenate(x) for x in zip(*self.waiting))
        return Trie.of(list(self.slots), key >> GROUP_BITS, key & ((1 << GROUP_BITS) - 1), count, docs, list(self.names))


def blocks_of(trie: Trie) -> pa.RecordBatch:
    """The trie in blocks of consecutive terms with about equally many counters."""
    cuts = np.unique(np.searchsorted(trie.at, np.arange(0, trie.at[-1], BLOCK_COUNTERS)))
    edges = [0, *cuts[(cuts > 0) & (cuts < len(trie.terms))].tolist(), len(trie.terms)]
    parts = [trie.cut(a, b) for a, b in pairwise(edges)]
    names, bodies = zip(*(p.body() for p in parts))
    return pa.RecordBatch.from_arrays(
        [pa.array([p.terms[0] for p in parts], pa.binary()), pa.array([len(p.group) for p in parts], pa.int64()), pa.array(names, GROUPS), pa.array(bodies, pa.binary())], ["first", "n_counters", "groups", "body"]
    )


def term_blocks(docs: DataFrame) -> DataFrame:
    """The blocks of the tries of all tasks over ``lang, source, text``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Counter()
        for batch in batches:
            for part, raw, off in W.chunks(batch):
                found.add(list(zip(part.column(0).to_pylist(), part.column(1).to_pylist())), raw, off)
                if found.full():
                    yield blocks_of(found.trie())
                    found = Counter()
        if found.waiting:
            yield blocks_of(found.trie())

    return docs.select("lang", "source", "text").mapInArrow(count, BLOCKS)


def _piece(number: int, trie: Trie) -> pa.RecordBatch:
    names, body = trie.body()
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([len(trie.group)], pa.int64()), pa.array([names], GROUPS), pa.array([body], pa.binary())], ["range", "n_counters", "groups", "body"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Trie]]:
    """The trie of each run of rows of one range; waiting tries are merged when they are many, so that they don't add up."""
    number, waiting, held = None, [], 0
    for batch in batches:
        for own, names, body in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("range", "groups", "body")), strict=True):
            if own != number and waiting:
                yield number, Trie.merged(waiting)
                waiting, held = [], 0
            number = own
            waiting.append(Trie.read(names, body))
            held += len(waiting[-1].group)
            if held > 2 * RANGE_COUNTERS and len(waiting) > 1:
                waiting = [Trie.merged(waiting)]
                held = len(waiting[0].group) // 2  # it is merged again when half as much has come
    if waiting:
        yield number, Trie.merged(waiting)


def pieces_by_range(blocks: DataFrame, cuts: list[bytes]) -> DataFrame:
    """Blocks cut where ranges begin, each piece with its range's number."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_left, bisect_right

        for batch in batches:
            for names, body in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("groups", "body"))):
                trie = Trie.read(names, body)
                lo, hi = bisect_right(cuts, trie.terms[0]), bisect_right(cuts, trie.terms[-1])
                edges = [0, *(bisect_left(trie.terms, c) for c in cuts[lo:hi]), len(trie.terms)]
                for k, (a, b) in enumerate(pairwise(edges)):
                    if a < b:
                        yield _piece(lo + k, trie.cut(a, b))

    return blocks.mapInArrow(cut, PIECES)


def kept_terms(blocks: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """The terms that each lang keeps, a row for each lang and range: ``sources`` in which they occur, ``sums`` of their occurrences there."""
    size = blocks.agg(F.count("*"), F.sum("n_counters")).first()
    ranges = 1 + int(size[1] or 0) // RANGE_COUNTERS
    sample = [bytes(r[0]) for r in blocks.select("first").orderBy(F.xxhash64("first", "n_counters")).limit(SAMPLED).collect()] if ranges > 1 else []
    sample.sort()
    cuts = sorted({sample[len(sample) * k // ranges] for k in range(1, ranges)} if sample else set())
    pieces = pieces_by_range(blocks, cuts)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from (_piece(*x) for x in _runs(batches))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, trie in _runs(batches):
            rows = list(_kept(trie, least_docs))
            if rows:
                kinds = (pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["lang", "n_terms", "sources", "sums", "body"])

    # with very many blocks, those of a range are merged in groups first
    many = int(size[0] or 0) // (ranges * FAN_IN)
    if many:
        salted = pieces.withColumn("salt", F.pmod(F.xxhash64("body"), F.lit(many + 1)))
        pieces = salted.repartition("range", "salt").sortWithinPartitions("range", "salt").drop("salt").mapInArrow(merge, PIECES)
    return pieces.repartition("range").sortWithinPartitions("range").mapInArrow(keep, KEPT)


def _kept(trie: Trie, least_docs: int) -> Iterator[tuple]:
    """For each lang, its terms that occur in enough documents: their number, sources, sums and the trie in bytes."""
    term = np.repeat(np.arange(len(trie.terms)), np.diff(trie.at))
    langs = {lang: k for k, lang in enumerate(dict.fromkeys(n[0] for n in trie.names))}
    lang = np.array([langs[n[0]] for n in trie.names], np.int64)[trie.group]
    for name, k in langs.items():
        mine = lang == k
        docs = _sums(term[mine], trie.docs[mine], len(trie.terms))
        mine &= docs[term] >= least_docs
        if mine.any():
            own, place = np.unique(term[mine], return_inverse=True)
            used, source = np.unique(trie.group[mine], return_inverse=True)
            count = trie.count[mine]
            body = packed(*front_coded([trie.terms[t] for t in own.tolist()]), place.astype(np.int64), source.astype(np.int64), count)
            yield name, len(own), [trie.names[g][1] for g in used.tolist()], _sums(source, count, len(used)).tolist(), body


def shares(count: np.ndarray, total: np.ndarray, n_terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + ADDED) / (total + ADDED * n_terms)), exact in 64 bits: the quotient is taken in two steps."""
    a, b = count + ADDED, total + ADDED * n_terms
    step = 31_250  # SCALE is 31250 * 32000
    q, r = np.divmod(a * step, b)
    return 1 + q * (SCALE // step) + r * (SCALE // step) // b


class Audit:
    """What a task has seen: sums of differences of each pair of sources, and the best terms of each source."""

    def __init__(self, places: int):
        self.places = places
        self.pairs: dict[str, tuple[list[str], np.ndarray]] = {}
        self.best: dict[Group, list[tuple[int, bytes]]] = {}

    def add(self, lang: str, n_terms: int, own: list[str], body: bytes, sources: list[str], totals: list[int]) -> None:
        shared, size, rest, place, source, count = unpacked(body)
        terms = whole_terms(shared, size, rest)
        column = {s: k for k, s in enumerate(sources)}
        source = np.array([column[s] for s in own], np.int64)[source]
        total = np.array(totals, np.int64)
        sums = self.pairs.setdefault(lang, (sources, np.zeros((len(sources), len(sources)), np.int64)))[1]
        step = max(1, CELLS // len(sources))
        for a in range(0, len(terms), step):
            b = min(a + step, len(terms))
            x, y = np.searchsorted(place, (a, b))
            counts = np.zeros((b - a, len(sources)), np.int64)
            counts[place[x:y] - a, source[x:y]] = count[x:y]
            p = shares(counts, total, n_terms)
            q = shares(counts.sum(1), total.sum(), n_terms)
            for k in range(len(sources) - 1):
                sums[k, k + 1 :] += np.abs(p[:, k + 1 :] - p[:, k : k + 1]).sum(0)
            over = np.where(counts > 0, p - q[:, None], 0)
            for k, name in enumerate(sources):
                found = np.flatnonzero(over[:, k] > 0)
                # the walk is in order, so a stable sort leaves ties in order
                found = found[np.argsort(-over[found, k], kind="stable")[: self.places]]
                mine = self.best.setdefault((lang, name), [])
                mine += [(-int(over[t, k]), terms[a + t]) for t in found.tolist()]
                mine.sort()
                del mine[self.places :]

    def rows(self) -> pa.RecordBatch:
        out: list[tuple] = []
        for lang, (sources, sums) in self.pairs.items():
            for i, j in zip(*np.triu_indices(len(sources), 1)):
                value = int(sums[i, j])
                out += [(lang, sources[i], sources[j], value, "pair"), (lang, sources[j], sources[i], value, "pair")]
        out += [(lang, source, term.decode(), -f, "term") for (lang, source), best in self.best.items() for f, term in best]
        columns = list(zip(*out)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(),) * 3 + (pa.int64(), pa.string()))], ["lang", "source", "item", "value", "part"])


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, places: int = PLACES) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source is from the others of its lang, and the terms that it has more of.

    ``docs`` needs text, lang and source; other columns are ignored. Nulls count as empty text, which is a lang or source like others;
    repeated rows count each; an empty table gives no rows. A lang without kept terms has its pairs with value 0; a lang with one
    source has no pairs. Part ``pair`` grows with the square of a lang's sources, as the result does.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = docs.select(text("lang"), text("source"), text("text"))
    blocks = stored(term_blocks(docs), "trie-blocks")
    kept = stored(kept_terms(blocks, least_docs), "kept-terms", blocks)
    sums = kept.select("lang", F.explode(F.arrays_zip("sources", "sums")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.sums").alias("total"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left")
    terms = kept.groupBy("lang").agg(F.sum("n_terms").alias("v"))
    each = F.array_sort(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0)).alias("total"))))
    # a row for each lang, as wide as its sources: one row of a pair table is as wide as that
    langs = stored(groups.groupBy("lang").agg(each.alias("all")).join(terms, "lang", "left"), "langs")
    known = kept.join(langs, "lang").select("lang", "v", F.col("sources").alias("own"), "body", F.col("all.source").alias("sources"), F.col("all.total").alias("totals"))

    def audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Audit(places)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found.add(*row)
        yield found.rows()

    rows = known.mapInArrow(audit, FOUND)
    pairs = rows.where("part = 'pair'").groupBy("lang", "source", "item", "part").agg(F.sum("value").alias("value"))
    ends = langs.where("v is null").select("lang", F.explode("all.source").alias("source"), F.col("all.source").alias("others"))
    none = ends.select("lang", "source", F.explode("others").alias("item"), F.lit("pair").alias("part"), F.lit(0).cast("long").alias("value")).where("item != source")
    everything = pairs.unionByName(none).unionByName(rows.where("part = 'term'"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = everything.withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= places))
    return ranked.select("lang", "source", "part", "item", "value", "rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: the divergence of all sources of all documents."""
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op12_source_divergence": query}
ORACLE_SQL = {
    "op12_source_divergence": """
with docs as materialized (select row_number() over () as d, coalesce(lang, '') as lang, coalesce(source, '') as source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
terms as materialized (select d, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from docs),
kept as materialized (select lang, term from terms group by all having count(distinct d) >= 30),
sizes as (select lang, count(*) as v from kept group by lang),
counts as materialized (select t.lang, t.source, t.term, count(*) as c from terms t join kept k on k.lang = t.lang and k.term = t.term group by all),
groups as materialized (select g.lang, g.source, coalesce(n, 0) as n, coalesce(v, 0) as v from (select distinct lang, source from docs) g
  left join (select lang, source, sum(c) as n from counts group by all) s on s.lang = g.lang and s.source = g.source left join sizes z on z.lang = g.lang),
p as materialized (select g.lang, g.source, k.term, coalesce(c, 0) as c, cast(1 + 1000000000::hugeint * (coalesce(c, 0) + 5) // (g.n + 5 * g.v) as bigint) as p
  from groups g join kept k on k.lang = g.lang left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term),
q as materialized (select k.lang, k.term, cast(1 + 1000000000::hugeint * (k.c + 5) // (n.n + 5 * n.v) as bigint) as q
  from (select lang, term, sum(c) as c from counts group by all) k join (select lang, sum(n) as n, any_value(v) as v from groups group by lang) n on n.lang = k.lang),
pairs as (select a.lang, a.source, b.source as item, coalesce(f, 0) as value from groups a join groups b on b.lang = a.lang and b.source <> a.source
  left join (select x.lang, x.source, y.source as other, sum(abs(x.p - y.p)) as f from p x join p y on y.lang = x.lang and y.term = x.term and y.source <> x.source group by all) s
  on s.lang = a.lang and s.source = a.source and s.other = b.source),
found as (select lang, source, 'pair' as part, item, cast(value as bigint) as value from pairs
  union all select p.lang, source, 'term', p.term, p.p - q.q from p join q on q.lang = p.lang and q.term = p.term where c > 0 and p.p > q.q)
select * from (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank from found) where part = 'pair' or rank <= 50
"""
}
