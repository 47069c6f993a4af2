"""Katz backoff n-gram scoring with Good-Turing discounts.

``P(w | h) = (c(h, w) - loss(c)) / c(h)`` for n-grams seen in training, else ``a(h) * P(w | h')``, where
h' is h without its first word and a(h) makes the sum over all words exactly one; a word that does not
follow a seen h has ``P(w | h')`` itself. A context reaches back to the start of the text and no further.
``P(w) = (c + 0.5) / (N + 0.5 * (V + 1))`` is normalised over the V words and one unknown word.

Texts are dealt into blocks of some millions of tokens. A block asks for each distinct word once,
and then, order by order, for each distinct n-gram once, with its own training counts: the questions,
hashed into buckets of bounded size, are summed where they meet and answered to every block. N-grams go
by their context, so that a bucket has all of its followers, unless it is so frequent that it would fill
a bucket alone: then by the word too, and its sums are added up after.
Arrays travel as Zstandard-compressed columns, as they are as large as the distinct n-grams.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .blobs import packed, unpacked
from .scratch import stored

ORDER = 3
BLOCK_TOKENS = 2_000_000
BUCKET_KEYS = 2_000_000
#: Counts up to this one have a Good-Turing discount; higher ones lose as much as this one does.
RELIABLE = 5
CLASSES = RELIABLE + 1
START, END, FIRST_ID = 0, 1, 2
BLOCKS = "block long, doc_id binary, held_out binary, size binary, local binary, words binary, counts binary, n_words long, n_tokens long"
ASKED = "block long, doc_id binary, held_out binary, size binary, local binary, buckets binary"
QUESTIONS = "bucket long, block long, body binary"
WORD_ANSWERS = "kind string, bucket long, block long, body binary, n long, v long"
GRAM_ANSWERS = "kind string, bucket long, block long, body binary, rest binary, seen array<long>"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _batch(schema: str, *columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.large_binary(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == "binary" else kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def blocks(docs: DataFrame) -> DataFrame:
    """Rows of some millions of tokens: word numbers within the block, the block's words and their training counts."""

    def emit(number: int, ids, held, hashes, sizes) -> pa.RecordBatch:
        size, all_held = np.concatenate(sizes), np.concatenate(held)
        words, local = np.unique(np.concatenate(hashes), return_inverse=True)
        counts = np.bincount(local[~np.repeat(all_held, size)], minlength=len(words))
        doc = np.concatenate([np.array([-1 if i is None else i for i in x], np.int64) for x in ids])
        null = np.concatenate([np.array([i is None for i in x], np.int8) for x in ids])
        return _batch(BLOCKS, [number], [packed(doc, null)], [packed(all_held.astype(np.int8))], [packed(size)], [packed(local)], [packed(words)], [packed(counts)], [len(words)], [len(local)])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        ids, held, hashes, sizes, n = [], [], [], [], 0
        for batch in batches:
            for part, raw, off in W.chunks(batch):
                h, _, _, at = W.word_hashes(raw, off)
                ids.append(part.column(0).to_pylist())
                held.append(np.array(part.column(2).to_pylist(), bool))
                hashes.append(h)
                sizes.append(np.diff(at))
                n += len(h)
                if n >= BLOCK_TOKENS:
                    yield emit(number, ids, held, hashes, sizes)
                    number, ids, held, hashes, sizes, n = number + 1, [], [], [], [], 0
        if ids:
            yield emit(number, ids, held, hashes, sizes)

    return docs.mapInArrow(deal, BLOCKS)


def ask_words(table: DataFrame, buckets: int) -> DataFrame:
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                (w,), (c,) = unpacked(words), unpacked(counts)
                bucket = (w % np.uint64(buckets)).astype(np.int64)
                own = [(b, packed(w[bucket == b], c[bucket == b])) for b in range(buckets)] if buckets < 64 else _split(bucket, w, c)
                yield _batch(QUESTIONS, [b for b, _ in own], [block] * len(own), [x for _, x in own])

    return table.select("block", "words", "counts").mapInArrow(ask, QUESTIONS)


def asked(table: DataFrame, buckets: int) -> DataFrame:
    """Blocks whose words are asked for: of each word its bucket alone stays, as hashes are by far the most of a block's bytes."""

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = [packed((unpacked(w)[0] % np.uint64(buckets)).astype(np.int64)) for w in batch.column(5).to_pylist()]
            yield _batch(ASKED, *batch.columns[:5], of)

    return table.select("block", "doc_id", "held_out", "size", "local", "words").mapInArrow(strip, ASKED)


def _split(bucket: np.ndarray, *arrays: np.ndarray) -> list[tuple[int, bytes]]:
    """(bucket, its packed arrays) in the arrays' own order."""
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0, [True]])) if len(order) else []
    return [(int(bucket[order[a]]), packed(*(x[order[a:b]] for x in arrays))) for a, b in zip(edges[:-1], edges[1:])]


def answer_words(questions: DataFrame, buckets: int) -> DataFrame:
    """Sums of each bucket's words (kind model) and, for each block, the words' ids and counts in the order asked."""

    def answer(group: pa.Table) -> pa.Table:
        asked = [(b, *unpacked(x)) for b, x in sorted(zip(group["block"].to_pylist(), group["body"].to_pylist()))]
        bucket = group["bucket"][0].as_py()
        words, where = np.unique(np.concatenate([w for _, w, _ in asked]), return_inverse=True)
        total = np.bincount(where, np.concatenate([c for _, _, c in asked]).astype(np.float64), len(words)).astype(np.int64)
        ids = FIRST_ID + bucket + buckets * np.arange(len(words))
        rows, at = [("model", bucket, -1, None, int(total.sum()), int((total > 0).sum()))], 0
        for block, w, _ in asked:
            mine = where[at : at + len(w)]
            rows.append(("answer", bucket, block, packed(ids[mine], total[mine]), None, None))
            at += len(w)
        return pa.Table.from_batches([_batch(WORD_ANSWERS, *zip(*rows, strict=True))])

    return questions.groupBy("bucket").applyInArrow(answer, WORD_ANSWERS)


def ordered(*keys: np.ndarray) -> np.ndarray:
    """Places in ascending order of integer keys, the first one first; two keys that fit into 64 bits are sorted as one."""
    joint = [keys[0]]
    for x in keys[1:]:
        y = joint[-1]
        if len(x) and -(1 << 31) <= y.min() and y.max() < 1 << 31 and x.min() >= 0 and x.max() < 1 << 32:
            joint[-1] = y << 32 | x
        else:
            joint.append(x)
    return np.argsort(joint[0]) if len(joint) == 1 else np.lexsort(joint[::-1])


class Block:
    """A block's tokens with the answers for its words."""

    def __init__(self, row: dict, answers: Iterable[tuple[int, bytes]]):
        self.doc, self.null = unpacked(row["doc_id"])
        self.held = unpacked(row["held_out"])[0].astype(bool)
        self.size, local, bucket = (unpacked(row[k])[0] for k in ("size", "local", "buckets"))
        ids, counts = np.zeros(len(bucket), np.int64), np.zeros(len(bucket), np.int64)
        for b, body in answers:
            ids[bucket == b], counts[bucket == b] = unpacked(body)
        # every text is its words and an end, each after the one before or the start
        n = self.size + 1
        last = np.cumsum(n) - 1
        is_word = np.ones(int(n.sum()), bool)
        is_word[last] = False
        self.word = np.full(len(is_word), END, np.int64)
        self.word[is_word] = ids[local]
        self.before = np.concatenate([[START], self.word[:-1]])
        self.before[last - n + 1] = START
        self.text = np.repeat(np.arange(len(n), dtype=np.int32), n)
        self.place = np.arange(len(is_word), dtype=np.int32) - np.repeat((last - n + 1).astype(np.int32), n)
        self.count = np.zeros(len(is_word), np.int64)
        self.count[is_word] = counts[local]
        self.is_word = is_word

    def grams(self, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For n = 2..order, distinct n-grams in order of their words, as positions of one token each, and every token's n-gram.

        The latter is -1 for tokens that have no context of n - 1 words, the start included.
        """
        context = self.before
        for n in range(2, order + 1):
            order_of = np.flatnonzero(self.place >= n - 2)
            order_of = order_of[ordered(context[order_of], self.word[order_of])]
            a, b = context[order_of], self.word[order_of]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
            which = np.full(len(self.word), -1, np.int64)
            which[order_of] = np.cumsum(new) - 1
            first = order_of[new]
            del context, order_of, a, b, new  # not held while the n-grams are dealt with
            yield n, first, which
            context = np.concatenate([[-1], which[:-1]])
            del first, which

    def contexts(self, n: int, first: np.ndarray) -> list[np.ndarray]:
        """The n - 1 words before tokens that have as many."""
        return [self.before[first - (n - 2)], *(self.word[first - k] for k in range(n - 2, 0, -1))]


def gram_buckets(context: list[np.ndarray], word: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    h = np.zeros(len(word), np.uint64)
    for x in context:
        h = W.scramble(h + x.astype(np.uint64))
    h = np.where(hot, W.scramble(h + W.scramble(word.astype(np.uint64))), h)
    return (h % np.uint64(buckets)).astype(np.int64)


def _by_block(table: DataFrame, answers: DataFrame, f, schema: str) -> DataFrame:
    return table.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(f, schema)


class Settings:
    def __init__(self, tokens: int, all_tokens: int, ends: int, distinct: int):
        self.all_tokens, self.bucket_keys = all_tokens, BUCKET_KEYS
        self.ends, self.tokens, self.distinct = ends, tokens, distinct
        self.scale = tokens + 0.5 * (distinct + 1)

    def buckets(self, n: int) -> int:
        return 1 + (n - 1) * self.all_tokens // self.bucket_keys

    def base(self, count: np.ndarray) -> np.ndarray:
        return (count + 0.5) / self.scale


def _word_counts(block: Block, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Training counts of each token and of the word before it."""
    count = np.where(block.is_word, block.count, s.ends)
    before = np.concatenate([[0], count[:-1]])
    before[block.before == START] = s.ends
    return count, before


def _dealt(block: Block, n: int, first: np.ndarray, before: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-grams in order of their buckets, each bucket's part of them, and which are hot; ``before`` is their contexts' count."""
    hot = before > s.bucket_keys
    bucket = gram_buckets(block.contexts(n, first), block.word[first], hot, s.buckets(n))
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(s.buckets(n) + 1)), hot


def _block(left: pa.Table, right: pa.Table) -> tuple[Block, int, Callable[[str], Iterator[tuple]]]:
    """The block, its number, and its answers of a kind, one at a time: (bucket, body, and rest if it was read)."""
    row = left.to_pylist()[0]
    bodies = [right[c] for c in ("body", "rest") if c in right.column_names]
    own: dict[str, list[tuple]] = {}
    for k, (kind, bucket) in enumerate(zip(right["kind"].to_pylist(), right["bucket"].to_pylist())):
        own.setdefault(kind, []).append((bucket, k))

    def got(kind: str) -> Iterator[tuple]:
        for bucket, k in own.get(kind, []):
            yield (bucket, *(c[k].as_py() for c in bodies))

    return Block(row, (x[:2] for x in got("words"))), row["block"], got


def ask_grams(table: DataFrame, answers: DataFrame, s: Settings, n: int) -> DataFrame:
    """Each block's distinct n-grams; ``answers`` has those for words and all shorter n-grams."""

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows:
            block, number, got = _block(left, right)
            lower, before = _word_counts(block, s)
            for m, first, which in block.grams(n):
                if m == n:
                    break
                order, edges, _ = _dealt(block, m, first, before[first], s)
                count = np.zeros(len(first) + 1, np.int64)  # the last is that of no n-gram
                for k, body, *_ in got(str(m)):
                    count[order[edges[k] : edges[k + 1]]] = unpacked(body)[0]
                lower = count[which]
                before = np.concatenate([[0], lower[:-1]])
            seen = np.bincount(which[(which >= 0) & ~block.held[block.text]], minlength=len(first))
            order, edges, hot = _dealt(block, n, first, before[first], s)
            a, *more = block.contexts(n, first)
            a = np.where(hot, -1 - a, a)  # a hot context is marked by its sign
            b, lower = block.word[first], np.where(seen > 0, lower[first], 0)
            # neighbours in a bucket have the same first word: only steps of it travel
            for k in range(s.buckets(n)):
                mine = order[edges[k] : edges[k + 1]]
                if len(mine):
                    out.append((k, number, packed(np.diff(a[mine], prepend=0), *(x[mine] for x in more), b[mine], seen[mine], lower[mine])))
        return pa.Table.from_batches([_batch(QUESTIONS, *(zip(*out, strict=True) if out else ([], [], [])))])

    return _by_block(table, answers, ask, QUESTIONS)


def answer_grams(questions: DataFrame, s: Settings, n: int, lower_loss: np.ndarray | None) -> DataFrame:
    """How often n-grams of each bucket are seen (kind model), sums of hot contexts (hot), and each block's counts in the order asked.

    For n-grams that training has not seen, the answer has the sum of the context's followers by the
    model of one order less (times the count of the shorter context, from pairs on), and their number
    by how often they follow. ``lower_loss`` is what counts of that model lose, None for single words.
    """

    def answer(group: pa.Table) -> pa.Table:
        asked = [(b, *unpacked(x)) for b, x in sorted(zip(group["block"].to_pylist(), group["body"].to_pylist()))]
        context = [np.concatenate([np.cumsum(x[1]) for x in asked]), *(np.concatenate([x[k] for x in asked]) for k in range(2, n))]
        b, c, lower = (np.concatenate([x[k] for x in asked]) for k in (n, n + 1, n + 2))
        numbers, sizes = [x[0] for x in asked], [len(x[1]) for x in asked]
        del asked
        order = ordered(*context, b)
        new_context = np.ones(len(b), bool)
        new_context[1:] = np.any([np.diff(x[order]) != 0 for x in context], axis=0)
        new = new_context.copy()
        new[1:] |= np.diff(b[order]) != 0
        which = np.zeros(len(b), np.int64)
        which[order] = np.cumsum(new) - 1
        size = int(new.sum())
        total = np.bincount(which, c.astype(np.float64), size).astype(np.int64)
        below = np.zeros(size, np.int64)
        np.maximum.at(below, which, lower)
        context = [x[order][new] for x in context]
        # sums by context
        start = np.flatnonzero(new_context[new])
        worth = s.base(below) if lower_loss is None else below - lower_loss[np.minimum(below, CLASSES)]
        mass = np.add.reduceat(np.where(total > 0, worth, 0.0), start)
        kind = np.minimum(total, CLASSES)
        seen = np.stack([np.add.reduceat((kind == r).astype(np.int64), start) for r in range(1, CLASSES + 1)], 1)
        of_gram = np.repeat(np.arange(len(start)), np.diff(np.append(start, size)))
        histogram = np.bincount(np.minimum(total, CLASSES + 1), minlength=CLASSES + 2)[1 : CLASSES + 1].tolist()
        bucket = group["bucket"][0].as_py()
        rows = [("model", bucket, -1, None, None, histogram)]
        hot = np.flatnonzero(context[0][start] < 0)
        if len(hot):
            rows.append(("hot", bucket, -1, packed(*(x[start[hot]] for x in context), mass[hot].view(np.uint64), seen[hot].reshape(-1)), None, None))
        at = 0
        for block, k in zip(numbers, sizes):
            mine = which[at : at + k]
            at += k
            own, back = np.unique(of_gram[mine[total[mine] == 0]], return_inverse=True)
            rows.append((str(n), bucket, block, packed(total[mine]), packed(back, mass[own].view(np.uint64), seen[own].reshape(-1)), None))
        return pa.Table.from_batches([_batch(GRAM_ANSWERS, *zip(*rows, strict=True))])

    return questions.groupBy("bucket").applyInArrow(answer, GRAM_ANSWERS)


def discounts(histogram: list[int]) -> np.ndarray:
    """What an n-gram seen r times loses, for r = 0..RELIABLE and more, from the numbers of n-grams seen 1..RELIABLE+1 times.

    Where Good-Turing gives no proper value (too few n-grams), it is that of absolute discounting.
    Every seen n-gram loses something, so that every context leaves some mass to back off with.
    """
    n = [0, *histogram]
    k = RELIABLE
    spare = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    flat = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    out = [0.0]
    for r in range(1, k + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - spare) / (1 - spare) if n[r] and spare < 1 else 0.0
        out.append(r * (1 - d) if 0 < d < 1 else flat)
    return np.array([*out, out[-1]])


def score_blocks(table: DataFrame, answers: DataFrame, s: Settings, losses: dict[int, np.ndarray], hot_sums: dict[tuple, tuple]) -> DataFrame:
    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_batches([_batch(SCORES, *([] for _ in range(7)))])
        block, _, got = _block(left, right)
        count, before = _word_counts(block, s)
        lowest = s.base(count)
        p, lower, shorter = lowest.copy(), count, np.ones(len(count), np.int64)
        # from single words up to the longest context: what an order has not seen keeps the weighted value of the one before
        for n, first, which in block.grams(max(losses, default=1)):
            loss, whole = losses[n], before[first]
            order, edges, is_hot = _dealt(block, n, first, whole, s)
            total, weight = np.zeros(len(first) + 1, np.int64), np.ones(len(first) + 1)
            for k, body, rest in got(str(n)):
                mine = order[edges[k] : edges[k + 1]]
                (total[mine],) = unpacked(body)
                back, mass, seen = unpacked(rest)
                left_over, mass = (seen.reshape(-1, CLASSES) * loss[1:]).sum(1)[back], mass.view(np.float64)[back]
                mine = mine[total[mine] == 0]
                for j in np.flatnonzero(is_hot[mine]) if hot_sums else ():
                    mass[j], x = hot_sums[tuple(int(y[0]) for y in block.contexts(n, first[mine[j] : mine[j] + 1]))]
                    left_over[j] = (x * loss[1:]).sum()
                known = whole[mine] > 0
                here = left_over / np.maximum(whole[mine], 1) / np.maximum(1 - mass / np.maximum(shorter[first[mine]], 1), 1e-300)
                weight[mine] = np.where(known, here, 1.0)
            lower = total[which]
            p = np.where(lower > 0, (lower - loss[np.minimum(lower, CLASSES)]) / np.maximum(before, 1), p * weight[which])
            shorter, before = before, np.concatenate([[0], lower[:-1]])
            del first, which, whole, order, edges, is_hot, total, weight
        n = len(block.size)
        add = lambda x: np.bincount(block.text, x, n)
        return pa.Table.from_batches([
            _batch(
                SCORES, pa.array(block.doc, mask=block.null.astype(bool)), block.held, block.size + 1, add((count > 0).astype(float)).astype(np.int64),
                np.full(n, s.tokens), add(np.log10(lowest)), add(np.log10(p)),
            )
        ])

    return _by_block(table, answers, score, SCORES)


def katz_scores(docs: DataFrame, held_out, order: int = ORDER) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``, a row for each row of ``docs``.

    ``score`` is by n-grams of up to ``order`` words, ``base_score`` by single words.
    ``docs`` needs doc_id and text; other columns are ignored. Training texts are those where the
    column expression ``held_out`` is not true. A null text is empty: its end is its only token.
    Null ids stay, rows may repeat (each counts), an empty table gives no rows; without training
    texts every token is unknown.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    table = stored(blocks(docs), "blocks")
    size = table.agg(F.sum("n_words"), F.sum("n_tokens"), F.count("*")).first()
    word_buckets = 1 + int(size[0] or 0) // BUCKET_KEYS
    ends = docs.where("not held_out").count()
    words = stored(answer_words(ask_words(table, word_buckets), word_buckets), "katz-words")
    total = words.where("kind = 'model'").agg(F.sum("n"), F.sum("v")).first()
    table = stored(asked(table, word_buckets), "blocks", table)
    s = Settings(int(total[0] or 0) + ends, int(size[1] or 0), ends, int(total[1] or 0) + (ends > 0))
    answers = words.where("kind = 'answer'").select(F.lit("words").alias("kind"), "bucket", "block", "body", F.lit(None).cast("binary").alias("rest"))
    losses: dict[int, np.ndarray] = {}
    hot: dict[tuple, tuple] = {}
    for n in range(2, order + 1):
        grams = stored(answer_grams(ask_grams(table, answers.drop("rest"), s, n), s, n, losses.get(n - 1)), f"katz-{n}")
        seen = grams.where("kind = 'model'").agg(*(F.sum(F.col("seen")[k]) for k in range(CLASSES))).first()
        losses[n] = discounts([int(x or 0) for x in seen])
        for (body,) in grams.where("kind = 'hot'").select("body").toLocalIterator():  # at most a row for each bucket and hot context
            *context, mass, x = unpacked(body)
            context[0] = -1 - context[0]
            for key, m, y in zip(zip(*(c.tolist() for c in context)), mass.view(np.float64).tolist(), x.reshape(-1, CLASSES)):
                o = hot.get(key, (0.0, 0))
                hot[key] = (o[0] + m, o[1] + y)
        answers = answers.unionByName(grams.where(F.col("kind") == str(n)).drop("seen"))
    return score_blocks(table, answers, s, losses, hot)


def query(spark, sf_dir: str) -> DataFrame:
    """op9: all documents, scored by a trigram model of those whose crc32 modulo 5 is not 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return katz_scores(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, ORDER)


QUERIES = {"op9_katz_backoff": query}
