"""Document quality by Bradley-Terry ranking of preference pairs.

Each pair has a document labelled 1 and one labelled 0; the chance that the first is preferred is the
logistic function of the difference of their scores, which are linear in features of the whole text.
The weights minimise the logistic loss on feature differences. The threshold is the quantile of the
scores of all labelled documents that the share of label 0 among them names, and a final logistic
curve, whose value there is ``CUT``, turns scores into numbers from 0 to 1.

The fit of the weights and the curve's slope takes a bounded sample of the labelled documents (``SAMPLE``,
by hash of the doc_id); the threshold takes all of them. Features and scores are computed where the documents are, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .scratch import discard, stored

#: Labelled documents that the fit takes at most, and preference pairs that it draws among them.
SAMPLE, PAIRS = 12_000, 120_000
HASHED = 1024
CUT = 0.7
EPOCHS, BATCH, RATE, DECAY = 8, 512, 0.02, 1e-4
#: The threshold is within one rank in so many of the exact quantile.
ACCURACY = 100_000

_B = np.arange(256)
_KINDS = {
    "upper": (_B >= 65) & (_B <= 90),
    "lower": (_B >= 97) & (_B <= 122),
    "digit": (_B >= 48) & (_B <= 57),
    "space": np.isin(_B, [0x20, 9, 11, 12, 13]),
    "line": _B == 10,
    "stop": np.isin(_B, [0x2E, 0x2C]),
    "mark": np.isin(_B, [0x21, 0x3F, 0x3B, 0x3A]),
    "sign": np.isin(_B, [ord(c) for c in "|<>{}[]()=/\\_*#@&%$^~+\"'`-"]),
    "high": _B >= 128,
}
SHAPE = 2 * len(_KINDS) + 9


def _sums(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0.0], np.cumsum(x)])[off])


def features(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of SHAPE + HASHED numbers for each text: shares of kinds of bytes, repetition, hashed words."""
    n = len(off) - 1
    size = np.diff(off)
    out = np.zeros((n, SHAPE + HASHED), np.float32)
    for k, kind in enumerate(_KINDS.values()):
        share = _sums(kind[raw], off) / np.maximum(size, 1)
        out[:, 2 * k], out[:, 2 * k + 1] = np.sqrt(share), share
    h, start, end, at = W.word_hashes(raw, off)
    count = np.diff(at)
    text = np.repeat(np.arange(n), count)
    long = np.maximum(count, 1)
    distinct, do = W.doc_sets(h, at)
    order = np.lexsort((h, text))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1])
    runs = np.diff(np.append(np.flatnonzero(new), len(h)))
    most = np.zeros(n)
    np.maximum.at(most, text[order][new], runs)
    near = np.zeros(len(h), bool)
    near[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    length = (end - start).astype(float)
    mean = _sums(length, at) / long
    at_k = 2 * len(_KINDS)
    extra = (
        np.log1p(size) / 10, np.log1p(count) / 10, mean / 10, np.sqrt(np.maximum(_sums(length**2, at) / long - mean**2, 0)) / 10,
        np.diff(do) / long, np.log1p(np.diff(do)) / 10, most / long, _sums(near, at) / long, (count == 0).astype(float),
    )
    for k, x in enumerate(extra):
        out[:, at_k + k] = x
    cell = text[order][new] * HASHED + (h[order][new] % np.uint64(HASHED)).astype(np.int64)
    hashed = np.bincount(cell, np.sqrt(runs), n * HASHED).reshape(n, HASHED)
    out[:, SHAPE:] = hashed / np.maximum(np.sqrt((hashed**2).sum(1, keepdims=True)), 1e-9)
    return out


class Model:
    """Weights, and the curve from a text's preference score to a number from 0 to 1."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, weights: np.ndarray, cut: float, slope: float):
        self.mean, self.spread, self.weights, self.cut, self.slope = mean, spread, weights, cut, slope

    def preference(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.spread) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self.slope * (self.preference(x) - self.cut) + np.log(CUT / (1 - CUT)), -40, 40)
        return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, label: np.ndarray, seed: int = 7) -> Model:
    """Bradley-Terry weights of feature rows ``x`` with labels 0 and 1, not yet with a cut; without both, all score alike."""
    width = SHAPE + HASHED
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return Model(np.zeros(width, np.float32), np.ones(width, np.float32), np.zeros(width, np.float32), 0.0 if len(good) else 1.0, 1.0)
    mean, spread = x.mean(0), x.std(0)
    spread = np.where(spread > 1e-6, spread, 1).astype(np.float32)
    spread[SHAPE:] = np.maximum(spread[SHAPE:].mean(), 1e-3) * 3
    x = ((x - mean) / spread).astype(np.float32)
    rng = np.random.default_rng(seed)
    w, m, v = (np.zeros(width) for _ in range(3))
    a, b = rng.choice(good, PAIRS), rng.choice(bad, PAIRS)
    t = 0
    for _ in range(EPOCHS):
        order = rng.permutation(PAIRS)
        for k in range(0, PAIRS, BATCH):
            pair = order[k : k + BATCH]
            d = x[a[pair]] - x[b[pair]]
            g = -((1 / (1 + np.exp(np.clip(d @ w, -40, 40)))) @ d) / len(pair) + DECAY * w
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(mean.astype(np.float32), spread, w.astype(np.float32), 0.0, 1.0)


def calibrated(model: Model, x: np.ndarray, label: np.ndarray, cut: float) -> Model:
    """The model with this cut and the slope of its scores that fits the labels best."""
    s = model.preference(x).astype(float)
    y, best = label.astype(float), (np.inf, 1.0)
    for slope in np.geomspace(0.05, 20, 25) / max(s.std(), 1e-9):
        z = np.clip(slope * (s - cut) + np.log(CUT / (1 - CUT)), -40, 40)
        best = min(best, (float(np.mean(np.logaddexp(0, z) - y * z)), slope))
    return Model(model.mean, model.spread, model.weights, cut, best[1])


def preferences(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, preference`` of rows ``doc_id, text, held_out``: the score before its cut and slope."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, off in W.chunks(batch):
                s = sent.value.preference(features(raw, off)).astype(float)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(s)], ["doc_id", "held_out", "preference"])

    return docs.mapInArrow(rows, "doc_id long, held_out boolean, preference double")


def threshold(preferred: DataFrame, known: DataFrame) -> float:
    """The quantile of the preferences of all documents in ``known``, at the share of label 0 among them.

    It is taken within a rank of 1 in ACCURACY, and is the middle of that preference and the next one up.
    """
    both = preferred.join(known, "doc_id").select("preference", "quality")
    share = both.agg(F.avg(1 - F.col("quality"))).first()[0]
    if share is None:
        return 0.0
    at = both.agg(F.percentile_approx("preference", F.lit(float(share)), F.lit(ACCURACY))).first()[0]
    above = both.where(F.col("preference") > F.lit(at)).agg(F.min("preference")).first()[0]
    return at if above is None else (at + above) / 2


def labelled(labels: DataFrame, held_out: Column) -> DataFrame:
    """``doc_id, quality`` of all documents with a label that ``held_out`` doesn't hold back."""
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    return known.where(~F.coalesce(held_out, F.lit(False)))


def learn(docs: DataFrame, labels: DataFrame, held_out: Column) -> tuple[Model, DataFrame | None]:
    """A model from the documents with a quality label that ``held_out`` doesn't hold back, and all documents' ``preferences``.

    It is fitted on at most SAMPLE such documents, those with the least hashes of their doc_id, and of rows
    that repeat their ids on 2 * SAMPLE rows at most. Its cut is taken over all of them. Without labels of
    both kinds there are no preferences.
    """
    every = labelled(labels, held_out)
    known = every.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    texts = docs.join(F.broadcast(known), "doc_id").select("doc_id", "text", "quality")  # SAMPLE rows at most

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, off in W.chunks(batch):
                x = features(raw, off).astype(np.float16)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2).cast(pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "quality", "x"])

    found = texts.mapInArrow(rows, "doc_id long, quality int, x binary")
    got = found.orderBy("doc_id", F.xxhash64("x"), "x").limit(2 * SAMPLE).toArrow()  # rows that repeat a doc_id count as documents
    label = got["quality"].to_numpy()
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float16).reshape(len(label), SHAPE + HASHED).astype(np.float32)
    model = fit(x, label)
    if len(np.unique(label)) < 2:
        return model, None
    preferred = stored(preferences(docs, model), "preferences")
    return calibrated(model, x, label, threshold(preferred, every)), preferred


def quality_scores(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """``doc_id, held_out, score, predicted``, a row for each row of ``docs``.

    ``docs`` needs doc_id and text, ``labels`` doc_id and quality; other columns are ignored. Labels
    other than 0 and 1 and those of null ids are left out; a document labelled twice counts with the
    higher label. Null texts are scored as empty ones; null ids stay and are not held out; rows may
    repeat. Without labels of both kinds, all documents score alike. An empty table gives no rows.
    """
    model, preferred = learn(docs, labels, held_out)
    if preferred is None:
        docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
        preferred = preferences(docs, model)
    z = F.lit(float(model.slope)) * (F.col("preference") - F.lit(float(model.cut))) + F.lit(float(np.log(CUT / (1 - CUT))))
    score = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(40.0)), F.lit(-40.0))))
    scored = preferred.select("doc_id", "held_out", score.alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= CUT, 1).otherwise(0))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those that the classifier rejects; all columns stay."""
    model, preferred = learn(docs, labels, F.lit(False))
    if preferred is not None:
        discard(preferred)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, off in W.chunks(batch, "text"):
                yield part.filter(pa.array(sent.value.score(features(raw, off)) >= CUT))

    return docs.mapInArrow(good, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: quality scores of all documents, by labels of those whose crc32 modulo 4 is not 2."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality_scores(docs, labels, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)


QUERIES = {"op6_bradley_terry_quality": query}
