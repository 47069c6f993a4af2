"""Texts and images to vectors: a hashed bag of words of built-in functions, and places for models of one's own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hashed_text(text: Column, size: int = 64) -> Column:
    """Counts of words by hash, scaled to length 1; a null text is the zero vector."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    cells = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(size)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.size(F.filter(cells, lambda c: c == k)).cast("double"))
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x)
    return F.transform(counts, lambda x: F.when(total > 0, x / F.sqrt(total)).otherwise(F.lit(0.0)))


def encoded_by(rows: DataFrame, key: str, text: str, make: Callable[[], Callable[[list[str]], list[list[float]]]]) -> DataFrame:
    """``key, vector`` by a model that ``make`` builds once in each task; it gets Arrow batches of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model([t or "" for t in b.column(1).to_pylist()]), pa.list_(pa.float64()))], [key, "vector"])

    return rows.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, f"{key} long, vector array<double>")


def images_by(rows: DataFrame, key: str, content: str, size: int, make: Callable[[], Callable[[list[bytes]], list[list[float]]]]) -> DataFrame:
    """``key, vector`` by an image model that ``make`` builds once in each task; it gets the bytes of the images of an Arrow batch.

    An item without an image has the zero vector of ``size`` numbers; a model's vector of another size fails.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for b in batches:
            images = b.column(1).to_pylist()
            found = iter(model([x for x in images if x is not None]))
            vectors = [[0.0] * size if x is None else list(next(found)) for x in images]
            if any(len(v) != size for v in vectors):
                raise ValueError(f"vectors of {size} numbers are wanted")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vectors, pa.list_(pa.float64()))], [key, "vector"])

    return rows.select(F.col(key).cast("long"), F.col(content).cast("binary")).mapInArrow(run, f"{key} long, vector array<double>")
