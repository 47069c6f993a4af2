"""Column expressions: identifiers, bins, text, vectors and ranking metrics, all of built-in functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

AGE_EDGES = (18, 25, 35, 45, 55, 65)


def hex_id(text: Column) -> Column:
    """The last 16 hexadecimal digits as an unsigned number, decimal(20, 0)."""
    return F.conv(F.right(text, F.lit(16)), 16, 10).cast("decimal(20,0)")


def padded_id(number: Column) -> Column:
    """An item number as text with a leading zero."""
    return F.concat(F.lit("0"), number.cast("string"))


def age_bin(age: Column, edges: Sequence[float] = AGE_EDGES) -> Column:
    """Right-closed bins ``(a, b]`` as text "0.0", "1.0", ..; null is "nan"."""
    out = F.lit(f"{len(edges)}.0")
    for k, edge in reversed(list(enumerate(edges))):
        out = F.when(age <= edge, F.lit(f"{k}.0")).otherwise(out)
    return F.when(age.isNull(), F.lit("nan")).otherwise(out)


def joined_text(*columns: str) -> Column:
    """Texts joined by single spaces; a null piece is empty and keeps its space."""
    return F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; a zero norm counts as 1e-8, a null vector as zeros."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    guarded = lambda n: F.when(n == 0, F.lit(1e-8)).otherwise(n)
    return F.when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(dot / (guarded(norm(a)) * guarded(norm(b))))


def average_precision(actual: Column, predicted: Column, k: int = 12) -> Column:
    """AP@k: an item that is predicted twice scores at its first place; no actual item gives 0."""
    first_k = F.slice(F.coalesce(predicted, F.array().cast("array<bigint>")), 1, k)
    placed = F.transform(first_k, lambda x, i: F.when(F.array_contains(actual, x) & (F.array_position(first_k, x) == i + 1), i + 1))
    hits = F.array_compact(placed)
    total = F.aggregate(F.transform(hits, lambda place, n: (n + 1) / place), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(actual) > 0, total / F.least(F.size(actual), F.lit(k))).otherwise(F.lit(0.0))


def ideal_precision(actual: Column, predicted: Column, k: int = 12) -> Column:
    """AP@k of the hits among the first k predictions, put first."""
    hits = F.filter(F.slice(F.coalesce(predicted, F.array().cast("array<bigint>")), 1, k), lambda x: F.array_contains(actual, x))
    return average_precision(actual, hits, k)


def human_size(n_bytes: float) -> str:
    """A size in the largest unit of which it has one or more; bytes are whole."""
    if n_bytes < 0:
        raise ValueError("a size is not negative")
    if n_bytes < 1024:
        return f"{int(n_bytes)} B"
    units = ("KB", "MB", "GB", "TB", "PB", "EB", "ZB", "YB")
    step = 0
    while n_bytes >= 1024 ** (step + 2) and step + 1 < len(units):
        step += 1
    return f"{n_bytes / 1024 ** (step + 1):.2f} {units[step]}"
