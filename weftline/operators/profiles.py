"""Profiles of tables: exact counts of values and describing figures, and mergeable sketches for large tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..sources.scratch import stored

#: Figures of a description, in their order.
FIGURES = ("mean", "std", "min", "q1", "median", "q3", "max")
#: Standard error of distinct counts is 1.04 / sqrt(2 ** HLL_BITS); ranks of quantiles are off by about 1.65 % for k = 200, less for more.
HLL_BITS, KLL_K = 14, 800
#: Counters of frequent values: a value with more than a 1 / FREQUENT share of the rows is found, off by less than that share.
FREQUENT = 4096


def numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType)]


def _stacked(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, value``: a row for each value, as text."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))
    return df.select(F.explode(pairs).alias("x")).select("x.*")


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column, value, n`` of every value of these columns, as text; null is a value. Counts are summed before the exchange."""
    return _stacked(df, columns or df.columns).groupBy("column", "value").agg(F.count("*").alias("n"))


def null_profile(df: DataFrame) -> DataFrame:
    """``column, n_rows, n_nulls, n_distinct`` of every column, exact.

    Counts by value come first, so that several distinct counts need no copy of each row for each column in one aggregate, and
    a column with one value in most rows is no large group.
    """
    counts = value_counts(df).groupBy("column").agg(F.sum("n").alias("n_rows"), F.sum(F.when(F.col("value").isNull(), F.col("n"))).alias("n_nulls"), F.count("value").alias("n_distinct"))
    names = df.sparkSession.createDataFrame([(c,) for c in df.columns], "column string")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return names.join(counts, "column", "left").select("column", *map(zero, ("n_rows", "n_nulls", "n_distinct")))


def top_values(df: DataFrame, k: int = 10, columns: list[str] | None = None) -> DataFrame:
    """``column, value, n, place``: the k most frequent values of each column, ties by value, null last."""
    order = Window.partitionBy("column").orderBy(F.desc("n"), F.asc_nulls_last("value"))
    return value_counts(df, columns).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def described(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column, n`` and the FIGURES of numeric columns, exact (quartiles interpolated, the standard deviation that of a sample)."""
    columns = columns or numeric(df)

    def figures(c: str) -> Column:
        x = F.col(c).cast("double")
        return F.struct(F.lit(c).alias("column"), F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))

    found = df.agg(F.array(*map(figures, columns)).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    quartiles = exact_quantiles(df, columns, (0.25, 0.5, 0.75))
    named = quartiles.select("column", *(F.col("quantiles")[k].alias(c) for k, c in enumerate(("q1", "median", "q3"))))
    return found.join(F.broadcast(named), "column", "left").select("column", "n", *FIGURES)


def exact_quantiles(df: DataFrame, columns: list[str], wanted: tuple[float, ...]) -> DataFrame:
    """``column, quantiles``: exact, interpolated quantiles of each column that has a value.

    Counts of values are stored in ranges, so that no task holds a column's values: sums of the ranges tell
    in which of them a rank lies, and only these are counted through.
    """
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns))
    counts = df.select(F.explode(pairs).alias("x")).select("x.*").where("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
    ranges = stored(counts.repartitionByRange("column", "value").withColumn("_part", F.spark_partition_id()), "values")
    sums = ranges.groupBy("column", "_part").agg(F.sum("n").alias("_n"))  # a row for each range
    own = Window.partitionBy("column")
    upto = F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0))
    sums = sums.select("column", "_part", (upto - F.col("_n")).alias("_before"), upto.alias("_upto"), F.sum("_n").over(own).alias("_total"))
    at = F.posexplode(F.array(*(F.lit(float(q)) for q in wanted))).alias("_k", "_q")
    place = F.col("_q") * (F.col("_total") - 1)
    sums = sums.select("*", at).withColumn("_at", place).withColumns({"_low": F.floor("_at"), "_high": F.ceil("_at")})
    inside = lambda rank: (F.col(rank) >= F.col("_before")) & (F.col(rank) < F.col("_upto"))
    sums = sums.where(inside("_low") | inside("_high")).drop("_upto", "_total", "_q")
    order = Window.partitionBy("column", "_part", "_k").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    rows = ranges.join(F.broadcast(sums), ["column", "_part"]).withColumn("_upto", F.col("_before") + F.sum("n").over(order)).withColumn("_before", F.col("_upto") - F.col("n"))
    found = rows.groupBy("column", "_k", "_at", "_low", "_high").agg(F.max(F.when(inside("_low"), F.col("value"))).alias("_a"), F.max(F.when(inside("_high"), F.col("value"))).alias("_b"))
    between = (F.col("_high") - F.col("_at")) * F.col("_a") + (F.col("_at") - F.col("_low")) * F.col("_b")
    value = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(between)
    listed = F.array_sort(F.collect_list(F.struct("_k", value.alias("v"))))  # as many as are wanted
    return found.groupBy("column").agg(F.transform(listed, lambda s: s["v"]).alias("quantiles"))


def sketched(df: DataFrame, columns: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """``*by, column, n_rows, n_nulls, distinct, quantiles, frequent``: sketches of every column, in one pass and small whatever the input's size.

    They may be stored, by week for instance, and ``merged`` later without the rows. ``quantiles`` is null for columns that are not numeric.
    """
    columns = [c for c in (columns or df.columns) if c not in (by or [])]
    numbers = set(numeric(df))

    def sketch(c: str) -> Column:
        text = F.col(c).cast("string")
        quantiles = F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(KLL_K)) if c in numbers else F.lit(None).cast("binary")
        frequent = F.call_function("approx_top_k_accumulate", F.coalesce(text, F.lit("")), F.lit(FREQUENT))
        return F.struct(
            F.lit(c).alias("column"), F.count("*").alias("n_rows"), F.count_if(F.col(c).isNull()).alias("n_nulls"), F.hll_sketch_agg(text, HLL_BITS).alias("distinct"), quantiles.alias("quantiles"), frequent.alias("frequent")
        )

    return df.groupBy(*(by or [])).agg(F.array(*map(sketch, columns)).alias("x")).select(*(by or []), F.explode("x").alias("x")).select(*(by or []), "x.*")


def merged(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sketches of parts as sketches of the whole, or of each group of ``by``."""
    return sketches.groupBy(*(by or []), "column").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_nulls").alias("n_nulls"), F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("quantiles").alias("quantiles"), F.call_function("approx_top_k_combine", F.col("frequent"), F.lit(FREQUENT)).alias("frequent")
    )


def estimated(sketches: DataFrame, k: int = 5, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Sketches as figures: ``n_rows, n_nulls, n_distinct, quantiles, top`` (structs ``item, count``; nulls count as empty text)."""
    wanted = F.array(*(F.kll_sketch_get_quantile_double("quantiles", F.lit(q)) for q in quantiles))
    keys = [c for c in sketches.columns if c not in ("distinct", "quantiles", "frequent")]
    return sketches.select(*keys, F.hll_sketch_estimate("distinct").alias("n_distinct"), F.when(F.kll_sketch_get_n_double("quantiles") > 0, wanted).alias("quantiles"), F.call_function("approx_top_k_estimate", F.col("frequent"), F.lit(k)).alias("top"))
