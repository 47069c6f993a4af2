"""Exact samples of customers, temporal splits, mappings and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .candidates import seeded
from .profiles import null_profile  # noqa: F401  it was defined here


def exact_sample(ids: DataFrame, column: str, share: float, seed: int = 42) -> DataFrame:
    """Exactly ``share`` of the distinct ids (rounded half-even), the same for the same seed.

    Ids are numbered within and across value ranges, not in one task.
    """
    if not 0 < share <= 1:
        raise ValueError("a share is over 0 and at most 1")
    keyed = ids.select(column).distinct().withColumn("_key", seeded(column, seed=seed)).withColumn("_range", F.floor(F.col("_key") / 1000))
    sizes = keyed.groupBy("_range").agg(F.count("*").alias("_n"))  # a thousand rows at most
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).withColumn("_all", F.sum("_n").over(Window.partitionBy()))
    place = F.row_number().over(Window.partitionBy("_range").orderBy("_key", column))
    out = keyed.withColumn("_place", place).join(F.broadcast(before), "_range")
    return out.where(F.col("_place") + F.col("_before") <= F.bround(F.lit(share) * F.col("_all"))).select(column)


def subsample(log: DataFrame, customers: DataFrame, articles: DataFrame, share: float, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A share of the customers, their purchases, and the items in these."""
    picked = exact_sample(customers, "customer_id", share, seed)
    kept = log.join(picked, "customer_id", "left_semi")
    return kept, customers.join(picked, "customer_id", "left_semi"), articles.join(kept.select("article_id").distinct(), "article_id", "left_semi")


def customer_items(log: DataFrame) -> DataFrame:
    """``customer_id, articles``: each customer's items in order of day, then item; repeats stay."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("t_dat", "article_id"))), lambda s: s["article_id"])
    return log.groupBy("customer_id").agg(ordered.alias("articles"))
