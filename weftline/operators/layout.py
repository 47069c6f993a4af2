"""The matrix's inputs laid out in buckets, so that its joins by customer read buckets side by side instead of exchanging rows."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables that share a customer's bucket may be joined by customer and week within it.
WITHIN_BUCKETS = "spark.sql.requireAllClusterKeysForCoPartition"


def laid_out(df: DataFrame, table: str, keys: list[str], buckets: int, sort_by: list[str] | None = None) -> DataFrame:
    """``df`` as a table in buckets of ``keys``, sorted within them; an earlier table of this name is replaced."""
    df.write.bucketBy(buckets, *keys).sortBy(*(sort_by or keys)).mode("overwrite").saveAsTable(table)
    return df.sparkSession.table(table)


def lay_out_inputs(candidates: DataFrame, customers: DataFrame, item_panel: DataFrame, customer_panel: DataFrame, name: str, buckets: int) -> dict[str, DataFrame]:
    """The inputs of ``matrix_of`` as tables ``<name>_...``; panels with the week in which they are used, one after their own.

    All that is looked up by customer is in buckets of the customer, the item panel in buckets of the item. As many buckets for
    training as for inference: panels are laid out once and serve both.
    """
    used = lambda df: df.withColumn("week_num", F.col("week_num") + 1)
    return {
        "candidates": laid_out(candidates, f"{name}_candidates", ["customer_id"], buckets, ["customer_id", "week_num"]),
        "customers": laid_out(customers, f"{name}_customers", ["customer_id"], buckets),
        "customer_panel": laid_out(used(customer_panel), f"{name}_customer_panel", ["customer_id"], buckets, ["customer_id", "week_num"]),
        "item_panel": laid_out(used(item_panel), f"{name}_item_panel", ["article_id"], buckets, ["article_id", "week_num"]),
    }


@contextmanager
def joined_within_buckets(spark: SparkSession) -> Iterator[None]:
    """Plans that are made within this may join by more keys than tables are in buckets of."""
    before = spark.conf.get(WITHIN_BUCKETS)
    spark.conf.set(WITHIN_BUCKETS, "false")
    try:
        yield
    finally:
        spark.conf.set(WITHIN_BUCKETS, before)
