"""Candidates from a customer's own history: the last basket, the last k rows, the last k distinct items."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REQUIRED = ("customer_id", "article_id", "week_num", "price", "sales_channel_id")


def require(df: DataFrame, columns: tuple[str, ...]) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns are missing: {missing}")


def of_keys(rows: DataFrame, key: str, wanted: DataFrame | list | None = None) -> DataFrame:
    """Rows of some keys, given as a table or a list; None means all, an empty list none."""
    if wanted is None:
        return rows
    if isinstance(wanted, DataFrame):
        return rows.join(wanted.select(key).distinct(), key, "left_semi")
    return rows.where(F.col(key).isin(wanted) if wanted else F.lit(False))


def of_customers(log: DataFrame, customers: DataFrame | list | None = None) -> DataFrame:
    return of_keys(log, "customer_id", customers)


def base_transactions(log: DataFrame, first_day: date | None = None, last_day: date | None = None, customers: DataFrame | list | None = None, articles: DataFrame | list | None = None) -> DataFrame:
    """Purchases of some days (both included), customers and articles; None means all, an empty list none."""
    for bound, inside in ((first_day, F.col("t_dat") >= F.lit(first_day)), (last_day, F.col("t_dat") <= F.lit(last_day))):
        if bound is not None:
            log = log.where(inside)
    return of_keys(of_keys(log, "customer_id", customers), "article_id", articles)


def next_purchase_week(log: DataFrame, default_week: int = 103) -> DataFrame:
    """``customer_id, week_num, next_week``: each week with purchases and the customer's next one."""
    weeks = log.select("customer_id", "week_num").distinct()
    after = F.lead("week_num").over(Window.partitionBy("customer_id").orderBy("week_num"))
    return weeks.withColumn("next_week", F.coalesce(after, F.lit(default_week)).cast("int"))


def last_purchase(log: DataFrame, start: int, end: int, default_week: int = 103) -> DataFrame:
    """Every purchase as a candidate of the customer's next week with purchases, within ``start..end``."""
    moved = log.join(next_purchase_week(log, default_week), ["customer_id", "week_num"])
    return moved.withColumn("week_num", F.col("next_week")).drop("next_week").where(F.col("week_num").between(start, end))


def last_k_items(log: DataFrame, k: int, start: int, end: int) -> DataFrame:
    """For each week of ``start..end``, the customer's k latest rows before it, by week, then by item.

    An item counts once a week and once for each week. A row serves the weeks after its own until k
    later ones exist: an interval, so that no row meets weeks in which it is not wanted.
    """
    dearest = Window.partitionBy("customer_id", "week_num", "article_id").orderBy(*(c for c in ("price", "sales_channel_id") if c in log.columns), *(["t_dat"] if "t_dat" in log.columns else []))
    rows = log.where(F.col("week_num") < end).withColumn("_n", F.row_number().over(dearest)).where("_n = 1").drop("_n")
    later = Window.partitionBy("customer_id").orderBy("week_num", F.desc("article_id"))
    rows = rows.withColumn("_until", F.coalesce(F.lead("week_num", k).over(later), F.lit(end)))
    rows = rows.withColumn("_from", F.greatest(F.col("week_num") + 1, F.lit(start))).withColumn("_until", F.least("_until", F.lit(end)))
    return rows.where("_from <= _until").withColumn("week_num", F.explode(F.sequence("_from", "_until"))).drop("_from", "_until")


def last_k_changes(log: DataFrame, k: int, start: int, end: int) -> DataFrame:
    """``customer_id, week_num, article_id, price, place, until``: the k latest distinct items, in the weeks in which they may change.

    These are the weeks in which the customer buys, and ``start`` where they bought before; the items hold
    up to the week ``until``. An item counts at its latest purchase; from its next purchase on, that one
    takes its place.
    """
    same = Window.partitionBy("customer_id", "week_num", "article_id").orderBy(F.desc("t_dat"), "price", "sales_channel_id")
    rows = log.where(F.col("week_num") <= end).withColumn("_n", F.row_number().over(same)).where("_n = 1")
    first = F.greatest("week_num", F.lit(start))
    again = F.lead("week_num").over(Window.partitionBy("customer_id", "article_id").orderBy("week_num"))
    # at most a number for each week of the history
    weeks = F.collect_set(first).over(Window.partitionBy("customer_id"))
    rows = rows.select("customer_id", "article_id", "t_dat", "price", weeks.alias("_weeks"), first.alias("_from"), F.coalesce(again - 1, F.lit(end)).alias("_until"))
    inside = F.filter("_weeks", lambda w: (w >= F.col("_from")) & (w <= F.col("_until")))
    each = rows.where("_from <= _until").withColumn("week_num", F.explode(inside))
    place = F.row_number().over(Window.partitionBy("customer_id", "week_num").orderBy(F.desc("t_dat"), "article_id"))
    later = F.array_min(F.filter("_weeks", lambda w: w > F.col("week_num")))
    kept = each.withColumn("place", place).where(F.col("place") <= k)
    return kept.select("customer_id", "week_num", "article_id", "price", "place", F.coalesce(later - 1, F.lit(end)).alias("until"))


def last_k_distinct(log: DataFrame, k: int, start: int, end: int) -> DataFrame:
    """``customer_id, week_num, article_id, price, place``: the k latest distinct items up to and with each week."""
    each = F.explode(F.sequence("week_num", "until"))
    return last_k_changes(log, k, start, end).withColumn("week_num", each).select("customer_id", "week_num", "article_id", "price", "place")


def repurchase_samples(log: DataFrame, strategy: str, start: int, end: int, k: int = 12, customers: DataFrame | list | None = None, default_week: int = 103) -> DataFrame:
    """Candidates by ``last_purchase`` or ``last_k_items``, tagged with their source."""
    require(log, REQUIRED)
    log = of_customers(log, customers).select(*REQUIRED)
    if strategy == "last_purchase":
        out = last_purchase(log, start, end, default_week)
    elif strategy == "last_k_items":
        out = last_k_items(log, k, start, end)
    else:
        raise ValueError(f"no such strategy: {strategy}")
    return out.select(*REQUIRED).withColumn("source", F.lit("repurchase"))
