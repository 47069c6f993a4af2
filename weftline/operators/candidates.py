"""Training and inference candidates: union of sources, labels, down-sampling, calendar features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import Calendar, date_features
from .popularity import item_week_stats, popularity_samples, weekly_popular_items
from .repurchase import of_customers, repurchase_samples

KEY = ["customer_id", "week_num", "article_id"]
#: Sources in the order in which the first one wins.
SOURCES = ("positive", "popularity", "repurchase")


def seeded(*columns: str, seed: int = 42) -> Column:
    """A pseudo-random order of rows by arithmetic on their keys: the same on every engine and partitioning."""
    total = F.lit(seed).cast("long")
    for c in columns:
        total = F.pmod(total * 31 + F.pmod(F.col(c).cast("long"), F.lit(1_000_003)) * 7919 + 17, F.lit(1_000_003))
    return total


def first_of_key(rows: DataFrame) -> DataFrame:
    """One row for each customer, week and item: that of the first source, then the lowest price and channel."""
    order = F.array_position(F.array(*(F.lit(s) for s in SOURCES)), F.col("source"))
    pick = Window.partitionBy(*KEY).orderBy(order, F.asc_nulls_last("price"), F.asc_nulls_last("sales_channel_id"))
    return rows.withColumn("_n", F.row_number().over(pick)).where("_n = 1").drop("_n")


def combined_samples(log: DataFrame, samples: list[DataFrame], train: bool = True, restrict: bool = True) -> DataFrame:
    """All sources' candidates, once each; unless positives are restricted to them, observed purchases are taken out."""
    rows = samples[0]
    for more in samples[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    rows = rows.where("article_id is not null")
    if train and restrict:
        rows = rows.join(log.select(*KEY).distinct(), KEY, "left_anti")
    return first_of_key(rows)


def positive_samples(log: DataFrame, start: int, end: int, most: int = 0, seed: int = 42) -> DataFrame:
    """Purchases of ``start..end`` as positives, once for each key; with ``most``, so many of a customer's week at most."""
    rows = first_of_key(log.where(F.col("week_num").between(start, end)).withColumn("source", F.lit("positive")))
    if most:
        order = Window.partitionBy("customer_id", "week_num").orderBy(seeded(*KEY, seed=seed), "article_id")
        rows = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")
    return rows.select(*KEY, "price", "sales_channel_id", "source")


def labelled(positives: DataFrame, negatives: DataFrame, restrict: bool) -> DataFrame:
    """Candidates with label 1 where purchased; unless restricted, positives are rows of their own."""
    if restrict:
        seen = positives.select(*KEY).distinct().withColumn("_seen", F.lit(1))
        return negatives.join(seen, KEY, "left").withColumn("label", F.coalesce("_seen", F.lit(0))).drop("_seen")
    return positives.withColumn("label", F.lit(1)).unionByName(negatives.withColumn("label", F.lit(0)), allowMissingColumns=True)


def downsampled(rows: DataFrame, ratio: float, seed: int = 42) -> DataFrame:
    """At most ``ratio`` negatives for each positive, an equal share (rounded half-even) of each customer's week.

    Without positives nothing is taken away.
    """
    counts = rows.agg(F.sum("label").alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    share = F.least(F.lit(1.0), F.coalesce(F.try_divide(F.lit(float(ratio)) * F.col("pos"), F.col("neg")), F.lit(1.0)))
    share = counts.select(F.when(F.col("pos") > 0, share).otherwise(F.lit(1.0)).alias("_share"))
    group = Window.partitionBy("customer_id", "week_num", "label")
    ranked = rows.withColumn("_n", F.row_number().over(group.orderBy(seeded(*KEY, seed=seed), "article_id"))).withColumn("_of", F.count("*").over(group))
    kept = ranked.crossJoin(F.broadcast(share)).where((F.col("label") == 1) | (F.col("_n") <= F.bround(F.col("_share") * F.col("_of"))))
    return kept.drop("_n", "_of", "_share")


def candidate_features(rows: DataFrame, popular: DataFrame, calendar: Calendar) -> DataFrame:
    """``rows`` with year, month and week text, and the item's rank in the week before (999: none)."""
    rank = popular.select((F.col("week_num") + 1).alias("week_num"), "article_id", "bestseller_rank")
    out = date_features(rows, calendar.week_start(F.col("week_num"))).join(rank, ["week_num", "article_id"], "left")
    return out.withColumn("bestseller_rank", F.coalesce("bestseller_rank", F.lit(999.0)))


def negative_samples(log: DataFrame, pairs: DataFrame, start: int, end: int, k: int = 12, strategy: str | None = "last_purchase", train: bool = True, restrict: bool = False, default_week: int = 103) -> tuple[DataFrame, DataFrame]:
    """(candidates, popular items): popular ones of the week before for customers' weeks, and repurchases of these customers."""
    before = log.where(F.col("week_num").between(start - 1, end - 1))
    popular = weekly_popular_items(before, k)
    samples = [popularity_samples(pairs, popular, item_week_stats(before))]
    if strategy:
        samples.append(repurchase_samples(log, strategy, start, end, k, pairs, default_week))
    return combined_samples(log, samples, train, restrict), popular


def training_candidates(log: DataFrame, start: int, end: int, calendar: Calendar, k: int = 12, strategy: str | None = "last_purchase", restrict_positives: bool = True, ratio: float | None = None, customers=None) -> DataFrame:
    """Labelled candidates of ``start..end`` with their features; history before ``start - 1`` must be in ``log``.

    ``customers`` (a table or list) restricts whose candidates are made, not the sales by which items are popular.
    """
    if start > end:
        raise ValueError("the first week is after the last")
    positives = positive_samples(of_customers(log, customers), start, end)
    pairs = positives.select("customer_id", "week_num").distinct()
    negatives, popular = negative_samples(log, pairs, start, end, k, strategy, restrict=not restrict_positives)
    rows = labelled(positives, negatives, restrict_positives)
    if ratio is not None:
        rows = downsampled(rows, ratio)
    return candidate_features(rows, popular, calendar)


def target_customers(log: DataFrame, week: int, customers: DataFrame | list | None = None) -> DataFrame:
    """``customer_id`` of those to make candidates for: a table or list of customers, or all who buy in ``week``."""
    if customers is None:
        return log.where(F.col("week_num") == week).select("customer_id").distinct()
    if isinstance(customers, DataFrame):
        return customers.select("customer_id").where("customer_id is not null").distinct()
    kind = log.schema["customer_id"].dataType.simpleString()
    rows = [(c,) for c in dict.fromkeys(customers) if c is not None]
    return log.sparkSession.createDataFrame(rows, f"customer_id {kind}")


def inference_candidates(log: DataFrame, week: int, calendar: Calendar, k: int = 12, strategy: str | None = "last_purchase", customers: DataFrame | list | None = None) -> DataFrame:
    """Candidates of the target week, from history strictly before it, for ``customers``: a table or list, known or
    not, or all who buy in that week.

    Popular items are those of all customers' sales. A customer without history is offered these alone.
    """
    history = log.where(F.col("week_num") < week)
    pairs = target_customers(log, week, customers).withColumn("week_num", F.lit(week))
    rows, popular = negative_samples(history, pairs, week, week, k, strategy, train=False, default_week=week)
    return candidate_features(rows, popular, calendar)


def prepared(
    log: DataFrame, sample: str, start: int, end: int, calendar: Calendar, k: int = 12, strategy: str | None = "last_purchase", restrict_positives: bool = True, ratio: float | None = None, customers=None
) -> dict[str, DataFrame]:
    """Candidates of a sample by name: ``train`` has labelled ones of ``start..end``; ``valid`` and ``test`` have
    inference candidates of week ``end``, from history strictly before it, for ``customers`` or all who buy in that week.

    ``valid`` has ``train`` beside them, for early stopping: labelled candidates of the target week alone.
    The log must reach to the week before ``start`` at least.
    """
    if sample not in ("train", "valid", "test"):
        raise ValueError(f"no such sample: {sample}")
    if sample != "train" and start != end:
        raise ValueError("inference takes one week")
    if log.where(F.col("week_num") < start).isEmpty():
        raise ValueError("the log has no history before the first week")
    found = {}
    if sample != "test":
        found["train"] = training_candidates(log, start, end, calendar, k, strategy, restrict_positives, ratio, customers)
    if sample != "train":
        found["inference"] = inference_candidates(log, end, calendar, k, strategy, customers)
    return found
