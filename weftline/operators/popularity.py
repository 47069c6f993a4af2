"""Popular items by week, rolling popularity, weekly item statistics, and candidates drawn from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of moved sums that a task is given.
PART_ROWS = 1_000_000


def weekly_popular_items(log: DataFrame, k: int = 12, week: str = "week_num", item: str = "article_id") -> DataFrame:
    """``week, item, bestseller_rank``: the k best items of each week, by dense rank of sales, ties by item."""
    counts = log.where(F.col(item).isNotNull() & F.col(week).isNotNull()).groupBy(week, item).agg(F.count("*").alias("n"))
    cut = counts.withColumn("row", F.row_number().over(Window.partitionBy(week).orderBy(F.desc("n"), item))).where(F.col("row") <= k)
    # among the first k rows, ranks are dense as they are among all
    rank = F.dense_rank().over(Window.partitionBy(week).orderBy(F.desc("n"))).cast("double")
    return cut.select(week, item, rank.alias("bestseller_rank"))


def rolling_popular_items(log: DataFrame, window: int, k: int, week: str = "week_num", item: str = "article_id", value: str | None = None) -> DataFrame:
    """``week, item, total``: the k items with the largest sums over the last ``window`` weeks, for every week from first to last.

    A negative value is an error. Each week's sums go to the weeks that they count in; items without
    sales rank after all others by their number, and the 2k smallest of them are enough to fill up a list.
    All sums of an item are in one part, in which totals and the part's own lists are made without a further exchange;
    there are as many parts as the rows ask for, so that a task's part doesn't grow with the table.
    """
    log = log.where(F.col(item).isNotNull() & F.col(week).isNotNull())
    sold = log.select(week, item, *([value] if value else []))
    # one pass tells whether there is anything to rank, what is wrong with it, which weeks there are and how many parts are wanted
    found = sold.agg(F.min(week), F.max(week), F.min(value) if value else F.lit(0), F.count("*")).first()
    first, last, least, n_rows = found
    if first is None:
        raise ValueError("no rows to rank")
    if least is not None and least < 0:
        raise ValueError("values must not be negative")
    kind = log.schema[week].dataType
    parts = n_rows * window // PART_ROWS + 1
    sums = sold.groupBy(week, item).agg((F.sum(value) if value else F.count("*")).alias("v"))  # of an item with very many sales a row a week is left
    moved = sums.repartition(parts, item).select(F.explode(F.sequence(F.col(week), F.least(F.col(week) + window - 1, F.lit(last)).cast(kind))).alias(week), item, "v")
    order = Window.partitionBy(week).orderBy(F.desc("total"), item)
    best = lambda rows: rows.groupBy(week, item).agg(F.sum("v").alias("total")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    weeks = log.sparkSession.range(first, last + 1, 1, 1).select(F.col("id").cast(kind).alias(week))
    filler = log.select(item).distinct().orderBy(item).limit(2 * k)
    none = weeks.crossJoin(F.broadcast(filler)).withColumn("v", F.lit(0))
    # what the k best sold items leave behind ranks after them whatever fills the list up
    listed = best(moved).select(week, item, F.col("total").alias("v"))
    return best(listed.unionByName(none)).select(week, item, "total", "place")


def item_week_stats(log: DataFrame, week: str = "week_num", item: str = "article_id", price: str = "price", channel: str = "sales_channel_id") -> DataFrame:
    """``week, item, count, avg_price, mode_<channel>``; the smallest of equally frequent channels counts.

    Rows are counted and summed by channel first, with partial sums; an item has few channels to choose from.
    """
    known = log.where(F.col(item).isNotNull() & F.col(week).isNotNull())
    by_channel = known.groupBy(week, item, channel).agg(F.count("*").alias("n"), F.sum(price).alias("total"), F.count(price).alias("priced"))
    most = F.max_by(channel, F.when(F.col(channel).isNotNull(), F.struct("n", -F.col(channel))))
    return by_channel.groupBy(week, item).agg(F.sum("n").alias("count"), F.try_divide(F.sum("total"), F.sum("priced")).alias("avg_price"), most.alias(f"mode_{channel}"))


def default_prediction(popular: DataFrame, week: int) -> DataFrame:
    """The popular items of the week before, best first: what is offered to unknown customers (k rows)."""
    return popular.where(F.col("week_num") == week - 1).select("article_id", "bestseller_rank").orderBy("bestseller_rank", "article_id")


def popularity_samples(pairs: DataFrame, popular: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """For each customer and week, the popular items of the week before, with their price and channel there.

    A pair without popular items has no rows. The lists are k items for each week: a table that
    Spark may broadcast by its size.
    """
    listed = popular.select((F.col("week_num") + 1).alias("week_num"), "article_id")
    out = pairs.select("customer_id", "week_num").distinct().join(listed, "week_num")
    if stats is not None:
        known = stats.select((F.col("week_num") + 1).alias("week_num"), "article_id", F.col("avg_price").alias("price"), F.col("mode_sales_channel_id").alias("sales_channel_id"))
        out = out.join(known, ["week_num", "article_id"], "left")
    return out.withColumn("source", F.lit("popularity"))
