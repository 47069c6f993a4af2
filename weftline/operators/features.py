"""Static features, ordinal codes, and point-in-time panels of items and customers by week."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.encoding import encoded, ordinal_codes
from ..functions.scalars import AGE_EDGES, age_bin
from .repurchase import last_k_changes


def customer_features(customers: DataFrame, columns: list[str], nulls: str = "fill", fill: dict | None = None, edges=AGE_EDGES, keep_age: bool = True) -> DataFrame:
    """Customers with lower-case names, nulls filled or dropped, age bins, the median for missing ages, and codes."""
    df = customers.toDF(*(c.lower() for c in customers.columns))
    if nulls == "fill":
        df = df.fillna(fill or {})
    elif nulls == "drop":
        df = df.na.drop("any")
    else:
        raise ValueError(f"no such way with nulls: {nulls}")
    df = df.withColumn("age_bin", age_bin(F.col("age"), edges))
    middle = df.agg(F.median("age").alias("_median"))
    df = df.crossJoin(F.broadcast(middle)).withColumn("age", F.coalesce("age", "_median")).drop("_median")
    df = encoded(df, ordinal_codes(df, columns), columns)
    return df if keep_age else df.drop("age")


def weeks_of(ids: DataFrame, start: int, end: int) -> DataFrame:
    """Every id with every week of ``start..end``."""
    return ids.withColumn("week_num", F.explode(F.sequence(F.lit(start), F.lit(end))))


def _filled(columns: dict[str, str], key: str) -> dict:
    """The last known value at or before each week."""
    order = Window.partitionBy(key).orderBy("week_num").rowsBetween(Window.unboundedPreceding, 0)
    return {name: F.last(c, ignorenulls=True).over(order) for name, c in columns.items()}


def carried_means(rows: DataFrame, key: str, value: str, start: int, end: int) -> DataFrame:
    """``week_num, _mean``: the mean over all ids of their last known values, for each week of ``start..end``.

    A value holds until the id's next one: each takes its place in the sum of its week, and sums run over the weeks. So the filled
    panel isn't needed, which has a row for each id and week.
    """
    known = rows.where(F.col(value).isNotNull() & F.col("week_num").between(start, end))
    before = F.lag(value).over(Window.partitionBy(key).orderBy("week_num"))
    changes = known.select("week_num", (F.col(value) - F.coalesce(before, F.lit(0.0))).alias("_more"), F.when(before.isNull(), 1).otherwise(0).alias("_new"))
    weekly = changes.groupBy("week_num").agg(F.sum("_more").alias("_more"), F.sum("_new").alias("_new"))
    kind = rows.schema["week_num"].dataType
    weeks = rows.sparkSession.range(start, end + 1, 1, 1).select(F.col("id").cast(kind).alias("week_num")).join(weekly, "week_num", "left")
    so_far = Window.orderBy("week_num").rowsBetween(Window.unboundedPreceding, 0)  # a row for each week
    return weeks.select("week_num", F.try_divide(F.sum("_more").over(so_far), F.sum("_new").over(so_far)).alias("_mean"))


def cumulative_ages(log: DataFrame, customers: DataFrame, count_null_ages: bool = True) -> DataFrame:
    """``article_id, week_num, cumulative_mean_age, cumulative_sales_count`` of the weeks in which an item is sold.

    Buyers count up to the last one of the week, in order of customer_id, whose age is known; by default
    those without an age count in the divisor. Sums by item and week come first, so that an item with very many sales
    is no large group.
    """
    ages = customers.select("customer_id", "age")
    buyers = log.groupBy("article_id", "week_num", "customer_id").agg(F.count("*").alias("n")).join(ages, "customer_id", "left")
    last = buyers.groupBy("article_id", "week_num").agg(F.max(F.when(F.col("age").isNotNull(), F.col("customer_id"))).alias("last"))
    weekly = buyers.join(last, ["article_id", "week_num"]).groupBy("article_id", "week_num").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("age")).alias("age"), F.sum(F.when(F.col("customer_id") <= F.col("last"), F.col("n"))).alias("upto"), F.sum(F.when(F.col("age").isNotNull(), F.col("n"))).alias("known")
    )
    so_far = Window.partitionBy("article_id").orderBy("week_num").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n").over(so_far)
    divisor = total - F.col("n") + F.col("upto") if count_null_ages else F.sum("known").over(so_far)
    mean = F.when(F.col("age").isNotNull(), F.sum("age").over(so_far) / divisor)
    return weekly.select("article_id", "week_num", mean.alias("cumulative_mean_age"), total.alias("cumulative_sales_count"))


def item_week_panel(log: DataFrame, articles: DataFrame, customers: DataFrame, start: int, end: int, history: tuple[int, int]) -> DataFrame:
    """Every item in every week of ``start..end``: sales, mean price, mean age of buyers and sales so far.

    Prices and running figures are carried on from the last week in the grid; a price that is still
    missing is the mean of the week, an age the median of all customers, counts are 0. Sales before the grid
    count in the running figures only from the item's first sale in the grid.
    """
    log = log.where(F.col("week_num").between(*history))
    inside = F.col("week_num").between(start, end)
    weekly = log.where(inside).groupBy("article_id", "week_num").agg(F.count("t_dat").alias("sold"), F.avg("price").alias("price"))
    running = cumulative_ages(log, customers).where(inside)
    ids = articles.select("article_id").distinct()
    grid = weeks_of(ids, start, end)
    joined = grid.join(weekly.join(running, ["article_id", "week_num"], "left"), ["article_id", "week_num"], "left")
    out = joined.withColumns(_filled({"price": "price", "cumulative_mean_age": "cumulative_mean_age", "cumulative_sales_count": "cumulative_sales_count"}, "article_id"))
    means = carried_means(weekly.join(ids, "article_id", "left_semi"), "article_id", "price", start, end)
    middle = customers.agg(F.median("age").alias("_median"))
    out = out.join(F.broadcast(means), "week_num").crossJoin(F.broadcast(middle))
    return out.select(
        "article_id", "week_num", F.coalesce("sold", F.lit(0)).alias("weekly_sales_count"), F.coalesce("price", "_mean").alias("weekly_avg_price"),
        F.coalesce("cumulative_mean_age", "_median").alias("cumulative_mean_age"), F.coalesce("cumulative_sales_count", F.lit(0)).alias("cumulative_sales_count"),
    )


def vector_means(rows: DataFrame, keys: list[str], vector: str = "vector") -> DataFrame:
    """The mean vector of each group, element by element, with partial sums before the exchange."""
    flat = rows.select(*keys, F.posexplode(vector).alias("_at", "_x")).groupBy(*keys, "_at").agg(F.avg("_x").alias("_x"))
    return flat.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_x"))), lambda s: s["_x"]).alias(vector))


def _any(columns) -> Column:
    """Whether one of the columns is known."""
    found = F.lit(False)
    for c in columns:
        found = found | F.col(c).isNotNull()
    return found


def customer_week_panel(log: DataFrame, embeddings: DataFrame, start: int, end: int, history: tuple[int, int], k: int = 5, vectors: dict[str, str] | None = None) -> DataFrame:
    """Every customer active in ``start..end``, in every week of it: mean price and vectors of the k latest distinct items.

    ``vectors`` names the columns of ``embeddings`` that are averaged (of texts and of images, say) and what their means are called. Where none
    of the k items is in ``embeddings`` with a vector, neither price nor means are known; they are carried on from earlier
    weeks of the grid, and a price that is still missing is the week's mean.
    """
    vectors = vectors or {"vector": "customer_avg_embedding"}
    log = log.where(F.col("week_num").between(*history))
    latest = last_k_changes(log, k, start, end)  # what holds until the next change is carried on below
    with_vectors = latest.join(embeddings.select("article_id", *vectors), "article_id", "left")
    key = ["customer_id", "week_num"]
    prices = with_vectors.groupBy(*key).agg(F.avg("price").alias("price"), F.count_if(_any(vectors)).alias("n")).where("n > 0").drop("n")
    active = log.where(F.col("week_num").between(start, end)).select("customer_id").distinct()
    known = prices
    for v in vectors:
        known = known.join(vector_means(with_vectors.where(F.col(v).isNotNull()), key, v), key, "left")
    grid = weeks_of(active, start, end).join(known, key, "left")
    out = grid.withColumns(_filled({c: c for c in ("price", *vectors)}, "customer_id"))
    week = carried_means(prices.join(active, "customer_id", "left_semi"), "customer_id", "price", start, end)
    out = out.join(F.broadcast(week), "week_num")
    return out.select("customer_id", "week_num", F.coalesce("price", "_mean").alias("customer_avg_price"), *(F.col(v).alias(name) for v, name in vectors.items()))
