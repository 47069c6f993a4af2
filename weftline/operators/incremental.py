"""Weekly panels by appending: a week costs its own purchases and the state that the week before left, not all history.

States and panels are tables partitioned by week. A week that is appended again reads the state before it and
overwrites its own partitions, so a run that failed is simply repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .features import vector_means
from .repurchase import last_k_distinct

ITEM_STATE = "article_id long, n long, age double, price double, mean_age double, so_far long, sold long, week_num int"
CUSTOMER_STATE = "customer_id long, items array<struct<d:date,a:long,p:double>>, active boolean, price double, vector array<double>, week_num int"


class PanelStore:
    """Item and customer panels of the weeks from ``start`` on, in tables under ``root``; ``k`` latest distinct items count for a customer.

    ``begin`` takes the history before ``start``; then ``append`` takes the purchases of one week after the other. The rows of an
    appended week are those that ``item_week_panel`` and ``customer_week_panel`` give for it when the grid ends there: all items, and the
    customers who were active in the grid until then. Log, customers and items are as there.
    """

    def __init__(self, spark: SparkSession, root: str, start: int, k: int = 5):
        self.spark, self.root, self.start, self.k = spark, root.rstrip("/"), start, k

    def _write(self, df: DataFrame, name: str, week: int) -> None:
        df.withColumn("week_num", F.lit(week)).write.partitionBy("week_num").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{self.root}/{name}")

    def _read(self, name: str, schema: str, week: int) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}").where(F.col("week_num") == week).drop("week_num")

    def item_panel(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/item_panel")

    def customer_panel(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/customer_panel")

    def begin(self, log: DataFrame, customers: DataFrame) -> None:
        """The state before the grid, from purchases before ``start``."""
        past = log.where(F.col("week_num") < self.start)
        sums = past.join(customers.select("customer_id", "age"), "customer_id", "left").groupBy("article_id").agg(F.count("*").alias("n"), F.coalesce(F.sum("age"), F.lit(0.0)).alias("age"))
        empty = {"price": F.lit(None).cast("double"), "mean_age": F.lit(None).cast("double"), "so_far": F.lit(None).cast("long"), "sold": F.lit(0).cast("long")}
        self._write(_typed(sums.withColumns(empty), ITEM_STATE), "item_state", self.start - 1)
        last = self.start - 1
        latest = last_k_distinct(past, self.k, last, last).join(past.groupBy("customer_id", "article_id").agg(F.max("t_dat").alias("d")), ["customer_id", "article_id"])
        items = latest.groupBy("customer_id").agg(F.collect_list(F.struct(F.col("d"), F.col("article_id").alias("a"), F.col("price").alias("p"))).alias("items"))
        empty = {"active": F.lit(False), "price": F.lit(None).cast("double"), "vector": F.lit(None).cast("array<double>")}
        self._write(_typed(items.withColumns(empty), CUSTOMER_STATE), "customer_state", self.start - 1)

    def append(self, sales: DataFrame, week: int, articles: DataFrame, customers: DataFrame, embeddings: DataFrame) -> None:
        """Takes up the purchases of a week; those of other weeks in ``sales`` are left out. Weeks come in order: the one before must be there."""
        if week < self.start:
            raise ValueError("the week is before the panels' first")
        sales = sales.where(F.col("week_num") == week)
        self._write(_typed(next_items(self._read("item_state", ITEM_STATE, week - 1), sales, articles, customers), ITEM_STATE), "item_state", week)
        self._write(item_rows(self._read("item_state", ITEM_STATE, week), articles, customers), "item_panel", week)
        known = next_customers(self._read("customer_state", CUSTOMER_STATE, week - 1), sales, embeddings, self.k, all_changed=week == self.start)
        self._write(_typed(known, CUSTOMER_STATE), "customer_state", week)
        self._write(customer_rows(self._read("customer_state", CUSTOMER_STATE, week)), "customer_panel", week)


def _typed(df: DataFrame, schema: str) -> DataFrame:
    names = [f.split(" ", 1) for f in schema.split(", ")]
    return df.select(*(F.col(n).cast(kind).alias(n) for n, kind in names if n != "week_num"))


def next_items(state: DataFrame, sales: DataFrame, articles: DataFrame, customers: DataFrame) -> DataFrame:
    """The items' state after a week: purchases and ages so far, and the last known price, mean age and count."""
    buyers = sales.groupBy("article_id", "customer_id").agg(F.count("*").alias("n"), F.count("t_dat").alias("dated"), F.sum("price").alias("paid"), F.count("price").alias("priced"))
    buyers = buyers.join(customers.select("customer_id", "age"), "customer_id", "left")
    last = buyers.groupBy("article_id").agg(F.max(F.when(F.col("age").isNotNull(), F.col("customer_id"))).alias("_last"))
    week = buyers.join(last, "article_id").groupBy("article_id").agg(
        F.sum("n").alias("_n"), F.sum("dated").alias("_sold"), F.try_divide(F.sum("paid"), F.sum("priced")).alias("_price"), F.sum(F.col("n") * F.col("age")).alias("_age"), F.sum(F.when(F.col("customer_id") <= F.col("_last"), F.col("n"))).alias("_upto")
    )
    ids = articles.select(F.col("article_id").cast("long")).distinct().join(state, "article_id", "full").join(week, "article_id", "full")
    before = F.coalesce("n", F.lit(0))
    age = F.coalesce("age", F.lit(0.0)) + F.coalesce("_age", F.lit(0.0))
    total = before + F.coalesce("_n", F.lit(0))
    mean = F.when(F.col("_age").isNotNull(), age / (before + F.col("_upto")))
    return ids.select(
        "article_id", total.alias("n"), age.alias("age"), F.coalesce("_price", "price").alias("price"), F.coalesce(mean, "mean_age").alias("mean_age"),
        F.when(F.col("_n").isNotNull(), total).otherwise(F.col("so_far")).alias("so_far"), F.coalesce("_sold", F.lit(0)).alias("sold"),
    )


def item_rows(state: DataFrame, articles: DataFrame, customers: DataFrame) -> DataFrame:
    """The panel's rows of the week that a state is of."""
    own = state.join(articles.select(F.col("article_id").cast("long")).distinct(), "article_id", "left_semi")
    fill = own.agg(F.avg("price").alias("_mean")).crossJoin(customers.agg(F.median("age").alias("_median")))  # one row
    return own.crossJoin(F.broadcast(fill)).select(
        "article_id", F.col("sold").alias("weekly_sales_count"), F.coalesce("price", "_mean").alias("weekly_avg_price"), F.coalesce("mean_age", "_median").alias("cumulative_mean_age"), F.coalesce("so_far", F.lit(0)).alias("cumulative_sales_count")
    )


def next_customers(state: DataFrame, sales: DataFrame, embeddings: DataFrame, k: int, all_changed: bool = False) -> DataFrame:
    """The customers' state after a week: their k latest distinct items, and the last known mean price and vector of these.

    An item counts at its latest purchase (of one day, that of the lowest price and channel). Only customers who buy
    have other items than before; with ``all_changed``, means are made for all: in the first week of the grid.
    """
    day = F.min(F.struct((-F.unix_date("t_dat")).alias("d"), "price", "sales_channel_id", "t_dat"))
    # a week's distinct items of a customer
    fresh = sales.groupBy("customer_id", "article_id").agg(day.alias("x")).groupBy("customer_id").agg(F.collect_list(F.struct(F.col("x.t_dat").alias("d"), F.col("article_id").cast("long").alias("a"), F.col("x.price").cast("double").alias("p"))).alias("_fresh"))
    both = state.join(fresh.withColumn("customer_id", F.col("customer_id").cast("long")), "customer_id", "full")
    old = F.coalesce("items", F.array().cast("array<struct<d:date,a:long,p:double>>"))
    new = F.coalesce("_fresh", F.array().cast("array<struct<d:date,a:long,p:double>>"))
    kept = F.filter(old, lambda r: ~F.array_contains(F.transform(new, lambda n: n["a"]), r["a"]))
    ranked = F.array_sort(F.transform(F.concat(new, kept), lambda r: F.struct((-F.unix_date(r["d"])).alias("o"), r["a"].alias("a"), r.alias("r"))))
    both = both.withColumn("_items", F.slice(F.transform(ranked, lambda s: s["r"]), 1, k)).withColumn("_bought", F.col("_fresh").isNotNull())
    changed = both.where(F.lit(True) if all_changed else F.col("_bought")).select("customer_id", F.explode("_items").alias("r"))
    priced = changed.select("customer_id", F.col("r.a").alias("article_id"), F.col("r.p").alias("p")).join(embeddings.select(F.col("article_id").cast("long"), F.col("vector").alias("v")), "article_id", "left")
    means = priced.groupBy("customer_id").agg(F.avg("p").alias("_price"), F.count("v").alias("_n")).where("_n > 0").drop("_n")
    vectors = vector_means(priced.where("v is not null"), ["customer_id"], "v").withColumnRenamed("v", "_vector")
    out = both.join(means.join(vectors, "customer_id"), "customer_id", "left")
    return out.select("customer_id", F.col("_items").alias("items"), (F.coalesce("active", F.lit(False)) | F.col("_bought")).alias("active"), F.coalesce("_price", "price").alias("price"), F.coalesce("_vector", "vector").alias("vector"))


def customer_rows(state: DataFrame) -> DataFrame:
    """The panel's rows of the week that a state is of: customers who were active in the grid."""
    own = state.where("active")
    mean = own.agg(F.avg("price").alias("_mean"))  # one row
    return own.crossJoin(F.broadcast(mean)).select("customer_id", F.coalesce("price", "_mean").alias("customer_avg_price"), F.col("vector").alias("customer_avg_embedding"))
