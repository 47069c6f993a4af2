"""Rolling popularity kept up to date by a stream: weekly sums as stored deltas, and the lists that a batch of events changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

COUNTS = "week_num int, article_id long, n long, batch long"
LISTS = "week_num int, article_id long, total long, place int"
FIRST_ITEMS = "article_id long"


class RollingPopularity:
    """The k most popular items of every ``window`` weeks, in tables under ``root``, from events ``week_num, article_id``.

    A batch of events becomes rows of ``counts``, in partitions of its weeks and its own number: a batch that runs
    again after a failure overwrites what it wrote. Late events count in their own week, whenever they come: the lists
    of the weeks whose windows hold a week of the batch are made anew, and only these. In the end ``lists`` has what
    ``popularity.rolling_popular_items`` gives for all events at once. Events without week or item are left out.
    """

    def __init__(self, spark: SparkSession, root: str, window: int, k: int):
        self.spark, self.root, self.window, self.k = spark, root.rstrip("/"), window, k

    def _table(self, name: str, schema: str) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(path.toString()) if there else self.spark.createDataFrame([], schema)

    def counts(self) -> DataFrame:
        return self._table("counts", COUNTS)

    def lists(self) -> DataFrame:
        return self._table("lists", LISTS)

    def update(self, events: DataFrame, batch: int) -> None:
        """Takes up a batch of events: a function for ``foreachBatch``."""
        known = events.where("week_num is not null and article_id is not null").select(F.col("week_num").cast("int").alias("week_num"), F.col("article_id").cast("long").alias("article_id"))
        sums = known.groupBy("week_num", "article_id").agg(F.count("*").alias("n")).withColumn("batch", F.lit(batch).cast("long"))
        sums.write.partitionBy("week_num", "batch").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{self.root}/counts")
        counts = self.counts()
        own = counts.where(F.col("batch") == batch).agg(F.min("week_num"), F.max("week_num")).first()
        if own[0] is None:
            return
        span = counts.agg(F.min("week_num"), F.max("week_num")).first()
        listed = self.lists().agg(F.min("week_num"), F.max("week_num")).first()
        # items without sales fill up lists by their number: the 2k smallest of all are enough
        before = self._table("first_items", FIRST_ITEMS)
        smallest = before.unionByName(counts.where(F.col("batch") == batch).select("article_id")).distinct().orderBy("article_id").limit(2 * self.k)
        items = [r[0] for r in smallest.collect()]
        if listed[0] is None or span[0] < listed[0] or items != sorted(r[0] for r in before.collect()):
            first, last = span  # lists of any week may be filled up with other items
            self.spark.createDataFrame([(i,) for i in items], FIRST_ITEMS).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/first_items")
        else:
            first, last = min(own[0], listed[1] + 1), min(max(own[1] + self.window - 1, span[1] if span[1] > listed[1] else own[1]), span[1])
        self._list(counts, items, first, last)

    def _list(self, counts: DataFrame, items: list[int], first: int, last: int) -> None:
        """Writes the lists of the weeks ``first..last``, from the counts of their windows."""
        recent = counts.where(F.col("week_num").between(first - self.window + 1, last)).groupBy("week_num", "article_id").agg(F.sum("n").alias("v"))
        each = F.sequence(F.greatest(F.col("week_num"), F.lit(first)), F.least(F.col("week_num") + self.window - 1, F.lit(last)))
        moved = recent.select(F.explode(each).alias("week_num"), "article_id", "v")
        weeks = self.spark.range(first, last + 1, 1, 1).select(F.col("id").cast("int").alias("week_num"))
        none = weeks.withColumn("article_id", F.explode(F.array(*(F.lit(i).cast("long") for i in items)))).withColumn("v", F.lit(0).cast("long"))
        total = moved.unionByName(none).groupBy("week_num", "article_id").agg(F.sum("v").alias("total"))
        place = F.row_number().over(Window.partitionBy("week_num").orderBy(F.desc("total"), "article_id"))
        top = total.withColumn("place", place).where(F.col("place") <= self.k)
        top.write.partitionBy("week_num").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{self.root}/lists")

    def start(self, events: DataFrame) -> StreamingQuery:
        """Follows a stream until what is there now has been read; run again with the same root, it goes on where it ended."""
        return events.writeStream.foreachBatch(self.update).option("checkpointLocation", f"{self.root}/progress").trigger(availableNow=True).start()
