"""Sources and sinks: typed CSV and Parquet reads, result bundles, path layout, and the test tables as a purchase log."""

from __future__ import annotations

import json
from functools import cached_property
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import with_week_num
from ..functions.scalars import hex_id

RAW_TRANSACTIONS = "t_dat string, customer_id string, article_id string, price double, sales_channel_id int"
#: Lines that a task joins to their orders, and the lines up to which the session decides.
PART_LINES, FEW_LINES = 500_000, 4_000_000
KINDS = ("raw", "candidates", "article_features", "customer_features", "embeddings", "ranking")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header by a given schema: nothing is inferred, and malformed rows fail."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def clean_transactions(raw: DataFrame, last_week: int = 104) -> DataFrame:
    """Typed purchase log: dates, numeric ids, and the week relative to its latest day."""
    typed = raw.select(F.to_date("t_dat", "yyyy-MM-dd").alias("t_dat"), hex_id(F.col("customer_id")).alias("customer_id"), F.col("article_id").cast("int"), F.col("price").cast("float"), F.col("sales_channel_id").cast("byte"))
    return with_week_num(typed, last_week=last_week)


def clean_customers(raw: DataFrame) -> DataFrame:
    """Typed customers; flags that are missing are 0."""
    flags = {c: F.coalesce(F.col(c).cast("byte"), F.lit(0).cast("byte")) for c in ("FN", "Active") if c in raw.columns}
    return raw.withColumns({"customer_id": hex_id(F.col("customer_id")), "age": F.col("age").cast("double")} | flags)


def clean_articles(raw: DataFrame) -> DataFrame:
    """Typed articles; long integers become int."""
    longs = {c: F.col(c).cast("int") for c, kind in raw.dtypes if kind == "bigint"}
    return raw.withColumns(longs | {"article_id": F.col("article_id").cast("int")})


def path_to(root: str, kind: str, subsample: float = 1, seed: int = 42) -> str:
    """Where a stage's tables are: ``full``, or a folder for a share of customers; embeddings are always full."""
    if kind not in KINDS:
        raise ValueError(f"no such kind of table: {kind}")
    part = "full" if subsample == 1 or kind == "embeddings" else f"subsample_{subsample}_{seed}"
    return str(PurePosixPath(root, kind, part)) if "://" not in root else f"{root.rstrip('/')}/{kind}/{part}"


class Bundle:
    """Named tables and a small JSON document in one folder, read and written by Spark's own file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def save(self, tables: dict[str, DataFrame], meta: dict | None = None, partition_by: dict[str, list[str]] | None = None, sort_by: dict[str, list[str]] | None = None) -> None:
        """Writes all tables; ``sort_by`` orders the rows of each file of a table, without a shuffle."""
        for name, df in tables.items():
            if sort_by and name in sort_by:
                df = df.sortWithinPartitions(*sort_by[name])
            df.write.mode("overwrite").partitionBy(*(partition_by or {}).get(name, [])).parquet(f"{self.path}/{name}")
        text = json.dumps({"tables": sorted(tables), "meta": meta or {}}, default=str)
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/metadata")

    def meta(self) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/metadata", wholetext=True).first()[0])

    def load(self, name: str) -> DataFrame:
        if name not in self.meta()["tables"]:
            raise ValueError(f"{self.path} has no table {name}")
        return self.spark.read.parquet(f"{self.path}/{name}")


def load_kind(spark: SparkSession, root: str, kind: str, table: str, subsample: float = 1, seed: int = 42, sample: str | None = None) -> DataFrame:
    """A table of one of the KINDS, from the folder of its share of customers; with ``sample`` (train, valid or test), that part of it."""
    if sample not in (None, "train", "valid", "test"):
        raise ValueError(f"no such sample: {sample}")
    return Bundle(spark, path_to(root, kind, subsample, seed)).load(f"{table}_{sample}" if sample else table)


def save_mapping(mapping: DataFrame, path: str) -> None:
    """A table ``(key, list)`` as lines of JSON; large maps stay tables."""
    mapping.write.mode("overwrite").json(path)


def read_mapping(spark: SparkSession, path: str, schema: str = "customer_id long, articles array<long>") -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_mapping_object(spark: SparkSession, path: str) -> DataFrame:
    """``customer_id, articles`` of one JSON object ``{customer: [articles]}`` in a file: one task reads it whole, so keep large maps as lines."""
    text = spark.read.text(path, wholetext=True)
    pairs = text.select(F.explode(F.from_json("value", "map<string,array<bigint>>")).alias("customer_id", "articles"))
    return pairs.withColumn("customer_id", F.col("customer_id").cast("long"))


def read_images(spark: SparkSession, ids: DataFrame, root: str) -> DataFrame:
    """``article_id, content, image_missing``: image files by item, left-joined so that items without one stay."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jpg").load(root)
    files = files.select(F.regexp_extract("path", r"0*(\d+)\.jpg$", 1).cast("long").alias("article_id"), "content")
    return ids.select(F.col("article_id").cast("long")).distinct().join(files, "article_id", "left").withColumn("image_missing", F.col("content").isNull())


class Domain:
    """The test tables as a purchase log: orders with their lines, customers, parts as articles, embeddings.

    Prices are whole cents, so that sums do not depend on the order of rows.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def transactions(self) -> DataFrame:
        orders = self.table("orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("customer_id"), F.to_date("o_orderdate").alias("t_dat"))
        lines = self.table("lineitem").select(
            F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("article_id"), F.round(F.col("l_extendedprice") * 100).alias("price"), F.when(F.col("l_linestatus") == "O", 1).otherwise(2).alias("sales_channel_id"), F.col("l_quantity").alias("quantity")
        )
        # the last day of the log is that of its orders; lines are joined to orders once
        last = orders.agg(F.max("t_dat").alias("_last"))
        dated = orders.crossJoin(F.broadcast(last)).withColumn("week_num", (F.lit(104) - F.floor(F.datediff("_last", "t_dat") / 7)).cast("int")).drop("_last")
        if self._n_lines > FEW_LINES:  # parts of the session's size hold many millions of these narrow rows
            parts = self._n_lines // PART_LINES + 1
            lines, dated = lines.repartition(parts, "k"), dated.repartition(parts, "k")
        return lines.join(dated, "k").drop("k")

    @cached_property
    def _n_lines(self) -> int:
        """Counted in the files' footers."""
        return self.table("lineitem").count()

    @property
    def customers(self) -> DataFrame:
        age = F.when(F.col("c_acctbal") >= 0, (F.col("c_custkey") % 60 + 16).cast("double"))
        return self.table("customer").select(
            F.col("c_custkey").alias("customer_id"), age.alias("age"), F.col("c_mktsegment").alias("club_member_status"), F.when(F.col("c_custkey") % 7 != 0, F.concat(F.lit("F"), (F.col("c_custkey") % 3).cast("string"))).alias("fashion_news_frequency"), F.col("c_nationkey").cast("string").alias("postal_code")
        )

    @property
    def articles(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("article_id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").alias("size"), F.col("p_name").alias("name"))

    @property
    def embeddings(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("article_id"), F.col("embedding").cast("array<double>").alias("vector"))
