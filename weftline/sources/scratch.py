"""Tables that cut lineage, written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Removes the shuffle files of a query when it has ended; its result is in the table by then.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; in local mode, where it may be unset, a fresh temporary folder."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="spark-weftline-")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def qualified(spark: SparkSession, path: str) -> str:
    """A path without a scheme as one of the file system that the session has by default, so that tasks mean the same place."""
    if "://" in path or path.startswith("file:"):
        return path
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(folder).toString()


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/weftline-{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str, *replaced: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: a lost executor costs no recomputation before it.

    Tables in ``replaced``, stored before, are deleted once this one is whole: nothing may read them any more.
    With ``partition_by``, rows of each value are in folders of their own, and reads of one value skip the others.
    """
    spark = df.sparkSession
    path = new_dir(spark, name)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").partitionBy(*(partition_by or [])).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    discard(*replaced)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for df in tables:
        if path := _paths.pop(df, None):
            context = df.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
