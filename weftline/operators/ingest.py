"""From raw tables to the stored training, validation and test parts of the purchase log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import split_of
from ..sources.scratch import discard, stored
from ..sources.tables import Bundle, clean_articles, clean_customers, clean_transactions
from .subsets import customer_items, subsample

#: How each table's files are sorted, so that row groups can be skipped by customer, item and day.
LAYOUT = {"customers": ["customer_id"], "articles": ["article_id"]} | {f"log_{part}": ["t_dat", "customer_id", "article_id"] for part in ("train", "valid", "test")}


def ingest(transactions: DataFrame, customers: DataFrame, articles: DataFrame, bundle: Bundle, share: float = 1, seed: int = 42, last_week: int = 104) -> Bundle:
    """Cleans raw tables, keeps a share of the customers, splits the log and saves all of it to ``bundle``.

    The last week of the whole log is the test part, the one before is the validation part. Tables:
    ``log_train``, ``log_valid``, ``log_test``, ``customers``, ``articles``, and each customer's items in
    the later parts, ``items_valid`` and ``items_test``. Rows without a day are in no part.
    """
    log, customers, articles = clean_transactions(transactions, last_week), clean_customers(customers), clean_articles(articles)
    if share < 1:
        log, customers, articles = subsample(log, customers, articles, share, seed)
    log = stored(log.withColumn("part", split_of(log["week_num"], last_week - 1, last_week)), "cleaned-log", partition_by=["part"])
    tables = {f"log_{name}": log.where(F.col("part") == name).drop("part") for name in ("train", "valid", "test")}
    tables |= {f"items_{name}": customer_items(tables[f"log_{name}"]) for name in ("valid", "test")}
    bundle.save(tables | {"customers": customers, "articles": articles}, {"share": share, "seed": seed, "last_week": last_week}, sort_by=LAYOUT)
    discard(log)
    return bundle
