"""Queries do their whole job, and their tasks stay small whatever the tables' sizes."""

from pyspark.sql import functions as F

from weftline.operators import popularity, profiles
from weftline.plans import registry
from weftline.sources import tables
from weftline.sources.tables import Domain

SF = "/root/testdata/sf0.001"


def test_inference_candidates_are_made_for_all_customers(spark):
    log = Domain(spark, SF).transactions
    ids = lambda df: {r[0] for r in df.select("customer_id").distinct().collect()}
    wanted, buyers = ids(log.where(F.col("week_num") <= registry.NEXT)), ids(log.where(F.col("week_num") == registry.NEXT))
    assert ids(registry.QUERIES["inference_candidates"](spark, SF)) == wanted and len(wanted) > len(buyers)


def lists(df, *keys):
    return [tuple(r) for r in df.orderBy(*keys).collect()]


def test_described_quartiles_need_no_task_with_all_values(spark):
    """As by ``percentile``, over many ranges, with nulls, one value only, and none at all; no aggregate keeps the values of a column."""
    rows = [(n % 997 * 1.5, 7 if n % 3 else None, (n * n) % 10007 - 5000, None) for n in range(20000)]
    df = spark.createDataFrame(rows, "a double, b int, c long, d double").repartition(7)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = profiles.described(df)
        got = lists(found.select("column", "q1", "median", "q3"), "column")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    want = []
    for c in df.columns:
        x = F.percentile(F.col(c).cast("double"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        want.append((c, *df.agg(x[0], x[1], x[2]).first()))
    assert got == want
    assert "percentile(" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_rolling_parts_grow_with_the_rows(spark, monkeypatch):
    """The same lists from parts of any size; the moved sums are not dealt out again by week and item."""
    log = spark.createDataFrame([(n % 9, (n * n) % 61, n % 4) for n in range(3000)], "week_num int, article_id int, q int")
    whole = lists(popularity.rolling_popular_items(log, 4, 5, value="q"), "week_num", "place")
    monkeypatch.setattr(popularity, "PART_ROWS", 500)
    small = popularity.rolling_popular_items(log, 4, 5, value="q")
    assert lists(small, "week_num", "place") == whole
    assert "RepartitionByExpression [article_id" in small._jdf.queryExecution().optimizedPlan().toString()
    assert ", 25" in [line for line in small._jdf.queryExecution().optimizedPlan().toString().split("\n") if "RepartitionByExpression" in line][0]


def test_transactions_are_joined_in_parts(spark, monkeypatch):
    whole = lists(Domain(spark, SF).transactions, "customer_id", "t_dat", "article_id", "price", "quantity")
    monkeypatch.setattr(tables, "FEW_LINES", 100)
    monkeypatch.setattr(tables, "PART_LINES", 1000)
    log = Domain(spark, SF).transactions
    assert lists(log, "customer_id", "t_dat", "article_id", "price", "quantity") == whole
    assert log.rdd.getNumPartitions() == Domain(spark, SF)._n_lines // 1000 + 1


def test_rankers_read_a_stored_matrix(spark, monkeypatch):
    """They go over their rows several times, so these must not be joined anew."""
    seen = []

    class Looks:
        def __init__(self, config):
            self.features = config.features

        def train(self, rows, valid=None):
            seen.extend([rows] if valid is None else [rows, valid])
            return self

        def ranks(self, rows, k):
            seen.append(rows)
            return rows

    monkeypatch.setattr(registry.ranking, "GbtRanker", Looks)
    registry.QUERIES["gbt_rank_topk"](spark, SF)
    assert len(seen) == 2 and not any("Join" in df._jdf.queryExecution().optimizedPlan().toString() for df in seen)


def test_data_checks_make_each_table_once(spark, monkeypatch):
    made = []

    def counted(module, name):
        own = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, **k: made.append(name) or own(*a, **k))

    counted(registry.features, "item_week_panel")
    counted(registry.features, "customer_week_panel")
    counted(registry.O, "training_candidates")
    registry.QUERIES["data_checks"](spark, SF)
    assert sorted(made) == ["customer_week_panel", "item_week_panel", "training_candidates"]


def test_values_of_sketched_columns_meet_their_medians_without_a_shuffle_by_column(spark):
    """Joined by column, all distinct values of one would be sorted by one task."""
    from weftline.plans import registry

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.QUERIES["profile_sketches"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin [column" in plan
