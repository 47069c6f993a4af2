"""Fitted encoders, tables that know their columns' kinds, and lists kept up by a stream."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.functions import encoding
from weftline.functions.encoding import OrdinalEncoder, OrdinalEncoderModel
from weftline.operators import features, popularity
from weftline.operators.runs import FeatureGroups, marked
from weftline.streaming.rolling import RollingPopularity


def test_codes_are_learnt_stored_and_applied_to_later_rows(spark, tmp_path, monkeypatch):
    train = spark.createDataFrame([(1, "b", 10), (2, "a", None), (3, None, 9), (4, "b", 10)], "id int, t string, n int")
    later = spark.createDataFrame([(5, "c", 9), (6, None, None), (7, "a", 11)], "id int, t string, n int")
    model = OrdinalEncoder(["t", "n"]).fit(train)
    model.write().overwrite().save(f"{tmp_path}/codes")
    again = OrdinalEncoderModel.load(f"{tmp_path}/codes")
    want = [(5, -1.0, 1.0), (6, 2.0, 2.0), (7, 0.0, -1.0)]
    for m in (model, again):
        assert sorted(map(tuple, m.transform(later).collect())) == want
    assert again.getInputCols() == ["t", "n"] and sorted(map(tuple, again.codes.collect())) == sorted(map(tuple, model.codes.collect()))
    plan = again.transform(later)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and "Python" not in plan  # all columns by one row
    monkeypatch.setattr(encoding, "MAPPED", 1)
    assert sorted(map(tuple, again.transform(later).collect())) == want
    assert sorted(map(tuple, features.encoded(later, model.codes, ["t", "n"]).collect())) == want
    OrdinalEncoder(["t"]).save(f"{tmp_path}/encoder")
    assert OrdinalEncoder.load(f"{tmp_path}/encoder").getInputCols() == ["t"]
    assert OrdinalEncoder(["t"]).fit(train.limit(0)).transform(later).select("t").distinct().collect()[0][0] == -1.0


def test_tables_yield_their_groups(spark, tmp_path):
    a = marked(marked(spark.createDataFrame([(1, 2.0, 0.0)], "id int, x double, c double"), "numerical", ["x"]), "categorical", ["c"])
    b = marked(spark.createDataFrame([(1, 5.0)], "id int, y double"), "numerical", ["y"])
    joined = a.join(b, "id").withColumn("plain", F.lit(1))
    joined.write.parquet(f"{tmp_path}/joined")
    for df in (joined, spark.read.parquet(f"{tmp_path}/joined"), joined.select("y", "x", "c")):
        groups = FeatureGroups.of(df)
        assert sorted(groups.groups["numerical"]) == ["x", "y"] and groups.groups["categorical"] == ["c"] and "plain" not in sum(groups.groups.values(), [])
    assert FeatureGroups.of(a).merged(FeatureGroups.of(b)).names(["numerical", "categorical"]) == ["x", "y", "c"]


def test_the_matrix_knows_its_columns(spark):
    from weftline.plans import registry
    from weftline.sources.tables import Domain

    groups = FeatureGroups.of(registry.matrix(Domain(spark, "/root/testdata/sf0.001")))
    assert set(registry.FEATURES) <= set(groups.names(["numerical"])) and groups.names(["id"]) == sorted(groups.names(["id"]), key=groups.names(["id"]).index)
    assert set(groups.names(["categorical"])) == {*registry.CODES, *registry.STATIC} and set(groups.names(["id"])) == {"customer_id", "week_num", "article_id"}


def rolled(log, window, k):
    return sorted(map(tuple, popularity.rolling_popular_items(log, window, k).select("week_num", "article_id", "total", "place").collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_a_stream_out_of_order_gives_the_lists_of_all_events(spark, tmp_path, seed):
    """Batches come in any order of weeks, with weeks without events, smaller items late, and nulls; one batch is run again."""
    rng = random.Random(seed)
    rows = [(rng.choice([1, 2, 3, 6, 7, 11]), rng.randrange(9) + 10 * (rng.random() < 0.8)) for _ in range(200)] + [(3, None), (None, 5)]
    rng.shuffle(rows)
    state = RollingPopularity(spark, f"file://{tmp_path}/rolling{seed}", 3, 4)
    batches = [rows[:15], rows[15:60], [], rows[60:140], rows[140:]]
    seen = []
    for n, batch in enumerate(batches):
        seen += batch
        df = spark.createDataFrame(batch, "week_num int, article_id int")
        state.update(df, n)
        if n == 3:
            state.update(df, n)
        assert sorted(map(tuple, state.lists().select("week_num", "article_id", "total", "place").collect())) == rolled(spark.createDataFrame(seen, "week_num int, article_id int"), 3, 4)


def test_only_changed_weeks_are_made_anew(spark, tmp_path):
    state = RollingPopularity(spark, f"file://{tmp_path}/few", 2, 2)
    state.update(spark.createDataFrame([(w, i) for w in range(1, 9) for i in (1, 2, 3, 4)], "week_num int, article_id int"), 0)
    made = []
    state._list = lambda counts, items, first, last: made.append((first, last))
    state.update(spark.createDataFrame([(3, 4)], "week_num int, article_id int"), 1)
    state.update(spark.createDataFrame([(10, 1)], "week_num int, article_id int"), 2)
    assert made == [(3, 4), (9, 10)]


def test_a_stream_of_files_goes_on_where_it_ended(spark, tmp_path):
    source, state = f"{tmp_path}/events", RollingPopularity(spark, f"file://{tmp_path}/state", 2, 3)
    rng, seen = random.Random(3), []
    for part in range(3):
        rows = [(rng.randrange(1, 6) + 2 * (1 - part), rng.randrange(6)) for _ in range(40)]
        seen += rows
        spark.createDataFrame(rows, "week_num int, article_id int").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("week_num int, article_id int").option("maxFilesPerTrigger", 1).parquet(source)
        state.start(stream).awaitTermination()
    assert sorted(map(tuple, state.lists().select("week_num", "article_id", "total", "place").collect())) == rolled(spark.createDataFrame(seen, "week_num int, article_id int"), 2, 3)
