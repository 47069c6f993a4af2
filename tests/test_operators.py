import random
from collections import Counter
from datetime import date

import pytest
from pyspark.sql import functions as F

from weftline.functions import scalars as S
from weftline.functions.calendar import Calendar, wednesday
from weftline.functions.encoders import encoded_by, hashed_text, images_by
from weftline.operators import candidates as O
from weftline.operators import checks, features, popularity, ranking, repurchase, runs, subsets
from weftline.operators.ingest import ingest
from weftline.sources.tables import Bundle, clean_transactions, path_to, read_csv, read_mapping_object


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_calendar_values(spark):
    cal = Calendar(date(2020, 9, 22))
    assert [cal.week_of(date(2020, 9, d)) for d in (22, 16, 15)] == [104, 104, 103]
    assert cal.week_of(date(2018, 9, 20)) == 0
    assert [cal.start_of(w) for w in (104, 103, 0)] == [date(2020, 9, 16), date(2020, 9, 9), date(2018, 9, 19)]
    df = frame(spark, [(date(2020, 9, 22),), (date(2020, 9, 15),), (date(2020, 9, 16),)], "d date")
    assert [tuple(r) for r in df.select(cal.week_num(F.col("d")), wednesday(F.col("d"))).collect()] == [(104, date(2020, 9, 16)), (103, date(2020, 9, 9)), (104, date(2020, 9, 16))]


def sales(seed, n=150, weeks=6, items=7):
    """Generated purchases ``(customer, week, item, price, channel)``."""
    rng = random.Random(seed)
    return [(rng.randrange(20), rng.randrange(1, weeks + 1), rng.randrange(items) + 50, rng.choice([4.0, 7.5, 8.0]), rng.choice([1, 2])) for _ in range(n)]


@pytest.mark.parametrize(("window", "k"), [(1, 2), (2, 3), (4, 20)])
def test_rolling_popularity_equals_counting(spark, window, k):
    rows = [r for r in sales(1) if r[1] != 3]  # a week without sales
    log = frame(spark, rows, LOG)
    items = sorted({a for _, _, a, *_ in rows})
    found = popularity.rolling_popular_items(log, window, k).orderBy("week_num", "place").collect()
    for week in range(1, 7):
        sold = Counter(a for _, w, a, *_ in rows if week - window < w <= week)
        assert [r.article_id for r in found if r.week_num == week] == sorted(items, key=lambda a: (-sold[a], a))[:k]
    sums = log.groupBy("week_num", "article_id").agg(F.count("*").alias("q"))
    assert got(popularity.rolling_popular_items(sums, window, k, value="q"), "week_num", "article_id", "place") == got(popularity.rolling_popular_items(log, window, k), "week_num", "article_id", "place")


def test_rolling_popularity_edges(spark):
    with pytest.raises(ValueError):
        popularity.rolling_popular_items(frame(spark, [], "week_num int, article_id int"), 2, 2)
    with pytest.raises(ValueError):
        popularity.rolling_popular_items(frame(spark, [(7, 5, -1)], "week_num int, article_id int, q int"), 2, 2, value="q")


LOG = "customer_id int, week_num int, article_id int, price double, sales_channel_id int"


def test_weekly_popularity_and_stats_equal_counting(spark):
    rows = sales(2)
    log = frame(spark, rows, LOG)
    ranked, stats = [], []
    for week in range(1, 7):
        sold = Counter(a for _, w, a, *_ in rows if w == week)
        levels = sorted(set(sold.values()), reverse=True)
        ranked += [(week, a, levels.index(sold[a]) + 1.0) for a in sorted(sold, key=lambda a: (-sold[a], a))[:3]]
        for a, n in sold.items():
            own = [r for r in rows if r[1:3] == (week, a)]
            channels = Counter(r[4] for r in own)
            stats.append((week, a, n, pytest.approx(sum(r[3] for r in own) / n), min(channels, key=lambda c: (-channels[c], c))))
    assert got(popularity.weekly_popular_items(log, 3), "week_num", "article_id", "bestseller_rank") == sorted(ranked)
    found = got(popularity.item_week_stats(log), "week_num", "article_id", "count", "avg_price", "mode_sales_channel_id")
    assert found == sorted(stats, key=lambda r: r[:2])


def test_popularity_samples_take_the_week_before(spark):
    pairs = frame(spark, [(8, 21), (8, 21), (9, 22), (9, 40)], "customer_id int, week_num int")
    popular = frame(spark, [(20, 71, 1.0), (21, 72, 1.0), (21, 73, 2.0), (22, 74, 1.0)], "week_num int, article_id int, bestseller_rank double")
    stats = frame(spark, [(20, 71, 2.5, 2), (21, 72, 3.5, 1)], "week_num int, article_id int, avg_price double, mode_sales_channel_id int")
    found = popularity.popularity_samples(pairs, popular, stats).select("customer_id", "week_num", "article_id", "price", "sales_channel_id")
    assert {tuple(r) for r in found.collect()} == {(8, 21, 71, 2.5, 2), (9, 22, 72, 3.5, 1), (9, 22, 73, None, None)} and found.count() == 3


def test_repurchase_equals_a_walk_over_weeks(spark):
    rows = sales(3, 60)
    log = frame(spark, rows, LOG)
    moved = []
    for c, w, a, *_ in rows:
        moved.append((c, min((x for d, x, *_ in rows if d == c and x > w), default=50), a))
    found = repurchase.repurchase_samples(log, "last_purchase", 0, 60, default_week=50)
    assert got(found, "customer_id", "week_num", "article_id") == sorted(moved)
    latest = []
    for week in range(2, 9):
        for c in range(20):
            own = sorted({(-w, a) for d, w, a, *_ in rows if d == c and w < week})[:3]
            latest += [(c, week, a) for _, a in own]
    found = repurchase.repurchase_samples(log, "last_k_items", 2, 8, k=3)
    assert got(found, "customer_id", "week_num", "article_id") == sorted(latest)
    assert repurchase.of_customers(log, []).count() == 0 and repurchase.of_customers(log).count() == 60
    with pytest.raises(ValueError):
        repurchase.repurchase_samples(log, "other", 0, 1)
    with pytest.raises(ValueError):
        repurchase.repurchase_samples(log.drop("price"), "last_purchase", 0, 1)


def test_combined_samples(spark):
    schema = "customer_id int, week_num int, article_id int, price double, sales_channel_id int, source string"
    a = frame(spark, [(4, 30, 61, 1.0, 1, "popularity"), (4, 30, 62, 1.0, 1, "popularity"), (5, 30, 63, 1.0, 1, "popularity")], schema)
    b = frame(spark, [(5, 30, 63, 9.0, 1, "repurchase"), (6, 30, 64, 9.0, 1, "repurchase"), (6, 30, 65, 9.0, 1, "repurchase")], schema)
    log = frame(spark, [(4, 30, 61, 1.0, 1), (6, 30, 65, 1.0, 1), (6, 29, 64, 1.0, 1)], LOG)
    assert got(O.combined_samples(log, [a, b]), "customer_id", "article_id", "source") == [(4, 62, "popularity"), (5, 63, "popularity"), (6, 64, "repurchase")]


def test_downsampling_rounds_half_even(spark):
    rows = [(1, 1, k, 0) for k in range(5)] + [(2, 1, 9, 0)] + [(1, 1, 50, 1), (1, 1, 51, 1), (2, 1, 52, 1)]
    df = frame(spark, rows, "customer_id int, week_num int, article_id int, label int")
    found = O.downsampled(df, 1).where("label = 0").groupBy("customer_id").count()
    assert got(found, "customer_id", "count") == [(1, 2)]  # 3 of 6: 2.5 gives 2, 0.5 gives none


@pytest.mark.parametrize(("actual", "predicted", "ap", "ideal"), [([1, 2], [1, 2], 1.0, 1.0), ([1, 2], [3, 1, 1, 2], (1 / 2 + 2 / 4) / 2, None), ([], [1], 0.0, 0.0), ([1], None, 0.0, 0.0), (list(range(20)), list(range(20)), 1.0, 1.0), ([5], [1, 2, 5], 1 / 3, 1.0)])
def test_average_precision(spark, actual, predicted, ap, ideal):
    df = frame(spark, [(actual, predicted)], "a array<long>, p array<long>")
    row = df.select(S.average_precision(F.col("a"), F.col("p")).alias("ap"), S.ideal_precision(F.col("a"), F.col("p")).alias("ideal")).first()
    assert row.ap == pytest.approx(ap)
    assert ideal is None or row.ideal == pytest.approx(ideal)


def test_cosine_bins_and_ids(spark):
    df = frame(spark, [([3.0, 4.0], [4.0, 3.0]), ([5.0, 0.0], [-3.0, 4.0]), ([0.0, 2.0], [7.0, 0.0]), (None, [1.0]), ([0.0], [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(S.cosine(F.col("a"), F.col("b"))).collect()] == pytest.approx([0.96, -0.6, 0, 0, 0], abs=1e-7)
    ages = frame(spark, [(18.0,), (18.5,), (25.0,), (65.0,), (66.0,), (None,)], "age double")
    assert [r[0] for r in ages.select(S.age_bin(F.col("age"))).collect()] == ["0.0", "1.0", "1.0", "5.0", "6.0", "nan"]
    ids = frame(spark, [("ab" * 24 + "00000000000000ff",), ("f" * 64,)], "c string")
    assert [int(r[0]) for r in ids.select(S.hex_id(F.col("c"))).collect()] == [255, 2**64 - 1]
    assert [S.human_size(n) for n in (0, 512, 2048, 3 * 1024**5)] == ["0 B", "512 B", "2.00 KB", "3.00 PB"]
    with pytest.raises(ValueError):
        S.human_size(-1)


def test_codes_and_static_features(spark):
    df = frame(spark, [("10",), ("9",), (None,), ("a",)], "v string")
    codes = features.ordinal_codes(df, ["v"])
    assert got(codes, "value", "code") == [("10", 0.0), ("9", 1.0), ("a", 2.0), ("nan", 3.0)]
    assert [r[0] for r in features.encoded(frame(spark, [("zz",), ("9",)], "v string"), codes, ["v"]).collect()] == [-1.0, 1.0]
    people = frame(spark, [(1, 20.0, "x"), (2, None, "y"), (3, 40.0, None)], "CUSTOMER_ID int, age double, s string")
    out = features.customer_features(people, ["s", "age_bin"], fill={"s": "unknown"})
    assert got(out, "customer_id", "age") == [(1, 20.0), (2, 30.0), (3, 40.0)]
    with pytest.raises(ValueError):
        features.customer_features(people, ["s"], nulls="other")


def test_cumulative_ages_count_unknown_ones(spark):
    log = frame(spark, [(1, 1, 1, 1.0), (1, 2, 1, 1.0), (1, 3, 2, 1.0), (1, 4, 2, 1.0)], "article_id int, customer_id int, week_num int, price double")
    people = frame(spark, [(1, 20.0), (2, None), (3, None), (4, 40.0)], "customer_id int, age double")
    assert got(features.cumulative_ages(log, people), "week_num", "cumulative_mean_age", "cumulative_sales_count") == [(1, 20.0, 2), (2, 15.0, 4)]
    assert got(features.cumulative_ages(log, people, count_null_ages=False), "week_num", "cumulative_mean_age") == [(1, 20.0), (2, 30.0)]


def test_sample_mapping_profile(spark):
    ids = frame(spark, [(k,) for k in range(10)], "customer_id int")
    assert subsets.exact_sample(ids, "customer_id", 0.25).count() == 2  # 2.5, half-even
    assert got(subsets.exact_sample(ids, "customer_id", 0.5), "customer_id") == got(subsets.exact_sample(ids.repartition(3), "customer_id", 0.5), "customer_id")
    with pytest.raises(ValueError):
        subsets.exact_sample(ids, "customer_id", 0)
    assert got(subsets.null_profile(frame(spark, [(1, None), (1, 2)], "a int, b int")), "column", "n_rows", "n_nulls", "n_distinct") == [("a", 2, 0, 1), ("b", 2, 1, 1)]


def test_matrix_uses_the_week_before_and_keeps_rows(spark):
    from weftline.plans import registry
    from weftline.sources.tables import Domain

    d = Domain(spark, "/root/testdata/sf0.001")
    rows = registry.matrix(d)
    candidates = O.training_candidates(d.transactions, registry.FIRST, registry.LAST, registry.calendar(d), registry.K)
    assert rows.count() == candidates.count()
    assert checks.repeated_keys(rows).isEmpty() and checks.wrong_labels(candidates, d.transactions).isEmpty()
    assert checks.panel_gaps(registry.item_panel(d), "article_id", *registry.GRID).isEmpty()
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan


def test_prepared_samples(spark):
    from weftline.plans import registry
    from weftline.sources.tables import Domain

    d = Domain(spark, "/root/testdata/sf0.001")
    log, cal, week = d.transactions, registry.calendar(d), registry.LAST
    valid = O.prepared(log, "valid", week, week, cal, registry.K)
    assert set(valid) == {"train", "inference"} and set(O.prepared(log, "train", week, week, cal)) == {"train"} and set(O.prepared(log, "test", week, week, cal)) == {"inference"}
    assert ranking.single_week(valid["inference"]) == week and ranking.single_week(valid["train"]) == week
    assert checks.wrong_labels(valid["train"], log).isEmpty() and checks.repeated_keys(valid["inference"]).isEmpty()
    # the buyers of the week, known before or not
    assert {r[0] for r in valid["inference"].select("customer_id").distinct().collect()} == {r[0] for r in log.where(F.col("week_num") == week).select("customer_id").collect()}
    for bad in (("all", week, week), ("test", week - 1, week), ("train", -10_000, week)):
        with pytest.raises(ValueError):
            O.prepared(log, *bad, cal)
    with pytest.raises(ValueError):
        ranking.single_week(log)


def test_export_order_and_evaluation(spark):
    rows = frame(spark, [(2, 1, 5, 0.5, 1), (1, 2, 4, 0.1, 0), (1, 1, 9, 0.2, 1), (1, 1, 3, 0.9, 0)], "customer_id int, week_num int, article_id int, x double, label int")
    out = ranking.for_ranker(rows, ["x"])
    assert out.columns == ["customer_id", "week_num", "article_id", "x", "label"]
    assert [tuple(r)[:3] for r in out.collect()] == [(1, 1, 3), (1, 1, 9), (1, 2, 4), (2, 1, 5)]
    with pytest.raises(ValueError):
        ranking.for_ranker(rows, ["y"])
    lists = lambda *rows: frame(spark, list(rows), "customer_id int, week_num int, articles array<int>")
    found = ranking.evaluation(lists((1, 1, [7]), (2, 1, [8])), lists((1, 1, [6, 7]), (2, 1, [8])), lists((1, 1, [7])), 2).first()
    assert tuple(found) == (2, 0.75, 0.5, 1.0)


def test_ranker_round_trip(spark, tmp_path):
    rows = frame(spark, [(c, 1, a, float(a % 3), float(a), int(a % 3 == 0)) for c in range(6) for a in range(9)], "customer_id int, week_num int, article_id int, x double, y double, label int")
    ranker = ranking.GbtRanker(ranking.RankerConfig(["x", "y"], trees=3, depth=2)).train(rows)
    lists = ranker.ranks(rows, 3)
    assert {tuple(r.articles) for r in lists.collect()} == {(0, 3, 6)}
    assert sum(ranker.importance().values()) == pytest.approx(1)
    ranker.save(str(tmp_path / "r"))
    again = ranking.GbtRanker.load(spark, str(tmp_path / "r"))
    assert ranking.score_rows(spark, [{"x": 0.0, "y": 3.0}, {"x": 1.0, "y": 4.0}], again) == pytest.approx(ranking.score_rows(spark, [{"x": 0.0, "y": 3.0}, {"x": 1.0, "y": 4.0}], ranker))
    with pytest.raises(ValueError):
        ranking.GbtRanker(ranking.RankerConfig(["x"])).scored(rows)


def test_sources(spark, tmp_path):
    (tmp_path / "t.csv").write_text("t_dat,customer_id,article_id,price,sales_channel_id\n2020-09-22," + "0" * 62 + "ff,0108775015,0.5,2\n2020-09-15," + "0" * 62 + "10,0108775044,0.25,1\n")
    from weftline.sources.tables import RAW_TRANSACTIONS

    log = clean_transactions(read_csv(spark, str(tmp_path / "t.csv"), RAW_TRANSACTIONS))
    assert got(log.withColumn("c", F.col("customer_id").cast("int")), "c", "article_id", "week_num") == [(16, 108775044, 103), (255, 108775015, 104)]
    bundle = Bundle(spark, str(tmp_path / "b"))
    bundle.save({"log": log}, {"stage": 1}, {"log": ["week_num"]})
    assert bundle.meta()["meta"] == {"stage": 1} and bundle.load("log").count() == 2
    with pytest.raises(ValueError):
        bundle.load("other")
    assert path_to("/d", "candidates", 0.25) == "/d/candidates/subsample_0.25_42" and path_to("/d", "embeddings", 0.25) == "/d/embeddings/full"
    with pytest.raises(ValueError):
        path_to("/d", "other")


def test_encoders(spark):
    df = frame(spark, [(1, "a b a"), (2, None)], "k long, t string")
    rows = {r.k: r.v for r in df.select("k", hashed_text(F.col("t"), 8).alias("v")).collect()}
    assert sum(x * x for x in rows[1]) == pytest.approx(1) and not any(rows[2])
    assert got(encoded_by(df, "k", "t", lambda: lambda texts: [[float(len(t))] for t in texts]).select("k", F.col("vector")[0].alias("n")), "k", "n") == [(1, 5.0), (2, 0.0)]


def test_stream_of_weeks(spark, tmp_path):
    from weftline.streaming.weekly import weekly_counts

    spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "e"))
    schema = spark.read.parquet(str(tmp_path / "e")).schema
    stream = weekly_counts(spark.readStream.schema(schema).parquet(str(tmp_path / "e")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("weeks").start()
    q.processAllAvailable()
    q.stop()
    batch = weekly_counts(spark.read.parquet(str(tmp_path / "e")))
    assert got(spark.table("weeks"), "week_start", "event_type", "n") == got(batch, "week_start", "event_type", "n")


def test_last_k_changes_equal_a_walk_over_weeks(spark):
    rng = random.Random(5)
    rows = sorted({(c, w, a): (c, w, a, date(2020, 1, 1 + w), float(rng.randint(1, 9)), 1) for c, w, a in ((rng.randint(1, 4), rng.randint(0, 12), rng.randint(1, 7)) for _ in range(60))}.values())
    log = frame(spark, rows, "customer_id int, week_num int, article_id int, t_dat date, price double, sales_channel_id int")
    want = []
    for c in {r[0] for r in rows}:
        for week in range(4, 11):
            last = {r[2]: r for r in rows if r[0] == c and r[1] <= week}
            kept = sorted(last.values(), key=lambda r: (-r[1], r[2]))[:3]
            want += [(c, week, r[2], r[4], n + 1) for n, r in enumerate(kept)]
    assert got(repurchase.last_k_distinct(log, 3, 4, 10), "customer_id", "week_num", "article_id", "price", "place") == sorted(want)
    assert repurchase.last_k_changes(log, 3, 4, 10).count() < len(want)
    assert repurchase.last_k_changes(log.limit(0), 3, 4, 10).count() == 0


def test_images_and_mappings(spark, tmp_path):
    df = frame(spark, [(1, bytearray(b"abc")), (2, None), (3, bytearray(b"z"))], "k long, content binary")
    found = images_by(df, "k", "content", 2, lambda: lambda images: [[float(len(x)), 1.0] for x in images])
    assert {r.k: tuple(r.vector) for r in found.collect()} == {1: (3.0, 1.0), 2: (0.0, 0.0), 3: (1.0, 1.0)}
    (tmp_path / "m.json").write_text('{"7": [3, 3, 1],\n "9": []}')
    assert got(read_mapping_object(spark, str(tmp_path / "m.json")), "customer_id", "articles") == [(7, [3, 3, 1]), (9, [])]


def test_ingest(spark, tmp_path):
    days = ["2020-09-22", "2020-09-16", "2020-09-15", "2020-09-09", "2020-09-08", "2020-08-01"]
    log = frame(spark, [(d, f"{c:064x}", f"0{100 + n}", 0.5, 2) for c in (1, 2) for n, d in enumerate(days)], "t_dat string, customer_id string, article_id string, price double, sales_channel_id int")
    customers = frame(spark, [(f"{c:064x}", None, 30) for c in (1, 2)], "customer_id string, FN double, age int")
    articles = frame(spark, [(100 + n, 5) for n in range(9)], "article_id long, code long")
    whole = ingest(log, customers, articles, Bundle(spark, str(tmp_path / "a")))
    assert [whole.load(f"log_{x}").count() for x in ("train", "valid", "test")] == [4, 4, 4]
    assert {tuple(r.articles) for r in whole.load("items_test").collect()} == {(101, 100)}
    part = ingest(log, customers, articles, Bundle(spark, str(tmp_path / "b")), share=0.5)
    assert part.load("customers").count() == 1 and part.load("log_train").count() == 2 and part.load("articles").count() == 6
    assert part.meta()["meta"]["share"] == 0.5


def test_feature_groups():
    both = runs.FeatureGroups({"numerical": ["x", "y"], "id": ["k"]}).merged(runs.FeatureGroups({"numerical": ["y", "z"], "categorical": ["c"]}))
    assert both.groups == {"numerical": ["x", "y", "z"], "id": ["k"], "categorical": ["c"]}
    assert both.names(["numerical", "categorical"]) == ["x", "y", "z", "c"] and both.names(["numerical"], ["z", "x"]) == ["x", "z"]
    for kinds, wanted in ((["numerical"], ["k"]), (["other"], None)):
        with pytest.raises(ValueError):
            both.names(kinds, wanted)


def test_runs(spark, tmp_path):
    rows = frame(spark, [(c, 1, a, float(a % 3), int(a % 3 == 0)) for c in range(4) for a in range(9)], "customer_id int, week_num int, article_id int, x double, label int")
    actual = frame(spark, [(c, 1, [0, 3, 6]) for c in range(4)], "customer_id int, week_num int, articles array<int>")
    store = runs.RunStore(spark, str(tmp_path / "runs"))
    config = ranking.RankerConfig(["x"], trees=2, depth=2)
    ranker, scores = runs.train_and_validate(config, rows, {"train": (rows, actual)}, store, "first", 3)
    assert scores["train_map"] == pytest.approx(1)
    store.save("second", ranking.RankerConfig(["x"], trees=9), {"train_map": 0.5})
    assert store.best("train_map") == "first" and store.config("first", depth=5) == ranking.RankerConfig(["x"], trees=2, depth=5)
    assert {r.name: set(r.importance or {}) for r in store.runs().collect()} == {"first": {"x"}, "second": set()}
    assert ranking.score_rows(spark, [{"x": 0.0}], store.ranker("first")) == pytest.approx(ranking.score_rows(spark, [{"x": 0.0}], ranker))
    for wrong in (lambda: store.best("other"), lambda: store.config("other")):
        with pytest.raises(ValueError):
            wrong()
