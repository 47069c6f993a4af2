"""Data checks with planted violations, provenance joins, and profiles by counts and sketches."""

import random
from collections import Counter
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from weftline.operators import candidates as O
from weftline.operators import checks, features, profiles, ranking
from weftline.functions.calendar import Calendar

LOG = "customer_id int, week_num int, article_id int, price double, sales_channel_id int, t_dat date"
START, END, HISTORY = 4, 7, (1, 7)
DAY = date(2020, 1, 1)


@pytest.fixture(scope="module")
def world(spark):
    """A generated log with its panels, candidates and matrix, cached: some items never sell, some customers have no age, some items no vector."""
    rng = random.Random(4)
    rows = []
    for _ in range(260):
        week = rng.randrange(1, 8)
        rows.append((rng.randrange(25), week, rng.randrange(12) + 50, rng.choice([4.0, 7.5, 8.0]), rng.choice([1, 2]), DAY + timedelta(days=7 * week + rng.randrange(7))))
    log = spark.createDataFrame(rows, LOG).cache()
    customers = spark.createDataFrame([(c, float(20 + c) if c % 4 else None) for c in range(25)], "customer_id int, age double")
    articles = spark.createDataFrame([(a,) for a in range(50, 64)], "article_id int")
    vectors = spark.createDataFrame([(a, [rng.gauss(0, 1) for _ in range(3)]) for a in range(50, 64) if a % 5], "article_id int, vector array<double>")
    items = features.item_week_panel(log, articles, customers, START, END, HISTORY).cache()
    people = features.customer_week_panel(log, vectors, START, END, HISTORY, 3).cache()
    made = O.training_candidates(log, START + 1, END, Calendar(DAY, END), 4, restrict_positives=True).cache()
    static = articles.withColumn("brand", F.lit(1.0))
    matrix = ranking.ranking_matrix(made, static, customers, items, people, vectors).cache()
    return dict(log=log, customers=customers, articles=articles, vectors=vectors, items=items, people=people, made=made, matrix=matrix)


def changed(df, where, **columns):
    return df.withColumns({c: F.when(F.expr(where), v).otherwise(F.col(c)) for c, v in columns.items()})


def one(df, *keys):
    return df.orderBy(*keys).limit(1)


def test_sound_tables_have_no_violations(world):
    w = world
    found = checks.candidate_checks(w["made"], w["log"], "last_purchase", START + 1, END, 4)
    found |= {
        "items": checks.panel_shape(w["items"], w["articles"], "article_id", START, END),
        "item values": checks.item_panel_differences(w["items"], w["log"], w["customers"], START, HISTORY),
        "people": checks.panel_shape(w["people"], checks.active_customers(w["log"], START, END), "customer_id", START, END),
        "people values": checks.customer_panel_differences(w["people"], w["log"], w["vectors"], HISTORY, 3),
        "matrix": checks.matrix_shape(w["matrix"], w["made"]),
        "prices": checks.customer_price_differences(w["matrix"], w["people"]),
        "features": checks.item_feature_differences(w["matrix"], w["items"]),
        "similarity": checks.similarity_differences(w["matrix"], w["people"], w["vectors"]),
        "nulls": checks.matrix_nulls(w["matrix"], ["label", "weekly_sales_count", "similarity"]),
    }
    assert {r.check: r.violations for r in checks.report(found).collect()} == dict.fromkeys(found, 0)


def test_planted_violations_of_panels_are_found(world):
    w = world
    lost = w["items"].where("not (article_id = 51 and week_num = 5)")
    assert [tuple(r) for r in checks.panel_shape(lost, w["articles"], "article_id", START, END).collect()] == [(51, "weeks")]
    gone = checks.panel_shape(w["items"].where("article_id != 52"), w["articles"].union(w["articles"].sparkSession.createDataFrame([(99,)], "a int")).where("article_id != 53"), "article_id", START, END)
    assert sorted(map(tuple, gone.collect())) == [(52, "right_only"), (53, "left_only"), (99, "right_only")]
    for column in ("weekly_sales_count", "weekly_avg_price", "cumulative_mean_age", "cumulative_sales_count"):
        key = w["items"].where("cumulative_sales_count > 0 and weekly_sales_count > 0").join(w["log"].join(w["customers"].where("age is not null"), "customer_id").select("article_id", "week_num").distinct(), ["article_id", "week_num"]).orderBy("article_id", "week_num").first()
        wrong = changed(w["items"], f"article_id = {key.article_id} and week_num = {key.week_num}", **{column: F.col(column) + 1})
        found = checks.item_panel_differences(wrong, w["log"], w["customers"], START, HISTORY).collect()
        assert [(r.article_id, r.week_num) for r in found] == [(key.article_id, key.week_num)]
        only = w["articles"].where(f"article_id != {key.article_id}")
        assert checks.item_panel_differences(wrong, w["log"], w["customers"], START, HISTORY, only).isEmpty()
    key = checks.customer_panel_differences(w["people"].withColumn("customer_avg_price", F.lit(-1.0)), w["log"], w["vectors"], HISTORY, 3).orderBy("customer_id", "week_num").first()
    where = f"customer_id = {key.customer_id} and week_num = {key.week_num}"
    for column, value in (("customer_avg_price", F.lit(1e6)), ("customer_avg_embedding", F.array(F.lit(0.0), F.lit(0.0), F.lit(9.0)))):
        found = checks.customer_panel_differences(changed(w["people"], where, **{column: value}), w["log"], w["vectors"], HISTORY, 3).collect()
        assert [(r.customer_id, r.week_num) for r in found] == [(key.customer_id, key.week_num)]


def test_planted_violations_of_candidates_are_found(world):
    w = world
    made, log = w["made"], w["log"]
    late = one(made, "customer_id", "week_num", "article_id")
    moved = made.unionByName(late.withColumn("week_num", F.lit(END + 3)))
    assert {r.provenance for r in checks.candidate_shape(moved, log, START + 1, END).collect()} == {"week", "left_only"}
    few = made.where(f"customer_id != {late.first().customer_id}")
    assert {(r.customer_id, r.provenance) for r in checks.candidate_shape(few, log, START + 1, END).collect()} == {(late.first().customer_id, "right_only")}
    assert checks.repeated_keys(made.unionByName(late)).count() == 1
    assert checks.positives_not_bought(made.withColumn("label", F.lit(1)), log).count() == made.where("label = 0").count()
    assert checks.negatives_bought(made.withColumn("label", F.lit(0)), log).count() == made.where("label = 1").count() > 0
    unrestricted = O.training_candidates(log, START + 1, END, Calendar(DAY, END), 4, restrict_positives=False)
    assert checks.positives_not_bought(unrestricted, log, restricted=True).count() == unrestricted.where("label = 1").count() > 0
    assert checks.positives_not_bought(unrestricted, log, restricted=False).isEmpty()
    again = made.where("source = 'repurchase'").orderBy("customer_id", "week_num", "article_id").first()
    key = f"customer_id = {again.customer_id} and week_num = {again.week_num} and article_id = {again.article_id}"
    assert [(r.customer_id, r.week_num, r.article_id) for r in checks.repurchases_missing(made.where(f"not ({key})"), log, "last_purchase", START + 1, END).collect()] == [(again.customer_id, again.week_num, again.article_id)]
    with pytest.raises(ValueError):
        checks.repurchases_missing(made, log, "none", START, END)


def test_last_k_candidates_are_checked(world):
    log = world["log"]
    made = O.training_candidates(log, START + 1, END, Calendar(DAY, END), 4, strategy="last_k_items")
    assert checks.repurchases_missing(made, log, "last_k_items", START + 1, END, 4).isEmpty()
    again = made.where("source = 'repurchase'").orderBy("customer_id", "week_num", "article_id").first()
    key = f"customer_id = {again.customer_id} and week_num = {again.week_num} and article_id = {again.article_id}"
    assert checks.last_k_missing(made.where(f"not ({key})"), log, START + 1, END, 4).count() == 1


def test_planted_violations_of_the_matrix_are_found(world):
    w = world
    first = w["matrix"].where("customer_avg_price is not null").orderBy(*O.KEY).first()
    where = f"customer_id = {first.customer_id} and week_num = {first.week_num} and article_id = {first.article_id}"
    key = (first.customer_id, first.week_num, first.article_id)
    keys = lambda df: [(r.customer_id, r.week_num, r.article_id) for r in df.collect()]
    assert keys(checks.customer_price_differences(changed(w["matrix"], where, customer_avg_price=F.lit(1e6)), w["people"])) == [key]
    for column in ("weekly_sales_count", "weekly_avg_price", "cumulative_sales_count", "cumulative_mean_age"):
        assert keys(checks.item_feature_differences(changed(w["matrix"], where, **{column: F.lit(-5)}), w["items"])) == [key]
    assert keys(checks.similarity_differences(changed(w["matrix"], where, similarity=F.lit(5.0)), w["people"], w["vectors"])) == [key]
    assert keys(checks.matrix_shape(w["matrix"].where(f"not ({where})"), w["made"])) == [key]
    assert keys(checks.matrix_shape(w["matrix"].unionByName(w["matrix"].where(where)), w["made"])) == [key]
    assert [tuple(r) for r in checks.matrix_nulls(changed(w["matrix"], where, similarity=F.lit(None)), ["similarity", "label"]).collect()] == [("similarity", 1)]
    with pytest.raises(ValueError):
        checks.matrix_nulls(w["matrix"], ["label", "label"])


def test_tables_are_measured_while_they_are_written(world, tmp_path):
    w = world
    df, found = checks.observed(w["items"], "items")
    df.write.parquet(f"{tmp_path}/items")
    n = w["articles"].count() * (END - START + 1)
    assert found.get["n_rows"] == n and checks.violations_of(found.get, START, END, n) == []
    holed, seen = checks.observed(changed(w["items"].where(f"week_num < {END}"), "article_id = 51", weekly_avg_price=F.lit(None)), "holed")
    holed.write.parquet(f"{tmp_path}/holed")
    assert checks.violations_of(seen.get, START, END, n) == [f"last week is {END - 1}, not {END}", f"{n - 14} rows, not {n}", "3 nulls in weekly_avg_price"]
    assert seen.get["rows_with_nulls"] == 3 and checks.violations_of(seen.get, START, END - 1, nullable=("weekly_avg_price",)) == []


def test_provenance_keeps_both_sides(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k int, v string")
    b = spark.createDataFrame([(2, "other", 5.0), (3, "w", 6.0), (None, "n", 7.0)], "k int, v string, n double")
    found = sorted(map(tuple, checks.provenance(a, b, ["k"]).select("k", "v", "n", "provenance").collect()), key=str)
    assert found == sorted([(1, "x", None, "left_only"), (2, "y", 5.0, "both"), (3, None, 6.0, "right_only"), (None, "z", None, "left_only"), (None, None, 7.0, "right_only")], key=str)


def test_popular_items_are_those_of_all_customers_and_newcomers_get_them(spark):
    """Item 200 is the best seller; customer 1 has bought item 100 only, customer 9 nothing."""
    day = DAY
    rows = [(c, 6, 200, 5.0, 1, day) for c in (2, 3, 4)] + [(1, 6, 100, 5.0, 1, day)] * 2 + [(1, 7, 100, 5.0, 1, day), (2, 7, 300, 5.0, 1, day)]
    log = spark.createDataFrame(rows, LOG)
    cal = Calendar(DAY, 7)
    offered = lambda **how: sorted((r.customer_id, r.article_id, r.source) for r in O.inference_candidates(log, 7, cal, 1, **how).collect())
    want = [(1, 100, "repurchase"), (1, 200, "popularity"), (9, 200, "popularity")]
    assert offered(customers=[1, 9]) == want == offered(customers=spark.createDataFrame([(1,), (9,), (9,), (None,)], "customer_id int"))
    assert offered() == [(1, 100, "repurchase"), (1, 200, "popularity"), (2, 200, "popularity")]
    assert offered(customers=[]) == []
    made = O.training_candidates(log, 7, 7, cal, 1, customers=[1]).collect()
    assert sorted((r.customer_id, r.article_id, r.label) for r in made) == [(1, 100, 1), (1, 200, 0)]
    found = O.prepared(log, "test", 7, 7, cal, 1, customers=[9])["inference"].collect()
    assert [(r.customer_id, r.article_id) for r in found] == [(9, 200)]
    extra = O.training_candidates(log, 7, 7, cal, 1, restrict_positives=False, ratio=1)
    assert sorted((r.customer_id, r.article_id, r.label) for r in extra.collect()) == [(1, 100, 1), (1, 200, 0), (2, 200, 0), (2, 300, 1)]


def test_exact_profiles(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", 1.5), (None, "b", 2.5), (4, None, 2.5)], "n int, t string, x double")
    assert sorted(map(tuple, profiles.null_profile(df).collect())) == [("n", 4, 1, 3), ("t", 4, 1, 2), ("x", 4, 1, 2)]
    assert sorted(map(tuple, profiles.null_profile(df.limit(0)).collect())) == [("n", 0, 0, 0), ("t", 0, 0, 0), ("x", 0, 0, 0)]
    assert sorted(map(tuple, profiles.top_values(df, 1).collect())) == [("n", "1", 1, 1), ("t", "a", 2, 1), ("x", "2.5", 2, 1)]
    found = {r.column: r for r in profiles.described(df).collect()}
    assert set(found) == {"n", "x"} and (found["n"].n, found["n"].median, found["x"].max, found["x"].q1) == (3, 2.0, 2.5, 2.0)
    for made in (profiles.null_profile(df), profiles.described(df), profiles.sketched(df)):
        assert "Expand" not in made._jdf.queryExecution().executedPlan().toString()


def test_sketches_merge_and_keep_their_bounds(spark):
    rng = random.Random(2)
    rows = [(k % 5, rng.randrange(3000), rng.gauss(0, 100), "hot" if rng.random() < 0.3 else f"v{rng.randrange(2000)}", None) for k in range(20_000)]
    df = spark.createDataFrame(rows, "week int, n int, x double, t string, none double").repartition(4)
    parts = profiles.sketched(df, by=["week"])
    assert parts.count() == 5 * 4
    found = {r.column: r for r in profiles.estimated(profiles.merged(parts), 3, (0.1, 0.5, 0.9)).collect()}
    n, x = [r[1] for r in rows], sorted(r[2] for r in rows)
    assert abs(found["n"].n_distinct - len(set(n))) <= 0.03 * len(set(n)) and found["none"].n_nulls == 20_000 and found["none"].quantiles is None and found["t"].quantiles is None
    for q, value in zip((0.1, 0.5, 0.9), found["x"].quantiles):
        assert abs(sum(v <= value for v in x) / len(x) - q) < 0.01
    counts = Counter(r[3] for r in rows)
    assert found["t"].top[0]["item"] == "hot" and abs(found["t"].top[0]["count"] - counts["hot"]) <= 20_000 / profiles.FREQUENT
    weekly = {(r.week, r.column): r for r in profiles.estimated(parts).collect()}
    assert all(weekly[k, "n"].n_rows == 4000 for k in range(5))
    nothing = {r.column: r for r in profiles.estimated(profiles.sketched(df.limit(0))).collect()}
    assert nothing["n"].n_rows == 0 and nothing["n"].quantiles is None and nothing["n"].n_distinct == 0


def test_appended_weeks_are_those_of_the_full_panels(spark, world, tmp_path):
    """Week by week from the state before, one of them twice; each equals the panel over all history whose grid ends there."""
    from weftline.operators.incremental import PanelStore

    w = world
    store = PanelStore(spark, f"file://{tmp_path}/panels", START, 3)
    store.begin(w["log"], w["customers"])
    with pytest.raises(ValueError):
        store.append(w["log"], START - 1, w["articles"], w["customers"], w["vectors"])
    own = lambda df, week: sorted((tuple(round(x, 9) if isinstance(x, float) else tuple(round(v, 9) for v in x) if isinstance(x, list) else x for x in r) for r in df.where(F.col("week_num") == week).collect()), key=str)
    items, people = ("article_id", "weekly_sales_count", "weekly_avg_price", "cumulative_mean_age", "cumulative_sales_count"), ("customer_id", "customer_avg_price", "customer_avg_embedding")
    for week in range(START, END + 1):
        for _ in range(1 + (week == START + 1)):
            store.append(w["log"], week, w["articles"], w["customers"], w["vectors"])
        full = features.item_week_panel(w["log"], w["articles"], w["customers"], START, week, (1, week))
        assert own(store.item_panel().select(*items, "week_num"), week) == own(full.select(*items, "week_num"), week)
        full = features.customer_week_panel(w["log"], w["vectors"], START, week, (1, week), 3)
        assert own(store.customer_panel().select(*people, "week_num"), week) == own(full.select(*people, "week_num"), week)
    assert store.item_panel().select("week_num").distinct().count() == END - START + 1


def test_a_matrix_over_buckets_joins_customers_without_an_exchange(spark, world):
    from weftline.operators import layout

    w = world
    static, people = w["articles"].withColumn("brand", F.lit(1.0)), w["customers"].withColumn("age", F.coalesce("age", F.lit(30.0)))
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain = ranking.ranking_matrix(w["made"], static, people, w["items"], w["people"], w["vectors"])
        t = layout.lay_out_inputs(w["made"], people, w["items"], w["people"], "bucketed", 4)
        with layout.joined_within_buckets(spark):
            made = ranking.ranking_matrix(t["candidates"], static, t["customers"], t["item_panel"], t["customer_panel"], w["vectors"], shifted=True)
            plan = made._jdf.queryExecution().executedPlan().toString()
            rows = sorted(map(str, made.select(sorted(made.columns)).collect()))
        exchanges = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]
        assert not any("customer_id" in x for x in exchanges) and sum("week_num" in x for x in exchanges) <= 2
        assert len(exchanges) < plain._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        assert rows == sorted(map(str, plain.select(sorted(plain.columns)).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
        for name in ("candidates", "customers", "item_panel", "customer_panel"):
            spark.sql(f"drop table if exists bucketed_{name}")


def test_text_and_image_vectors_side_by_side(spark, world):
    """Two vectors of each item: both are averaged, both have their similarity, and one alone gives what the plain panel gives."""
    w = world
    both = w["vectors"].withColumn("image", F.transform("vector", lambda x: -x)).unionByName(spark.createDataFrame([(50, None, [1.0, 2.0, 3.0])], "article_id int, vector array<double>, image array<double>"))
    names = {"vector": "customer_avg_text", "image": "customer_avg_image"}
    panel = features.customer_week_panel(w["log"], both, START, END, HISTORY, 3, names)
    one_text = features.customer_week_panel(w["log"], both.select("article_id", "vector"), START, END, HISTORY, 3)
    joined = panel.join(one_text, ["customer_id", "week_num"]).collect()
    assert panel.columns == ["customer_id", "week_num", *["customer_avg_price"], *names.values()] and len(joined) == one_text.count()
    assert all(r.customer_avg_text is not None for r in joined if r.customer_avg_embedding is not None)
    static = w["articles"].withColumn("brand", F.lit(1.0))
    wanted = {"text_similarity": ("customer_avg_text", "vector"), "image_similarity": ("customer_avg_image", "image")}
    made = ranking.ranking_matrix(w["made"], static, w["customers"], w["items"], panel, both, similarities=wanted)
    assert not {"customer_avg_text", "customer_avg_image", "_vector", "_image"} & set(made.columns)
    assert checks.similarity_differences(made, panel, both, column="text_similarity", own="customer_avg_text").isEmpty()
    assert checks.similarity_differences(made, panel, both, column="image_similarity", own="customer_avg_image", vector="image").isEmpty()
    assert made.count() == w["made"].count() and made.where("image_similarity > 0").count() > 0


def test_configurations_make_the_same_tables_again(world):
    from weftline.operators.configs import CandidateConfig, PanelConfig, StaticConfig

    w, cal = world, Calendar(DAY, END)
    for config in (CandidateConfig(START + 1, END, 4, ratio=2), PanelConfig(START, END, 1, 3), StaticConfig(("age_bin",), fill={"x": "y"})):
        again = type(config).from_json(config.to_json())
        assert again.to_json() == config.to_json()
        with pytest.raises(ValueError):
            type(config).from_json(config.to_json()[:-1] + ', "other": 1}')
    with pytest.raises(ValueError):
        PanelConfig.from_json(CandidateConfig(1, 2).to_json())
    for bad in (lambda: CandidateConfig(3, 2), lambda: CandidateConfig(1, 2, strategy="none"), lambda: PanelConfig(3, 4, 5)):
        with pytest.raises(ValueError):
            bad()
    rows = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert rows(PanelConfig(START, END, 1, 3).items(w["log"], w["articles"], w["customers"])) == rows(w["items"])
    assert rows(PanelConfig(START, END, 1, 3).customers(w["log"], w["vectors"])) == rows(w["people"])
    assert rows(CandidateConfig(START + 1, END, 4).prepared(w["log"], "train", cal)["train"]) == rows(w["made"])


def test_filters_of_transactions_and_tables_by_kind(spark, world, tmp_path):
    from weftline.operators.repurchase import base_transactions
    from weftline.sources.tables import Bundle, load_kind, path_to

    log = world["log"]
    n = lambda **how: base_transactions(log, **how).count()
    day = DAY + timedelta(days=20)
    assert n() == log.count() and n(articles=[]) == n(customers=[]) == 0 and n(first_day=day) + n(last_day=day - timedelta(days=1)) == log.count()
    assert n(articles=world["articles"].where("article_id < 55"), customers=[1, 2]) == log.where("article_id < 55 and customer_id in (1, 2)").count()
    root = f"file://{tmp_path}/root"
    Bundle(spark, path_to(root, "candidates", 0.25)).save({"candidates_valid": world["made"].limit(3)})
    assert load_kind(spark, root, "candidates", "candidates", 0.25, sample="valid").count() == 3
    for bad in ({"sample": "all"}, {"sample": "test"}):
        with pytest.raises(ValueError):
            load_kind(spark, root, "candidates", "candidates", 0.25, **bad)
    with pytest.raises(ValueError):
        load_kind(spark, root, "none", "candidates")


def test_an_evaluation_of_one_week_takes_no_more(spark):
    lists = "customer_id int, week_num int, articles array<int>"
    actual = spark.createDataFrame([(1, 5, [1, 2]), (2, 5, [3])], lists)
    predicted = spark.createDataFrame([(1, 5, [1, 9]), (2, 5, [9, 3])], lists)
    found = ranking.evaluation(actual, predicted, predicted, 2, one_week=True).first()
    assert (found.customers, found.map_model, found.map_heuristic) == (2, 0.5, 0.5) and found.map_ideal == 0.75
    with pytest.raises(ValueError):
        ranking.evaluation(actual, predicted.unionByName(predicted.withColumn("week_num", F.lit(6))), predicted, 2, one_week=True)
