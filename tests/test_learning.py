"""The listwise ranker, early stopping, the search and the run store."""

import math
import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import listwise as L
from weftline.operators import ranking, search
from weftline.operators.runs import RunStore, train_and_validate

ROWS = "customer_id int, week_num int, article_id int, a double, b double, c double, label int"


def groups(seed, n, size=10, week=1):
    """Rows of which ``a`` says which item of a customer is bought, while ``b`` says which customers buy much at all."""
    rng, rows = random.Random(seed), []
    for customer in range(n):
        level = rng.gauss(0, 5)
        for item in range(size):
            a = rng.gauss(0, 1)
            p = 1 / (1 + math.exp(-(1.5 * a + level - 2)))
            rows.append((customer, week, item, a, level, rng.gauss(0, 1), int(rng.random() < p)))
    return rows


def python_gradients(items, cut, sigma):
    """``(g, w)`` of items ``(score, label)`` in their order, by the formula of LambdaMART."""
    gain = lambda label: 2.0**label - 1
    discount = lambda k: 1 / math.log2(k + 2) if k < cut else 0.0
    best = sum(gain(label) * discount(k) for k, label in enumerate(sorted((x[1] for x in items), reverse=True)))
    out = [[0.0, 0.0] for _ in items]
    for i, (si, li) in enumerate(items):
        for j, (sj, lj) in enumerate(items):
            if li > lj and min(i, j) < cut:
                change = abs((gain(li) - gain(lj)) * (discount(i) - discount(j))) / best
                rho = 1 / (1 + math.exp(sigma * (si - sj)))
                for k, sign in ((i, 1), (j, -1)):
                    out[k][0] += sign * sigma * rho * change
                    out[k][1] += sigma * sigma * rho * (1 - rho) * change
    return out


@pytest.mark.parametrize(("cut", "sigma"), [(12, 1.0), (3, 2.0), (1, 0.5)])
def test_gradients_equal_python(spark, cut, sigma):
    rng = random.Random(cut)
    lists = [sorted(((rng.choice([rng.gauss(0, 1), 0.0]), rng.choice([0, 0, 1, 2])) for _ in range(rng.randrange(1, 9))), reverse=True) for _ in range(25)]
    rows = [(k, 1, [(float(s), j, float(label), [0.0]) for j, (s, label) in enumerate(items)]) for k, items in enumerate(lists)]
    df = spark.createDataFrame(rows, "customer_id int, week_num int, items array<struct<score:double,article_id:long,label:double,x:array<double>>>")
    for r in L.with_gradients(df, cut, sigma).collect():
        items = [(x.score, x.label) for x in r["items"]]
        want = python_gradients(items, cut, sigma) if any(label for _, label in items) else [[0.0, 0.0]] * len(items)
        assert [[x.g, x.w] for x in r.lambdas] == [pytest.approx(x, abs=1e-12) for x in want]


def test_ndcg_and_order(spark):
    rows = [(1, 1, 7, 0.0, 0.0, 0.0, 0), (1, 1, 5, 0.0, 0.0, 0.0, 1), (1, 1, 6, 0.0, 0.0, 0.0, None), (2, 1, 5, None, 0.0, 0.0, 0)]
    found = {r[0]: r for r in L.grouped(spark.createDataFrame(rows, ROWS), ["a", "b"]).withColumn("ndcg", L.ndcg(F.col("items"), 2)).collect()}
    assert [x.article_id for x in found[1]["items"]] == [5, 6, 7] and found[1].ndcg == 1.0 and found[2].ndcg is None
    assert found[2]["items"][0].x == [-1.0, 0.0]
    with pytest.raises(ValueError):
        L.LambdaRanker(L.LambdaConfig(["a"])).train(spark.createDataFrame(rows[3:], ROWS))
    with pytest.raises(ValueError):
        L.LambdaRanker(L.LambdaConfig(["a"])).scored(spark.createDataFrame(rows, ROWS))


def test_parsed_tree_scores_like_the_model(spark):
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import DecisionTreeRegressor

    df = spark.createDataFrame(groups(3, 40), ROWS).withColumn("x", F.array("a", "b", "c")).withColumn("features", array_to_vector("x"))
    model = DecisionTreeRegressor(labelCol="label", maxDepth=4).fit(df)
    model.setLeafCol("leaf_id")
    tree = L.parsed_tree(model.toDebugString)
    rows = model.transform(df).select("prediction", "leaf_id", L.value_of(tree, F.col("x")).alias("own"), L.leaf_of(tree, F.col("x")).alias("leaf")).collect()
    assert all(r.prediction == pytest.approx(r.own) for r in rows)
    assert len({(r.leaf_id, r.leaf) for r in rows}) == len({r.leaf for r in rows}) == len(L.leaves(tree))
    assert [x["leaf"] for x in L.leaves(tree)] == list(range(len(L.leaves(tree))))


@pytest.fixture(scope="module")
def learnt(spark):
    train, valid, held = (spark.createDataFrame(groups(seed, 150, week=week), ROWS).repartition(3).cache() for seed, week in ((1, 1), (2, 2), (3, 3)))
    config = L.LambdaConfig(["a", "b", "c"], trees=6, depth=3, step=0.3, patience=2)
    return train, valid, held, L.LambdaRanker(config).train(train, valid)


def bought(rows):
    return rows.where("label = 1").groupBy("customer_id", "week_num").agg(F.collect_list("article_id").alias("articles"))


def test_listwise_is_at_least_as_good_as_pointwise(spark, learnt):
    train, _, held, ranker = learnt
    gbt = ranking.GbtRanker(ranking.RankerConfig(["a", "b", "c"], trees=6, depth=3)).train(train)
    actual = bought(held)
    score = lambda lists: ranking.mean_precision(actual, lists, 5).first()["map"]
    chance = score(ranking.ranked_lists(held, "c", 5))
    own = score(ranker.ranks(held, 5))
    assert own >= score(gbt.ranks(held, 5)) and own > chance + 0.05
    assert next(iter(ranker.importance())) == "a" and sum(ranker.importance().values()) == pytest.approx(1)
    assert ranker.history[-1]["train"] > ranker.history[0]["train"]
    # scores by columns are the scores that training ended with
    again = L.grouped(held, ["a", "b", "c"]).select("customer_id", F.explode("items").alias("r")).count()
    assert again == held.count()
    plan = ranker.scored(held)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange hash" not in plan


def test_training_stops_and_keeps_the_best_round(spark):
    """The validation labels follow the other feature, so that rounds after the best one only get worse."""
    train = spark.createDataFrame([(c, 1, i, *r) for c in range(60) for i, r in enumerate([(1.0, 0.0, 0.0, 1), (0.9, 1.0, 0.0, 0), (0.1, 0.5, 0.0, 0)])], ROWS)
    valid = spark.createDataFrame([(c, 2, i, *r) for c in range(20) for i, r in enumerate([(1.0, 0.0, 0.0, 0), (0.9, 1.0, 0.0, 1), (0.1, 0.5, 0.0, 0)])], ROWS)
    config = L.LambdaConfig(["a", "b"], trees=9, depth=2, patience=2, least_rows=1)
    ranker = L.LambdaRanker(config).train(train, valid)
    assert ranker.best_round() == len(ranker.trees) < len(ranker.history) - 1 < config.trees
    assert len(ranker.history) - 1 - ranker.best_round() == config.patience
    whole = L.LambdaRanker(L.LambdaConfig(["a", "b"], trees=3, depth=2, least_rows=1)).train(train)
    assert len(whole.trees) == 3 and whole.history[-1]["train"] == pytest.approx(1)
    L_stub = L.LambdaRanker(config, [{}] * 4, [], [{"train": 0.1, "valid": v} for v in (0.2, 0.5, 0.7, 0.7, 0.4)])
    assert L_stub.best_round() == 2


def test_listwise_runs_in_the_store(spark, learnt, tmp_path):
    train, valid, held, _ = learnt
    store = RunStore(spark, f"file://{tmp_path}/runs")
    config = L.LambdaConfig(["a", "c"], trees=2, depth=2)
    ranker, scores = train_and_validate(config, train, {"held": (held, bought(held))}, store, "listwise", 5, valid)
    assert 0 < scores["held_map"] <= scores["held_ideal_map"] <= 1
    again = store.ranker("listwise")
    assert again.trees == ranker.trees and store.config("listwise", depth=3) == L.LambdaConfig(["a", "c"], trees=2, depth=3)
    key = ["customer_id", "article_id", "score"]
    assert sorted(map(tuple, again.scored(held).select(*key).collect())) == sorted(map(tuple, ranker.scored(held).select(*key).collect()))
    gbt = ranking.RankerConfig(["a", "c"], trees=3)
    train_and_validate(gbt, train, {"held": (held, bought(held))}, store, "pointwise", 5, valid)
    assert store.config("pointwise") == gbt and isinstance(store.ranker("pointwise"), ranking.GbtRanker)
    with pytest.raises(ValueError):
        store.config("none")


SPACE = {"x": search.Float(-5, 5), "y": search.Float(1e-4, 1, log=True), "n": search.Int(1, 20), "kind": search.Choice(("good", "bad", "worse"))}


def hill(p):
    return -((p["x"] - 1.5) ** 2) - (math.log10(p["y"]) + 2) ** 2 - abs(p["n"] - 7) / 3 - {"good": 0, "bad": 2, "worse": 4}[p["kind"]]


def test_parzen_search_beats_random_search():
    """With the same seeds and trials: on the whole clearly, and for most seeds."""
    own = [search.searched(hill, SPACE, 60, seed)[0]["score"] for seed in range(12)]
    chance = [search.searched(hill, SPACE, 60, seed, startup=60)[0]["score"] for seed in range(12)]
    assert sum(own) / 12 > sum(chance) / 12 + 0.5 and sum(a >= b for a, b in zip(own, chance)) >= 9


def test_search_bounds_and_failed_trials():
    found = search.searched(lambda p: None if p["kind"] == "bad" else hill(p), SPACE, 40, 1)
    assert len(found) == 40 and all(-5 <= t["params"]["x"] <= 5 and 1e-4 <= t["params"]["y"] <= 1 and 1 <= t["params"]["n"] <= 20 for t in found)
    scores = [t["score"] for t in found]
    assert found[0]["score"] is not None and scores == sorted(scores, key=lambda s: (s is None, -(s or 0)))
    one = search.searched(lambda p: 0.0, {"x": search.Float(2, 2), "n": search.Int(3, 3)}, 15, 1)
    assert all(t["params"] == {"x": 2.0, "n": 3} for t in one)
    parzen = search.Parzen([0.2, 0.21, 0.9])
    step = 1 / 4000
    assert sum(parzen.density((k + 0.5) * step) * step for k in range(4000)) == pytest.approx(1, abs=1e-3)


def test_search_goes_on_as_if_it_had_not_ended(spark, tmp_path):
    store = RunStore(spark, f"file://{tmp_path}/search")
    assert store.trials("hill") == []
    search.searched(hill, SPACE, 4, 7, startup=2, store=store, study="hill")
    calls = []
    resumed = search.searched(lambda p: calls.append(p) or hill(p), SPACE, 7, 7, startup=2, store=store, study="hill")
    assert len(calls) == 3 and resumed == search.searched(hill, SPACE, 7, 7, startup=2)
    assert [t["trial"] for t in store.trials("hill")] == list(range(7))


def test_tuned_rankers(spark, learnt, tmp_path):
    train, valid, held, _ = learnt
    small = train.where("customer_id < 40")
    store = RunStore(spark, f"file://{tmp_path}/tuned")
    best, found = search.tuned_ranker(ranking.RankerConfig(["a", "b"], trees=2), {"depth": search.Int(1, 3), "step": search.Float(0.05, 0.5, log=True)}, small, valid, held, bought(held), 3, 5, store=store)
    assert best.depth == found[0]["params"]["depth"] and best.features == ["a", "b"] and len(store.trials("ranker")) == 3
    space = {"depth": [1, 2], "trees": [1, 2]}
    plain = ranking.random_search(small, held, bought(held), ["a", "b"], space, trials=2, k=5)
    assert len(plain) == 2 and plain[0]["map"] >= plain[1]["map"] and all(t["depth"] in (1, 2) for t in plain)
    assert [t["map"] for t in ranking.random_search(small, held, bought(held), ["a", "b"], space, trials=2, k=5)] == [t["map"] for t in plain]
