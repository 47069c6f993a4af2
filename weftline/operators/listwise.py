"""A listwise ranker: regression trees boosted on the gradients of NDCG within each customer's week.

The rows to train on are held by group, one row for each customer and week with its candidates in an array, best first.
So gradients, scores and metrics are expressions over arrays without a shuffle; only the trees' own statistics are
aggregated. A customer's week has the candidates of its sources (k popular items, the last basket or last k items), which bounds its array.
Trees become nested conditions over columns, so that scoring needs no Python and no model object.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import discard, stored
from .ranking import ranked_lists

GROUP = ["customer_id", "week_num"]
#: What a missing feature counts as.
MISSING = -1.0


@dataclass
class LambdaConfig:
    """What a listwise ranker is trained on, as JSON in its folder.

    ``cut`` is the k of NDCG@k: pairs count if one of the two is among the first k. Training stops when NDCG@k of the
    validation rows was not better for ``patience`` rounds; the trees up to the best round stay.
    """

    features: list[str]
    label: str = "label"
    trees: int = 20
    depth: int = 4
    step: float = 0.2
    sigma: float = 1.0
    cut: int = 12
    patience: int = 5
    least_rows: int = 20
    smooth: float = 1e-3
    seed: int = 42
    notes: dict = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> LambdaConfig:
        return cls(**json.loads(text))


def grouped(rows: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """``customer_id, week_num, items``: each group's candidates as ``score, article_id, label, x``, scores 0; null features count as -1, null labels as 0."""
    x = F.array(*(F.coalesce(F.col(f).cast("double"), F.lit(MISSING)) for f in features))
    own = F.coalesce(F.col(label).cast("double"), F.lit(0.0)) if label in rows.columns else F.lit(0.0)
    item = F.struct(F.lit(0.0).alias("score"), F.col("article_id").cast("long").alias("article_id"), own.alias("label"), x.alias("x"))
    return rows.groupBy(*GROUP).agg(F.collect_list(item).alias("items")).withColumn("items", by_score(F.col("items")))


def by_score(items: Column) -> Column:
    """Best first; of equal scores, the smaller item."""
    keyed = F.transform(items, lambda r: F.struct((-r["score"]).alias("k"), r["article_id"].alias("a"), r.alias("r")))
    return F.transform(F.array_sort(keyed), lambda s: s["r"])


def _discount(place: Column) -> Column:
    """Of a place counted from 0."""
    return 1 / F.log2(place.cast("double") + 2)


def _gain(label: Column) -> Column:
    return F.pow(F.lit(2.0), label) - 1


def _dcg(gains: Column, cut: int) -> Column:
    weighed = F.transform(F.slice(gains, 1, cut), lambda g, k: g * _discount(k))
    return F.aggregate(weighed, F.lit(0.0), lambda s, v: s + v)


def ideal_dcg(items: Column, cut: int) -> Column:
    """DCG@cut of the labels in the best order."""
    return _dcg(F.sort_array(F.transform(items, lambda r: _gain(r["label"])), asc=False), cut)


def ndcg(items: Column, cut: int = 12) -> Column:
    """NDCG@cut of a group's items as they stand; null without a positive label."""
    best = ideal_dcg(items, cut)
    return F.when(best > 0, _dcg(F.transform(items, lambda r: _gain(r["label"])), cut) / best)


def with_gradients(groups: DataFrame, cut: int = 12, sigma: float = 1.0) -> DataFrame:
    """``groups`` with ``lambdas``: for each item its gradient ``g`` and weight ``w``, in the items' order.

    Of two items with different labels, the better one is pulled up and the other down by the logistic loss of their scores'
    difference times the NDCG@cut that swapping their places would change. At least one of the two is among the first
    ``cut``: an item behind them meets these only, so a group of n costs n times cut.
    """
    pairs = groups.withColumn("_best", ideal_dcg(F.col("items"), cut))
    placed = F.transform("items", lambda r, k: F.struct(r["score"].alias("s"), r["label"].alias("l"), _gain(r["label"]).alias("gain"), F.when(k < cut, _discount(k)).otherwise(0.0).alias("d"), k.alias("k")))
    pairs = pairs.withColumn("_placed", placed)

    def pull(r: Column, o: Column) -> Column:
        """The pair's part of item ``r``, against ``o``."""
        up = r["l"] > o["l"]
        sign = F.when(up, F.lit(1.0)).otherwise(F.lit(-1.0))
        rho = 1 / (1 + F.exp(sign * sigma * (r["s"] - o["s"])))
        change = F.abs((r["gain"] - o["gain"]) * (r["d"] - o["d"])) / F.col("_best")
        return F.struct((sign * sigma * rho * change).alias("g"), (sigma * sigma * rho * (1 - rho) * change).alias("w"))

    def of_item(r: Column) -> Column:
        others = F.when(r["k"] < cut, F.col("_placed")).otherwise(F.slice("_placed", 1, cut))
        different = F.filter(others, lambda o: o["l"] != r["l"])
        none = F.struct(F.lit(0.0).alias("g"), F.lit(0.0).alias("w"))
        total = F.aggregate(F.transform(different, lambda o: pull(r, o)), none, lambda s, p: F.struct((s["g"] + p["g"]).alias("g"), (s["w"] + p["w"]).alias("w")))
        return F.when(F.col("_best") > 0, total).otherwise(none)

    return pairs.withColumn("lambdas", F.transform("_placed", of_item)).drop("_best", "_placed")


def parsed_tree(text: str) -> dict:
    """A regression tree of ``pyspark.ml`` from its description: splits ``{at, most, low, high}`` and leaves numbered from 0."""
    lines = [x.strip() for x in text.split("\n")[1:] if x.strip()]
    at, leaves = 0, 0

    def node() -> dict:
        nonlocal at, leaves
        line = lines[at]
        at += 1
        if line.startswith("Predict:"):
            leaves += 1
            return {"leaf": leaves - 1, "value": float(line.split()[1])}
        _, _, feature, _, threshold = line.strip("()").replace("(", "").replace(")", "").split()
        low = node()
        at += 1  # the line of the other branch
        return {"at": int(feature), "most": float(threshold), "low": low, "high": node()}

    return node()


def leaf_of(tree: dict, x: Column) -> Column:
    """The number of the leaf that a feature array falls into."""
    return _walk(tree, x, lambda leaf: F.lit(leaf["leaf"]))


def value_of(tree: dict, x: Column) -> Column:
    return _walk(tree, x, lambda leaf: F.lit(float(leaf["value"])))


def _walk(tree: dict, x: Column, leaf) -> Column:
    if "leaf" in tree:
        return leaf(tree)
    return F.when(x[tree["at"]] <= tree["most"], _walk(tree["low"], x, leaf)).otherwise(_walk(tree["high"], x, leaf))


def leaves(tree: dict) -> list[dict]:
    return [tree] if "leaf" in tree else leaves(tree["low"]) + leaves(tree["high"])


class LambdaRanker:
    """Boosted trees on NDCG gradients, with early stopping by validation groups."""

    def __init__(self, config: LambdaConfig, trees: list[dict] | None = None, gains: list[float] | None = None, history: list[dict] | None = None):
        self.config, self.trees, self.gains, self.history = config, trees, gains or [], history or []

    def train(self, rows: DataFrame, valid: DataFrame | None = None) -> LambdaRanker:
        """Fits the trees; ``valid`` has labelled rows like ``rows``. ``history`` keeps NDCG@cut of both after every round, from round 0 on.

        Without any pair of different labels in one group there is nothing to learn: ValueError.
        """
        c = self.config
        state = {"train": stored(grouped(rows, c.features, c.label), "ranker-train")}
        if valid is not None:
            state["valid"] = stored(grouped(valid, c.features, c.label), "ranker-valid")
        self.trees, self.gains, self.history = [], [0.0] * len(c.features), [self._metrics(state)]
        if self.history[0]["train"] is None:
            raise ValueError("no group has a positive label")
        gains = []
        for _ in range(c.trees):
            tree, gain = self._round(state["train"])
            self.trees.append(tree)
            gains.append(gain)
            state = {name: self._moved(groups, tree) for name, groups in state.items()}
            self.history.append(self._metrics(state))
            if valid is not None and self._stale() >= c.patience:
                break
        discard(*state.values())
        if valid is not None:
            self.trees = self.trees[: self.best_round()]
        self.gains = [sum(g[k] for g in gains[: len(self.trees)]) for k in range(len(c.features))]
        return self

    def best_round(self) -> int:
        """The number of trees with the best NDCG of the validation rows, or all trees without such; the first of equal ones."""
        scores = [h.get("valid") for h in self.history]
        if all(s is None for s in scores):
            return len(self.trees)
        return max(range(len(scores)), key=lambda k: (scores[k] is not None, scores[k] or 0.0, -k))

    def _stale(self) -> int:
        return len(self.history) - 1 - self.best_round() if self.history[-1].get("valid") is not None else 0

    def _metrics(self, state: dict[str, DataFrame]) -> dict:
        return {name: groups.agg(F.avg(ndcg(F.col("items"), self.config.cut))).first()[0] for name, groups in state.items()}

    def _round(self, groups: DataFrame) -> tuple[dict, list[float]]:
        """The next tree: its splits by least squares on each item's own Newton step, weighed by its weight; its leaves by their rows' Newton step."""
        from pyspark.ml.functions import array_to_vector
        from pyspark.ml.regression import DecisionTreeRegressor

        c = self.config
        each = with_gradients(groups, c.cut, c.sigma).select(F.explode(F.arrays_zip("items", "lambdas")).alias("r"))
        rows = each.select(F.col("r.items.x").alias("x"), F.col("r.lambdas.g").alias("g"), F.col("r.lambdas.w").alias("w"))
        rows = stored(rows.where("w > 0"), "ranker-gradients")
        fit = DecisionTreeRegressor(featuresCol="features", labelCol="y", weightCol="w", maxDepth=c.depth, minInstancesPerNode=c.least_rows, seed=c.seed + len(self.trees))
        model = fit.fit(rows.withColumns({"features": array_to_vector("x"), "y": F.col("g") / F.col("w")}))
        tree = parsed_tree(model.toDebugString)
        sums = rows.groupBy(leaf_of(tree, F.col("x")).alias("leaf")).agg(F.sum("g").alias("g"), F.sum("w").alias("w")).collect()  # a row for each leaf
        steps = {r.leaf: c.step * r.g / (r.w + c.smooth) for r in sums}
        for leaf in leaves(tree):
            leaf["value"] = steps.get(leaf["leaf"], 0.0)
        discard(rows)
        return tree, model.featureImportances.toArray().tolist()

    def _moved(self, groups: DataFrame, tree: dict) -> DataFrame:
        moved = F.transform("items", lambda r: r.withField("score", r["score"] + value_of(tree, r["x"])))
        return stored(groups.withColumn("items", by_score(moved)), "ranker-groups", groups)

    def _trained(self) -> list[dict]:
        if self.trees is None:
            raise ValueError("the ranker is not trained")
        return self.trees

    def scored(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``score``: sums of the trees' values."""
        trees = self._trained()
        x = F.array(*(F.coalesce(F.col(f).cast("double"), F.lit(MISSING)) for f in self.config.features))
        total = F.lit(0.0)
        for tree in trees:
            total = total + value_of(tree, F.col("_x"))
        return rows.withColumn("_x", x).withColumn("score", total).drop("_x")

    def ranks(self, rows: DataFrame, k: int = 12) -> DataFrame:
        return ranked_lists(self.scored(rows), k=k)

    def importance(self) -> dict[str, float]:
        """Shares of the features in the trees' gains, largest first."""
        self._trained()
        total = sum(self.gains) or 1.0
        return dict(sorted(((f, g / total) for f, g in zip(self.config.features, self.gains, strict=True)), key=lambda x: -x[1]))

    def save(self, path: str) -> None:
        text = json.dumps({"config": asdict(self.config), "trees": self._trained(), "gains": self.gains, "history": self.history})
        SparkSession.active().createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/listwise")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LambdaRanker:
        found = json.loads(spark.read.text(f"{path}/listwise", wholetext=True).first()[0])
        return cls(LambdaConfig(**found["config"]), found["trees"], found["gains"], found["history"])
