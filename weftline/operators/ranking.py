"""The ranking matrix, rankings as lists, MAP@k, rankers and their run records."""

from __future__ import annotations

import json
import random
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import average_precision, cosine, ideal_precision


def ranking_matrix(candidates: DataFrame, articles: DataFrame, customers: DataFrame, item_panel: DataFrame, customer_panel: DataFrame, embeddings: DataFrame, shifted: bool = False, similarities: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Candidates with static features, both panels of the week before, similarity and derived ratios.

    Every right side has one row for each key, so no candidate is multiplied. Divisions by zero give null.
    Panels that are ``shifted`` have the week in which they are used already (``layout.lay_out_inputs``). What is looked up by customer comes
    first, so that candidates in buckets of the customer are dealt anew once only, by item. ``similarities`` are the cosines that are wanted, each
    of a column of the customer panel and one of ``embeddings``: by default ``similarity`` of ``customer_avg_embedding`` and ``vector``.
    """
    similarities = similarities or {"similarity": ("customer_avg_embedding", "vector")}
    before = lambda df: df if shifted else df.withColumn("week_num", F.col("week_num") + 1)
    out = candidates.join(customers, "customer_id", "left").join(before(customer_panel), ["customer_id", "week_num"], "left")
    out = out.join(before(item_panel), ["article_id", "week_num"], "left").join(articles, "article_id", "left")
    wanted = dict.fromkeys(v for _, v in similarities.values())
    out = out.join(embeddings.select("article_id", *(F.col(v).alias(f"_{v}") for v in wanted)), "article_id", "left")
    out = out.withColumns({name: cosine(F.col(own), F.col(f"_{v}")) for name, (own, v) in similarities.items()})
    out = out.drop(*(f"_{v}" for v in wanted), *(own for own, _ in similarities.values()))
    age = F.col("age") - F.col("cumulative_mean_age")
    price = F.col("price") - F.col("customer_avg_price")
    return out.withColumns({"age_difference": age, "age_ratio": F.try_divide(age, F.col("age")), "price_difference": price, "price_ratio": F.try_divide(price, F.col("customer_avg_price"))})


def group_sizes(rows: DataFrame) -> DataFrame:
    """Candidates of each customer and week."""
    return rows.groupBy("customer_id", "week_num").agg(F.count("*").alias("n"))


def ranked_lists(rows: DataFrame, score: str = "score", k: int = 12) -> DataFrame:
    """``customer_id, week_num, articles``: the k items of the highest scores, ties by item; the cut comes before the lists."""
    order = Window.partitionBy("customer_id", "week_num").orderBy(F.desc_nulls_last(score), "article_id")
    top = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_n", "article_id"))), lambda s: s["article_id"])
    return top.groupBy("customer_id", "week_num").agg(listed.alias("articles"))


def actual_lists(log: DataFrame, start: int, end: int) -> DataFrame:
    """``customer_id, week_num, articles``: the distinct items that a customer bought in a week."""
    return log.where(F.col("week_num").between(start, end)).groupBy("customer_id", "week_num").agg(F.array_sort(F.collect_set("article_id")).alias("articles"))


def precision_by_customer(actual: DataFrame, predicted: DataFrame, k: int = 12) -> DataFrame:
    """``customer_id, week_num, ap, ideal_ap`` for all customers with purchases; without a prediction both are 0."""
    joined = actual.join(predicted.withColumnRenamed("articles", "predicted"), ["customer_id", "week_num"], "left")
    return joined.select("customer_id", "week_num", average_precision(F.col("articles"), F.col("predicted"), k).alias("ap"), ideal_precision(F.col("articles"), F.col("predicted"), k).alias("ideal_ap"))


def mean_precision(actual: DataFrame, predicted: DataFrame, k: int = 12, by_week: bool = False) -> DataFrame:
    """MAP@k and its ideal, over all customers' weeks or for each week."""
    per = precision_by_customer(actual, predicted, k)
    return (per.groupBy("week_num") if by_week else per.groupBy()).agg(F.count("*").alias("customers"), F.avg("ap").alias("map"), F.avg("ideal_ap").alias("ideal_map"))


def heuristic_lists(actual: DataFrame, popular: DataFrame, k: int = 12) -> DataFrame:
    """The same list for every customer: the popular items of the week before."""
    listed = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("bestseller_rank", "article_id"))), 1, k), lambda s: s["article_id"])
    weekly = popular.groupBy((F.col("week_num") + 1).alias("week_num")).agg(listed.alias("articles"))
    return actual.select("customer_id", "week_num").join(weekly, "week_num").select("customer_id", "week_num", "articles")


def evaluation(actual: DataFrame, predicted: DataFrame, heuristic: DataFrame, k: int = 12, one_week: bool = False) -> DataFrame:
    """One row: customers' weeks, and the mean precisions of the model, of the heuristic, and of the model's items in the best order.

    With ``one_week``, predictions of several weeks are an error, as an inference is for one.
    """
    if one_week:
        single_week(predicted)
    model = mean_precision(actual, predicted, k)
    plain = mean_precision(actual, heuristic, k).select(F.col("map").alias("map_heuristic"))
    return model.join(plain).select("customers", F.col("map").alias("map_model"), "map_heuristic", F.col("ideal_map").alias("map_ideal"))


def single_week(rows: DataFrame) -> int:
    """The only week of ``rows``; ValueError with several or none."""
    weeks = [r[0] for r in rows.select("week_num").distinct().limit(2).collect()]
    if len(weeks) != 1:
        raise ValueError("rows of one week are wanted")
    return weeks[0]


def for_ranker(rows: DataFrame, features: list[str], label: str | None = "label") -> DataFrame:
    """Keys, features and label in this order, sorted by customer, week and item: for export, as that is a global sort."""
    columns = ["customer_id", "week_num", "article_id", *(f for f in features if f not in ("customer_id", "week_num", "article_id"))]
    unknown = [c for c in columns if c not in rows.columns]
    if unknown:
        raise ValueError(f"no such columns: {unknown}")
    return rows.select(*columns, *([label] if label and label in rows.columns else [])).orderBy("customer_id", "week_num", "article_id")


@dataclass
class RankerConfig:
    """What a ranker is trained on, as JSON in its folder."""

    features: list[str]
    label: str = "label"
    trees: int = 20
    depth: int = 4
    step: float = 0.1
    seed: int = 42
    notes: dict = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> RankerConfig:
        return cls(**json.loads(text))


class GbtRanker:
    """A pointwise ranker: gradient-boosted trees on the label, applied by score. It is not a listwise ranker."""

    def __init__(self, config: RankerConfig, model=None):
        self.config, self.model = config, model

    def train(self, rows: DataFrame, valid: DataFrame | None = None) -> GbtRanker:
        """Fits the trees; with labelled rows ``valid``, no more of them once these are not predicted better."""
        from pyspark.ml import Pipeline
        from pyspark.ml.classification import GBTClassifier
        from pyspark.ml.feature import VectorAssembler

        c = self.config
        tree = GBTClassifier(labelCol=c.label, maxIter=c.trees, maxDepth=c.depth, stepSize=c.step, seed=c.seed)
        own = self._typed(rows)
        if valid is not None:
            columns = [*c.features, c.label]
            own = own.select(*columns, F.lit(False).alias("_valid")).unionByName(self._typed(valid).select(*columns, F.lit(True).alias("_valid")))
            tree.setValidationIndicatorCol("_valid")
        self.model = Pipeline(stages=[VectorAssembler(inputCols=c.features, outputCol="features", handleInvalid="keep"), tree]).fit(own)
        return self

    def _typed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(-1.0)) for f in self.config.features} | ({self.config.label: F.col(self.config.label).cast("double")} if self.config.label in rows.columns else {}))

    def scored(self, rows: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        if self.model is None:
            raise ValueError("the ranker is not trained")
        out = self.model.transform(self._typed(rows)).withColumn("score", vector_to_array("probability")[1])
        return out.drop("features", "rawPrediction", "probability", "prediction")

    def ranks(self, rows: DataFrame, k: int = 12) -> DataFrame:
        return ranked_lists(self.scored(rows), k=k)

    def importance(self) -> dict[str, float]:
        """Shares of the features in the trees' gains, largest first."""
        got = self.model.stages[-1].featureImportances.toArray()
        total = got.sum() or 1.0
        return dict(sorted(zip(self.config.features, (got / total).tolist(), strict=True), key=lambda x: -x[1]))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        SparkSession.active().createDataFrame([(self.config.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")

    @classmethod
    def load(cls, spark, path: str) -> GbtRanker:
        from pyspark.ml import PipelineModel

        return cls(RankerConfig.from_json(spark.read.text(f"{path}/config", wholetext=True).first()[0]), PipelineModel.load(f"{path}/model"))


def random_search(train: DataFrame, valid: DataFrame, actual: DataFrame, features: list[str], space: dict[str, list], trials: int = 5, seed: int = 42, k: int = 12) -> list[dict]:
    """Seeded random search by MAP@k on the validation candidates, best first: each trial a record of its parameters and score."""
    rng, found = random.Random(seed), []
    for n in range(trials):
        drawn = {name: rng.choice(values) for name, values in space.items()}
        ranker = GbtRanker(RankerConfig(features, seed=seed, **drawn)).train(train)
        score = mean_precision(actual, ranker.ranks(valid, k), k).first()["map"]
        found.append({"trial": n, **drawn, "map": score})
    return sorted(found, key=lambda x: -(x["map"] or 0))


def score_rows(spark, rows: list[dict], ranker: GbtRanker) -> list[float]:
    """Scores of a few rows given as dictionaries, in their order: the function behind a scoring service."""
    missing = [f for f in ranker.config.features if any(f not in r for r in rows)]
    if missing:
        raise ValueError(f"features are missing: {missing}")
    df = spark.createDataFrame([(n, *(float(r[f]) if r[f] is not None else None for f in ranker.config.features)) for n, r in enumerate(rows)], ", ".join(["_n int", *(f"`{f}` double" for f in ranker.config.features)]))
    return [x[0] for x in ranker.scored(df).orderBy("_n").select("score").collect()]
