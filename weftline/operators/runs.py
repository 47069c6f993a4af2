"""Named columns by kind, and training runs with their parameters, scores and models in one folder."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .listwise import LambdaConfig, LambdaRanker
from .ranking import GbtRanker, RankerConfig, mean_precision

RUN = "name string, config string, scores map<string,double>, importance map<string,double>, kind string"
TRIAL = "trial int, params string, score double"
#: Rankers by the name of what they are trained on; a run without a kind is of the first.
RANKERS = {"RankerConfig": (RankerConfig, GbtRanker), "LambdaConfig": (LambdaConfig, LambdaRanker)}


def ranker_for(config: RankerConfig | LambdaConfig) -> GbtRanker | LambdaRanker:
    """An untrained ranker of the kind that a configuration is for."""
    return RANKERS[type(config).__name__][1](config)


#: The key of a column's metadata that holds its kind.
KIND = "kind"


def marked(df: DataFrame, kind: str, columns: list[str]) -> DataFrame:
    """``df`` with the kind of some columns in their metadata, which joins, selections and Parquet files keep."""
    for c in columns:
        df = df.withMetadata(c, df.schema[c].metadata | {KIND: kind})
    return df


@dataclass(frozen=True)
class FeatureGroups:
    """Columns of a table by kind (numerical, categorical, id, label or any other); fit for a bundle's JSON as ``groups``."""

    groups: dict[str, list[str]]

    @classmethod
    def of(cls, df: DataFrame) -> FeatureGroups:
        """The kinds that the columns of a table are marked with, in the order of the columns."""
        found: dict[str, list[str]] = {}
        for column in df.schema:
            if KIND in column.metadata:
                found.setdefault(column.metadata[KIND], []).append(column.name)
        return cls(found)

    def merged(self, *others: FeatureGroups) -> FeatureGroups:
        """All kinds of all tables; a column counts once, at its first place."""
        out: dict[str, dict[str, None]] = {}
        for one in (self, *others):
            for kind, names in one.groups.items():
                out.setdefault(kind, {}).update(dict.fromkeys(names))
        return FeatureGroups({kind: list(names) for kind, names in out.items()})

    def names(self, kinds: list[str], wanted: list[str] | None = None) -> list[str]:
        """Columns of these kinds in their order, or those of them that are wanted; ValueError for any other."""
        known = dict.fromkeys(name for kind in kinds for name in self.groups.get(kind, []))
        unknown = [name for name in wanted or [] if name not in known]
        if unknown or (lost := [kind for kind in kinds if kind not in self.groups]):
            raise ValueError(f"no such columns: {unknown}" if unknown else f"no such kinds: {lost}")
        return [name for name in known if wanted is None or name in wanted]


class RunStore:
    """Runs under one root, each in a folder of its own, so that runs at the same time do not meet."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def save(self, name: str, config: RankerConfig | LambdaConfig, scores: dict[str, float], ranker: GbtRanker | LambdaRanker | None = None) -> None:
        """A run's parameters and scores, with the model and its importances if given; a name is used once only."""
        if ranker is not None:
            ranker.save(f"{self.root}/models/{name}")
        row = (name, config.to_json(), {k: float(v) for k, v in scores.items() if v is not None}, ranker.importance() if ranker else {}, type(config).__name__)
        self.spark.createDataFrame([row], RUN).coalesce(1).write.mode("errorifexists").json(f"{self.root}/runs/{name}")

    def runs(self) -> DataFrame:
        """``name, config, scores, importance`` of all runs."""
        return self.spark.read.schema(RUN).option("recursiveFileLookup", True).json(f"{self.root}/runs")

    def best(self, score: str) -> str:
        """The name of the run with the highest score of this name; of equal ones the first by name."""
        value = F.col("scores")[score]
        found = self.runs().where(value.isNotNull()).orderBy(value.desc(), "name").select("name").first()
        if found is None:
            raise ValueError(f"no run has a score {score}")
        return found[0]

    def _run(self, name: str):
        found = self.runs().where(F.col("name") == name).select("config", "kind").first()
        if found is None:
            raise ValueError(f"no such run: {name}")
        return found[0], RANKERS[found[1] or "RankerConfig"]

    def config(self, name: str, **changes) -> RankerConfig | LambdaConfig:
        """A run's configuration, with changes."""
        text, (kind, _) = self._run(name)
        return replace(kind.from_json(text), **changes)

    def ranker(self, name: str) -> GbtRanker | LambdaRanker:
        return self._run(name)[1][1].load(self.spark, f"{self.root}/models/{name}")

    def save_trial(self, study: str, trial: dict) -> None:
        """A trial of a search; its number is used once only in a study."""
        row = (trial["trial"], json.dumps(trial["params"]), trial["score"])
        self.spark.createDataFrame([row], TRIAL).coalesce(1).write.mode("errorifexists").json(f"{self.root}/trials/{study}/{trial['trial']:06d}")

    def trials(self, study: str) -> list[dict]:
        """All trials of a study by number; none if there is no such study."""
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/trials/{study}")
        if not folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            return []
        rows = self.spark.read.schema(TRIAL).option("recursiveFileLookup", True).json(folder.toString()).orderBy("trial").collect()
        return [{"trial": r.trial, "params": json.loads(r.params), "score": r.score} for r in rows]


def train_and_validate(
    config: RankerConfig | LambdaConfig, train: DataFrame, parts: dict[str, tuple[DataFrame, DataFrame]], store: RunStore | None = None, name: str = "run", k: int = 12, valid: DataFrame | None = None
) -> tuple[GbtRanker | LambdaRanker, dict[str, float]]:
    """A ranker of the rows ``train``, and its MAP@k on each part: candidates, and what the customers bought (``articles``).

    With labelled rows ``valid`` (``candidates.prepared(...)["train"]`` of the validation week), training stops by them.
    """
    ranker = ranker_for(config).train(train, valid)
    scores = {}
    for part, (candidates, actual) in parts.items():
        found = mean_precision(actual, ranker.ranks(candidates, k), k).first()
        scores |= {f"{part}_map": found["map"], f"{part}_ideal_map": found["ideal_map"]}
    if store is not None:
        store.save(name, config, scores, ranker)
    return ranker, scores
