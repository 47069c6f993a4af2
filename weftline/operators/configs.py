"""What each stage is run with, as JSON, so that a stored table says how it was made and can be made again."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame

from ..functions.calendar import Calendar
from . import candidates, features


class _Json:
    """Configurations as JSON objects with their kind; an unknown field or kind is an error."""

    def to_json(self) -> str:
        return json.dumps({"kind": type(self).__name__} | asdict(self))

    @classmethod
    def from_json(cls, text: str):
        found = json.loads(text)
        if found.pop("kind", cls.__name__) != cls.__name__:
            raise ValueError(f"this is no {cls.__name__}")
        if unknown := sorted(found.keys() - {f.name for f in fields(cls)}):
            raise ValueError(f"no such fields: {unknown}")
        return cls(**found)


@dataclass(frozen=True)
class CandidateConfig(_Json):
    """Candidates of the weeks ``start..end``: k popular items and a repurchase strategy (or none), negatives for each positive at most ``ratio``."""

    start: int
    end: int
    k: int = 12
    strategy: str | None = "last_purchase"
    restrict_positives: bool = True
    ratio: float | None = None

    def __post_init__(self):
        if self.start > self.end:
            raise ValueError("the first week is after the last")
        if self.strategy not in (None, "last_purchase", "last_k_items"):
            raise ValueError(f"no such strategy: {self.strategy}")

    def prepared(self, log: DataFrame, sample: str, calendar: Calendar, customers: DataFrame | list | None = None) -> dict[str, DataFrame]:
        """The candidates of a sample by name: see ``candidates.prepared``."""
        return candidates.prepared(log, sample, self.start, self.end, calendar, self.k, self.strategy, self.restrict_positives, self.ratio, customers)


@dataclass(frozen=True)
class PanelConfig(_Json):
    """Panels of the weeks ``start..end`` from purchases since ``history_start``; k latest distinct items count for a customer."""

    start: int
    end: int
    history_start: int
    k: int = 5

    def __post_init__(self):
        if not self.history_start <= self.start <= self.end:
            raise ValueError("history, first and last week are not in this order")

    def items(self, log: DataFrame, articles: DataFrame, customers: DataFrame) -> DataFrame:
        return features.item_week_panel(log, articles, customers, self.start, self.end, (self.history_start, self.end))

    def customers(self, log: DataFrame, embeddings: DataFrame, vectors: dict[str, str] | None = None) -> DataFrame:
        return features.customer_week_panel(log, embeddings, self.start, self.end, (self.history_start, self.end), self.k, vectors)


@dataclass(frozen=True)
class StaticConfig(_Json):
    """Static features of customers: columns that are coded, and what nulls become."""

    columns: tuple[str, ...]
    nulls: str = "fill"
    fill: dict | None = None
    keep_age: bool = True

    def customers(self, customers: DataFrame) -> DataFrame:
        return features.customer_features(customers, list(self.columns), self.nulls, self.fill, keep_age=self.keep_age)
