"""The weekly calendar: 7-day blocks counted back from the last day of the purchase log."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Calendar:
    """Week ``last_week`` is the seven days that end at ``last_day``; earlier weeks have smaller numbers."""

    last_day: date
    last_week: int = 104

    def week_num(self, day: Column) -> Column:
        return (F.lit(self.last_week) - F.floor(F.datediff(F.lit(self.last_day), day) / 7)).cast("int")

    def week_start(self, week: Column) -> Column:
        """First day of a week: the last week starts six days before ``last_day``."""
        return F.date_sub(F.lit(self.last_day + timedelta(days=1)), (F.lit(self.last_week + 1) - week) * 7)

    def week_of(self, day: date) -> int:
        return self.last_week - (self.last_day - day).days // 7

    def start_of(self, week: int) -> date:
        return self.last_day + timedelta(days=1) - timedelta(weeks=self.last_week - week + 1)


def with_week_num(log: DataFrame, day: str = "t_dat", last_week: int = 104) -> DataFrame:
    """``log`` with week_num, relative to the latest day of the whole log (one row, joined in without a collect)."""
    last = log.agg(F.max(day).alias("_last"))
    return log.crossJoin(F.broadcast(last)).withColumn("week_num", (F.lit(last_week) - F.floor(F.datediff("_last", day) / 7)).cast("int")).drop("_last")


def wednesday(day: Column) -> Column:
    """The Wednesday on or before a day."""
    return F.date_sub(day, (F.dayofweek(day) + 3) % 7)


def date_features(rows: DataFrame, week_start: Column) -> DataFrame:
    """``rows`` with year, month and week (text) of a week's first day."""
    return rows.withColumns({"year": F.year(week_start), "month": F.month(week_start), "week": F.date_format(week_start, "yyyy-MM-dd")})


def split_of(day: Column, valid_from: Column, test_from: Column) -> Column:
    """train, valid or test; both later parts start on their first day."""
    return F.when(day >= test_from, "test").when(day >= valid_from, "valid").when(day.isNotNull(), "train")
