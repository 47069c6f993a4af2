"""Ordinal codes as a fitted transformer: learnt from training rows, stored, and applied to later ones."""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Up to so many codes go along as one row's map; with more of them, each column is joined.
MAPPED = 10_000
#: The category of a null, and the code of a value that was not there when codes were learnt.
NULL, UNKNOWN = "nan", -1.0


def _text(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit(NULL))


def ordinal_codes(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, value, code``: values as text in their order, numbered from 0; null is the category "nan".

    One pass: all columns' values are stacked and made distinct before they are numbered. An item
    attribute has few values; the table is as large as all of them.
    """
    stacked = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), _text(c).alias("value")) for c in columns))).alias("x")).select("x.*")
    number = F.row_number().over(Window.partitionBy("column").orderBy("value")) - 1
    return stacked.distinct().withColumn("code", number.cast("double"))


def encoded(df: DataFrame, codes: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with columns replaced by their codes; a value that the codes don't know is -1.

    Few codes are a map in one row, so that all columns are looked up without a join of ``df``'s rows; the number of codes is counted first.
    """
    if codes.limit(MAPPED + 1).count() > MAPPED:
        for c in columns:
            own = codes.where(F.col("column") == c).select(F.col("value").alias("_value"), F.col("code").alias("_code"))
            df = df.join(own, _text(c) == F.col("_value"), "left").withColumn(c, F.coalesce("_code", F.lit(UNKNOWN))).drop("_value", "_code")
        return df
    each = codes.groupBy().agg(*(F.map_from_entries(F.collect_list(F.when(F.col("column") == c, F.struct("value", "code")))).alias(f"_{k}") for k, c in enumerate(columns)))
    out = df.crossJoin(F.broadcast(each))  # one row
    return out.withColumns({c: F.coalesce(F.try_element_at(f"_{k}", _text(c)), F.lit(UNKNOWN)) for k, c in enumerate(columns)}).drop(*(f"_{k}" for k in range(len(columns))))


class OrdinalEncoder(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the codes of ``inputCols``; the model replaces these columns."""

    def __init__(self, columns: list[str] | None = None):
        super().__init__()
        if columns is not None:
            self._set(inputCols=list(columns))

    def _fit(self, dataset: DataFrame) -> OrdinalEncoderModel:
        return OrdinalEncoderModel(self.getInputCols(), ordinal_codes(dataset, self.getInputCols()))


class _Writer(MLWriter):
    def __init__(self, model: OrdinalEncoderModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.codes.coalesce(1).write.parquet(f"{path}/codes")


class _Reader(MLReader):
    def load(self, path: str) -> OrdinalEncoderModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = OrdinalEncoderModel([], SparkSession.active().read.parquet(f"{path}/codes"))
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class OrdinalEncoderModel(Model, HasInputCols, MLWritable, MLReadable):
    """Codes that were learnt: ``codes`` has ``column, value, code``."""

    def __init__(self, columns: list[str], codes: DataFrame):
        super().__init__()
        self.codes = codes
        self._set(inputCols=list(columns))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return encoded(dataset, self.codes, self.getInputCols())

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()
