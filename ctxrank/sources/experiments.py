"""The experiment log: one row per run, addressed by column name."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of the log, in order.
COLUMNS = (
    "datetime STRING, model_name STRING, method STRING, task STRING, topic STRING,"
    " question_coef DOUBLE, second_question_coef DOUBLE, spread_coef DOUBLE, downsample DOUBLE,"
    " temperature DOUBLE, n INT, indexer_name STRING, first_n INT, encoder_name STRING,"
    " indexer_ndcg DOUBLE, encoder_ndcg DOUBLE, reranked_ndcg DOUBLE,"
    " second_reranked_ndcg DOUBLE, third_reranked_ndcg DOUBLE"
)


def experiment_rows(spark: SparkSession, rows: DataFrame | Iterable[Mapping]) -> DataFrame:
    """Rows with all columns of the log; a column a row lacks is null."""
    empty = spark.createDataFrame([], COLUMNS)
    if not isinstance(rows, DataFrame):
        names = empty.columns
        values = [tuple(row.get(name) for name in names) for row in rows]
        return spark.createDataFrame(values, COLUMNS)
    whole = empty.unionByName(rows, allowMissingColumns=True).select(empty.columns)
    types = dict(empty.dtypes)
    return whole.select(*[F.col(c).cast(types[c]) for c in empty.columns])


def append_experiments(spark: SparkSession, rows: DataFrame | Iterable[Mapping], path: str) -> None:
    """Append to the log as CSV with a header in every file."""
    experiment_rows(spark, rows).write.mode("append").option("header", True).csv(path)


def read_experiments(spark: SparkSession, path: str) -> DataFrame:
    """Read the log; no folder is an empty log."""
    try:
        return spark.read.schema(COLUMNS).option("header", True).csv(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COLUMNS)
