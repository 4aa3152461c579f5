"""Service logs: newline-delimited JSON with a fixed schema, no inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from feedlake.schemas import LOGS


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOGS).json(path)


def stream_logs(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(LOGS).json(path)


def write_logs(logs: DataFrame, path: str) -> None:
    logs.write.mode("overwrite").json(path)
