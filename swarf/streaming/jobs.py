"""The job log as a stream: the same latest-state aggregate, kept in Spark's state store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from swarf.operators.jobs import latest


def read_log(spark: SparkSession, folder: str, schema: str = "job_id long, ts timestamp, n long, status string, mode string", files_a_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream of events."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)


def latest_states(log: DataFrame) -> DataFrame:
    """For output mode complete or update: one row a job."""
    return latest(log)
