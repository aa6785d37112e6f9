"""Reading the engine's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; projections and filters reach the Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_json_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON file that holds a list of objects, by its schema; text that is not valid is an error. The file is a bounded fixture, read by one task."""
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Structured log lines (timestamp, level, event, context as a map of texts); lines that are no JSON are left out."""
    rows = spark.read.schema("timestamp string, level string, event string, context map<string,string>, bad string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="bad")
    return rows.where("bad is null").drop("bad")
