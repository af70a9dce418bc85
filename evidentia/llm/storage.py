"""Tables in and the scratch tables of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..scratch import folder, scratch, store

__all__ = ["folder", "read", "scratch", "store"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
