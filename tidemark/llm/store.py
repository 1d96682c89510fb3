"""Intermediate tables in the shared folder, and the tables that queries read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import fresh_path, materialize, scratch_root

__all__ = ["discard", "fresh_path", "materialize", "read_table", "scratch_root"]


def discard(*tables: DataFrame | str) -> None:
    """Delete intermediate tables once nothing reads them any more."""
    spark = SparkSession.getActiveSession()
    for table in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(table if isinstance(table, str) else table.table_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
