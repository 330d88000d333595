"""Reading the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarryspan.session import with_package


def load(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """One table; with columns, only those, so that the scan reads no others."""
    df = with_package(spark).read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df
