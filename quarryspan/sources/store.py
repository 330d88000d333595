"""A table that rows are merged into: the same delivery twice leaves it as it was."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryspan.session import cut

#: Parts of the table by the hash of the key: a merge reads and writes only the parts that its rows fall into.
PARTS = 64


def merge(rows: DataFrame, path: str, key: list[str], order: str, parts: int = PARTS) -> None:
    """Put rows into the table at a path (made if it is not there): of rows with one key the one with the largest order stays.

    Parts are replaced as a whole by a dynamic overwrite, so a merge that is run again, or that died halfway, can be repeated.
    """
    spark = rows.sparkSession
    new = rows.withColumn("_part", F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int"))
    try:
        old = spark.read.parquet(path).select(*new.columns)
    except Exception as error:  # no table yet
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        old = new.limit(0)
    touched = [r["_part"] for r in new.select("_part").distinct().collect()]  # `parts` numbers at most
    both = old.where(F.col("_part").isin(touched)).unionByName(new)
    last = both.groupBy("_part", *key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in key]), order).alias("_row"))
    # the old parts are read to the end before they are replaced
    cut(last.select(*key, "_row.*", "_part").select(*new.columns)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_part").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a merged table."""
    return spark.read.parquet(path).drop("_part")
