"""Queries of problems 8, 9 and 10: token ids, containers and sentence units of the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarryspan.llm.bpe import encode, token_counts
from quarryspan.llm.packing import fill_report, pack
from quarryspan.llm.sentences import sentence_units
from quarryspan.tables import load

CAPACITY = 2048


def _spread(spark: SparkSession, folder: str) -> DataFrame:
    """The documents' ids and texts; a table in few files is spread over all cores, as text work is long."""
    docs = load(spark, folder, "documents", "doc_id", "text")
    cores = spark.sparkContext.defaultParallelism
    return docs.repartition(4 * cores, "doc_id") if docs.rdd.getNumPartitions() < 2 * cores else docs


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The token ids of every document."""
    return encode(_spread(spark, folder))


def p9_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every document, or of every part of a long one."""
    return pack(token_counts(_spread(spark, folder)), CAPACITY)


def p9_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers are."""
    return fill_report(p9_containers(spark, folder), CAPACITY)


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """The sentence units of every document."""
    return sentence_units(_spread(spark, folder))


QUERIES = {"p8_ids": p8_ids, "p9_containers": p9_containers, "p9_fill": p9_fill, "p10_found": p10_found}
ORACLE: dict[str, str] = {}
