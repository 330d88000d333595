"""Streams over append-only event files: counts in windows, removal of repeats, attempts by state.

Each runs to the end of what is there (available now) and writes to a table in the checkpoint folder.
"""

from __future__ import annotations

import uuid

import pandas as pd
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarryspan.session import checkpoint_dir
from quarryspan.tables import load


def stream_of(spark: SparkSession, folder: str, table: str, files: int | None = None) -> DataFrame:
    """A table's file, or folder of files, as a stream of rows; files: so many a micro-batch at most."""
    schema = load(spark, folder, table).schema
    reader = spark.readStream if files is None else spark.readStream.option("maxFilesPerTrigger", files)
    return reader.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{table}.parquet*")


def run_to_table(stream: DataFrame, mode: str = "append", key: list[str] | None = None) -> DataFrame:
    """The rows that a stream gives until nothing more is there, from a table in the shared folder.

    mode append: all rows. complete: those of the last micro-batch. update: for each key the row of the last micro-batch that has it;
    every micro-batch is kept in a folder of its own, which a repeated one replaces.
    """
    spark = stream.sparkSession
    at = f"{checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"
    schema = T.StructType([*stream.schema.fields, T.StructField("_batch", T.LongType())])
    if mode == "append":
        stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{at}/rows")

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{at}/rows/_batch={batch}" if mode == "update" else f"{at}/rows")

    spark.createDataFrame([], stream.schema).write.parquet(f"{at}/rows/_batch=-1" if mode == "update" else f"{at}/rows")
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{at}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{at}/rows")
    if not key:
        raise ValueError("updates need a key")
    rows = spark.read.schema(schema).parquet(f"{at}/rows")
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in stream.columns if c not in key]), "_batch").alias("_row"))
    return last.select(*key, "_row.*").select(*stream.columns)


def windowed_counts(events: DataFrame, time: str, by: str, window: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window; rows later than the watermark are left out once a window is closed."""
    counts = events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), by).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), by, "n")


def without_repeats(events: DataFrame, key: list[str], time: str, within: str = "5 minutes") -> DataFrame:
    """The first row of each key within the time that the watermark keeps state."""
    return events.withWatermark(time, within).dropDuplicatesWithinWatermark(key)


ATTEMPT_STATE = "session_id string, source_type string, attempts int, last_attempt int, outcome string"


def attempt_states(attempts: DataFrame) -> DataFrame:
    """For each session and source its number of attempts, the last one, and its outcome so far, kept as state.

    Rows delivered twice count once, however far apart they come: the state has the ids of a key's attempts, which are
    few by nature (a session has a largest number of attempts for each source). Of equal attempts the larger id is the last.
    """

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, last, last_id, outcome = state.get if state.exists else ([], -1, -1, "")
        known = set(ids)
        for part in parts:
            for i, attempt, status in zip(part["id"].tolist(), part["attempt"].tolist(), part["status"].tolist()):
                known.add(i)
                if (attempt, i) > (last, last_id):
                    last, last_id, outcome = int(attempt), int(i), str(status)
        state.update((sorted(known), last, last_id, outcome))
        yield pd.DataFrame([[*key, len(known), last, outcome]], columns=["session_id", "source_type", "attempts", "last_attempt", "outcome"])

    return attempts.groupBy("session_id", "source_type").applyInPandasWithState(fold, ATTEMPT_STATE, "ids array<bigint>, last_attempt int, last_id bigint, outcome string", "update", GroupStateTimeout.NoTimeout)
