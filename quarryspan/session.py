"""Session settings used by tests and the bench, and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def with_package(spark: SparkSession) -> SparkSession:
    """The session, whose Python workers will find this package even if it isn't installed."""
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([ROOT, *filter(None, paths)]))
    return spark


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with adaptive execution; only for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quarryspan")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Only a local session may do without: it gets a folder of its
    own, which goes when the process ends; on a cluster a missing setting is an error, as executors share no temporary folder."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if current is None:
        if not named:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="quarryspan-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
        current = context.getCheckpointDir()
    return current


def cut(df: DataFrame) -> DataFrame:
    """The same rows read back from the shared checkpoint folder, with a short lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
