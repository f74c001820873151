"""Session helpers and durable stage tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "feedloom", partitions: int = 8) -> SparkSession:
    """Session for tests and the local benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("FEEDLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of its own, because there the
    driver and the executors are one process.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="feedloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def stage_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/feedloom/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


#: Spark's setting that lets the shuffle files of a statement go as soon as it has ended.
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting that holds for the statements run inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def write_freed(df: DataFrame, path: str, mode: str = "error", by: tuple = ()) -> DataFrame:
    """Write ``df`` to ``path``, let go of the shuffle files it took and read it back.

    Else they stay until the driver collects its garbage, and a long chain of stages fills the disk.
    """
    with setting(df.sparkSession, _FREED, "true"):
        df.write.mode(mode).partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back.

    Used where a result is read several times or a lineage must be cut: the copy
    survives lost executors, gives the optimizer real sizes and stays prunable.
    """
    return write_freed(df, stage_path(df.sparkSession, label))


class Rounds:
    """Stages of a loop whose rounds read the one before only: two folders take turns, so disk does not grow with the rounds."""

    def __init__(self, spark: SparkSession, label: str):
        self.paths, self.number = [stage_path(spark, f"{label}-{k}") for k in range(2)], 0

    def stage(self, df: DataFrame) -> DataFrame:
        """Write a round's result over that of the round before last; ``df`` may read the last round."""
        self.number += 1
        return write_freed(df, self.paths[self.number % 2], "overwrite")
