"""Runs of the streaming queries with file sinks that can be repeated safely."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.session import stage_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NO_DATA_KEY = "spark.sql.streaming.noDataMicroBatches.enabled"
PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"


def use_rocksdb(spark: SparkSession) -> None:
    """The keyed state needs the RocksDB store; a session that names one keeps it."""
    if "RocksDB" not in (spark.conf.get(PROVIDER_KEY, "") or ""):
        spark.conf.set(PROVIDER_KEY, ROCKSDB)


def read_parquet_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream over the parquet files of one table."""
    schema = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def batch_folders(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: one folder per micro-batch, so a repeated batch replaces itself."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def run_available(stream: DataFrame, label: str, mode: str = "update", sink=None, out: str | None = None, event_time: bool = False) -> DataFrame:
    """Process what is there now and return everything the sink wrote.

    With ``out`` of an earlier run the stream goes on where that run stopped: its progress lies
    beside it, and a batch that was written but not committed is written again over itself.
    ``event_time``: follow with the empty batches that let event-time timers fire.
    """
    spark = stream.sparkSession
    out = out or stage_path(spark, label)
    # Processing-time state asks for another, empty batch after every batch; a run
    # over the data at hand must not follow that for ever.
    before = spark.conf.get(NO_DATA_KEY)
    spark.conf.set(NO_DATA_KEY, "true" if event_time else "false")
    try:
        query = (
            stream.writeStream.outputMode(mode)
            .foreachBatch(sink(out) if sink else batch_folders(out))
            .option("checkpointLocation", f"{out}-progress")
            .trigger(availableNow=True)
            .start()
        )
    finally:
        spark.conf.set(NO_DATA_KEY, before)
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
    return spark.read.option("basePath", out).parquet(out)


def append_event_log(stream: DataFrame, path: str, progress: str):
    """Feedback or request events appended as JSON lines."""
    return (
        stream.writeStream.outputMode("append")
        .format("json")
        .option("path", path)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )


def windowed_stream(log: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Tumbling request metrics that accept events up to ``late`` behind."""
    from feedloom.operators.monitoring import windowed_requests

    return windowed_requests(log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late), width)
