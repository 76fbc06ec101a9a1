"""Streams: requests deduplicated and counted by window, and papers ingested in micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.runtime import table_path

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_table(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """A parquet table as a stream of its files."""
    schema = spark.read.parquet(path).schema
    folder, name = path.rsplit("/", 1)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    single = spark._jvm.org.apache.hadoop.fs.Path(path)
    if single.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(single).isFile():
        return source.option("pathGlobFilter", name).parquet(folder)
    return source.parquet(path)


def request_windows(requests: DataFrame, window: str = "1 hour", lateness: str | None = None) -> DataFrame:
    """``(window_start, requests)``: requests by the hour they were made; a request sent again counts once.

    By default no row is too late, in whatever order files come, and the state holds every request's id: for replays of
    what is there. For a stream without end ``lateness`` bounds the state; rows later than that are then dropped, and a
    request sent again after it counts twice.
    """
    timed = requests.withColumn("at", F.col("requested_at").cast("timestamp"))
    if lateness is None:
        once = timed.select("request_id", "at").dropDuplicates(["request_id"])
    else:
        once = timed.withWatermark("at", lateness).dropDuplicatesWithinWatermark(["request_id"])
    return once.groupBy(F.window("at", window).alias("w")).agg(F.count("*").alias("requests")).select(F.col("w.start").alias("window_start"), "requests")


def run_to_table(stream: DataFrame, path: str | None = None) -> DataFrame:
    """Runs a stream over all that is there now, and returns the table it wrote. Its state is kept on disk, as it may outgrow memory."""
    spark = stream.sparkSession
    path = path or table_path(spark, "stream-out")

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ON_DISK)
    try:
        query = stream.writeStream.outputMode("complete").option("checkpointLocation", table_path(spark, "stream-state")).trigger(availableNow=True).foreachBatch(write).start()
    finally:
        spark.conf.set(STATE_STORE, before)  # a query keeps the settings it started with
    query.awaitTermination()
    return spark.read.parquet(path)


def ingest(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str | None = None) -> None:
    """Hands each micro-batch to ``apply`` with its number; a batch that is run again has the same number."""
    spark = stream.sparkSession
    query = stream.writeStream.option("checkpointLocation", checkpoint or table_path(spark, "ingest-state")).trigger(availableNow=True).foreachBatch(apply).start()
    query.awaitTermination()
