"""Structured Streaming forms of the usage operators; each ends with the same rows as its batch twin."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset in local mode (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="spark-")


def event_stream(spark: SparkSession, folder: str, files_a_trigger: int = 1) -> DataFrame:
    """``events`` as a file stream with an event time that a watermark accepts."""
    path = f"{folder}/events.parquet"
    schema = spark.read.parquet(path).schema
    glob = path if not path.endswith(".parquet") else f"{folder}/events.parque[t]"
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(glob)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def end_stream(spark: SparkSession, after: DataFrame, late: str) -> DataFrame:
    """A stream of one row without a key whose time is ``late`` and a second after the last ``ts``: with it, a drained stream closes all that is there."""
    path = f"{shared_folder(spark)}/end-{uuid.uuid4().hex}"
    after.agg((F.max(F.col("ts").cast("timestamp")) + F.expr(f"interval {late}") + F.expr("interval 1 second")).alias("ts")).write.parquet(path)
    return spark.readStream.schema("ts timestamp").parquet(path)


def drained(stream: DataFrame, mode: str = "append", change: Callable[[DataFrame], DataFrame] | None = None, conf: dict[str, str] | None = None) -> DataFrame:
    """Run a stream over what is there, with its checkpoint and its files in the shared folder, and return what it wrote.

    Batches are written under their number, so a batch that is repeated after a failure overwrites itself.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def sink(batch: DataFrame, number: int) -> None:
        (change(batch) if change else batch).write.mode("overwrite").parquet(f"{base}/rows/batch={number}")

    before = {k: spark.conf.get(k, None) for k in conf or ()}
    for k, v in (conf or {}).items():  # read when the stream starts
        spark.conf.set(k, v)
    try:
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return spark.read.parquet(f"{base}/rows")


def session_stream(events: DataFrame, gap: str = "30 minutes", late: str = "7 days") -> DataFrame:
    """user_id, start, last, events of visits; state of closed ones goes when the watermark has passed them."""
    window = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("user_id", window.alias("w")).agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("events")).drop("w")


def closed_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, start, last, events of each visit, once, when the watermark has passed its gap."""
    window = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(window.alias("w"), "user_id").agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("events")).drop("w")


def tumbling_stream(events: DataFrame, width: str = "1 day", late: str = "7 days") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def once_each(events: DataFrame, key: str, late: str = "7 days") -> DataFrame:
    """Rows whose key has not come before, remembered as long as the watermark allows."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
