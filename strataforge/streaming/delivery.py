"""Delivery with a ledger: what a stream brings is pending until the sink has taken it, across runs, failures and refusals.

Spark's checkpoint is the resume point: a run takes up where the last one ended, in micro-batches of bounded size. The ledger
is two tables of the base folder that are only appended to: ``pending`` (rows by key) and ``delivered`` (keys). A row goes to the sink if its key is
pending and not delivered, so a batch that is repeated after a failure, a row that comes twice and a row that the sink
refused last time all end the same way. Keys that a failed run had sent before it could write them down are sent again: the
sink sees each row at least once, and once by key if it keeps rows by key (:func:`outbox`).
The first run of a ledger can take what is there as known (``baseline``): history is not news.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

Send = Callable[[DataFrame], DataFrame]  # rows to send -> the rows that were taken


class Ledger:
    def __init__(self, spark: SparkSession, base: str, schema: T.StructType, key: str):
        self.spark, self.base, self.schema, self.key = spark, base.rstrip("/"), schema, key
        self.keys = T.StructType([schema[key]])

    def _append(self, rows: DataFrame, name: str) -> None:
        rows.write.mode("append").parquet(f"{self.base}/{name}")

    def _read(self, name: str, schema: T.StructType) -> DataFrame:
        self._append(self.spark.createDataFrame([], schema), name)  # so that the folder is there
        return self.spark.read.schema(schema).parquet(f"{self.base}/{name}")

    def pending(self) -> DataFrame:
        """Rows not delivered yet."""
        return self._read("pending", self.schema).join(self.delivered(), self.key, "left_anti")

    def delivered(self) -> DataFrame:
        return self._read("delivered", self.keys)

    def record(self, batch: DataFrame) -> None:
        """Write down the rows whose key is new; rows without a key have nothing to be known by and are left out."""
        known = self._read("pending", self.schema).select(self.key)
        rows = batch.filter(batch[self.key].isNotNull()).dropDuplicates([self.key]).join(known, self.key, "left_anti")
        self._append(rows.select(self.schema.names), "pending")

    def flush(self, send: Send) -> None:
        """Offer all pending rows to the sink and write down what it took."""
        self._append(send(self.pending()).select(self.key).distinct(), "delivered")

    def run(self, stream: DataFrame, send: Send, baseline: bool = False) -> None:
        """Take what is there since the last run, then offer what is pending, also if nothing new came."""
        state = f"{self.base}/state"

        def sink(batch: DataFrame, number: int) -> None:
            self.record(batch)
            if baseline and number == 0:
                self._append(self.pending().select(self.key), "delivered")

        stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
        self.flush(send)


def outbox(path: str, key: str) -> Send:
    """A sink that keeps rows by key: one that it has already is taken, not written again."""

    def send(rows: DataFrame) -> DataFrame:
        spark = rows.sparkSession
        spark.createDataFrame([], rows.schema).write.mode("append").parquet(path)
        have = spark.read.schema(rows.schema).parquet(path).select(key)
        rows.join(have, key, "left_anti").write.mode("append").parquet(path)
        return rows

    return send
