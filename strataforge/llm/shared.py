"""Where the operators keep tables that must outlive an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset in local mode (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _OWN[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/strataforge-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, into: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    ``into`` takes the path, for :func:`forget`; else the folder is the cluster's to clean, as it is for checkpoints.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    if into is not None:
        into.append(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables whose results have been written in turn, and the shuffle files of finished jobs."""
    for path in paths:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    paths.clear()
    release(spark)


def release(spark: SparkSession) -> None:
    """Have the driver collect plans that are out of use: Spark deletes a shuffle's files when its plan is collected.

    What was written is read from its table from then on, so no shuffle before it is needed, even if executors are lost.
    """
    spark.sparkContext._jvm.System.gc()


ROWS_A_BATCH, BYTES_A_BATCH = 1000, 8 << 20  # whole texts go to Python workers, so Spark's usual 10,000 rows and 64 MB would be large


def bound_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches of this session small; results don't depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_A_BATCH)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BYTES_A_BATCH)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
