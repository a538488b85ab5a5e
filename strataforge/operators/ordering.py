"""Places in a total order without one task for all rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..streaming.jobs import shared_folder

_OWN = (1 << 33) - 1


def numbered(rows: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """``rows`` with their place (from 0) by ``order``: ranges are sorted apart and written, and their sizes tell where each begins.

    Rows that are equal in ``order`` get their places in any order. Only one row a range meets in a single task.
    """
    path = f"{shared_folder(rows.sparkSession)}/numbered-{uuid.uuid4().hex}"
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    ranged.write.parquet(path)
    back = rows.sparkSession.read.schema(ranged.schema).parquet(path).withColumn("__range", F.shiftright("__at", 33))
    sizes = back.groupBy("__range").agg(F.count(F.lit(1)).alias("__size"))
    first = sizes.select("__range", (F.sum("__size").over(Window.orderBy("__range")) - F.col("__size")).alias("__before"))
    return back.join(first, "__range").withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit(_OWN))).drop("__at", "__range", "__before")
