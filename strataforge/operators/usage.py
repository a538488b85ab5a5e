"""Usage analytics over event tables: sessions, dwell, rolling counts, latest rows, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GAP_SECONDS = 1800


def sessions(events: DataFrame, user: str, ts: str, gap: int = GAP_SECONDS) -> DataFrame:
    """user, start, last, events of each visit; a pause of more than ``gap`` seconds starts a new one.

    Gaps and islands over each user's events, with a tie between equal times left to the minimum and maximum.
    """
    order = Window.partitionBy(user).orderBy(ts)
    late = F.unix_micros(F.col(ts)) - F.unix_micros(F.lag(ts).over(order)) > gap * 1_000_000
    numbered = events.withColumn("visit", F.sum(F.when(late, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(user, "visit").agg(F.min(ts).alias("start"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("events"))


def rolling_count(events: DataFrame, key: str, ts: str, seconds: int) -> Column:
    """Events of the same key in the last ``seconds``, this one included."""
    return F.count(F.lit(1)).over(Window.partitionBy(key).orderBy(F.unix_micros(F.col(ts))).rangeBetween(-seconds * 1_000_000, 0))


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: a maximum of a struct, so nothing is sorted and partial results are merged before the shuffle."""
    rest = [c for c in rows.columns if c not in key and c not in order]
    return rows.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("m")).select(*key, *[F.col("m")[c].alias(c) for c in [*order, *rest]])


def merged_intervals(intervals: DataFrame, group: str, low: str, high: str) -> DataFrame:
    """group, low, high of the unions of overlapping or touching intervals."""
    order = Window.partitionBy(group).orderBy(low, high)
    before = F.max(high).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.withColumn("new", F.when(before.isNull() | (F.col(low) > before), 1).otherwise(0))
    island = marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(group, "island").agg(F.min(low).alias(low), F.max(high).alias(high)).drop("island")
