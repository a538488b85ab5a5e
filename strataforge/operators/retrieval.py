"""Ranked retrieval: constants of BM25, the best of each query, and rule-based re-ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K1, B = 1.2, 0.75  # Robertson, Zaragoza 2009
LEAST_IDF = 1e-6  # a term of most documents still counts for something


def best(scored: DataFrame, query: str, key: str, k: int, score: str = "score") -> DataFrame:
    """The k best rows of each query with their rank; ties go to the smaller key."""
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), F.col(key)))
    return scored.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)


def gate(ranked: DataFrame, on_topic: Column, with_topic: int = 1, without: int = 3) -> DataFrame:
    """Rows with enough matched terms: a source, or silence."""
    return ranked.filter(F.col("matched") >= F.when(on_topic, with_topic).otherwise(without))


def promote(ranked: DataFrame, query: str, flag: Column, to: int) -> DataFrame:
    """If none of the first ``to`` rows has the flag, the first row that has it moves to place ``to``."""
    by = Window.partitionBy(query)
    first = F.min(F.when(flag, F.col("rank"))).over(by)
    moved = ranked.withColumn("first_flagged", first)
    place = F.when((F.col("first_flagged") > to) & (F.col("rank") == F.col("first_flagged")), F.lit(float(to) - 0.5)).otherwise(F.col("rank").cast("double"))
    order = F.row_number().over(by.orderBy("place"))
    return moved.withColumn("place", place).withColumn("new_rank", order.cast("long")).drop("place", "first_flagged")


def stable_partition(ranked: DataFrame, query: str, flag: Column) -> DataFrame:
    """Rows with the flag first, otherwise in the order they had."""
    order = F.row_number().over(Window.partitionBy(query).orderBy(F.when(flag, 0).otherwise(1), "rank"))
    return ranked.withColumn("new_rank", order.cast("long"))
