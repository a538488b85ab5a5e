"""Connected components of an edge table, as DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

ROWS_A_TASK = 200_000


def connected_components(edges: DataFrame, a: str, b: str, into: list[str] | None = None) -> DataFrame:
    """(node, component): the smallest node of each node's component, for every node that has an edge.

    Alternates large-star and small-star (Kiveris, Lattanzi, Mirrokni, Rastogi,
    Vassilvitskii 2014), which ends after about log(nodes) rounds, until a round
    changes nothing. Each step's table is written to the shared folder. Minima are
    aggregated before their shuffle and joined from a written table, so both sides of
    the join are plain exchanges and a hub's edges are split between tasks. Rows with
    a null end and loops are ignored.
    """
    u, v = F.col(a), F.col(b)
    state = written(edges.filter(u.isNotNull() & v.isNotNull() & (u != v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "edges", into)
    mark = _mark(state)

    def few(df: DataFrame) -> DataFrame:
        """As many tasks as the number of edges calls for."""
        return df.coalesce(1 + mark[0] // ROWS_A_TASK)

    while mark[0]:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(few(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))), "large-star-minima", into)
        large = written(few(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()), "large-star", into)
        least = written(few(large.groupBy("u").agg(F.min("v").alias("m"))), "small-star-minima", into)
        moved = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        state = written(few(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()), "small-star", into)
        before, mark = mark, _mark(state)
        if mark == before:
            break
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _mark(state: DataFrame) -> tuple:
    """Count and hash of the whole edge set, to tell whether a round changed it."""
    r = state.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]
