"""Lookups and range joins against small reference tables, bounded by construction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calculators import lms_z

# Fixed values of the reference tables that queries share.
SCHEDULE = [(0.0, "birth"), (2.0, "first"), (4.0, "second"), (6.0, "third"), (12.0, "fourth"), (18.0, "fifth"), (48.0, "sixth"), (72.0, "seventh")]
LMS = [(0, 0.3487, 3.3464, 0.14602), (10, 0.2297, 4.4709, 0.13395), (20, 0.1970, 5.5675, 0.12385), (30, 0.1738, 6.3762, 0.11727), (40, 0.1553, 7.0023, 0.11316), (51, 0.1395, 7.5105, 0.1108)]
# Month, L, M, S of a coarse weight-for-age table, boys and girls, near the published standards.
GROWTH = {
    "boy": [(0, 0.3487, 3.3464, 0.14602), (3, 0.1738, 6.3762, 0.11727), (6, 0.1257, 7.934, 0.10958), (12, 0.0644, 9.6479, 0.10925), (24, -0.0137, 12.1515, 0.11426), (36, -0.0689, 14.3429, 0.12116), (60, -0.1506, 18.3366, 0.13517)],
    "girl": [(0, 0.3809, 3.2322, 0.14171), (3, 0.0402, 5.8458, 0.12619), (6, -0.0756, 7.297, 0.12204), (12, -0.2024, 8.9481, 0.12268), (24, -0.2941, 11.4775, 0.12587), (36, -0.3201, 13.8503, 0.13096), (60, -0.3518, 18.2193, 0.14821)],
}


def schedule(spark: SparkSession) -> DataFrame:
    """month, label, and the month of the slot that follows; eight rows."""
    rows = [(m, label, SCHEDULE[i + 1][0] if i + 1 < len(SCHEDULE) else None) for i, (m, label) in enumerate(SCHEDULE)]
    return spark.createDataFrame(rows, "month double, label string, next_month double")


def tolerance(months: Column) -> Column:
    """How far from its month a slot still counts."""
    return F.when(months < 24, 1.5).otherwise(6.0)


def interpolated(x: Column, table: list[tuple], column: int) -> Column:
    """A table's column at x, linear between its rows, exact on them, null outside.

    The rows are constants of the plan: no join, and the optimizer folds them.
    """
    out = F.when(x == float(table[0][0]), float(table[0][column]))
    for lo, hi in zip(table, table[1:]):
        part = (x - float(lo[0])) / float(hi[0] - lo[0])
        out = out.when((x > float(lo[0])) & (x <= float(hi[0])), float(lo[column]) + part * (float(hi[column]) - float(lo[column])))
    return out


def interpolated_sql(x: str, table: list[tuple], column: int) -> str:
    """:func:`interpolated` in DuckDB's SQL."""
    parts = [f"WHEN {x} = {float(table[0][0])} THEN {table[0][column]}::DOUBLE"]
    for lo, hi in zip(table, table[1:]):
        parts.append(f"WHEN {x} > {float(lo[0])} AND {x} <= {float(hi[0])} THEN {lo[column]}::DOUBLE + ({x} - {float(lo[0])}::DOUBLE) / {float(hi[0] - lo[0])}::DOUBLE * ({hi[column]}::DOUBLE - {lo[column]}::DOUBLE)")
    return "CASE " + " ".join(parts) + " END"


def growth_z(sex: Column, months: Column, kg: Column) -> Column:
    """z-score of a weight at an age; null for an unknown sex or outside the table."""
    out = None
    for name, rows in GROWTH.items():
        z = lms_z(kg, *(interpolated(months, rows, k) for k in (1, 2, 3)))
        out = F.when(sex == name, z) if out is None else out.when(sex == name, z)
    return out


def with_default(rows: DataFrame, reference: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """rows with the reference's columns for their key, or the given defaults."""
    joined = rows.join(reference, key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), d) for c, d in values.items()})
