"""Anchors and invariants of the calculators."""

import math

from pyspark.sql import functions as F

from strataforge.functions import calculators as C
from strataforge.operators.lookups import LMS, interpolated


def test_dose_invariants(spark):
    weights = spark.range(2, 241).select((F.col("id") / 2).alias("w"))
    ages = spark.createDataFrame([(None,), (0.0,), (2.9,), (3.0,), (12.0,), (60.0,), (216.0,)], "mo double")
    grid = weights.join(ages, F.lit(True))
    for drug in C.DOSES:
        d = C.DOSES[drug]
        for r in grid.select("w", "mo", C.dose(F.col("w"), F.col("mo"), drug, 20.0).alias("d")).collect():
            got = r["d"]
            if got["outcome"] != "ok":
                assert got["mg_high"] is None
                continue
            assert got["mg_low"] <= got["mg_high"] <= d["single"]
            assert got["doses"] >= 1 and got["doses"] <= 24 // d["hours"]
            assert got["ml"] * 20 <= got["mg_high"] + 0.1
            assert r["mo"] is None or r["mo"] >= max(3, d["months"])


def test_percentile_matches_normal(spark):
    for z in (-3.0, -1.88079, -0.5, 0.0, 1.0, 2.5):
        got = spark.range(1).select(C.percentile(F.lit(z))).first()[0]
        assert abs(got - 50 * (1 + math.erf(z / math.sqrt(2)))) < 1e-4


def test_lms_round_trip_and_ends(spark):
    rows = spark.createDataFrame([(0.0,), (15.0,), (51.0,), (52.0,), (-1.0,)], "x double")
    got = [r[0] for r in rows.select(interpolated(F.col("x"), LMS, 2)).collect()]
    assert got[0] == 3.3464 and abs(got[1] - (4.4709 + 5.5675) / 2) < 1e-12 and got[2] == 7.5105 and got[3:] == [None, None]
    l, m, s = F.lit(0.2), F.lit(5.0), F.lit(0.1)
    z = spark.range(1).select(C.lms_z(C.lms_value(F.lit(1.3), l, m, s), l, m, s)).first()[0]
    assert abs(z - 1.3) < 1e-9


def test_text_values(spark):
    rows = spark.createDataFrame([("100 mg/5 ml",), ("10mg/ml",), ("none",), (None,)], "t string")
    assert [r[0] for r in rows.select(C.strength(F.col("t"))).collect()] == [20.0, 10.0, None, None]
    rows = spark.createDataFrame([("2 years",), ("18 months",), ("x",)], "t string")
    assert [r[0] for r in rows.select(C.age_months(F.col("t"))).collect()] == [24.0, 18.0, None]
