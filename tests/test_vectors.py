"""Cosines by blocks of packed vectors, against sums pair by pair."""

import functools
import math
import random

from strataforge.operators import vectors as V


def test_near_equals_pairs(spark, monkeypatch):
    monkeypatch.setattr(V, "PACK", 16)
    r = random.Random(3)
    rows = [(i, [float(r.gauss(0, 1)) for _ in range(7)]) for i in range(300)]
    rows += [(300, [1.0, 2.0]), (301, [2.0, 4.0]), (302, None), (303, [None, *rows[0][1][1:]]), (400, rows[0][1]), (401, rows[0][1]), (401, rows[0][1]), (None, rows[0][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    single = {(k, tuple(v)) for k, v in ((x["vec_id"], x["embedding"]) for x in frame.collect() if x["vec_id"] is not None and x["embedding"] is not None) if None not in v}
    every = sorted([*single, next(s for s in single if s[0] == 401)])

    def cosine(v, q):
        dot = lambda a, b: functools.reduce(lambda s, x: s + x, (x * y for x, y in zip(a, b)), 0.0)
        return dot(v, q) / math.sqrt(dot(v, v) * dot(q, q))

    wanted = sorted((a, b, cosine(v, q)) for a, q in every if a % 100 == 0 for b, v in every if len(v) == len(q) and cosine(v, q) > 0.3)
    got = sorted(map(tuple, V.near(frame, frame.filter("vec_id % 100 = 0"), "vec_id", "embedding", 0.3).collect()))
    assert got == [(a, b, c) for a, b, c in wanted] and len(got) > 100 and any(a == 300 and b == 301 for a, b, _ in got)


def test_zero_and_not_finite_vectors_have_no_number(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [float("nan"), 1.0]), (3, [0.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {b: c for _, b, c in V.near(frame, frame.filter("vec_id = 0"), "vec_id", "embedding", 0.3).collect()}
    assert set(got) == {0, 1, 2} and got[0] == 1 and math.isnan(got[1]) and math.isnan(got[2])
    assert V.near(frame.limit(0), frame.limit(0), "vec_id", "embedding", 0.3).count() == 0


def test_rows_shuffled_do_not_grow_with_pairs(spark):
    """Packs are joined, not vectors: 4,000 vectors and 40 queries are a few rows each."""
    frame = spark.range(4000).selectExpr("id as vec_id", "array(cast(id as float), 1f) as embedding")
    assert V._packs(frame.coalesce(1), "vec_id", "embedding").count() == 8
