"""Quality scores: held-out accuracy, statistics and pools against plain Python, odd rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataforge.llm import quality

SF = "/root/testdata/sf0.01"
S = {name: i for i, name in enumerate(quality.STATISTICS)}


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    right = sum((r["score"] >= 0.5) == (r["quality"] == 1) for r in rows)
    bad, good = ([r["score"] for r in rows if r["quality"] == q] for q in (0, 1))
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert len(rows) > 50 and right / len(rows) >= 0.95 and auc >= 0.97
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) >= 0.93


def test_held_out_labels_and_other_columns_teach_nothing(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.fold_of(F.col("doc_id")) == 0
    turned = labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality"))).repartition(3)
    bare = docs.select("doc_id", "text", F.lit("x").alias("lang"), F.lit("x").alias("source")).repartition(5)
    one, two = (Counter(tuple(r) for r in quality.classify(d, x).collect()) for d, x in ((docs, labels), (bare, turned)))
    assert one == two


def test_odd_rows(spark):
    good, bad = "Plain words of a text, and more of them. " * 5, "BUY!! NOW!! $$$ ### " * 9
    rows = [(i, good + str(i) if i % 2 else bad + str(i)) for i in range(200)] + [(None, good), (900, None), (901, ""), (902, "\n\n  "), (903, "x" * 200_000), (903, "x" * 200_000), (904, "é")]
    labels = [(i, i % 2, 0) for i in range(200)] + [(None, 1, 0), (1, None, 0), (3, 1, 0), (3, 0, 0), (777777, 1, 0)]
    docs = spark.createDataFrame([(*r, 1, "s", "y") for r in rows], "doc_id long, text string, quality int, stats string, y string").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.classify(docs, marks).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if r["doc_id"] is not None and 10 < r["doc_id"] < 200:
            assert r["predicted"] == r["doc_id"] % 2
    assert {r["score"] for r in quality.classify(docs, marks.limit(0)).collect()} == {0.0}
    assert quality.classify(docs.limit(0), marks).count() == 0
    one_kind = quality.classify(docs, marks.filter("quality = 1")).collect()
    assert all(0 <= r["score"] <= 1 for r in one_kind)


def test_statistics():
    texts = ["The CAT sat,\nÉcole 12 $x$ a a a!!\nThe CAT sat,\n", None, "", "one"]
    got = quality.statistics(pa.array(texts)) / quality._STAT
    text = texts[0]
    words, data = text.split(), text.encode()
    near = lambda name, value, row=0: math.isclose(got[row, S[name]], value, abs_tol=2e-4)
    assert near("log bytes", math.log1p(len(data))) and near("log words", math.log1p(len(words)))
    letters = [c for c in text if c.isalpha()]
    assert near("capital letters", sum(c.isupper() for c in letters) / len(letters))
    assert near("digits", 2 / len(data)) and near("exclamation marks", 2 / len(data)) and near("other symbols", 2 / len(data))
    assert near("distinct words", len(set(words)) / len(words)) and near("most frequent word", 2 / len(words))
    assert near("words in capitals", 2 / len(words)) and near("capitalised words", 5 / len(words))
    assert near("distinct lines", 2 / 3) and near("lines by words", 3 / len(words))
    share = Counter(data)
    assert near("byte entropy", -sum(n / len(data) * math.log2(n / len(data)) for n in share.values()))
    assert (got[1] == got[2]).all() and near("distinct words", 1, 1) and near("log words", math.log1p(1), 3)
    alone = np.concatenate([quality.statistics(pa.array([t], pa.string())) for t in texts]) / quality._STAT
    assert (alone == got).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(1, 4)), min_size=1, max_size=25))
def test_monotone(points):
    """Pools are the least-squares monotone fit: the largest lower mean over the smallest upper one (min-max formula)."""
    at, value, weight = np.arange(len(points), dtype=float), np.array([p[0] for p in points], float), np.array([p[1] for p in points], float)
    knots, pools = quality.monotone(at, value, weight)
    assert (np.diff(pools) > 0).all() and (np.diff(knots) > 0).all()
    mean = lambda i, j: (value[i : j + 1] * weight[i : j + 1]).sum() / weight[i : j + 1].sum()
    n = len(points)
    fit = sorted({round(max(min(mean(i, j) for j in range(k, n)) for i in range(k + 1)), 9) for k in range(n)})
    assert np.allclose(fit, pools)


def test_sums_do_not_depend_on_partitions(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["Aa", "bb!!", "c", "dd,"]) for _ in range(r.randint(1, 60)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int("!!" not in t[:20])) for i, t in rows], "doc_id long, quality int")
    found = [{x["doc_id"]: x["score"] for x in quality.classify(d, m).collect()} for d, m in ((docs.repartition(1), marks), (docs.repartition(9), marks.repartition(3)))]
    assert found[0] == found[1]
