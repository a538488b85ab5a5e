"""Sinks that commit as a whole, and searches in documents of unknown shape."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from strataforge.operators.variants import find_first, priced
from strataforge.sources import sinks

SCHEMA = "doc_id long, text string"


def files(folder):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if not f.endswith(".crc"))


def test_a_file_a_document(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    rows = [(1, "a"), (2, "é\nx"), (2, "again"), (3, None), (None, "lost")]
    sinks.write_document_files(spark.createDataFrame(rows, SCHEMA).repartition(3), f"file://{folder}", "doc_id")
    assert sorted(os.path.basename(f) for f in files(folder)) == ["1.jsonl", "2.jsonl", "3.jsonl", sinks.MANIFEST]
    back = sinks.read_lines(spark, f"file://{folder}", SCHEMA).select("doc_id", "text").collect()
    assert sorted(map(tuple, back), key=str) == sorted(rows[:4], key=str)


def test_a_failed_task_leaves_nothing(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    bad = spark.range(100).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 77, F.raise_error(F.lit("broken"))).otherwise("x").alias("text"))
    with pytest.raises(Exception, match="broken"):
        sinks.write_document_files(bad, f"file://{folder}", "doc_id")
    assert files(folder) == []


def test_export_with_its_counts(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    rows = [(f"s{i % 3}", i, 'a "quoted", text' if i % 2 else "é") for i in range(500)]
    sinks.write_export(spark.createDataFrame(rows, "source string, doc_id long, lang string").repartition(4), f"file://{folder}", ["source", "doc_id"], ["source", "lang"])
    told = sinks.manifest(f"file://{folder}")
    assert told["rows"] == 500 and told["counts"]["source"] == {"s0": 167, "s1": 167, "s2": 166} and sum(told["counts"]["lang"].values()) == 500
    lines = [json.loads(x) for p in told["parts"] for x in open(f"{folder}/{p['folder']}/rows.jsonl")]
    assert [(x["source"], x["doc_id"], x["lang"]) for x in lines] == sorted(rows)
    table = spark.read.schema("source string, doc_id long, lang string").option("escape", '"').csv([f"file://{folder}/{p['folder']}/rows.csv" for p in told["parts"]])
    assert sorted(map(tuple, table.collect())) == sorted(rows)
    empty = tempfile.mkdtemp(prefix="spark-")
    sinks.write_export(spark.createDataFrame([], "source string, doc_id long"), f"file://{empty}", ["source"], ["source"])
    assert sinks.manifest(f"file://{empty}")["rows"] == 0 and sinks.read_lines(spark, f"file://{empty}", SCHEMA).count() == 0


def depth_first(v, keys):
    """The same search over Python values, members in the order of their keys."""
    if isinstance(v, dict):
        for k in sorted(v):
            if k.lower() in keys and v[k] not in (None, "", [], {}):
                return v[k]
    for x in [v[k] for k in sorted(v)] if isinstance(v, dict) else v if isinstance(v, list) else []:
        got = depth_first(x, keys)
        if got is not None:
            return got
    return None


def test_first_key_in_documents_of_any_shape(spark):
    import random

    r = random.Random(8)

    def grown(depth):
        kind = r.random()
        if depth == 0 or kind < 0.3:
            return r.choice([1, 2.5, "price", '"price": 9', "", None, True, [], {}])
        if kind < 0.6:
            return [grown(depth - 1) for _ in range(r.randint(0, 3))]
        return {r.choice(["a", "b", "Price", "cost", "z"]): grown(depth - 1) for _ in range(r.randint(0, 4))}

    values = [grown(r.randint(0, 6)) for _ in range(400)]
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)] + [(1000, None), (1001, "not json {")], "i long, body string")
    got = {x["i"]: x["value"] for x in find_first(rows, "i", "body", ["price", "cost"]).collect()}
    wanted = {i: found for i, v in enumerate(values) if (found := depth_first(v, ["price", "cost"])) is not None}
    as_value = lambda text: json.loads(text) if not isinstance(text, str) or text[:1] in '[{0123456789tf-' else text
    assert set(got) == set(wanted)
    for i, v in wanted.items():
        assert (got[i] == v) if isinstance(v, str) else (as_value(got[i]) == v)


def test_price_of_what_a_job_names(spark):
    jobs = spark.createDataFrame([(1, '{"x":[{"offering":"b"}]}'), (2, '{"offering":"unknown"}'), (3, "{}"), (4, None)], "i long, body string")
    offers = spark.createDataFrame([("a", 3.0), ("b", 7.0)], "name string, price double")
    got = priced(jobs, "i", offers, find_first(jobs, "i", "body", ["offering"])).collect()
    assert sorted(map(tuple, got)) == [(1, 7.0), (2, 3.0), (3, 3.0), (4, 3.0)]
