"""Search in JSON documents of unknown shape, with VARIANT values opened level by level.

A document's first value under one of some keys: those of a node itself come before those further in, and
what is in an earlier child before what is in a later one (object members in the order of their keys, as VARIANT keeps them). Null,
empty strings, lists and objects don't count. Text that isn't JSON has no value; a key's name inside a string is no key.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming.jobs import shared_folder


def find_first(docs: DataFrame, key: str, json: str, keys: list[str]) -> DataFrame:
    """key, value (as text): of each document that has one of ``keys`` (lower case) anywhere. One job a level of the deepest document."""
    spark = docs.sparkSession
    base = f"{shared_folder(spark)}/variant-{uuid.uuid4().hex}"
    inner = "'^(OBJECT|ARRAY)'"
    level = docs.select(F.col(key).alias("id"), F.array().cast("array<int>").alias("path"), F.try_parse_json(json).alias("v")).filter("v is not null")
    hits, depth = None, 0
    while True:
        opened = level.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("id", "path", "pos", "key", "value", F.schema_of_variant("value").alias("kind"))
        opened.write.parquet(f"{base}/{depth}")  # cuts the plan, which would grow with the depth
        opened = spark.read.schema(opened.schema).parquet(f"{base}/{depth}")
        empty = F.to_json("value").isin("null", '""', "[]", "{}")
        own = opened.filter(F.lower("key").isin(keys) & ~empty).select("id", F.concat("path", F.array(F.lit(0), F.col("pos"))).alias("path"), F.when(F.col("kind") == "STRING", F.expr("try_variant_get(value, '$', 'string')")).otherwise(F.to_json("value")).alias("value"))
        hits = own if hits is None else hits.unionByName(own)
        level = opened.filter(f"kind rlike {inner}").select("id", F.concat("path", F.array(F.col("pos") + 1)).alias("path"), F.col("value").alias("v"))
        depth += 1
        if level.isEmpty():
            return hits.groupBy("id").agg(F.min_by("value", "path").alias("value")).select(F.col("id").alias(key), "value")


def priced(jobs: DataFrame, key: str, offers: DataFrame, named: DataFrame) -> DataFrame:
    """key, price: of the offer that a job names (``named``: key, value), else the cheapest of ``offers`` (name, price): better too little than too much."""
    cheapest = offers.agg(F.min("price").alias("least"))
    found = jobs.select(key).join(named, key, "left").join(offers.withColumnRenamed("name", "value"), "value", "left")
    return found.crossJoin(F.broadcast(cheapest)).select(key, F.coalesce("price", "least").alias("price"))  # one row
