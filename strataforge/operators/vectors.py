"""Exact cosines of all vectors with some of them, block against block.

Vectors are packed where they are read, PACK to a row. Packs are dealt to LANES, and the packs of queries go to every lane, so what is
shuffled grows with the vectors; only the products grow with vectors times queries, and they are of two packs at a time. Products by blocks
only tell which pairs may pass; those are summed again component by component, so a cosine doesn't depend on its block.

Vectors that are null or hold nulls take no part, and vectors of different lengths have no cosine. That of a zero vector, or of one with a component that
is not finite, is not a number, which counts as above any limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACK, LANES = 512, 64
_PACKED = "size int, ids binary, vectors binary"
MARGIN = 1e-9  # sums of products in another order are off by far less


def _packs(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """size (components of each), ids, vectors (float64, side by side): a narrow map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.filter(pa.array(batch.column("v").is_valid()))
            ids, lists = given.column("id").to_numpy(), given.column("v")
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.values.slice(lists.offsets[0].as_py(), int(sizes.sum())) if len(lists) else lists.values[:0]
            start = np.cumsum(sizes) - sizes
            holes = np.concatenate([[0], np.cumsum(~flat.is_valid().to_numpy(zero_copy_only=False))])
            whole = holes[start + sizes] == holes[start]
            numbers = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
            for size in np.unique(sizes[whole]):
                rows = np.flatnonzero(whole & (sizes == size))
                for k in range(0, len(rows), PACK):
                    some = rows[k : k + PACK]
                    block = numbers[start[some][:, None] + np.arange(size)]
                    yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([ids[some].astype(np.int64).tobytes()], pa.binary()), pa.array([block.tobytes()], pa.binary())], ["size", "ids", "vectors"])

    return vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("id is not null").mapInArrow(run, _PACKED)


def _squares(block: np.ndarray) -> np.ndarray:
    return _summed(block * block)


def _summed(products: np.ndarray) -> np.ndarray:
    """Sums of rows, from the first component to the last."""
    return np.add.accumulate(products, axis=1)[:, -1] if products.shape[1] else np.zeros(len(products))


def near(vectors: DataFrame, asked: DataFrame, key: str, vector: str, above: float) -> DataFrame:
    """query_id, key, cosine of each row of ``vectors`` with each row of ``asked`` whose cosine is larger than ``above``."""
    packs = _packs(vectors, key, vector).withColumn("lane", F.pmod(F.xxhash64("ids"), F.lit(LANES)).cast("int"))
    few = asked.repartition(max(1, -(-asked.count() // (8 * PACK))))  # so that packs of queries are full
    queries = _packs(few, key, vector).select(F.col("size"), F.col("ids").alias("query_ids"), F.col("vectors").alias("queries"), F.explode(F.sequence(F.lit(0), F.lit(LANES - 1))).alias("lane"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, *blobs in zip(*(batch.column(c).to_pylist() for c in ("size", "ids", "vectors", "query_ids", "queries"))):
                ids, own, asking, theirs = (np.frombuffer(b, t) for b, t in zip(blobs, (np.int64, np.float64) * 2))
                own, theirs = own.reshape(len(ids), size), theirs.reshape(len(asking), size)
                with np.errstate(all="ignore"):
                    n, m = _squares(own), _squares(theirs)
                    i, j = np.nonzero(~((own @ theirs.T) / np.sqrt(n[:, None] * m[None]) <= above - MARGIN))
                    for k in range(0, len(i), 1 << 14):
                        a, b = i[k : k + (1 << 14)], j[k : k + (1 << 14)]
                        cosine = _summed(own[a] * theirs[b]) / np.sqrt(n[a] * m[b])
                        kept = ~(cosine <= above)
                        yield pa.RecordBatch.from_arrays([pa.array(asking[b][kept]), pa.array(ids[a][kept]), pa.array(cosine[kept])], ["query_id", key, "cosine"])

    rows = packs.join(queries.hint("merge"), ["size", "lane"])
    return rows.select("size", "ids", "vectors", "query_ids", "queries").mapInArrow(run, f"query_id long, {key} long, cosine double")
