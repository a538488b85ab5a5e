"""Document fingerprints by one-permutation MinHash.

Every word shingle is hashed once. The hash's high bits choose one of ``BINS``
bins, the rest is its value, and a bin keeps its smallest value (Li, Owen,
Zhang 2012). An empty bin borrows from the bin that a universal hash of (bin,
attempt) names, at the first attempt that names a full bin: optimal
densification (Shrivastava 2017). Of each bin the ``BITS`` low-order bits are
stored, packed. Two fingerprints agree in a bin with probability
J + (1 - J) / 2**BITS, which :func:`likeness` inverts (Li, Koenig 2010).

Edge cases: a null or empty text, or one of white space, has no shingle; its
fingerprint is the empty string, which is like itself (1) and unlike all others
(0). Texts of fewer than five words have one shingle. Repeated ids are ordered
by their text, null ids come first; columns other than doc_id and text do not matter.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .words import U

BINS, BITS = 512, 4
ROWS_A_BUCKET = 1024
MOST_BUCKETS = 65536
_EMPTY = U(0xFFFFFFFFFFFFFFFF)


@lru_cache(1)
def _borrowed() -> np.ndarray:
    """[attempt, bin] -> the bin to borrow from."""
    tries = np.arange(4096, dtype=np.uint64)[:, None] * U(BINS) + np.arange(BINS, dtype=np.uint64)[None, :]
    return (words.mix(words.mix(tries + U(1))) % U(BINS)).astype(np.int64)


def signatures(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(documents x BINS low-order bits, whether the document has a shingle)."""
    hashed, first = words.hashes(column)
    shingle, offsets = words.shingles(hashed, first)
    n = len(offsets) - 1
    values = np.full(n * BINS, _EMPTY, np.uint64)
    shift = U(64 - (BINS - 1).bit_length())
    np.minimum.at(values, np.repeat(np.arange(n), np.diff(offsets)) * BINS + (shingle >> shift).astype(np.int64), shingle)
    values = values.reshape(n, BINS)
    full = values != _EMPTY
    some = full.any(axis=1)
    doc, hole = np.nonzero(~full & some[:, None])
    dense, table = values.copy(), _borrowed()
    for attempt in range(len(table)):
        if not len(doc):
            break
        source = table[attempt][hole]
        found = full[doc, source]
        dense[doc[found], hole[found]] = values[doc[found], source[found]]
        doc, hole = doc[~found], hole[~found]
    for d, h in zip(doc, hole):  # after 4096 attempts: the next full bin
        full_bins = np.flatnonzero(full[d])
        dense[d, h] = values[d, full_bins[np.searchsorted(full_bins, h) % len(full_bins)]]
    return (dense & U((1 << BITS) - 1)).astype(np.uint8), some


def packed(low: np.ndarray, some: np.ndarray) -> list[str]:
    """Fingerprints as base64 text of BITS bits a bin."""
    bits = ((low[:, :, None] >> np.arange(BITS - 1, -1, -1, dtype=np.uint8)) & 1).reshape(len(low), -1)
    return [base64.b64encode(row.tobytes()).decode() if has else "" for row, has in zip(np.packbits(bits, axis=1), some)]


def likeness(a: np.ndarray, has_a: np.ndarray, b: np.ndarray, has_b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity, corrected for chance agreement of the low bits."""
    chance = 2.0**-BITS
    same = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0.0, 1.0)
    return np.where(has_a & has_b, same, np.where(has_a == has_b, 1.0, 0.0))


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of each row's text: a narrow map without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(packed(*signatures(batch.column("text"))), pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (bucket, late, doc_id, text, extra) in which each row's successor by doc_id is the next row of its bucket.

    Buckets are ranges of doc_id between approximate quantiles, about ROWS_A_BUCKET
    rows each (at most MOST_BUCKETS of them, so what the driver holds is bounded).
    The first row of each bucket is sent a second time, marked ``extra``, to the end
    of the bucket before it, and that of the first bucket to the end of the last.
    """
    lowest = F.lit(-(1 << 63))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("doc_id").cast("long"), lowest).alias("key"))
    keys = docs.select("key")
    wanted = max(1, min(MOST_BUCKETS, keys.count() // ROWS_A_BUCKET))
    cuts = keys.stat.approxQuantile("key", [i / wanted for i in range(1, wanted)], 0.25 / wanted) if wanted > 1 else []
    splits = [-float("inf"), *sorted(set(cuts)), float("inf")]
    if len(splits) > 2:
        search = Bucketizer(splits=splits, inputCol="place", outputCol="bucket")  # a binary search in the JVM
        numbered = lambda df: search.transform(df.withColumn("place", F.col("key").cast("double"))).withColumn("bucket", F.col("bucket").cast("int"))
    else:
        numbered = lambda df: df.withColumn("bucket", F.lit(0))
    firsts = sorted((r.bucket, r.key) for r in numbered(keys).groupBy("bucket").agg(F.min("key").alias("key")).collect())
    moved = [(firsts[i][1], firsts[i - 1][0]) for i in range(len(firsts))]
    to = docs.sparkSession.createDataFrame(moved, "key long, bucket int")
    heads = (
        docs.join(F.broadcast(to), "key")  # MOST_BUCKETS rows at most
        .groupBy("bucket", "doc_id")
        .agg(F.min(F.struct(F.col("text").isNotNull().alias("some"), "text")).alias("m"))
        .select("bucket", F.lit(1).alias("late"), "doc_id", F.col("m.text").alias("text"), F.lit(True).alias("extra"))
    )
    return numbered(docs).select("bucket", F.lit(0).alias("late"), "doc_id", "text", F.lit(False).alias("extra")).unionByName(heads)


_PAIRS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_with_edits(docs: DataFrame) -> DataFrame:
    """Each row's fingerprint, that of its edited text, and its likeness to that and to its successor by doc_id.

    The edited text has the last quarter (rounded down, in code points) replaced by
    the first as many code points of the successor's text, or all that there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in words.slices(batches):
            rows = pa.Table.from_batches([batch])
            if kept is not None:
                rows = pa.concat_tables([kept, rows])
            kept = rows.slice(rows.num_rows - 1)
            if rows.num_rows > 1:
                yield from judged(rows.combine_chunks())

    def judged(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        own = np.flatnonzero(~rows["extra"].to_numpy()[:-1])
        if not len(own):
            return
        texts = [t or "" for t in rows["text"].to_pylist()]
        edited = []
        for i in own:
            quarter = len(texts[i]) // 4
            edited.append(texts[i][: len(texts[i]) - quarter] + texts[i + 1][:quarter])
        low, some = signatures(rows["text"])
        edited_low, edited_some = signatures(pa.array(edited, pa.large_string()))
        out = [
            rows["doc_id"].take(pa.array(own)).combine_chunks(),
            pa.array([len(texts[i]) for i in own], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            pa.array(packed(low[own], some[own]), pa.string()),
            pa.array(packed(edited_low, edited_some), pa.string()),
            pa.array(likeness(low[own], some[own], edited_low, edited_some)),
            pa.array(likeness(low[own], some[own], low[own + 1], some[own + 1])),
        ]
        yield pa.RecordBatch.from_arrays(out, [f.split()[0] for f in _PAIRS.split(", ")])

    rows = with_next(docs).repartition("bucket").sortWithinPartitions("bucket", "late", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    return rows.select("doc_id", "text", "extra").mapInArrow(run, _PAIRS)
