"""Helpers for Arrow batches: runs of equal keys, and a key filter of fixed size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import give_back

FILTER_BITS = 1 << 24


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Runs of equal keys in a partition sorted by them, each as one batch."""
    held: list[pa.RecordBatch] = []  # the run that has begun, in parts
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows - 1, bool)
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            change |= v[1:] != v[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        if held and tuple(batch.column(k)[0].as_py() for k in keys) != last:
            yield pa.concat_batches(held)
            held = []
        for a, b in zip(cuts, cuts[1:]):
            if a:
                yield pa.concat_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in keys)
    if held:
        yield pa.concat_batches(held)
        held.clear()
    give_back()


def stretches(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Whole runs of equal keys in a partition sorted by them, about ``rows`` rows of them at once."""
    held: list[pa.RecordBatch] = []
    many = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        many += batch.num_rows
        if many < rows:
            continue
        whole = pa.concat_batches(held)
        change = np.zeros(whole.num_rows - 1, bool)
        for k in keys:
            v = whole.column(k).to_numpy(zero_copy_only=False)
            change |= v[1:] != v[:-1]
        last = np.flatnonzero(change)
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield whole.slice(0, cut)
        held, many = [whole.slice(cut)], 0 if cut else -whole.num_rows  # a run without an end is looked through when it has doubled
    if held:
        yield pa.concat_batches(held)
        held.clear()
    give_back()


def filter_place(column: str) -> Column:
    """A key's bit in :func:`key_filter`."""
    return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))


def key_filter(keys: DataFrame, column: str) -> np.ndarray:
    """A one-hash Bloom filter of FILTER_BITS bits (2 MB), whatever the number of keys."""
    place = filter_place(column)
    rows = keys.select(F.shiftright(place, 6).cast("int").alias("word"), place.alias("place")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits"))
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    for r in rows.collect():
        out[r["word"]] = r["bits"] & 0xFFFFFFFFFFFFFFFF
    return out


def maybe(bits: np.ndarray, places: pa.Array) -> pa.Array:
    """Whether keys may be in the filter, by their places."""
    h = places.to_numpy(zero_copy_only=False).astype(np.uint64)
    return pa.array(((bits[h >> np.uint64(6)] >> (h & np.uint64(63))) & np.uint64(1)).astype(bool))


def hash_filter(keys: DataFrame, column: str) -> np.ndarray:
    """:func:`key_filter` of keys that are hashes already: their low bits are the place."""
    low = F.col(column).bitwiseAND(F.lit(FILTER_BITS - 1))
    rows = keys.select(F.shiftright(low, 6).cast("int").alias("word"), low.alias("place")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits"))
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    for r in rows.collect():
        out[r["word"]] = r["bits"] & 0xFFFFFFFFFFFFFFFF
    return out


def in_filter(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether hashes may be in a :func:`hash_filter`."""
    low = hashes.view(np.uint64) & np.uint64(FILTER_BITS - 1)
    return ((bits[low >> np.uint64(6)] >> (low & np.uint64(63))) & np.uint64(1)).astype(bool)


def divided(rows: DataFrame, place: str, bits) -> tuple[DataFrame, DataFrame]:
    """(rows whose ``place`` is set in a broadcast filter, the others): narrow maps, so only the first need be shuffled."""

    def pick(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = maybe(bits.value, batch.column(place)).to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(found == wanted))
            give_back()

        return run

    return rows.mapInArrow(pick(True), rows.schema), rows.mapInArrow(pick(False), rows.schema)
