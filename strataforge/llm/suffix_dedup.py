"""Exact removal of repeated byte strings with suffix arrays built by linear grouping.

Every byte covered by a LENGTH-byte string that also starts anywhere else goes.
To spread the work, each LENGTH-byte window of a text names an owner, the GRAM-byte
substring in it with the smallest hash (leftmost on ties). Equal windows have
equal owners, so windows only meet windows of an owner with equal bytes. What
an owner's windows span, without the owner itself, is its context; it takes part
only if the owner's hash occurs twice in the corpus.

An owner whose distinct contexts have more than MOST_SYMBOLS symbols is split. A window is known by how many of
its bytes come before the owner, too; the windows of a range of such places all hold the bytes
next to the owner that the range has in common, so equal windows agree in them, and
range and bytes are an owner of their own. Ranges are halved until no owner has too many contexts,
at the latest when a range is one place and the bytes are the window.

In a task, the distinct contexts of one owner, cut to the ranges of places whose common bytes another
context has as well (others can't hold equal windows), become one text, with a symbol of
the owner's own for its bytes, and neighbours in the suffix array of that text tell which
windows occur twice. The array is built as in Baier's linear-time grouping construction (2016):
suffixes are grouped by their first symbol; groups are taken in descending order,
each member points to the nearest smaller suffix before it, and a group that is
pointed to is split by how often, so that in the end a group holds the suffixes of
one Lyndon prefix, in order. A second pass emits each group's order from the order of the suffixes that follow the
prefixes; nothing is renamed or recursed into.

Equal texts are one text that occurs twice: all of it goes if it has LENGTH bytes.

Texts are known by their MD5 (128 bits), grams by 64-bit hashes and contexts, within an owner, by 64 bits of BLAKE2b.

Edge cases: null counts as empty; texts shorter than LENGTH lose nothing. Null and
repeated doc_ids are rows like others: rows are told apart by their text. Removal
may cut a character; digests are of bytes. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .batches import filter_place, hash_filter, in_filter, key_filter, maybe
from .shared import forget, written
from .words import U

LENGTH = 200
GRAM = 64
SYMBOLS = 1 << 14  # contexts of several owners share a suffix array up to about so many symbols
MOST_SYMBOLS = 1 << 20  # of one owner; beyond, it is split
RANGE = 35  # places of a context that are looked at together before it takes part
_POSITION = U((1 << 31) - 1)
_STEP = U(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- suffix array


def lyndon_groups(s: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(group of each suffix, nearest smaller suffix before each, size of each group in ascending order's links).

    Groups are numbered 0.. in ascending order of their Lyndon prefixes.
    """
    n = len(s)
    number = {c: k for k, c in enumerate(sorted(set(s)))}
    group = [number[c] for c in s]
    members: list = [[] for _ in number]
    for i, g in enumerate(group):
        members[g].append(i)
    count = len(members)
    size = [len(m) for m in members]
    above, below, done = [*range(1, count), -1], list(range(-1, count - 1)), [False] * count
    smaller = [-1] * n
    g = count - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]  # others have moved to a split-off group
        members[g], done[g] = None, True
        pointed: dict[int, int] = {}
        for i in own:
            p = i - 1
            while p >= 0 and done[group[p]]:  # larger, or in this group and further right
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        split: dict[int, dict[int, list[int]]] = {}
        for p, times in pointed.items():
            split.setdefault(times, {}).setdefault(group[p], []).append(p)
        for times in sorted(split, reverse=True):  # more repeats of this group's prefix: larger
            for h, moved in split[times].items():
                if len(moved) == size[h]:
                    continue
                new, over = len(members), above[h]
                moved.sort()
                members.append(moved)
                size.append(len(moved))
                size[h] -= len(moved)
                done.append(False)
                above.append(over)
                below.append(h)
                above[h] = new
                if over >= 0:
                    below[over] = new
                for p in moved:
                    group[p] = new
        g = below[g]
    lowest = 0
    while below[lowest] >= 0:
        lowest = below[lowest]
    start, total, g = [0] * len(size), 0, lowest
    while g >= 0:
        start[g], total, g = total, total + size[g], above[g]
    return group, smaller, start


def suffix_array(s: list[int]) -> list[int]:
    """Starts of the suffixes of ``s`` in ascending order; the end of the text is smaller than any symbol."""
    if not s:
        return []
    group, smaller, start = lyndon_groups(s)
    order, placed = [0] * len(s), [False] * len(s)
    follows = len(s)  # the suffix whose predecessors by Lyndon prefix come next: first the empty one
    for k in range(-1, len(s)):
        if k >= 0:
            follows = order[k]
        i = follows - 1
        while i >= 0 and not placed[i]:
            g = group[i]
            placed[i], order[start[g]] = True, i
            start[g] += 1
            i = smaller[i]
    return order


def repeated_windows(contexts: list[tuple[int, bytes]]) -> list[np.ndarray]:
    """For each (owner, context): which of its windows also occur in another of the contexts.

    A context is its left part's length, the left part, and the right part; windows are LENGTH - GRAM + 1 symbols.
    """
    window = LENGTH - GRAM + 1
    text: list[int] = []
    starts, counts, owners = [], [], {}
    for owner, context in contexts:
        left = context[0]
        mark = 258 + owners.setdefault(owner, len(owners))
        starts.append(len(text))
        counts.append(len(context) - window + 1)  # symbols: left + owner + right
        text += [b + 1 for b in context[1 : 1 + left]]
        text.append(mark)
        text += [b + 1 for b in context[1 + left :]]
        text.append(0)  # ends the context; below any other symbol
    order = np.array(suffix_array(text))
    s = np.array(text)
    of = np.zeros(len(text), np.int64)
    may = np.zeros(len(text), bool)
    for k, (a, n) in enumerate(zip(starts, counts)):
        may[a : a + n], of[a : a + n] = True, k
    order = order[may[order]]
    hit = np.zeros(len(text), bool)
    if len(order) > 1:
        views = np.lib.stride_tricks.sliding_window_view(s, window)
        same = np.concatenate([(views[order[i : i + 4096]] == views[order[i + 1 : i + 4097]]).all(axis=1) if i + 4097 <= len(order) else (views[order[i:-1]] == views[order[i + 1 :]]).all(axis=1) for i in range(0, len(order) - 1, 4096)])
        hit[order[:-1][same]] = True
        hit[order[1:][same]] = True
    return [hit[a : a + n] for a, n in zip(starts, counts)]


# ---------------------------------------------------------------- owners of windows


def owned(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner's hash, document, owner's place, first and last window) of every owner; places are in ``raw``."""
    none = np.zeros(0, np.int64)
    n = len(raw)
    if n < LENGTH:
        return np.zeros(0, np.uint64), none, none, none, none
    grams = n - GRAM + 1
    at = np.arange(grams)
    hashed = words.span_hashes(raw, at, at + GRAM)
    packed = (hashed & ~_POSITION) | at.astype(np.uint64)
    width = LENGTH - GRAM + 1  # grams in a window
    blocks = -(-grams // width)
    table = np.full(blocks * width, ~U(0), np.uint64)
    table[:grams] = packed
    table = table.reshape(blocks, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - LENGTH + 1
    best = (np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows]) & _POSITION).astype(np.int64)
    lengths = np.diff(offsets)
    inside = np.zeros(windows + 1, np.int64)  # windows that stay in their document
    long = lengths >= LENGTH
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, offsets[1:][long] - LENGTH + 1, -1)
    x = np.flatnonzero(np.cumsum(inside)[:windows] > 0)
    if not len(x):
        return np.zeros(0, np.uint64), none, none, none, none
    own = best[x]
    new = np.ones(len(x), bool)
    new[1:] = own[1:] != own[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(x)) - 1
    place = own[first]
    return hashed[place], np.searchsorted(offsets, place, side="right") - 1, place, x[first], x[last]


def _uids(column: pa.Array) -> np.ndarray:
    """MD5 values as rows of two 64-bit halves."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 2)


def _occurrence(uid: np.ndarray, start: np.ndarray) -> np.ndarray:
    return words.mix(words.mix(uid[:, 0] + start.astype(np.uint64) * _STEP) ^ uid[:, 1]).view(np.int64)


def _context_id(context: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(context, digest_size=8).digest(), "little", signed=True)


_CONTEXTS = "key long, context binary, context_id long, uid binary, first int, occurrence long"
_CONTEXT_KINDS = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]


def parts_of(context: bytes, size: int) -> Iterator[tuple[bytes, bytes, int]]:
    """(what its windows have in common, context, first window) for each range of ``size`` places of a context.

    A window's place is the number of its bytes before the owner, 0 to LENGTH - GRAM.
    """
    free = LENGTH - GRAM
    n = context[0]
    left, right = context[1 : 1 + n], context[1 + n :]
    least, most = free - len(right), n  # places of its windows
    for p in range(max(least, 0) // size, most // size + 1):
        low, high = p * size, min(free, p * size + size - 1)
        a, b = max(low, least), min(high, most)
        common = bytes([p, size]) + left[n - low :] + b"|" + right[: free - high]
        yield common, bytes([b]) + left[n - b :] + right[: free - a], n - b


def facing(contexts: list[tuple[bytes, bool]], size: int = RANGE) -> list[tuple[int, bytes, int]]:
    """(number, context, first window) of one owner's contexts that may share a window not yet known to occur twice.

    Each is cut to the ranges of ``size`` places whose common bytes another context has, too. A context marked True
    occurs twice itself: its windows are known, and it only shows those of others.
    """
    seen: dict[bytes, tuple[int, bool]] = {}  # common bytes: how many contexts, and whether one is unknown
    parts = []
    for context, known in contexts:
        parts.append(list(parts_of(context, size)))
        for common, _, _ in parts[-1]:
            n, unknown = seen.get(common, (0, False))
            seen[common] = n + 1, unknown or not known
    out = []
    for k, own in enumerate(parts):
        hit = [(part, at) for common, part, at in own if seen[common][0] > 1 and seen[common][1]]
        if hit:  # places ascend, so the first part reaches furthest right and the last one furthest left
            n, left = contexts[k][0][0], contexts[k][0][1:]
            (near, _), (far, first) = hit[0], hit[-1]
            end = n + len(near) - 1 - near[0]
            out.append((k, far[:1] + left[first:end], first))
    return out


def _split(size: int):
    """Rows of _CONTEXTS -> the same windows, each range of ``size`` places with an owner of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, context, uid, first in zip(*(batch.column(c).to_pylist() for c in ("key", "context", "uid", "first"))):
                for common, part, at in parts_of(context, size):
                    own = int.from_bytes(hashlib.blake2b(key.to_bytes(8, "little", signed=True) + common, digest_size=8).digest(), "little", signed=True)
                    out.append((own, part, _context_id(part), uid, first + at))
            if out:
                columns = [pa.array(c, t) for c, t in zip(zip(*out), _CONTEXT_KINDS)]
                spot = _occurrence(_uids(columns[3]), columns[4].to_numpy())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(spot)], [f.split()[0] for f in _CONTEXTS.split(", ")])

    return run


def _owners(texts: DataFrame) -> DataFrame:
    """key, occurrence of every owner: a narrow map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches):
            raw, offsets = words.utf8(batch.column("text"))
            key, doc, _, first, _ = owned(raw, offsets)
            uid = _uids(batch.column("uid"))[doc]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(_occurrence(uid, first - offsets[doc]))], ["key", "occurrence"])

    return texts.mapInArrow(run, "key long, occurrence long")


def _contexts(texts: DataFrame, bits) -> DataFrame:
    """key, context, context_id, uid, first window, occurrence of owners that may occur twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches):
            raw, offsets = words.utf8(batch.column("text"))
            key, doc, place, first, last = owned(raw, offsets)
            may = in_filter(bits.value, key)
            key, doc, place, first, last = key[may], doc[may], place[may], first[may], last[may]
            blob = raw.tobytes()
            context = [bytes([p - a]) + blob[a:p] + blob[p + GRAM : b + LENGTH] for p, a, b in zip(place.tolist(), first.tolist(), last.tolist())]
            uid = _uids(batch.column("uid"))[doc]
            start = first - offsets[doc]
            ids = [_context_id(c) for c in context]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(context, pa.binary()), pa.array(ids, pa.int64()), batch.column("uid").take(pa.array(doc)), pa.array(start.astype(np.int32)), pa.array(_occurrence(uid, start))],
                [f.split()[0] for f in _CONTEXTS.split(", ")],
            )

    return texts.mapInArrow(run, _CONTEXTS)


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by owner -> key, context_id, runs (first, end of windows that occur twice, in pairs)."""
    window = LENGTH - GRAM + 1
    out: list[tuple[int, int, list[int]]] = []
    waiting: list[tuple[int, int, bytes, bool, int]] = []
    symbols = 0

    def solve() -> None:
        for (key, cid, _, many, at), hit in zip(waiting, repeated_windows([(w[0], w[2]) for w in waiting])):
            if not many and hit.any():
                edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
                out.append((key, cid, (edges + at).tolist()))
        waiting.clear()

    def take(rows: list[tuple[int, int, bytes, bool]]) -> None:
        nonlocal symbols
        for key, cid, context, many in rows:
            if many:
                out.append((key, cid, [0, len(context) - window + 1]))
        if len(rows) > 1 and not all(r[3] for r in rows):
            for k, context, at in facing([r[2:] for r in rows]):
                waiting.append((rows[k][0], rows[k][1], context, rows[k][3], at))
                symbols += len(context) + 1
            if symbols >= SYMBOLS:
                solve()
                symbols = 0

    def flush() -> Iterator[pa.RecordBatch]:
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.list_(pa.int32())))], ["key", "context_id", "runs"])
            out.clear()

    held: list[tuple[int, int, bytes, bool]] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("key", "context_id", "context", "many"))):
            if held and held[0][0] != row[0]:
                take(held)
                held = []
            held.append(row)
        yield from flush()
    if held:
        take(held)
    if waiting:
        solve()
    yield from flush()


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _text_id():
    """The text's MD5, which tells texts apart."""
    return F.unhex(F.md5("text"))


def repeats(docs: DataFrame) -> DataFrame:
    """uid, whole, firsts, runs: for each text with repeated windows, their places; ``whole`` marks equal texts."""
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).filter(F.octet_length("text") >= LENGTH).withColumn("uid", _text_id()).select("uid", "text")
    temp: list[str] = []
    keys = written(_owners(texts).groupBy("key").agg(F.min("occurrence").alias("lo"), F.max("occurrence").alias("hi")).filter("lo < hi").select("key"), "owners", temp)
    bits = docs.sparkSession.sparkContext.broadcast(hash_filter(keys, "key"))
    found = written(_contexts(texts, bits).join(keys, "key"), "contexts", temp)
    size, hits = LENGTH - GRAM + 1, []
    while True:
        distinct = found.groupBy("key", "context_id").agg(F.min("occurrence").alias("lo"), F.max("occurrence").alias("hi"), F.first("context").alias("context")).select("key", "context_id", "context", (F.col("lo") < F.col("hi")).alias("many"))
        distinct = written(distinct, "distinct-contexts", temp)
        large = written(distinct.groupBy("key").agg(F.sum(F.octet_length("context")).alias("n")).filter(F.col("n") > MOST_SYMBOLS).select("key"), "large-owners", temp)
        none = size == 1 or large.isEmpty()
        small = distinct if none else distinct.join(large, "key", "left_anti")
        runs = written(small.repartition("key").sortWithinPartitions("key", "context_id").mapInArrow(_judged, "key long, context_id long, runs array<int>"), "runs", temp)
        hits.append(found.select("key", "context_id", "uid", "first").join(runs, ["key", "context_id"]).select("uid", "first", "runs"))
        if none:
            break
        size = -(-size // 2)
        found = written(found.join(large, "key").mapInArrow(_split(size), _CONTEXTS), "contexts", temp)
    hits = reduce(DataFrame.unionByName, hits).groupBy("uid").agg(F.collect_set(F.struct("first", "runs")).alias("hits"))
    copies = texts.groupBy("uid").count().filter(F.col("count") > 1).select("uid", F.lit(True).alias("whole"))
    both = hits.join(copies, "uid", "full").select("uid", F.coalesce("whole", F.lit(False)).alias("whole"), F.col("hits.first").alias("firsts"), F.col("hits.runs").alias("runs"))
    out = written(both, "repeats")
    forget(docs.sparkSession, temp)
    return out


def removed(n: int, whole: bool, firsts: list[int] | None, runs: list[list[int]] | None) -> np.ndarray:
    """(start, end) of the maximal runs of bytes to remove."""
    if whole:
        return np.array([[0, n]])
    edge = np.zeros(n + 1, np.int64)
    for first, pairs in zip(firsts or [], runs or []):
        for a, b in zip(pairs[::2], pairs[1::2]):
            edge[first + a] += 1
            edge[first + b - 1 + LENGTH] -= 1
    cover = (np.cumsum(edge[:n]) > 0).astype(np.int8)
    return np.flatnonzero(np.diff(np.concatenate([[0], cover, [0]]))).reshape(-1, 2)


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row.

    Texts that a filter of fixed size excludes are finished where they are read; only others are shuffled to their spans.
    """
    spans = repeats(docs)
    bits = docs.sparkSession.sparkContext.broadcast(key_filter(spans, "uid"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("uid", _text_id()).withColumn("place", filter_place("uid"))

    def first_look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches):
            may = maybe(bits.value, batch.column("place")).to_numpy(zero_copy_only=False)
            text = batch.column("text").cast(pa.binary()).to_pylist()
            digest = [None if m else hashlib.sha256(t).hexdigest() for t, m in zip(text, may)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("uid"), pa.array([len(t) for t in text], pa.int64()), pa.array(digest, pa.string()), pa.array([t if m else None for t, m in zip(text, may)], pa.binary())], ["doc_id", "uid", "n_bytes", "kept_sha256", "data"]
            )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, "data"):
            out = []
            for doc, data, whole, firsts, runs in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "data", "whole", "firsts", "runs"))):
                gone = removed(len(data), bool(whole), firsts, runs)
                kept, at = hashlib.sha256(), 0
                for a, b in gone.tolist():
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                out.append((doc, len(data), int((gone[:, 1] - gone[:, 0]).sum()), len(gone), kept.hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], [f.split()[0] for f in _RESULT.split(", ")])

    seen = rows.select("doc_id", "uid", "text", "place").mapInArrow(first_look, "doc_id long, uid binary, n_bytes long, kept_sha256 string, data binary")
    clean = seen.filter("data is null").select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), "kept_sha256")
    rest = seen.filter("data is not null").select("doc_id", "uid", "data").join(spans, "uid", "left").select("doc_id", "data", "whole", "firsts", "runs").mapInArrow(cut, _RESULT)
    return clean.unionByName(rest)
