"""Quality classification: random Fourier features of document statistics, ridge regression, isotonic calibration.

A document is described by statistics of its whole text (:data:`STATISTICS`). They are standardised and
projected to cosines, whose products approximate a Gaussian kernel (Rahimi, Recht 2007). Tasks sum their rows' normal
equations by fold, a shuffle adds the sums, and the driver gets FOLDS matrices of fixed size. All but one fold's sums give a
model that has not seen that fold; the ridge with the least squared error on unseen folds is taken. Unseen rows' scores, counted in
BINS bins, are made monotone by pooling adjacent violators; the scores of the model of all folds pass
through that curve (linear between the pools' means).

Statistics, cosines and labels are whole numbers (fixed point), so sums don't depend on how rows are dealt to tasks.
All labelled rows teach; what is collected is of fixed size.

Edge cases: a null or empty text has the statistics of an empty one and a score like any other. A null quality teaches
nothing; if a doc_id has several labels, their mean is taught. Null doc_ids are scored and never teach.
Without any labelled row every score is 0. Repeated rows of ``docs`` count each. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .shared import written

STATISTICS = (
    "log bytes", "log words", "log word length", "spread of word lengths", "short words", "long words", "capital letters", "digits", "white space",
    "punctuation", "exclamation marks", "bars", "other symbols", "beyond ASCII", "byte entropy", "words in capitals", "capitalised words",
    "words that end in a symbol", "words that end in a stop", "distinct words", "most frequent word", "distinct triples", "lines by words", "distinct lines",
)
FEATURES, WIDTH = 256, 1.0  # cosines; kernel width in units of the root of the number of statistics
RIDGES = (1e-4, 1e-3, 1e-2, 1e-1, 1.0)  # by row
FOLDS, BINS = 4, 4096
CUT = 0.3
_STAT, _COS, _LABEL = 1 << 12, 1 << 14, 1 << 12  # fixed points
_MOST = 5.0  # standard deviations; beyond that a statistic says nothing more

_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LETTER = _UPPER.copy()
_LETTER[0x61:0x7B] = True
_LETTER[0x80:] = True
_STOPS = np.zeros(256, bool)
_STOPS[[ord(c) for c in ".,;:?'\")"]] = True
_KINDS = np.zeros((256, 7))  # digits, space, punctuation, exclamation marks, bars, other symbols, beyond ASCII
_KINDS[0x30:0x3A, 0] = 1
_KINDS[words._SPACE, 1] = 1
_KINDS[[ord(c) for c in ".,;:?'\"()-"], 2] = 1
_KINDS[ord("!"), 3] = 1
_KINDS[ord("|"), 4] = 1
_KINDS[0x80:, 6] = 1
_KINDS[:, 5] = (_KINDS.sum(axis=1) == 0) & ~_LETTER


def _total(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.float64)])[first])


def _repeats(hashed: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(share of different values, share of the most frequent one) in each document; 1 and 0 without any."""
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((hashed, doc))
    h, d = hashed[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(h)))
    most = np.zeros(len(n))
    np.maximum.at(most, d[at], size)
    some = np.maximum(n, 1)
    return np.where(n > 0, np.bincount(d[at], minlength=len(n)) / some, 1.0), most / some


def statistics(column: pa.Array) -> np.ndarray:
    """Rows of STATISTICS, in units of 1 / _STAT."""
    raw, offsets = words.utf8(column)
    n, sizes = len(offsets) - 1, np.diff(offsets)
    doc = np.repeat(np.arange(n), sizes)
    seen = np.bincount(doc * 256 + raw, minlength=256 * n).reshape(n, 256).astype(np.float64)
    some = np.maximum(sizes, 1)
    share = seen / some[:, None]
    kinds = share @ _KINDS
    entropy = -(share * np.log2(np.where(share > 0, share, 1.0))).sum(axis=1)
    upper = _UPPER[raw]
    upper[1:] |= (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
    letters = np.maximum(_total(_LETTER[raw] & (raw != 0xC3), offsets), 1)
    starts, ends, first = words.spans(raw, offsets)
    count = np.maximum(np.diff(first), 1)
    length = ends - starts
    mean = _total(length, first) / count
    spread = np.sqrt(np.maximum(_total(length.astype(np.float64) ** 2, first) / count - mean**2, 0))
    up, low = (np.concatenate([[0], np.cumsum(x)]) for x in (upper, _LETTER[raw] & ~upper & (raw != 0xC3)))
    ups, lows = up[ends] - up[starts], low[ends] - low[starts]
    leading = upper[starts] | upper[np.minimum(starts + 1, len(raw) - 1)] & (raw[starts] == 0xC3) if len(starts) else np.zeros(0, bool)
    tail = raw[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    stop = _STOPS[tail]
    hashed = words.span_hashes(raw, starts, ends)
    different, most = _repeats(hashed, first)
    triples, _ = _repeats(*words.shingles(hashed, first, 3))
    newline = np.concatenate([np.flatnonzero(raw == 0x0A) + 1, offsets[:-1][sizes > 0]])
    line_starts = np.unique(newline[newline < len(raw)])
    line_ends = np.append(line_starts[1:], len(raw))
    line_first = np.searchsorted(line_starts, offsets)
    lines, _ = _repeats(words.span_hashes(raw, line_starts, line_ends), line_first)
    by_words = lambda x: _total(x, first) / count
    table = [
        np.log1p(sizes), np.log1p(np.diff(first)), np.log1p(mean), np.log1p(spread), by_words(length <= 2), by_words(length > 16), _total(upper, offsets) / letters, kinds[:, 0], kinds[:, 1],
        kinds[:, 2], kinds[:, 3], kinds[:, 4], kinds[:, 5], kinds[:, 6], entropy, by_words((ups >= 2) & (lows == 0)), by_words(leading),
        by_words(~_LETTER[tail] & ~stop & ((tail < 0x30) | (tail > 0x39))), by_words(stop), different, most, triples, np.diff(line_first) / count, lines,
    ]
    return np.rint(np.stack(table, axis=1) * _STAT).astype(np.int64)


def described(docs: DataFrame) -> DataFrame:
    """doc_id, stats of each document: a narrow map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches):
            found = statistics(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * len(STATISTICS)), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "stats"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, stats array<long>")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("stats").flatten().to_numpy().reshape(batch.num_rows, len(STATISTICS))


@dataclass
class Cosines:
    """The random map from statistics to FEATURES cosines and a constant, in units of 1 / _COS."""

    mean: np.ndarray
    scale: np.ndarray
    seed: int = 5

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        r = np.random.default_rng(self.seed)
        d = len(STATISTICS)
        weights, shift = r.normal(0, 1 / (WIDTH * d**0.5), (d, FEATURES)), r.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((stats / _STAT - self.mean) / self.scale, -_MOST, _MOST)
        return np.concatenate([np.rint(np.cos(z @ weights + shift) * _COS), np.full((len(stats), 1), float(_COS))], axis=1)


@dataclass
class Model:
    cosines: Cosines
    weights: np.ndarray
    knots: np.ndarray = None  # raw scores and the calibrated ones
    values: np.ndarray = None

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return np.round(self.cosines(stats) @ self.weights / _COS, 9)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots, self.values), 0, 1)


def monotone(at: np.ndarray, value: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools of adjacent violators: (mean place, mean value) of each, ascending."""
    pools: list[list[float]] = []
    for a, v, w in zip(at.tolist(), value.tolist(), weight.tolist()):
        pools.append([a * w, v * w, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def _sums(labelled: DataFrame, cosines: Cosines) -> tuple[np.ndarray, np.ndarray]:
    """Of each fold: the matrix of products of features and label (last), and its number of rows; added by tasks, then by a shuffle."""
    size = FEATURES + 2

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, size, size), np.int64)
        rows = np.zeros(FOLDS, np.int64)
        for batch in batches:
            x = np.concatenate([cosines(_matrix(batch)), batch.column("y").to_numpy()[:, None].astype(np.float64)], axis=1)
            fold = batch.column("fold").to_numpy()
            for f in range(FOLDS):
                own = x[fold == f]
                total[f] += (own.T @ own).astype(np.int64)  # whole numbers below 2**53
                rows[f] += len(own)
        for f in np.flatnonzero(rows):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size, f)), pa.array(np.arange(size)), pa.array(np.full(size, rows[f])), pa.array([r.tobytes() for r in total[f]], pa.binary())], ["fold", "i", "n", "row"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list] = {}
        for batch in batches:
            for f, i, n, row in zip(*(batch.column(c).to_pylist() for c in ("fold", "i", "n", "row"))):
                have = found.setdefault((f, i), [0, np.zeros(size, np.int64)])
                have[0] += n
                have[1] += np.frombuffer(row, np.int64)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found]), pa.array([k[1] for k in found]), pa.array([v[0] for v in found.values()]), pa.array([v[1].tobytes() for v in found.values()], pa.binary())], ["fold", "i", "n", "row"])

    kind = "fold long, i long, n long, row binary"
    total, rows = np.zeros((FOLDS, size, size)), np.zeros(FOLDS)
    for r in labelled.mapInArrow(of_task, kind).repartition("fold", "i").mapInArrow(added, kind).collect():  # FOLDS x size rows
        total[r["fold"], r["i"]] = np.frombuffer(r["row"], np.int64)
        rows[r["fold"]] = r["n"]
    unit = np.append(np.full(size - 1, float(_COS)), float(_LABEL))
    return total / np.outer(unit, unit), rows


def _solved(total: np.ndarray, rows: float, ridge: float) -> np.ndarray:
    a = total[:-1, :-1] + ridge * max(rows, 1) * np.diag(np.append(np.ones(FEATURES), 1e-9))  # the constant is free
    return np.linalg.solve(a, total[:-1, -1])


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id's decimal text modulo 5: 0 is held out, the others are folds."""
    return F.crc32(doc_id.cast("string")) % 5


def train(stats: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on the rows of ``stats`` (doc_id, stats) that ``labels`` (doc_id, quality) marks and that are not held out."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality"))
    marks = marks.filter("doc_id is not null and quality is not null").filter(fold_of(F.col("doc_id")) != 0)
    y = marks.groupBy("doc_id").agg(F.round(F.avg("quality") * _LABEL).cast("long").alias("y"))
    labelled = written(stats.join(y, "doc_id").select((fold_of(F.col("doc_id")) - 1).cast("long").alias("fold"), "y", "stats"), "labelled")
    exact = [f(F.col("stats")[i].cast("decimal(19,0)")) for i in range(len(STATISTICS)) for f in (F.sum, lambda c: F.sum((c * c).cast("decimal(28,0)")))]
    *moments, n = labelled.agg(*[c.alias(f"m{i}") for i, c in enumerate(exact)], F.count(F.lit(1)).alias("n")).first()
    if not n:
        return None
    mean = np.array([float(m) for m in moments[::2]]) / n / _STAT
    square = np.array([float(m) for m in moments[1::2]]) / n / _STAT**2
    cosines = Cosines(mean, np.sqrt(np.maximum(square - mean**2, 1e-6)))
    total, rows = _sums(labelled, cosines)
    whole = total.sum(axis=0)

    def unseen(ridge: float) -> tuple[float, list[np.ndarray]]:
        """Squared error on folds that a model has not seen, from the sums alone, and those models."""
        models = [_solved(whole - total[f], n - rows[f], ridge) for f in range(FOLDS)]
        return sum(t[-1, -1] - 2 * m @ t[:-1, -1] + m @ t[:-1, :-1] @ m for m, t in zip(models, total)), models

    ridge = min(RIDGES, key=lambda r: unseen(r)[0])
    by_fold = np.stack(unseen(ridge)[1])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.einsum("ij,ij->i", cosines(_matrix(batch)), by_fold[batch.column("fold").to_numpy()]) / _COS
            place = np.clip(np.floor((raw + 0.5) * (BINS / 2)), 0, BINS - 1).astype(np.int64)  # -0.5 to 1.5
            yield pa.RecordBatch.from_arrays([pa.array(place), batch.column("y")], ["place", "y"])

    seen = labelled.mapInArrow(binned, "place long, y long").groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")).orderBy("place").collect()  # BINS rows
    weight = np.array([r["n"] for r in seen], np.float64)
    at = (np.array([r["place"] for r in seen]) + 0.5) * (2 / BINS) - 0.5
    knots, values = monotone(at, np.array([r["y"] for r in seen]) / weight / _LABEL, weight)
    return Model(cosines, _solved(whole, n, ridge), knots, values)


def scored(stats: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score of each row of ``stats``: a narrow map."""
    if model is None:
        return stats.select("doc_id", F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_matrix(batch)) if batch.num_rows else np.zeros(0))], ["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each document, by a model that saw no label of a held-out one."""
    stats = written(described(docs), "statistics")
    held_out = F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False))
    return scored(stats, train(stats, labels)).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
