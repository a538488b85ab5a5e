"""Approximate nearest neighbours by largest inner product with a permutation index.

A vector is represented by its nearest LIST pivots, in order of nearness (Chavez,
Figueroa, Navarro 2008). It is posted in the inverted files of its POSTS nearest
pivots (Amato, Savino 2008; Esuli 2012). A query goes to the files of its own PROBES
nearest pivots. A file ranks its vectors by Spearman's footrule with a missing
pivot counted as place LIST, the best KEPT of them (ties included) are ranked
again by inner product in double precision on the original vectors, and the best
of all files are the answer. A vector that a query meets in several files is
ranked in the first of them only.

Largest inner product is turned into smallest angle by one more coordinate,
sqrt(M**2 - |x|**2) with M the largest norm and 0 for queries (Bachrach and
others 2014), so pivots see lengths as well. Pivots are a random sample of different vectors:
PIVOTS of them, more from FILE_ROWS * PIVOTS / POSTS vectors on so that files keep their size,
MOST_PIVOTS at most. A file that is larger than FILE_ROWS vectors or FILE_QUERIES queries
(a hot pivot) is dealt to several tasks by a hash of the id. So a vector is shuffled
POSTS times and a query PROBES times, however many there are.

Edge cases: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do those of another length than most of ``vectors`` have.
Repeated rows count once, a vec_id is never its own neighbour, and of equal vectors only
the k + 1 smallest ids are indexed, for no others can be in an answer. Queries that share an id
but not a vector are answered each. With fewer rows than asked for, all that were
found are returned; an empty table gives no rows. Ties go to the smaller vec_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .words import U, mix

PIVOTS, MOST_PIVOTS, LIST = 512, 65536, 64
POSTS, PROBES = 8, 64
KEPT = 0.5
FILE_ROWS, FILE_QUERIES = 16384, 16384
SHARES = 1 << 30  # of the sample
STEP_CELLS = 1 << 22  # products of vectors and pivots that a task holds at once


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v array<double>: the rows that can take part, each once."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    return rows.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Rows with the coordinate that makes all of them as long as the longest."""
    return np.hstack([x, np.sqrt(np.maximum(longest**2 - (x * x).sum(axis=1, keepdims=True), 0))])


def choose_pivots(sample: np.ndarray, count: int, seed: int = 5) -> np.ndarray:
    """Distinct rows of a sample in random order."""
    sample = np.unique(sample, axis=0)
    return sample[np.random.default_rng(seed).permutation(len(sample))[:count]]


def nearest_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """rows x LIST (or fewer): pivots by descending inner product."""
    size = min(LIST, len(pivots))
    out = np.zeros((len(x), size), np.uint16)
    step = min(1024, max(1, STEP_CELLS // len(pivots)))
    for k in range(0, len(x), step):
        near = x[k : k + step] @ pivots.T
        own = np.argpartition(-near, size - 1, axis=1)[:, :size]
        out[k : k + step] = np.take_along_axis(own, np.argsort(-np.take_along_axis(near, own, 1), axis=1, kind="stable"), 1)
    return out


def footrule(lists: np.ndarray, query: np.ndarray, n_pivots: int) -> np.ndarray:
    """How near each list is to the query's: larger is nearer.

    Of two lists the footrule is a constant less twice the sum, over shared pivots, of the
    smaller number of places that follow; that sum is returned.
    """
    size = lists.shape[1]
    after = np.arange(size, 0, -1, dtype=np.uint8)
    own = np.zeros(n_pivots, np.uint8)
    own[query] = after
    return np.minimum(own[lists], after).sum(axis=1, dtype=np.int32)


def _spread(rows: DataFrame, asks: bool, pivots: np.ndarray, longest: float, posted: np.ndarray | None, asked: np.ndarray | None) -> DataFrame:
    """A row for each file of each vector: pivot, i, j, asks, id, place (of the pivot in its list), list, v.

    Without the files' sizes (``posted``, ``asked``), only the pivots, to count them.
    """
    counting = posted is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            x = flat.reshape(batch.num_rows, -1)
            lists = nearest_pivots(np.pad(x, ((0, 0), (0, 1))) if asks else lifted(x, longest), pivots)
            files = lists[:, : PROBES if asks else POSTS]
            place = np.tile(np.arange(files.shape[1], dtype=np.int8), len(files))
            row, pivot = np.repeat(np.arange(len(files)), files.shape[1]), files.ravel().astype(np.int32)
            if counting:
                yield pa.RecordBatch.from_arrays([pa.array(pivot)], ["pivot"])
                continue
            ids = batch.column("vec_id").to_numpy()
            own, others = (asked, posted) if asks else (posted, asked)
            mine = (mix(ids.astype(np.uint64))[row] % own[pivot].astype(U)).astype(np.int32)
            copies = others[pivot]
            row, pivot, place, mine = (np.repeat(z, copies) for z in (row, pivot, place, mine))
            other = (np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)).astype(np.int32)
            i, j = (other, mine) if asks else (mine, other)
            for k in range(0, len(row), 8192):
                at = slice(k, k + 8192)
                part = row[at]
                column = lambda a: pa.array([z.tobytes() for z in a[part]], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pivot[at]), pa.array(i[at]), pa.array(j[at]), pa.array(np.full(len(part), asks)), pa.array(ids[part]), pa.array(place[at]), column(lists), column(x)],
                    ["pivot", "i", "j", "asks", "id", "place", "list", "v"],
                )

    return rows.select("vec_id", "v").mapInArrow(run, "pivot int" if counting else "pivot int, i int, j int, asks boolean, id long, place byte, list binary, v binary")


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, kept: float = KEPT) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row of ``queries``; both have vec_id, embedding."""
    rows, asked = usable(vectors), usable(queries)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    facts = rows.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("square"), F.approx_count_distinct(F.xxhash64("v")).alias("different")).orderBy(F.desc("n"), "size").first()
    size, n, longest, different = (facts["size"], facts["n"], float(facts["square"]) ** 0.5, facts["different"]) if facts else (0, 0, 0.0, 0)
    rows, asked = (t.filter(F.size("v") == size).distinct() for t in (rows, asked))
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("copy") <= k + 1).drop("copy")
    count = min(MOST_PIVOTS, max(PIVOTS, n * POSTS // FILE_ROWS))
    share = SHARES if different <= 4 * count else SHARES * 4 * count // different  # about four times the pivots, by a hash of the vector, reach a sort
    known = usable(vectors).filter(F.size("v") == size).select("v", F.xxhash64("v").alias("h")).filter(F.pmod("h", F.lit(SHARES)) < share)
    sample = known.distinct().orderBy("h", "v").limit(2 * count).select("v").collect() if n else []
    raw = np.array([r["v"] for r in sample], np.float64).reshape(-1, max(size, 1))
    pivots = choose_pivots(lifted(raw, longest), count)
    n_pivots, probes = len(pivots), min(PROBES, LIST)

    def parts(of: DataFrame, asks: bool, most: int) -> np.ndarray:
        """Into how many parts each pivot's file is dealt; one row a pivot comes to the driver."""
        out = np.ones(max(n_pivots, 1), np.int64)
        for r in _spread(of, asks, pivots, longest, None, None).groupBy("pivot").count().collect():
            out[r["pivot"]] = -(-r["count"] // most)
        return out

    posted, asking = parts(rows, False, FILE_ROWS), parts(asked, True, FILE_QUERIES)
    both = _spread(rows, False, pivots, longest, posted, asking).unionByName(_spread(asked, True, pivots, longest, posted, asking))

    def run(key: tuple, file: pa.Table) -> pa.Table:
        asks = file["asks"].to_numpy()
        query, found, score, version = [], [], [], []
        if asks.any() and not asks.all():
            ids = file["id"].to_numpy()
            lists = np.frombuffer(b"".join(file["list"].to_pylist()), np.uint16).reshape(len(ids), -1)
            x = np.frombuffer(b"".join(file["v"].to_pylist()), np.float64).reshape(len(ids), -1)
            place, seen, probed = file["place"].to_numpy()[~asks], np.flatnonzero(~asks), np.zeros(n_pivots, bool)
            own_lists, posts = lists[seen], lists[seen][:, :POSTS]
            for at in np.flatnonzero(asks):
                probed[:] = False
                probed[lists[at, :probes]] = True
                here = np.flatnonzero((probed[posts].argmax(axis=1) == place) & (ids[seen] != ids[at]))
                if not len(here):
                    continue
                near = footrule(own_lists[here], lists[at], n_pivots)
                keep = max(k, int(np.ceil(kept * len(here))))
                if keep < len(here):
                    here = here[near >= np.partition(near, len(here) - keep)[len(here) - keep]]
                s = (x[seen[here]] * x[at]).sum(axis=1)  # row by row alike, so equal vectors tie
                best = np.lexsort((ids[seen[here]], -s))[:k]
                query.append(np.full(len(best), ids[at]))
                version.append(np.full(len(best), int(mix(x[at].view(np.uint64)).sum(dtype=np.uint64).view(np.int64))))
                found.append(ids[seen[here]][best])
                score.append(s[best])
        join = lambda z, kind: pa.array(np.concatenate(z) if z else np.zeros(0), kind)
        return pa.table({"query_id": join(query, pa.int64()), "version": join(version, pa.int64()), "vec_id": join(found, pa.int64()), "score": join(score, pa.float64())})

    found = both.groupBy("pivot", "i", "j").applyInArrow(run, "query_id long, version long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "version").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
