"""Ranked lexical search: term at a time with a limited number of accumulators (Moffat, Zobel 1996).

A term is a maximal run of ASCII letters, digits and other characters beyond ASCII; A-Z are lower-cased.
The documents' terms that any query asks for are written once, a row a document
(term hashes and frequencies), with the number of all its terms. Queries are
taken in blocks of about PAIRS_A_BLOCK (query, term) pairs. A task inverts CHUNK documents at a time into
postings and goes through each query's terms from the rarest on. A term's postings create accumulators until
what the remaining terms can add at most (the chunk's own maxima) is below the
k-th best partial score, or below the k-th best score of the task's earlier chunks; from then on
survivors only are updated, exactly. A task returns the k best of each query; windows over (query, a few
tasks) and then over the query merge them. Scores are integers, so the order of addition doesn't matter.

Edge cases: null or empty texts hold no term and count nowhere. A document with null doc_id counts in the
statistics and is never returned. Rows that share a doc_id are documents of their own. Queries that share an item_id (or
have none) are one query of all their terms. A query without a known term has no rows. Equal scores
go by doc_id. An empty table gives no rows. Terms are told apart by 64-bit hashes: 10^4 asked terms among 10^9
others meet a wrong one with odds of 5 in 10^7.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import words
from .batches import hash_filter, in_filter
from .shared import written

K = 50
CHUNK, CHUNK_POSTINGS = 8192, 1 << 20
PAIRS_A_BLOCK = 1 << 20
TASKS_A_GROUP = 256  # tasks whose best rows are merged first

#: Bytes of a term, lower-cased; all others become spaces.
_TERM = np.full(256, 0x20, np.uint8)
_TERM[0x80:] = np.arange(0x80, 0x100)
_TERM[0x30:0x3A] = np.arange(0x30, 0x3A)
_TERM[0x41:0x5B] = _TERM[0x61:0x7B] = np.arange(0x61, 0x7B)


def counted(column: pa.Array, keep=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of terms of each document, offsets of documents in the next two, distinct term hashes, their frequencies).

    ``keep`` picks among an array of hashes.
    """
    raw, offsets = words.utf8(column)
    raw = _TERM[raw]
    starts, ends, first = words.spans(raw, offsets)
    hashed = words.span_hashes(raw, starts, ends)
    sizes = np.diff(first)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    if keep is not None:
        wanted = keep(hashed)
        hashed, doc = hashed[wanted], doc[wanted]
    order = np.lexsort((hashed, doc))
    hashed, doc = hashed[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (hashed[1:] != hashed[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return sizes, words.by_document(doc[at], len(sizes)), hashed[at], np.diff(np.append(at, len(doc)))


def asked_terms(queries: DataFrame) -> DataFrame:
    """item_id, term (a hash): the distinct terms of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches):
            _, offsets, terms, _ = counted(batch.column("text"))
            item = batch.column("item_id").take(pa.array(np.repeat(np.arange(batch.num_rows), np.diff(offsets))))
            yield pa.RecordBatch.from_arrays([item, pa.array(terms.view(np.int64))], ["item_id", "term"])

    return queries.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, term long").distinct()


def forward_index(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """doc_id, n (terms with repeats), terms, tfs (of asked terms) of each document with a term: a narrow map.

    Terms are picked by a filter of fixed size; one that nobody asked for and that passes it is left out when queries meet the index.
    """
    bits = docs.sparkSession.sparkContext.broadcast(hash_filter(asked, "term"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches):
            sizes, offsets, terms, tfs = counted(batch.column("text"), lambda h: in_filter(bits.value, h))
            offsets = pa.array(offsets.astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(terms.view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(tfs.astype(np.int64)))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes.astype(np.int64)), *lists], ["doc_id", "n", "terms", "tfs"]).filter(pa.array(sizes > 0))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, terms array<long>, tfs array<long>")


@dataclass
class Block:
    """Queries of a block: query q asks terms ``order[starts[q] : starts[q + 1]]`` (places in ``terms``), rarest first, with weights ``weights``."""

    items: list[int | None]
    terms: np.ndarray
    starts: np.ndarray
    order: np.ndarray
    weights: np.ndarray
    n_docs: int
    n_terms: int

    @staticmethod
    def of(pairs: pa.Table, n_docs: int, n_terms: int) -> Block:
        """``pairs`` has item_id, term, df."""
        df = pairs["df"].to_numpy()
        terms, place = np.unique(pairs["term"].to_numpy().view(np.uint64), return_inverse=True)
        names = pairs["item_id"].to_pylist()
        items = sorted(set(names), key=lambda i: (i is None, i))
        number = {item: q for q, item in enumerate(items)}
        query = np.array([number[i] for i in names], np.int64)
        by = np.lexsort((place, df, query))
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        return Block(items, terms, np.searchsorted(query[by], np.arange(len(items) + 1)), place[by], weights[by], n_docs, n_terms)


class TermAtATime:
    """The k best documents of each query of a block among those given in chunks."""

    def __init__(self, block: Block, k: int):
        self.block, self.k = block, k
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in block.items]  # scores, doc_ids
        self.created = self.updated = 0

    def scale(self, n: np.ndarray) -> np.ndarray:
        """A document's m: grows with its length against the mean; whole numbers beyond 64 bits are met with Python's."""
        b = self.block
        if len(n) and 50 * int(n.max()) * b.n_docs >= 1 << 63:
            return np.array([50 + 50 * x * b.n_docs // b.n_terms for x in n.tolist()], np.int64)
        return 50 + 50 * n * b.n_docs // b.n_terms

    def add(self, doc_ids: np.ndarray, n: np.ndarray, of: np.ndarray, hashed: np.ndarray, tf: np.ndarray) -> None:
        """Documents and their postings: ``of`` (place of the document, ascending), term hash, frequency."""
        b = self.block
        place = np.minimum(np.searchsorted(b.terms, hashed), len(b.terms) - 1)
        known = b.terms[place] == hashed
        place, of, tf = place[known], of[known], tf[known]
        by = np.argsort(place, kind="stable")
        place, of, tf = place[by], of[by], tf[by]
        impact = (1_000_000_000 * tf) // (1000 * tf + 20 * self.scale(n)[of])
        starts = np.searchsorted(place, np.arange(len(b.terms) + 1))
        most = np.zeros(len(b.terms), np.int64)
        here = np.flatnonzero(np.diff(starts))
        if not len(here):
            return
        most[here] = np.maximum.reduceat(impact, starts[here])
        acc = np.zeros(len(doc_ids), np.int64)
        for q in range(len(b.items)):
            terms, weights = b.order[b.starts[q] : b.starts[q + 1]], b.weights[b.starts[q] : b.starts[q + 1]]
            some = most[terms] > 0
            if some.any():
                self._query(q, terms[some], weights[some], most, starts, of, impact, acc, doc_ids)

    def _query(self, q, terms, weights, most, starts, of, impact, acc, doc_ids) -> None:
        k, (scores, ids) = self.k, self.best[q]
        bounds = np.cumsum((weights * most[terms])[::-1])[::-1].tolist()  # what the terms from here on can add
        floor = int(scores[-1]) if len(scores) == k else 0
        survivors = None
        for t, w, rest in zip(terms.tolist(), weights.tolist(), bounds):
            a, z = starts[t], starts[t + 1]
            if survivors is None and (rest < floor or (rest < acc.max() and rest < self._kth(acc))):
                survivors = np.flatnonzero(acc)
                if not len(survivors):
                    return
            if survivors is None:
                acc[of[a:z]] += w * impact[a:z]
                self.created += int(z - a)
            else:
                at = np.minimum(np.searchsorted(of[a:z], survivors), z - a - 1) + a
                hit = of[at] == survivors
                acc[survivors[hit]] += w * impact[at[hit]]
                self.updated += int(hit.sum())
        found = np.flatnonzero(acc) if survivors is None else survivors
        new, who = acc[found], doc_ids[found]
        acc[found] = 0
        good = new >= max(floor, 1)
        scores, ids = np.concatenate([scores, new[good]]), np.concatenate([ids, who[good]])
        by = np.lexsort((ids, -scores))[:k]
        self.best[q] = scores[by], ids[by]

    def _kth(self, acc: np.ndarray) -> int:
        return int(np.partition(acc, len(acc) - self.k)[len(acc) - self.k]) if len(acc) >= self.k else 0

    def results(self) -> Iterator[tuple[int | None, np.ndarray, np.ndarray]]:
        for item, (scores, ids) in zip(self.block.items, self.best):
            if len(scores):
                yield item, scores, ids


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Index rows as (doc_ids, n, document of each posting, term, tf), CHUNK documents and about CHUNK_POSTINGS postings at once."""
    held, rows, postings = [], 0, 0

    def joined() -> tuple[np.ndarray, ...]:
        t = pa.Table.from_batches(held)
        sizes = t["terms"].combine_chunks().value_lengths().to_numpy()
        flat = lambda c: t[c].combine_chunks().flatten().to_numpy()
        return t["doc_id"].to_numpy(), t["n"].to_numpy(), np.repeat(np.arange(len(sizes)), sizes), flat("terms").view(np.uint64), flat("tfs")

    for batch in batches:
        batch = batch.filter(batch.column("doc_id").is_valid())
        if not batch.num_rows:
            continue
        held.append(batch)
        rows, postings = rows + batch.num_rows, postings + len(batch.column("terms").flatten())
        if rows >= CHUNK or postings >= CHUNK_POSTINGS:
            yield joined()
            held, rows, postings = [], 0, 0
    if held:
        yield joined()


_FOUND = "item_id long, doc_id long, score long, task long"


def _searched(index: DataFrame, block: Block, k: int) -> DataFrame:
    """item_id, doc_id, score, task: the k best documents of each query in each task."""
    shared = index.sparkSession.sparkContext.broadcast(block)  # at most about PAIRS_A_BLOCK pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = TermAtATime(shared.value, k)
        for chunk in _chunks(batches):
            search.add(*chunk)
        task = TaskContext.get().partitionId()
        for item, scores, ids in search.results():
            columns = [pa.array([item] * len(ids), pa.int64()), pa.array(ids), pa.array(scores), pa.array([task] * len(ids), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["item_id", "doc_id", "score", "task"])

    return index.mapInArrow(run, _FOUND)


def search(docs: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents (doc_id, text) of each query (item_id, text)."""
    spark = docs.sparkSession
    none = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    asked = written(asked_terms(queries), "asked-terms")
    pairs = asked.count()
    if not pairs:
        return none
    index = written(forward_index(docs, asked), "forward-index")
    facts = index.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("terms")).first()
    if not facts["n"]:
        return none
    df = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    blocks = -(-pairs // PAIRS_A_BLOCK)
    known = written(asked.join(df, "term").withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks))), "known-terms")
    found = None
    for number in range(blocks):
        terms = known.filter(F.col("block") == number).select("item_id", "term", "df").toArrow()
        if terms.num_rows:
            part = _searched(index, Block.of(terms, facts["n"], facts["terms"]), k)
            found = part if found is None else found.unionByName(part)
    if found is None:
        return none
    order = [F.desc("score"), F.col("doc_id")]
    near = Window.partitionBy("item_id", F.floor(F.col("task") / TASKS_A_GROUP)).orderBy(*order)
    merged = found.withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= k)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(*order))
    return merged.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
