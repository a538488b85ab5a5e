"""Cross-tokenizer alignment by inverted pair bitmaps.

Two tokenizers (A byte-level BPE, B pieces with byte fallback) encode a space and the text. A's and B's tokens
that end at the same byte are linked, and such places cut the tokens into groups. The corpus index has a posting for
each pair (id of A, id of B) and container of 65,536 consecutive documents of a task: compressed bitmaps of
document places, one of the documents that hold the pair and one for each binary digit of
(links - 1), the multiplicity planes. A bitmap is a list of places, runs, or plain bits,
whichever is shortest (Chambi, Lemire, Kaser, Godin 2016). A task gives a container away in parts; they are OR-merged, and
popcounts give a pair's documents and links, first in a container and then over all. A pair's scores (its links, whether it is its B id's best) go
back over its postings: each container adds them up at the places of its planes.

Postings meet the scores by (pair, container modulo SALT), so a pair that is in
every document is spread, and a container's sums are two arrays of fixed size.

Edge cases: a text that is null or empty, or whose joined token bytes of A or B differ
from a space and the text (for instance one with U+2581, or with an id that is no byte sequence), has no tokens: zeros and ''.
Rows that share a doc_id, or have none, are documents of their own. An empty table gives no rows. Long texts are encoded by B in parts cut before a space
after another character, where no piece goes across. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .shared import written
from .token_output import PieceEncoder, _stretches

PLACES = 1 << 16  # documents of a container
FLUSH = 1 << 20  # links held by a task before they become postings
SALT = 16
PART_CHARS = 1 << 18
LIST, RUNS, BITS = 0, 1, 2


# ---------------------------------------------------------------- tokens and their bytes


@dataclass
class Bytes:
    """The bytes that each id stands for."""

    start: np.ndarray
    length: np.ndarray
    data: np.ndarray

    @staticmethod
    def of(tokens: list[bytes]) -> Bytes:
        length = np.array([len(t) for t in tokens], np.int64)
        return Bytes(np.cumsum(length) - length, length, np.frombuffer(b"".join(tokens), np.uint8))

    def same(self, ids: np.ndarray, counts: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether each document's ids stand for exactly its bytes, none of them for nothing."""
        size, upto = self.length[ids], np.concatenate([[0], np.cumsum(counts)])
        total = np.concatenate([[0], np.cumsum(size)])
        void = np.concatenate([[0], np.cumsum(size == 0)])
        sizes = np.diff(offsets)
        ok = (np.diff(total[upto]) == sizes) & (np.diff(void[upto]) == 0)
        kept = np.repeat(ok, counts)
        found = self.data[_stretches(self.start[ids[kept]], size[kept])]
        differ = np.flatnonzero(found != raw[np.repeat(ok, sizes)])
        right = np.flatnonzero(ok)
        ok[right[np.searchsorted(np.cumsum(sizes[right]), differ, side="right")]] = False
        return ok


class PlainEncoder(PieceEncoder):
    """Strings of special tokens in a text are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        self.added = []

    def table(self) -> Bytes:
        """A character of a token's name stands for a byte: the printable ones of Latin-1 for themselves, the others, in order, from U+0100 on."""
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}
        names = {i: name for name, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        token = lambda name: bytes(byte_of[c] for c in name) if all(c in byte_of for c in name) else b""
        return Bytes.of([token(names.get(i, "")) for i in range(max(names) + 1)])


class Pieces:
    """The sentencepiece library; it puts a space before a text."""

    def __init__(self, path: str):
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)

    def table(self) -> Bytes:
        p = self.processor
        return Bytes.of([bytes([int(p.id_to_piece(i)[3:5], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace("▁", " ").encode() for i in range(p.get_piece_size())])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        parts = [cut(t) for t in texts]
        found = self.processor.encode([p for ps in parts for p in ps], out_type=int, num_threads=1)
        sizes = np.array([len(ids) for ids in found], np.int64)
        first = np.cumsum([0, *(len(ps) for ps in parts)])
        ids = np.concatenate([np.array(x, np.int64) for x in found]) if found else np.zeros(0, np.int64)
        return ids, np.diff(np.concatenate([[0], np.cumsum(sizes)])[first])


def cut(text: str, most: int = PART_CHARS) -> list[str]:
    """Parts of about ``most`` characters; the space between two parts is the one that is put before the second."""
    parts, begin = [], 0
    while len(text) - begin > most:
        at = text.find(" ", begin + most)
        while 0 < at and text[at - 1] in " ▁":
            at = text.find(" ", at + 1)
        if at < 0 or at + 1 == len(text):
            break
        parts.append(text[begin:at])
        begin = at + 1
    return [*parts, text[begin:]]


@lru_cache(1)
def tokenizers(a_path: str, b_path: str) -> tuple[PlainEncoder, Bytes, Pieces, Bytes, list[bytes]]:
    a, b = PlainEncoder(a_path), Pieces(b_path)
    a_bytes, b_bytes = a.table(), b.table()
    decimals = [b"%d%s" % (i, mark) for i in range(max(len(a_bytes.length), len(b_bytes.length))) for mark in (b",", b"|", b";", b"")]
    return a, a_bytes, b, b_bytes, decimals


@dataclass
class Aligned:
    """Of each document: numbers of tokens and groups, the groups' digest; of each link: document, pair."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    digests: list[str]
    doc: np.ndarray
    pair: np.ndarray


def align(column: pa.Array, a_path: str, b_path: str) -> Aligned:
    a, a_bytes, b, b_bytes, decimals = tokenizers(a_path, b_path)
    n = len(column)
    present = np.flatnonzero(pc.fill_null(pc.greater(pc.binary_length(column), 0), False).to_numpy(zero_copy_only=False))
    texts = column.take(pa.array(present))
    spaced = pc.binary_join_element_wise(pa.scalar("", texts.type), texts, pa.scalar(" ", texts.type))
    raw, offsets = words.utf8(spaced)
    a_ids, a_counts = a.encode(spaced)
    b_ids, b_counts = b.encode(texts.to_pylist())
    a_ids = a_ids.astype(np.int64)
    good = a_bytes.same(a_ids, a_counts, raw, offsets) & b_bytes.same(b_ids, b_counts, raw, offsets)
    a_ids, b_ids = a_ids[np.repeat(good, a_counts)], b_ids[np.repeat(good, b_counts)]
    docs, a_counts, b_counts = present[good], a_counts[good], b_counts[good]
    n_a, n_b, n_groups = (np.zeros(n, np.int64) for _ in range(3))
    n_a[docs], n_b[docs] = a_counts, b_counts
    digests = [""] * n
    if not len(docs):
        return Aligned(n_a, n_b, n_groups, digests, np.zeros(0, np.int64), np.zeros(0, np.int64))
    # Both sides have the same bytes, so ends can be counted over all documents at once.
    a_ends, b_ends = np.cumsum(a_bytes.length[a_ids]), np.cumsum(b_bytes.length[b_ids])
    at = np.searchsorted(b_ends, a_ends)
    linked = b_ends[at] == a_ends
    ia, ib = np.flatnonzero(linked), at[linked]
    doc_of_link = np.searchsorted(np.cumsum(a_counts), ia, side="right")
    n_groups[docs] = np.bincount(doc_of_link, minlength=len(docs))
    # A group's tokens of A, then those of B: a token's place is its own plus the other side's tokens before it.
    group_a = np.concatenate([[0], np.cumsum(linked)[:-1]])
    b_linked = np.zeros(len(b_ids), bool)
    b_linked[ib] = True
    group_b = np.concatenate([[0], np.cumsum(b_linked)[:-1]])
    listed = np.empty(len(a_ids) + len(b_ids), np.int64)
    listed[np.arange(len(a_ids)) + np.concatenate([[0], ib + 1])[group_a]] = 4 * a_ids + linked
    mark = np.where(b_linked, 2, 0)
    mark[np.cumsum(b_counts) - 1] = 3
    listed[np.arange(len(b_ids)) + (ia + 1)[group_b]] = 4 * b_ids + mark
    begin = 0
    for d, end in zip(docs.tolist(), np.cumsum(a_counts + b_counts).tolist()):
        digests[d] = hashlib.sha256(b"".join([decimals[i] for i in listed[begin:end].tolist()])).hexdigest()
        begin = end
    return Aligned(n_a, n_b, n_groups, digests, docs[doc_of_link], (a_ids[ia] << 32) | b_ids[ib])


# ---------------------------------------------------------------- bitmaps


def bitmap(places: np.ndarray) -> bytes:
    """Ascending places below PLACES: kind, number of 16-bit words, words."""
    kind, body = LIST, places.astype("<u2")
    if len(places) > 4:
        breaks = np.flatnonzero(np.diff(places) != 1)
        if 2 * (len(breaks) + 1) < min(len(places), PLACES // 16):
            first, last = places[np.concatenate([[0], breaks + 1])], places[np.append(breaks, len(places) - 1)]
            kind, body = RUNS, np.stack([first, last], axis=1).astype("<u2").ravel()
        elif len(places) > PLACES // 16:
            bits = np.zeros(PLACES, bool)
            bits[places] = True
            kind, body = BITS, np.packbits(bits, bitorder="little").view("<u2")
    return struct.pack("<BI", kind, len(body)) + body.tobytes()


def bitmaps(blob: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(kind, words) of each bitmap, one after another."""
    at = 0
    while at < len(blob):
        kind, n = struct.unpack_from("<BI", blob, at)
        yield kind, np.frombuffer(blob, "<u2", n, at + 5)
        at += 5 + 2 * n


def places(kind: int, body: np.ndarray) -> np.ndarray:
    if kind == LIST:
        return body.astype(np.int64)
    if kind == RUNS:
        first, last = body[::2].astype(np.int64), body[1::2].astype(np.int64)
        return _stretches(first, last - first + 1)
    return np.flatnonzero(np.unpackbits(body.view(np.uint8), bitorder="little"))


def popcount(kind: int, body: np.ndarray) -> int:
    if kind == LIST:
        return len(body)
    if kind == RUNS:
        return int((body[1::2].astype(np.int64) - body[::2] + 1).sum())
    return int(np.bitwise_count(body).sum())


def merged(blobs: list[bytes]) -> bytes:
    """OR of postings plane by plane; their documents are different ones."""
    if len(blobs) == 1:
        return blobs[0]
    planes: list[np.ndarray] = []
    for blob in blobs:
        for j, (kind, body) in enumerate(bitmaps(blob)):
            if j == len(planes):
                planes.append(np.zeros(PLACES, bool))
            planes[j][places(kind, body)] = True
    return b"".join(bitmap(np.flatnonzero(p)) for p in planes)


def counts(blob: bytes) -> tuple[int, int]:
    """(documents, links) of a posting: the first plane, and the others by their digit's worth."""
    ones = [popcount(kind, body) for kind, body in bitmaps(blob)]
    return ones[0], ones[0] + sum(n << j for j, n in enumerate(ones[1:]))


def postings_of(pair: np.ndarray, slot: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(pair, container, planes) of links given by pair and document slot."""
    order = np.lexsort((slot, pair))
    pair, slot = pair[order], slot[order]
    new = np.ones(len(pair), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (slot[1:] != slot[:-1])
    at = np.flatnonzero(new)
    more = np.diff(np.append(at, len(pair))) - 1
    pair, slot = pair[at], slot[at]
    container = slot // PLACES
    here = (slot % PLACES).astype("<u2")
    new = np.ones(len(pair), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (container[1:] != container[:-1])
    cuts = np.flatnonzero(new)
    most = np.maximum.reduceat(more, cuts) if len(cuts) else cuts
    ends = np.append(cuts[1:], len(pair))
    head = struct.pack("<BI", LIST, 1)
    for p, c, i, j, m in zip(pair[cuts].tolist(), container[cuts].tolist(), cuts.tolist(), ends.tolist(), most.tolist()):
        own = here[i:j]
        blob = head + own.tobytes() if j == i + 1 else bitmap(own)
        for digit in range(m.bit_length()):
            blob += bitmap(own[(more[i:j] >> digit) & 1 == 1])
        yield p, c, blob


# ---------------------------------------------------------------- Spark


_DOCUMENT = "doc_id long, slot long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_ROW = f"{_DOCUMENT}, pair long, container long, planes binary"
_NAMES = [f.split()[0] for f in _ROW.split(", ")]
_TYPES = [pa.int64()] * 6 + [pa.string(), pa.int64(), pa.int64(), pa.binary()]


def encoded(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One narrow map: a row for each document (slot is not null) and one for each part of a posting (pair is not null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = TaskContext.get().partitionId() << 36  # a repeated task gives the same slots
        pairs, slots, held = [], [], 0

        def rows(columns: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(columns, _NAMES)

        def flushed() -> Iterator[pa.RecordBatch]:
            part = []
            for posting in postings_of(np.concatenate(pairs), np.concatenate(slots)):
                part.append(posting)
                if len(part) == 1 << 14:
                    yield posting_rows(part)
                    part = []
            if part:
                yield posting_rows(part)

        def posting_rows(part: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
            return rows([pa.nulls(len(part), t) for t in _TYPES[:7]] + [pa.array(c, t) for c, t in zip(zip(*part), _TYPES[7:])])

        for batch in words.slices(batches):
            found = align(batch.column("text"), a_path, b_path)
            n = batch.num_rows
            own = slot + np.arange(n)
            yield rows([batch.column("doc_id"), *map(pa.array, (own, found.n_a, found.n_b, found.n_groups, found.n_groups)), pa.array(found.digests, pa.string()), *(pa.nulls(n, t) for t in _TYPES[7:])])
            pairs.append(found.pair)
            slots.append(own[found.doc])
            slot, held = slot + n, held + len(found.pair)
            if held >= FLUSH:
                yield from flushed()
                pairs, slots, held = [], [], 0
        if held:
            yield from flushed()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _ROW)


def postings(rows: DataFrame) -> DataFrame:
    """pair, container, n_docs, n_links, planes: parts of a container OR-merged and popcounted."""
    parts = rows.filter("pair is not null").groupBy("pair", "container").agg(F.collect_list("planes").alias("parts"))  # a container's parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [merged(p) for p in batch.column("parts").to_pylist()]
            found = [counts(b) for b in blobs]
            yield pa.RecordBatch.from_arrays(
                [batch.column("pair"), batch.column("container"), pa.array([n for n, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64()), pa.array(blobs, pa.binary())],
                ["pair", "container", "n_docs", "n_links", "planes"],
            )

    return parts.mapInArrow(run, "pair long, container long, n_docs long, n_links long, planes binary")


def pair_counts(posts: DataFrame) -> DataFrame:
    """pair, a_id, b_id, n_docs, n_links, best (no pair of the B id has more links) of each pair."""
    counted = posts.groupBy("pair").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links"))
    named = counted.select("pair", F.shiftright("pair", 32).alias("a_id"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b_id"), "n_docs", "n_links")
    most = named.groupBy("b_id").agg(F.max("n_links").alias("most"))
    return named.join(most, "b_id").withColumn("best", F.col("n_links") == F.col("most")).drop("most")


def returned(posts: DataFrame, scores: DataFrame) -> DataFrame:
    """slot, n_best, count_sum: each pair's score at every document of its postings, summed by document."""
    salted = posts.withColumn("salt", F.pmod("container", F.lit(SALT)))
    wanted = salted.groupBy("pair", "salt").agg(F.lit(1).alias("one")).join(scores.select("pair", "n_links", "best"), "pair")
    asked = salted.select("pair", "salt", "container", "planes").join(wanted.select("pair", "salt", "n_links", "best"), ["pair", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best, total = None, np.zeros(PLACES, np.int64), np.zeros(PLACES, np.int64)

        def sums() -> pa.RecordBatch:
            some = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays([pa.array(some + now * PLACES), pa.array(best[some]), pa.array(total[some])], ["slot", "n_best", "count_sum"])

        for batch in batches:
            for container, planes, links, is_best in zip(*(batch.column(c).to_pylist() for c in ("container", "planes", "n_links", "best"))):
                if container != now:
                    if now is not None:
                        yield sums()
                        best[:], total[:] = 0, 0
                    now = container
                for j, (kind, body) in enumerate(bitmaps(planes)):
                    at, worth = places(kind, body), 1 << max(j - 1, 0)
                    total[at] += worth * links
                    if is_best:
                        best[at] += worth
        if now is not None:
            yield sums()

    return asked.drop("pair", "salt").repartition("container").sortWithinPartitions("container").mapInArrow(run, "slot long, n_best long, count_sum long")


def align_documents(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document."""
    rows = written(encoded(docs, a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")), "aligned")
    posts = written(postings(rows), "pair-postings")
    scored = returned(posts, pair_counts(posts))
    joined = rows.filter("slot is not null").join(scored, "slot", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
