"""Token ids in a binary file format with random access: directly addressable codes.

An id is cut into 8-bit chunks, lowest first (Brisaboa, Ladra, Navarro 2013).
Level k holds the k-th chunks of the ids that have one, a bitmap tells which of
them continue at level k+1, and a rank directory (ones before each block of
``BLOCK`` bits) finds an id's place there. Any id, or any stretch of ids, is read without decoding others.

Files: a folder of uncompressed binary files, written by Spark's own commit (a
temporary name, then a rename) on any file system that Spark can write to, a file a partition and
SEGMENTS_A_FILE segments at most. A segment is :func:`segment_bytes` of consecutive documents in ascending
doc_id order, numbered (part, seq): their ids, where each ends, and the codes. A line feed follows each segment.

Encoding uses the tokenizers library. It is asked once for each distinct piece
of text: pieces end where no alternative of the byte-level split pattern can
cross (before white space after other characters; between a letter and ASCII
punctuation), so a document's ids are its pieces' ids one after another. Known pieces are found by a hash and compared
byte by byte. A text that holds the string of an added token goes to the library whole.

Edge cases: a null or empty text has the end id only. Null doc_ids come first;
repeated doc_ids are neighbours, ordered by a hash of the text. An empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from . import words
from .shared import new_path, written

END_ID = 2
BLOCK = 512
MAGIC = b"DAC1"
KNOWN_PIECES = 400_000  # a worker forgets its pieces beyond that; only time depends on it

_SPACE = words._SPACE
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


# ---------------------------------------------------------------- directly addressable codes


def dac_encode(ids: np.ndarray) -> bytes:
    """Chunk levels, continuation bitmaps and rank directories of an array of unsigned ids."""
    levels = []
    rest = ids.astype(np.uint64)
    while True:
        low, rest = (rest & np.uint64(255)).astype(np.uint8), rest >> np.uint64(8)
        more = rest > 0
        bits = np.packbits(more)
        ones = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
        rank = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.uint32) if len(ones) else np.zeros(0, np.uint32)
        levels.append((len(low), low.tobytes(), bits.tobytes(), rank.tobytes()))
        if not more.any():
            break
        rest = rest[more]
    head = MAGIC + struct.pack("<I", len(levels)) + b"".join(struct.pack("<Q", n) for n, *_ in levels)
    return head + b"".join(part for _, *parts in levels for part in parts)


class Dac:
    """A reader of :func:`dac_encode`'s bytes."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        (count,) = struct.unpack_from("<I", blob, 4)
        sizes = struct.unpack_from(f"<{count}Q", blob, 8)
        at, self.levels = 8 + 8 * count, []
        for n in sizes:
            low = np.frombuffer(blob, np.uint8, n, at)
            bits = np.frombuffer(blob, np.uint8, -(-n // 8), at + n)
            rank = np.frombuffer(blob, np.uint32, -(-n // BLOCK), at + n + len(bits))
            self.levels.append((low, bits, rank))
            at += n + len(bits) + 4 * len(rank)

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def _ones_before(self, level: int, i: int) -> int:
        """Continuation bits set before place ``i`` of a level: a directory entry and less than a block of bits."""
        _, bits, rank = self.levels[level]
        block = i // BLOCK
        if block == len(rank):
            block -= 1
        if block < 0:
            return 0
        return int(rank[block]) + int(np.unpackbits(bits[block * BLOCK // 8 : (i + 7) >> 3], count=i - block * BLOCK).sum())

    def read(self, start: int, end: int) -> np.ndarray:
        """The ids from ``start`` to ``end``: of each level, only the chunks and bits that they have."""
        out = np.zeros(end - start, np.uint32)
        place = np.arange(end - start)
        for k, (low, bits, _) in enumerate(self.levels):
            if start == end:
                break
            out[place] |= low[start:end].astype(np.uint32) << np.uint32(8 * k)
            more = np.unpackbits(bits[start >> 3 : (end + 7) >> 3], count=end - (start & ~7))[start & 7 :].astype(bool)
            place = place[more]
            start = self._ones_before(k, start) if len(place) else 0
            end = start + len(place)
        return out

    def __getitem__(self, i: int) -> int:
        return int(self.read(i, i + 1)[0])


# ---------------------------------------------------------------- encoding by distinct pieces


def piece_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Positions at which a piece starts: every document's start, and safe places of the split pattern."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64)
    cut = np.zeros(n, bool)
    space, wide = _SPACE[raw], raw >= 0x80
    # White space beyond ASCII ends in these bytes; before ASCII white space such a place isn't safe.
    odd = np.zeros(n, bool)
    odd[1:] = wide[1:] & (raw[:-1] == 0xC2)
    odd[2:] |= wide[2:] & (raw[:-2] >= 0xE1) & (raw[:-2] <= 0xE3) & (raw[1:-1] <= 0xA0)
    cut[1:] = space[1:] & ~space[:-1] & ~odd[:-1]
    letter = _LETTER[raw]
    letter[1:] |= wide[1:] & (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
    cut[1:] |= _PUNCT[raw[1:]] & letter[:-1]
    cut[offsets[:-1][offsets[:-1] < n]] = True
    return np.flatnonzero(cut)


def _stretches(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... start[0] + length[0] - 1, start[1], ..."""
    upto = np.cumsum(length, dtype=np.int64)
    out = np.repeat(start - (upto - length), length)
    out += np.arange(len(out))
    return out


class PieceEncoder:
    """Ids of texts through a table of known pieces, filled by the tokenizer."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at, self.size, self.start, self.length = (np.zeros(0, np.int32) for _ in range(4))
        self.ids, self.bytes = np.zeros(0, np.uint32), np.zeros(0, np.uint8)

    def learn(self, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, raw: np.ndarray) -> None:
        """Encode pieces not known yet and merge them into the table."""
        first, last = raw[starts], raw[ends - 1]
        joint = _SPACE[first] & ~_SPACE[last] & (last < 0x80)  # neighbours' ids don't change when such pieces are joined
        lone = np.flatnonzero(~joint)
        order, lists, sizes = [lone], [], []
        blob = raw.tobytes()
        if len(lone):
            found = self.tokenizer.encode_batch_fast([blob[starts[i] : ends[i]].decode() for i in lone], add_special_tokens=False)
            lists += [np.asarray(e.ids, np.uint32) for e in found]
            sizes.append(np.array([len(e.ids) for e in found], np.int64))
        together = np.flatnonzero(joint)
        for k in range(0, len(together), 2000):
            part = together[k : k + 2000]
            text = b"".join([blob[starts[i] : ends[i]] for i in part]).decode()
            ids = np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            ends_of_ids = np.cumsum(self.lengths()[ids])
            upto = np.searchsorted(ends_of_ids, np.cumsum(ends[part] - starts[part]), side="right")
            order.append(part)
            lists.append(ids)
            sizes.append(np.diff(upto, prepend=0))
        order, size = np.concatenate(order), np.concatenate(sizes)
        at = len(self.ids) + np.concatenate([[0], np.cumsum(size)[:-1]])
        self.ids = np.concatenate([self.ids, *lists])
        length = (ends - starts)[order]
        begin = len(self.bytes) + np.cumsum(length) - length
        self.bytes = np.concatenate([self.bytes, raw[_stretches(starts[order], length)]])
        old = (self.keys, self.at, self.size, self.start, self.length)
        joined = [np.concatenate([o, n.astype(o.dtype)]) for o, n in zip(old, (keys[order], at, size, begin, length))]
        by = np.argsort(joined[0], kind="stable")
        self.keys, self.at, self.size, self.start, self.length = (z[by] for z in joined)

    @lru_cache(1)  # noqa: B019  one encoder a worker
    def lengths(self) -> np.ndarray:
        """Bytes of each id: a character of a token's name stands for one byte."""
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        out = np.zeros(max(names.values()) + 1, np.int64)
        for name, i in names.items():
            out[i] = len(name)
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents, number of ids of each)."""
        ids, counts, same = self.by_pieces(column)
        whole = ~same
        for string in self.added:
            whole |= pc.fill_null(pc.match_substring(column, string), False).to_numpy(zero_copy_only=False)
        if not whole.any():
            return ids, counts
        lists = np.split(ids, np.cumsum(counts)[:-1])
        for i in np.flatnonzero(whole):
            lists[i] = np.asarray(self.tokenizer.encode(column[int(i)].as_py(), add_special_tokens=False).ids, np.uint32)
        return np.concatenate(lists), np.array([len(x) for x in lists], np.int64)

    def by_pieces(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all documents, number of ids of each, whether the bytes of all its pieces are those that the hashes stand for)."""
        raw, offsets = words.utf8(column)
        n = len(offsets) - 1
        starts = piece_starts(raw, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64), np.ones(n, bool)
        ends = np.append(starts[1:], len(raw))
        keys, one, which = np.unique(words.span_hashes(raw, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > KNOWN_PIECES:
            self.forget()
        place = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = place < len(self.keys)
        new[inside] = self.keys[place[inside]] != keys[inside]
        if new.any():
            self.learn(keys[new], starts[one[new]], ends[one[new]], raw)
            place = np.searchsorted(self.keys, keys)
        known = place[which]
        first = np.searchsorted(starts, offsets)
        length = ends - starts
        odd = self.length[known] != length
        if not odd.any():  # pieces tile the text, so known bytes in their order are the text
            differ = np.flatnonzero(self.bytes[_stretches(self.start[known], length)] != raw)
            odd[np.searchsorted(starts, differ, side="right") - 1] = True
        odd_before = np.concatenate([[0], np.cumsum(odd)])[first]
        at, size = self.at[known], self.size[known]
        ids = self.ids[_stretches(at, size)]
        before = np.concatenate([[0], np.cumsum(size)])[first]
        return ids, np.diff(before), np.diff(odd_before) == 0


@lru_cache(2)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` after each document's, and where each document ends."""
    ends = np.cumsum(counts + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, end_id, np.uint32)
    own = np.ones(len(out), bool)
    own[ends - 1] = False
    out[own] = ids
    return out, ends


# ---------------------------------------------------------------- files

SEGMENTS_A_FILE = 4  # of about words.SLICE_BYTES of text each, so a file is small enough to be read as one value
_HEAD = struct.Struct("<4sIIQQ")  # name, part, seq, documents, bytes of the codes
_NULL_ID = -(1 << 63)


def segment_bytes(part: int, seq: int, doc_ids: np.ndarray, ends: np.ndarray, codes: bytes) -> bytes:
    return _HEAD.pack(b"DOCS", part, seq, len(doc_ids), len(codes)) + doc_ids.astype("<i8").tobytes() + ends.astype("<u8").tobytes() + codes


def read_segments(blob: bytes) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, Dac]]:
    """(part, seq, doc_ids, ends, codes) of each segment of a file."""
    at = 0
    while at < len(blob):
        name, part, seq, n, size = _HEAD.unpack_from(blob, at)
        if name != b"DOCS":
            raise ValueError("not a file of segments")
        at += _HEAD.size
        doc_ids, ends = np.frombuffer(blob, "<i8", n, at), np.frombuffer(blob, "<u8", n, at + 8 * n).astype(np.int64)
        at += 16 * n
        yield part, seq, doc_ids, ends, Dac(blob[at : at + size])
        at += size + 1


def write_files(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = END_ID) -> str:
    """Encode all texts in ascending doc_id order into files in the shared folder; returns their folder."""
    path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = encoder(path), TaskContext.get().partitionId()
        for seq, batch in enumerate(words.slices(batches)):
            ids, ends = with_end(*coder.encode(batch.column("text")), end_id)
            doc_ids = pc.fill_null(batch.column("doc_id"), _NULL_ID).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([segment_bytes(part, seq, doc_ids, ends, dac_encode(ids))], pa.binary())], ["segment"])

    order = [F.col("doc_id").asc_nulls_first(), F.col("h")]
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h")).repartitionByRange(*order).sortWithinPartitions(*order)
    folder = new_path(docs.sparkSession, "segments")
    # A string's bytes are written as they are, so the text writer is a writer of raw bytes.
    segments = ordered.select("doc_id", "text").mapInArrow(run, "segment binary").select(F.col("segment").cast("string"))
    segments.write.option("maxRecordsPerFile", SEGMENTS_A_FILE).text(folder)
    return folder


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, its ids read from the files by random access."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("content"):
                for part, seq, doc_ids, ends, codes in read_segments(blob.as_buffer().to_pybytes()):
                    starts = np.concatenate([[0], ends[:-1]])
                    crc = [zlib.crc32(codes.read(a, b).astype("<u4").tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
                    n = len(ends)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, seq, np.int32)), pa.array(doc_ids, mask=doc_ids == _NULL_ID), pa.array(starts), pa.array(ends - starts), pa.array(crc, pa.int64())],
                        ["part", "seq", "doc_id", "local", "n_tokens", "ids_crc32"],
                    )

    files = spark.read.format("binaryFile").load(folder).filter("length > 0").select("content")
    found = written(files.mapInArrow(run, "part int, seq int, doc_id long, local long, n_tokens long, ids_crc32 long"), "documents-read")
    # Counts of a part's segments, then of the parts before: one row a part in the last window.
    segments = found.groupBy("part", "seq").agg(F.sum("n_tokens").alias("n_ids"))
    by_part = segments.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    before = by_part.select("part", (F.sum("n_ids").over(Window.orderBy("part")) - F.col("n_ids")).alias("parts_before"))
    seqs = segments.select("part", "seq", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")).alias("seqs_before"))
    bases = seqs.join(before, "part").select("part", "seq", (F.col("parts_before") + F.col("seqs_before")).alias("base"))
    return found.join(bases, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
