"""Byte-level BPE encoding with the tiktoken library, and raw-byte decoding.

Long texts are split by a regular expression at safe boundaries: between a
character that is not white space and ASCII white space after it. No
alternative of the pre-splitting pattern matches across such a place, and what
matches on one side does not depend on the other, so the pieces' ids, one after
another, are the whole text's ids. A piece without such a place, like a long run of white space, is
more than the library's own matcher can take: the pattern's matches are then
found by the ``regex`` module, and the library encodes each by itself.

Edge cases: a null or empty text has no ids (an empty array, the SHA-256 of
nothing). Repeated ids and other columns pass through untouched; nothing is
shuffled, so one very long text or a hot source costs only its own length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from . import words

PIECE_CHARS = 1 << 15
#: Up to the last safe boundary in so many characters, or, if there is none, up to the next one.
_PIECE = regex.compile(r"(?s).{1,%d}(?<=\S)(?=[ \t\n\r\v\f]|\Z)|.+?(?<=\S)(?=[ \t\n\r\v\f]|\Z)|.+" % PIECE_CHARS)


@lru_cache(4)
def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(4)
def decimals(ranks_path: str, pattern: str) -> list[bytes]:
    return [str(i).encode() for i in range(encoding(ranks_path, pattern).max_token_value + 1)]


@lru_cache(4)
def matcher(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def pieces(text: str) -> list[str]:
    return [text] if len(text) <= PIECE_CHARS else _PIECE.findall(text)


def encode(text: str | None, coder: tiktoken.Encoding) -> list[int]:
    """Ids of the whole text, special tokens not recognised."""
    if not text:
        return []
    out: list[int] = []
    for piece in pieces(text):
        if len(piece) <= PIECE_CHARS:
            out += coder.encode_ordinary(piece)
        else:
            for match in matcher(coder._pat_str).finditer(piece):
                out += coder._encode_single_piece(match.group())
    return out


def decode(ids: list[int], coder: tiktoken.Encoding) -> bytes:
    """The bytes that the ids stand for; they need not be whole characters."""
    return coder.decode_bytes(ids)


def encode_documents(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns``, token_ids array<int>, n_tokens: each row's text encoded."""
    path, split = ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    kept = docs.select(*columns, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(path, split)
        for batch in words.slices(batches):
            ids = [encode(t, coder) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(ids, pa.list_(pa.int32())), pa.array(map(len, ids), pa.int64())], [*columns, "token_ids", "n_tokens"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != "text")
    return kept.mapInArrow(run, f"{fields}, token_ids array<int>, n_tokens long")


def round_trip(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: ids of each text and the bytes decoded from them."""
    path, split = ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, digits = encoding(path, split), decimals(path, split)
        for batch in words.slices(batches):
            counts, listed, decoded = [], [], []
            for text in batch.column("text").to_pylist():
                ids = encode(text, coder)
                counts.append(len(ids))
                listed.append(hashlib.sha256(b",".join([digits[i] for i in ids])).hexdigest())
                decoded.append(hashlib.sha256(decode(ids, coder)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(listed, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
