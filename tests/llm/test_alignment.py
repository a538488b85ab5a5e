"""Pair bitmaps against token lists of the libraries."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strataforge.llm import alignment

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "a", "a▁b", "▁", "<|endoftext|> x<s></s><unk><0x41>", "é" * 300, "two  spaces \n\n and\tmore  ", "hello world " * 40, "日本語 𝒳 ñandú", "\x00 nul \x00", "x" * 3000, "word " * 9, "end space "]


def brute(docs):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, sha) of each document, and (documents, links) of each pair."""
    a, b = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(x): x for x in printable} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in printable)}
    names = {i: t for t, i in a.get_vocab().items()}
    held = []
    for i, text in docs:
        links, groups, n = [], [], (0, 0)
        if text:
            ids_a = a.encode(" " + text, add_special_tokens=False).ids
            ids_b = b.encode(text)
            bytes_a = [bytes(byte_of[c] for c in names[x]) for x in ids_a]
            bytes_b = [bytes([int(b.id_to_piece(x)[3:5], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode() for x in ids_b]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                n = len(ids_a), len(ids_b)
                ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
                left_a = left_b = 0
                for end in sorted({*ends_a} & {*ends_b}):
                    ia, ib = ends_a.index(end), ends_b.index(end)
                    links.append((ids_a[ia], ids_b[ib]))
                    groups.append(",".join(map(str, ids_a[left_a : ia + 1])) + "|" + ",".join(map(str, ids_b[left_b : ib + 1])))
                    left_a, left_b = ia + 1, ib + 1
        held.append((i, *n, links, groups))
    count = Counter(p for *_, links, _ in held for p in links)
    most = Counter()
    for (_, y), c in count.items():
        most[y] = max(most[y], c)
    rows = [(i, x, y, len(g), len(ls), sum(count[p] == most[p[1]] for p in ls), sum(count[p] for p in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, x, y, ls, g in held]
    in_docs = Counter(p for *_, links, _ in held for p in set(links))
    return rows, {p: (in_docs[p], c) for p, c in count.items()}


def test_against_the_libraries(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(60).collect()]
    docs = [*enumerate(ODD), (None, "hello world"), (3, "again"), (3, "again"), *enumerate(texts, 100)]
    frame = spark.createDataFrame([(*d, 1, "p", 2) for d in docs], "doc_id long, text string, slot int, pair string, container int")
    wanted, pairs = brute(docs)
    for parts in (1, 4):
        got = alignment.align_documents(frame.repartition(parts))
        assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert Counter(tuple(r) for r in got.collect()) == Counter(wanted)
    counted = alignment.pair_counts(alignment.postings(alignment.encoded(frame, A_PATH, B_PATH))).collect()
    assert {(r["a_id"], r["b_id"]): (r["n_docs"], r["n_links"]) for r in counted} == pairs
    assert alignment.align_documents(frame.limit(0)).count() == 0
    assert alignment.align_documents(frame.filter("text is null")).collect()[0]["groups_sha256"] == ""


def test_long_texts_in_parts():
    coder = alignment.Pieces(B_PATH)
    for text in ("ab  cd e   " * 90, " " * 500, "x" * 700, "w " * 300, "a▁ b " * 100, " lead and trail  "):
        parts = alignment.cut(text, 50)
        assert " ".join(parts) == text
        ids, _ = coder.encode([text])
        assert [i for p in parts for i in coder.processor.encode(p)] == ids.tolist()


@settings(max_examples=60, deadline=None)
@given(st.sets(st.one_of(st.integers(0, 65535), st.integers(0, 300)), max_size=400), st.booleans())
def test_bitmaps(some, dense):
    at = np.array(sorted(some | (set(range(1000, 9000, 1 if len(some) % 2 else 2)) if dense else set())), np.int64)
    ((kind, body),) = alignment.bitmaps(alignment.bitmap(at))
    assert alignment.places(kind, body).tolist() == at.tolist() and alignment.popcount(kind, body) == len(at)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(0, 5) | st.integers(65534, 65538)), max_size=80), st.integers(0, 80))
def test_parts_of_postings(links, at):
    """Postings of two parts, no document in both, are those of all links."""
    links = sorted(links, key=lambda x: x[1])
    while 0 < at < len(links) and links[at][1] == links[at - 1][1]:
        at += 1
    parts = {}
    for part in (links[:at], links[at:]):
        pair, slot = (np.array([x[i] for x in part], np.int64) for i in range(2))
        for p, c, blob in alignment.postings_of(pair, slot) if part else ():
            parts.setdefault((p, c), []).append(blob)
    for (p, c), blobs in parts.items():
        own = [s for q, s in links if q == p and s // 65536 == c]
        blob = alignment.merged(blobs)
        assert alignment.counts(blob) == (len(set(own)), len(own))
        total = Counter()
        for j, (kind, body) in enumerate(alignment.bitmaps(blob)):
            for s in alignment.places(kind, body).tolist():
                total[s] += 1 << max(j - 1, 0)
        assert total == Counter(s % 65536 for s in own)
    assert {*parts} == {(p, s // 65536) for p, s in links}


def test_byte_tables_reject_other_texts():
    table = alignment.Bytes.of([b"a", b"bc", b"", b"\xff"])
    raw = np.frombuffer(b"abcbca", np.uint8)
    ids, offsets = np.array([0, 1, 1, 0]), np.array([0, 3, 5, 6])
    assert table.same(ids, np.array([2, 1, 1]), raw, offsets).tolist() == [True, True, True]
    assert table.same(np.array([0, 1, 0, 0, 2, 0]), np.array([2, 2, 2]), raw, offsets).tolist() == [True, False, False]
    found = alignment.align(pa.array([None, "", "▁"], pa.string()), A_PATH, B_PATH)
    assert not found.n_a.any() and not len(found.doc) and found.digests == ["", "", ""]
