"""Accumulator-limited search against scoring every document."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataforge.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, queries, k):
    """(item_id, rank, doc_id, score) of each query, every document scored."""
    held = [(i, Counter(t)) for i, t in ((i, terms(t)) for i, t in docs) if t]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = defaultdict(set)
    for item, text in queries:
        asked[item] |= set(terms(text))
    out = []
    for item, wanted in asked.items():
        found = []
        for i, c in held:
            m = 50 + 50 * sum(c.values()) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in wanted if c[t])
            if score > 0 and i is not None:
                found.append((-score, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


ODD = [(1, None), (2, ""), (3, "É é é Straße STRASSE x1 X1"), (4, "a,b;c'd a b"), (None, "a b c unique"), (5, "a"), (5, "a a a"), (6, "a " * 30000 + "rare"), (7, "日本語 テキスト a"), (8, "a b"), (9, "a b")]


def _rows(seed, n):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    return [(i, " ".join(r.choices(vocabulary, weights, k=r.randint(1, 40)))) for i in range(n)]


def test_every_case(spark):
    docs = ODD + _rows(1, 400)
    queries = [(10, "a rare b"), (11, None), (12, "nothing here"), (None, "x1"), (None, "straße"), (13, "W1 w2 w3 w40 w55 w1"), (14, "é"), (13, "w7")]
    schema = "doc_id long, text string, term string, n int, score int, task int"
    frame = spark.createDataFrame([(*d, "t", 1, 2, 3) for d in docs], schema).repartition(5)
    asked = spark.createDataFrame([(*q, "x") for q in queries], "item_id long, text string, term string")
    for k in (1, 5, 50):
        got = sorted((tuple(r) for r in lexical_search.search(frame, asked, k).select("item_id", "rank", "doc_id", "score").collect()), key=str)
        assert got == brute(docs, queries, k)
    assert lexical_search.search(frame.limit(0), asked).count() == 0
    assert lexical_search.search(frame, asked.limit(0)).count() == 0
    assert lexical_search.search(frame.filter("text is null or text = ''"), asked).count() == 0


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_blocks_of_queries(spark, monkeypatch, block):
    monkeypatch.setattr(lexical_search, "PAIRS_A_BLOCK", block)
    docs, queries = _rows(2, 60), [(i, f"w{i} w{2 * i} w{3 * i}") for i in range(6)]
    got = lexical_search.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "item_id long, text string"), 4)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, queries, 4)


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 8), st.sampled_from([3, 17, 200]))
def test_chunks(seed, k, chunk):
    """Whatever the chunks are, the k best are the same, though later chunks create fewer accumulators."""
    docs, queries = _rows(seed, 150), [(1, "w0 w1 w2 w50 w59"), (2, "w3 w0")]
    sizes, offsets, hashed, tf = lexical_search.counted(pa.array([t for _, t in docs]))
    df = Counter(hashed.tolist())
    _, at, asked, _ = lexical_search.counted(pa.array([t for _, t in queries]))
    rows = [(queries[q][0], np.uint64(t).view(np.int64).item(), df[t]) for q in range(2) for t in asked[at[q] : at[q + 1]].tolist() if df[t]]
    pairs = pa.table({c: [r[i] for r in rows] for i, c in enumerate(("item_id", "term", "df"))}) if rows else None
    if pairs is None:
        return
    search = lexical_search.TermAtATime(lexical_search.Block.of(pairs, len(docs), int(sizes.sum())), k)
    for a in range(0, len(docs), chunk):
        z = min(a + chunk, len(docs))
        own = slice(offsets[a], offsets[z])
        search.add(np.arange(a, z), sizes[a:z], np.repeat(np.arange(z - a), np.diff(offsets[a : z + 1])), hashed[own], tf[own])
    got = [(item, rank, i, s) for item, scores, ids in search.results() for rank, (s, i) in enumerate(zip(scores.tolist(), ids.tolist()), 1)]
    assert sorted(got, key=str) == brute(docs, queries, k)


def test_accumulators_are_limited():
    """A rare term's documents outscore what a common one can add, so the common one creates nothing."""
    docs = [(i, "common " + ("rare rare" if i < 5 else "filler")) for i in range(1000)]
    sizes, offsets, hashed, tf = lexical_search.counted(pa.array([t for _, t in docs]))
    df = Counter(hashed.tolist())
    _, _, asked, _ = lexical_search.counted(pa.array(["common rare"]))
    pairs = pa.table({"item_id": [1, 1], "term": asked.view(np.int64), "df": [df[t] for t in asked.tolist()]})
    search = lexical_search.TermAtATime(lexical_search.Block.of(pairs, len(docs), int(sizes.sum())), 3)
    search.add(np.arange(1000), sizes, np.repeat(np.arange(1000), np.diff(offsets)), hashed, tf)
    assert (search.created, search.updated) == (5, 5)


def test_scale_beyond_64_bits():
    search = lexical_search.TermAtATime(lexical_search.Block([], np.zeros(0, np.uint64), np.zeros(1, int), np.zeros(0, int), np.zeros(0, int), 10**12, 10**15), 3)
    assert search.scale(np.array([10**9, 1])).tolist() == [50 + 50 * 10**9 * 10**12 // 10**15, 50]
