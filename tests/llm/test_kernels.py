"""Kernels against brute force, without Spark."""

import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataforge.llm import byte_bpe, fingerprints, language_id, near_dup, passages, permutation_index, suffix_dedup, token_output, words

ODD = [None, "", "a", " a ", "\n\n x   y　 z  ", "don't we'll 's  ’s “quoted” text…  ", "<|endoftext|> hi<|endoftext|>", "x  y  \n z", "naïve café, élan. × ÷ 3,4 l'été", "a" * 5000, "\t\t", "ab\x1c cd\x85 ef", "𝒳 y, ñandú! été?"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_suffix_array(s):
    assert suffix_dedup.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_words_and_shingles():
    texts = [None, "", "a b  c\n", "é x é x é x", "a b c d e f", "c"]
    raw, offsets = words.utf8(pa.array(texts))
    starts, ends, first = words.spans(raw, offsets)
    blob = raw.tobytes()
    assert [blob[a:b].decode() for a, b in zip(starts, ends)] == [w for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    hashed, first = words.hashes(pa.array(texts))
    shingle, at = words.shingles(hashed, first)
    assert np.diff(at).tolist() == [0, 0, 1, 2, 2, 1] and hashed[2] == hashed[-1]


def test_fingerprint_estimates():
    r = random.Random(1)
    vocabulary = [f"w{i}" for i in range(5000)]
    base = r.choices(vocabulary, k=800)
    for edit in (0, 40, 160):
        other = list(base)
        for i in range(edit):
            other[i] = r.choice(vocabulary)
        a, b = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (base, other))
        low, some = fingerprints.signatures(pa.array([" ".join(base), " ".join(other)]))
        got = fingerprints.likeness(low[:1], some[:1], low[1:], some[1:])[0]
        assert abs(got - len(a & b) / len(a | b)) < 0.08
    low, some = fingerprints.signatures(pa.array(["", None, "one", "one"]))
    assert some.tolist() == [False, False, True, True] and (low[2] == low[3]).all()


def test_bag_min_hash_is_unbiased():
    r = np.random.default_rng(3)
    got, true = [], []
    for _ in range(40):
        w = r.integers(0, 9, (2, 60))
        sets = [(np.flatnonzero(x).astype(np.uint64) + np.uint64(r.integers(1 << 40)) * np.uint64(0), x[x > 0]) for x in w]
        salt = np.uint64(r.integers(1 << 62))
        shingle = np.concatenate([words.mix(s + salt) for s, _ in sets])
        weight = np.concatenate([x for _, x in sets])
        times = near_dup.signatures(shingle, weight, np.array([0, len(sets[0][0]), len(shingle)]))
        got.append((times[0] == times[1]).mean())
        true.append(np.minimum(*w).sum() / np.maximum(*w).sum())
    assert abs(np.mean(got) - np.mean(true)) < 0.02


def test_chains_and_alignment():
    r = random.Random(5)
    a = [r.randrange(10**6) for _ in range(300)]
    b = [r.randrange(10**6) for _ in range(40)] + a[50:200] + [r.randrange(10**6) for _ in range(40)]
    for i in range(45, 185, 25):
        b[i] = -i
    del b[100]

    def lcs(x, y):
        row = [0] * (len(y) + 1)
        for v in x:
            before = 0
            for j, w in enumerate(y, 1):
                before, row[j] = row[j], before + 1 if v == w else max(row[j], row[j - 1])
        return row[-1]

    assert passages.common(a, b) == lcs(a, b)
    text = pa.array([" ".join(map(str, a)), " ".join(map(str, b))])
    key, doc, place, again = passages.minimizers(*words.hashes(text))
    mine = {k: p for k, d, p in zip(key, doc, place) if d == 0}
    pairs = [(mine[k], p) for k, d, p in zip(key, doc, place) if d == 1 and k in mine]
    parts = passages.fragments(np.array([p for p, _ in pairs]), np.array([p for _, p in pairs]))
    best = parts[passages.chains(parts)[0]][:, :4].tolist()
    codes = [np.array(x, np.int64) for x in (a, b)]
    (found,) = passages.align(best, codes[0], codes[1], 0, 0)
    assert found[0] <= 52 and found[1] >= 195 and found[4] >= 0.9


def test_dac_random_access():
    ids = np.array([0, 255, 256, 70000, 2**31, 5] * 300, np.uint32)
    codes = token_output.Dac(token_output.dac_encode(ids))
    assert (codes.read(0, len(ids)) == ids).all() and all(codes[i] == ids[i] for i in range(len(ids)))
    r = random.Random(3)
    for _ in range(300):
        a = r.randrange(len(ids) + 1)
        b = r.randrange(a, len(ids) + 1)
        assert (codes.read(a, b) == ids[a:b]).all()
    assert len(token_output.Dac(token_output.dac_encode(np.zeros(0, np.uint32)))) == 0
    with pytest.raises(ValueError):
        token_output.Dac(b"????")


def test_pieces_encode_like_whole_texts():
    coder = token_output.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for _ in range(2):  # unknown, then known pieces
        ids, counts = coder.encode(pa.array(ODD, pa.string()))
        whole = coder.tokenizer.encode_batch([t or "" for t in ODD], add_special_tokens=False)
        assert counts.tolist() == [len(e.ids) for e in whole] and ids.tolist() == [i for e in whole for i in e.ids]
    assert coder.encode(pa.array(["hello <|endoftext|> world"]))[1].tolist() == [4]


def test_pieces_with_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(words, "span_hashes", lambda raw, starts, ends: raw[starts].astype(np.uint64))  # the first byte alone
    coder = token_output.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["ab, cd", "ax, cd", "b", "ab, cd ef cd"]
    for _ in range(2):
        ids, counts = coder.encode(pa.array(texts))
        whole = coder.tokenizer.encode_batch(texts, add_special_tokens=False)
        assert counts.tolist() == [len(e.ids) for e in whole] and ids.tolist() == [i for e in whole for i in e.ids]


def test_long_texts_split_safely():
    coder = byte_bpe.encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    r = random.Random(2)
    text = "".join(r.choice(["word", "l'été", " ", "  ", "\n", "…", "　", " ", "12", "?!"]) for _ in range(60000))
    for t in (text, "x" * 70000, " " * 70000, "\xa0 " * 40000, "a" + "\n" * 70000 + "b"):
        parts = byte_bpe.pieces(t)
        assert "".join(parts) == t
        assert byte_bpe.encode(t, coder) == coder.encode_ordinary(t)
    for t in (" " * 3_000_000, "\n" * 3_000_000 + "a", "a" * 3_000_000, "x" + "\u3000" * 1_000_000):  # more than the library's matcher can take
        by_match = [i for m in re.finditer(r"\s+(?!\S)|\s+|\S+", t) for i in coder._encode_single_piece(m.group())]
        assert byte_bpe.encode(t, coder) == by_match
    assert byte_bpe.decode(byte_bpe.encode(text, coder), coder) == text.encode() and byte_bpe.encode(None, coder) == []


def test_network_gradients():
    r = np.random.default_rng(1)
    net = language_id.Network.fresh(["a", "b"])
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    x = r.integers(1, 255, (3, language_id.WINDOW + 3)).astype(np.uint8)
    y = np.array([0, 1, 0])
    _, g = net.gradients(x, y)
    for name in ("dense", "w3", "embedding", "b"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        e, old = 1e-5, net.weights[name][at]
        net.weights[name][at] = old + e
        up, _ = net.gradients(x, y)
        net.weights[name][at] = old - e
        down, _ = net.gradients(x, y)
        net.weights[name][at] = old
        assert abs((up - down) / (2 * e) - g[name][at]) < 1e-4 + 0.02 * abs(g[name][at])


def test_tables_agree_with_filters():
    net = language_id.Network.fresh(["a", "b", "c"])
    x = np.random.default_rng(2).integers(0, 255, (20, language_id.WINDOW + 3)).astype(np.uint8)
    x[:, language_id.WINDOW :] = 0
    p, pooled = net.weights, []
    for w in language_id.WIDTHS:
        views = np.stack([p["embedding"][x[:, j : j + language_id.WINDOW]] for j in range(w)], axis=2).reshape(20, language_id.WINDOW, -1)
        pooled.append((views @ p[f"w{w}"]).max(axis=1))
    slow = language_id.softmax(np.maximum(np.concatenate(pooled, axis=1) + p["b"], 0) @ p["dense"] + p["bias"])
    assert np.allclose(language_id.Predictor(net).probabilities(x), slow, atol=1e-5)


def test_footrule_order():
    r = np.random.default_rng(4)
    pivots, x = r.normal(size=(96, 8)), r.normal(size=(50, 8))
    lists = permutation_index.nearest_pivots(x, pivots)
    size = permutation_index.LIST
    assert lists.shape == (50, size)

    def rule(a, b):
        place = [{p: k for k, p in enumerate(z)} for z in (a.tolist(), b.tolist())]
        return sum(abs(place[0].get(p, size) - place[1].get(p, size)) for p in range(96))

    near = permutation_index.footrule(lists, lists[0], 96)
    whole = rule(lists[0], np.array([], int))
    assert all(rule(lists[0], lists[k]) == 2 * (whole - near[k]) for k in range(50))
    assert permutation_index.nearest_pivots(x, pivots[:5]).shape == (50, 5)


def test_windows_of_a_split_context():
    r = random.Random(6)
    context = bytes([100]) + bytes(r.choices(range(256), k=100 + 120))
    free = suffix_dedup.LENGTH - suffix_dedup.GRAM

    def windows(c):
        n = c[0]
        return [(c[1 + w : 1 + n], c[1 + n : 1 + n + free - (n - w)]) for w in range(len(c) - free)]

    for size in (69, 35, 1):
        found = {}
        for common, part, at in suffix_dedup.parts_of(context, size):
            for k, w in enumerate(windows(part)):
                found[at + k] = w
        assert [found[k] for k in sorted(found)] == windows(context) and sorted(found) == list(range(len(context) - free))


def test_facing_contexts_keep_all_shared_windows():
    r = random.Random(8)
    texts = [bytes(r.choices(b"ab", k=272)) for _ in range(3)]
    contexts = []
    for t in texts * 6:
        left, right = r.randint(0, 136), r.randint(0, 136)
        if left + right < 136:
            continue
        edited = bytearray(t[136 - left : 136 + right])
        for _ in range(r.choice((0, 0, 1, 3))):
            edited[r.randrange(len(edited))] = 99
        contexts.append((bytes([left]) + bytes(edited), r.random() < 0.2))
    whole = suffix_dedup.repeated_windows([(0, c) for c, _ in contexts])
    facing = suffix_dedup.facing(contexts)
    cut = [np.zeros(len(h), bool) for h in whole]
    for (k, c, at), hit in zip(facing, suffix_dedup.repeated_windows([(0, c) for _, c, _ in facing])):
        cut[k][at : at + len(hit)] = hit
    assert any(h.any() for (_, known), h in zip(contexts, whole) if not known)
    assert all((h == c).all() for (_, known), h, c in zip(contexts, whole, cut) if not known)


def test_ends_reach_over_small_edits():
    a = np.arange(100)
    b = np.concatenate([a[:20], [900], a[21:40], a[41:60], [901], a[60:]])
    assert passages.reach(a, b) == (100, 100) and passages.reach(a, a[50:]) == (0, 0)
