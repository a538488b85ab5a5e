"""Operators on small tables: brute force, odd rows, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from strataforge.llm import byte_bpe, components, fingerprints, language_id, mixing, near_dup, passages, permutation_index, queries, suffix_dedup, token_output, url_filters

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, node string, key string, row int"


def _text(seed, n=120):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(n))


def _odd_rows():
    a = _text(1, 300)
    near = a.split()
    near[7] = "edited"
    passage = " ".join(_text(2, 90).split()[10:75])
    texts = [a, a, " ".join(near), None, "", "   ", "one", "é" * 300, _text(3) + " " + passage + " " + _text(4), _text(5) + " " + passage, _text(6, 4000), "12 34 !!", "x " * 400, "hello <|endoftext|> world<|endoftext|>x", "\n" * 50000 + "a"]
    ids = [*range(len(texts))]
    rows = [(i, t, ["en", None, "fr"][i % 3], [None, "s1", "s2"][i % 3], len(t) if t else None, i, "n", "k", i) for i, t in zip(ids, texts)]
    return [*rows, rows[0], (8, "same id, other text", None, "s1", 3, 1, "n", "k", 1), (None, a, "en", "s1", 4, 1, "n", "k", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _texts():
    return [(r[0], r[1] or "") for r in _odd_rows()]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (5, 5), (None, 3)], "a long, b long")
    got = {r[0]: r[1] for r in components.connected_components(edges, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert components.connected_components(edges.limit(0), "a", "b").count() == 0


def test_passages(spark, docs, empty):
    found = [r.asDict() for r in passages.passages(docs).collect()]
    assert {(r["doc_id"], r["source_id"]) for r in found} >= {(1, 0), (2, 0), (9, 8)}
    (shared,) = [r for r in found if (r["doc_id"], r["source_id"]) == (9, 8)]
    assert 63 <= shared["end"] - shared["start"] <= 67 and shared["similarity"] >= 0.95
    assert passages.passages(empty).count() == 0
    kept = passages.without_passages(docs)
    assert kept.columns == docs.columns
    left = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert 1 not in left and left[3] is None and len(left[9].split()) == 120 and left[10] == _text(6, 4000)
    assert passages.without_passages(empty).count() == 0


def test_mixing(spark, docs, empty):
    rows = [r.asDict() for r in mixing.mix(docs).collect()]
    assert len(rows) == len(_odd_rows()) and mixing.mix(empty).count() == 0
    size = Counter()
    for r, (_, t) in zip(sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"], r["size"])), sorted(_texts(), key=lambda x: (x[0] is None, x[0], len(re.findall(r"[^\x20\x09-\x0D]+", x[1]))))):
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", t)) and 0 <= r["taken"] <= 2 * r["size"] and r["target"] <= 2 * r["source_size"]
        size[r["source_size"], r["target"]] += r["taken"]
    total = sum(len(re.findall(r"[^\x20\x09-\x0D]+", t)) for _, t in _texts())
    assert abs(sum(t for _, t in size) - 1.5 * total) < 1e-6
    again = [r.asDict() for r in mixing.mix(docs.repartition(5)).collect()]
    key = lambda r: str(sorted(r.items(), key=str))
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert mixing.mixed(docs).columns == docs.columns


def test_mixing_comes_near_targets(spark):
    rows = [(i, " ".join(["w"] * (1 + i * i % 90)), f"s{min(i % 7, 3)}") for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).withColumn("s", F.col("source_size"))
    for r in got.groupBy("s", "target").agg(F.sum("taken").alias("t")).collect():
        assert abs(r["t"] - r["target"]) <= 90


def test_fingerprints(spark, docs, empty):
    got = [r.asDict() for r in fingerprints.fingerprint_with_edits(docs).collect()]
    order = sorted(_odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    texts = [r[1] or "" for r in order]
    wanted = Counter()
    for i, t in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        quarter = len(t) // 4
        wanted[order[i][0], len(t), hashlib.sha256((t[: len(t) - quarter] + after[:quarter]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == wanted
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert fingerprints.fingerprint_with_edits(empty).count() == 0
    assert fingerprints.fingerprint(docs).count() == len(order)


def test_suffix_dedup(spark, docs, empty):
    texts = [t.encode() for _, t in _texts()]
    seen = Counter(b[i : i + 200] for b in texts for i in range(len(b) - 199))
    wanted = Counter()
    for (d, _), b in zip(_texts(), texts):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
        wanted[d, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()] += 1
    assert Counter(tuple(r) for r in suffix_dedup.dedup(docs).collect()) == wanted
    assert suffix_dedup.dedup(empty).count() == 0


def test_url_filters(spark):
    page = lambda i, url, html="": (i, url, html, "clash")
    rows = [
        page(1, "http://a.com/en/1"),
        page(2, "https://example.com/en/7x"),
        page(3, "http://x.org/fr/1#top", '<link rel="canonical" href="http://y.com/en/2">'),
        page(4, "http://z.org/fr/2", '<META http-equiv="refresh" content="0; url=/fr/3">'),
        page(5, "http://z.org/fr/3", '<link href="http://x.org/fr/1" rel=canonical>'),
        page(6, "http://q.org/fr/4", '<link rel="canonical" href="http://b.net/de/1">'),
        page(7, "http://q.org/fr/5", '<link rel="canonical" href="http://q.org/fr/4"><meta http-equiv="refresh" content="0;url=http://c.com/en/1">'),
        page(8, None),
        page(9, "no scheme"),
        page(10, "HTTP://EXAMPLE.NET/de/8?x"),
        page(1, "http://a.com/en/1"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    rules = spark.createDataFrame(url_filters.RULES, "action string, host string, path string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.judge(pages, rules).collect()}
    assert got[1] == ("a.com", "/en/1", "com/en/", "block") and got[2][2:] == ("example.com/en/7", "allow")
    assert got[3][2:] == (None, "block") and got[4][3] == "block" and got[5][3] == "block"
    assert got[6][3] == "allow" and got[7][3] == "allow"
    assert got[8] == ("", "", None, "allow") and got[9] == ("", "", None, "allow")
    assert got[10] == ("example.net", "/de/8", "example.net/de/8", "block")
    assert url_filters.judge(pages, rules).count() == len(rows) and url_filters.judge(pages.limit(0), rules).count() == 0


def test_language_id(spark, docs, empty):
    from conftest import DATA

    table = spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/documents.parquet")
    got = language_id.identify(table).join(table.select("doc_id", "lang"), "doc_id").filter("held_out")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.93
    odd = {(r["doc_id"], r["lang_pred"] == "und") for r in language_id.identify(docs).collect()}
    assert {(3, True), (4, True), (11, True), (0, False)} <= odd
    assert language_id.identify(empty).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_byte_bpe(spark, docs, empty):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        import base64

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    wanted = Counter()
    for d, t in _texts():
        ids = coder.encode_ordinary(t)
        wanted[d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in byte_bpe.round_trip(docs).collect()) == wanted
    assert byte_bpe.round_trip(empty).count() == 0 and byte_bpe.encode_documents(docs).count() == len(_texts())


def test_nearest_neighbours(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 24)) * r.uniform(0.5, 2, (3000, 1))
    x[7] = x[9] = x[40]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(5000, None, 0), (5020, [0.0] * 24, 0), (5040, [float("nan")] * 24, 0), (5060, [None] * 24, 0), *((5080 + 20 * i, [1.0], 0) for i in range(300))]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = permutation_index.search(vectors, vectors.filter("vec_id % 20 = 0")).collect()
    hit = total = 0
    for q in range(0, 3000, 20):
        s = (x * x[q]).sum(axis=1)
        best = [i for i in np.lexsort((np.arange(3000), -s)) if i != q][:20]
        own = sorted((g for g in got if g["query_id"] == q), key=lambda g: g["rank"])
        assert [g["rank"] for g in own] == list(range(1, 21)) and all(abs(g["score"] - s[g["vec_id"]]) < 1e-9 for g in own)
        hit, total = hit + len({g["vec_id"] for g in own} & set(best)), total + 20
    assert hit / total >= 0.9 and {g["query_id"] for g in got} == set(range(0, 3000, 20))
    few = vectors.filter("vec_id < 3 or vec_id = 20")
    assert permutation_index.search(few, few.filter("vec_id % 20 = 0")).count() == 6
    assert permutation_index.search(few.limit(0), few.limit(0)).count() == 0


def _classes(rows):
    bags = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bags.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both, either = sum((bags[i] & bags[j]).values()), sum((bags[i] | bags[j]).values())
            if rows[i][1] == rows[j][1] or (either and both / either >= 0.8):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [None if d is None else least[root(i)] for i, (d, _) in enumerate(rows)]


def test_near_duplicates(spark, docs, empty):
    got = Counter((r["doc_id"], r["class_id"]) for r in near_dup.classes(docs).collect())
    assert got == Counter((d, c) for (d, _), c in zip(_texts(), _classes(_texts())))
    kept = near_dup.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(0) == 1 and 1 not in ids and 2 not in ids and None in ids and 10 in ids
    assert near_dup.classes(empty).count() == 0 and near_dup.deduplicated(empty).count() == 0


def test_near_duplicates_around_a_hub(spark):
    """Edited copies that are like their original but not like each other, and chains of edits."""
    base = _text(9, 200).split()
    rows = [(0, " ".join(base))]
    for k in range(1, 40):
        w = list(base)
        for i in range(4):
            w[(k * 5 + i * 47) % 200] = f"new{k}x{i}"
        rows.append((k, " ".join(w)))
    rows = [(d + 1 if d else 500, t) for d, t in rows]
    w = list(base)
    for k in range(10):
        for i in range(3):
            w[(k * 17 + i * 61) % 200] = f"step{k}x{i}"
        rows.append((100 + k, " ".join(w)))
    got = Counter((r["doc_id"], r["class_id"]) for r in near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter((d, c) for (d, _), c in zip(rows, _classes(rows)))


def test_token_output(spark, docs, empty):
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    order = [(r["doc_id"], r["text"]) for r in sorted(hashed, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"]))]
    start, wanted = 0, Counter()
    for r in order:
        ids = [*coder.encode(r[1] or "", add_special_tokens=False).ids, 2]
        wanted[r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        start += len(ids)
    folder = token_output.write_files(docs)
    assert Counter(tuple(r) for r in token_output.read_documents(spark, folder).collect()) == wanted
    assert token_output.read_documents(spark, token_output.write_files(empty)).count() == 0


def test_pipeline_stages(spark, docs):
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = spark.createDataFrame(stage(spark, at, "").collect(), docs.schema)
        assert at.columns == docs.columns and at.count() > 0, name
    last = corpus_pipeline.STAGES[-1][1](spark, at, "").collect()
    assert len(last) == at.count()
    left = {r["doc_id"] for r in last}
    assert 3 not in left and 1 not in left and 10 in left


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    from conftest import DATA, canon

    found = queries.QUERIES[name](spark, DATA)
    wanted = duck.execute(queries.ORACLES[name])
    columns = [c[0] for c in wanted.description]
    assert canon(found.columns, [tuple(r) for r in found.collect()]) == canon(columns, wanted.fetchall())
