"""Cases where an operator once did less than its whole job."""

import random

from test_operators import _classes, _text

from strataforge.llm import near_dup, passages


def test_near_duplicates_behind_likelier_looking_ones(spark):
    """Texts of one template, all at 0.75 to each other; some pairs among them at 0.81, ranked behind more than six others."""
    template, rows = _text(21, 304), []
    for k in range(320):
        pair = k // 2 if k < 80 else k
        shared = " ".join(f"pair{pair}x{i}" for i in range(14))
        own = " ".join(f"own{k}x{i}" for i in range(36))
        rows.append((k, f"{template} {shared} {own}"))
    assert _classes(rows[:2] + rows[80:82]) == [0, 0, 80, 81]
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: k - k % 2 if k < 80 else k for k in range(320)}


def test_passage_far_from_the_linking_one(spark):
    """Two documents share a linking passage and, 600 words on, one whose keys older documents hold in fragments."""
    near, far = _text(31, 60), _text(32, 80).split()
    rows = [(k, " ".join(far[4 * k : 4 * k + 20])) for k in range(16)] + [(20 + n, " ".join(far[:n])) for n in range(5, 17)]
    rows += [(k, f"{near} " + " ".join(f"own{k}x{i}" for i in range(600)) + " " + " ".join(far)) for k in (100, 101)]
    found = passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    spans = sorted((r["start"], r["end"]) for r in found if (r["doc_id"], r["source_id"]) == (101, 100))
    assert spans == [(0, 60), (660, 740)]


def test_passage_whose_first_holders_have_pieces_of_it(spark):
    """Each half of a passage is in an older document; only the two newest share it whole."""
    passage = _text(41, 80).split()
    rows = [(1, " ".join(passage[:40])), (2, " ".join(passage[40:])), (3, _text(42, 50) + " " + " ".join(passage)), (4, " ".join(passage) + " " + _text(43, 50))]
    found = passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["source_id"], r["start"], r["end"]) for r in found] == [(4, 3, 0, 80)]


def test_seeds_of_a_frequent_key_over_many_partitions(spark):
    """Copies of one text over range partitions: each is linked, whatever partition its seeds are in."""
    rows = [(k, _text(44, 60)) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = passages.passages(docs).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert {r["doc_id"] for r in found} == set(range(1, 300)) and all(r["start"] == 0 and r["end"] == 60 for r in found)


def test_recall_of_edited_passages(spark):
    """Passages of 60 to 100 words with words replaced, lost and added: nine of ten at 5 %, half at 10 %."""
    import random

    for share, least in ((0.05, 0.9), (0.1, 0.5)):
        r, rows = random.Random(7), []
        for k in range(200):
            passage = _text(1000 + k, r.randint(60, 100)).split()
            edited = []
            for w in passage:
                kind = r.random() / share
                edited += [w] if kind >= 1 else [] if kind < 0.25 else [w, f"add{r.random()}"] if kind < 0.5 else [f"new{r.random()}"]
            rows.append((2 * k, _text(2000 + k, 80) + " " + " ".join(passage) + " " + _text(3000 + k, 80)))
            rows.append((2 * k + 1, _text(4000 + k, 80) + " " + " ".join(edited) + " " + _text(5000 + k, 80)))
        found = {(x["doc_id"], x["source_id"]) for x in passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert found <= {(2 * k + 1, 2 * k) for k in range(200)}
        print("edited passages found", share, len(found) / 200)
        assert len(found) >= least * 200


def test_passages_with_edits_in_every_few_words(spark):
    """Every fifth word replaced, and a fifth of the words replaced, lost or added: nine of ten at least are found."""

    def fifth(passage, r):
        at = r.randrange(5)
        return [f"new{r.random()}" if i % 5 == at else w for i, w in enumerate(passage)]

    def mixed(passage, r):
        out = []
        for w in passage:
            kind = r.random() / 0.2
            out += [w] if kind >= 1 else [] if kind < 0.25 else [w, f"add{r.random()}"] if kind < 0.5 else [f"new{r.random()}"]
        return out

    for edit, least in ((fifth, 100), (mixed, 90)):
        r, rows = random.Random(7), []
        for k in range(100):
            passage = _text(1000 + k, r.randint(60, 100)).split()
            rows.append((2 * k, _text(2000 + k, 80) + " " + " ".join(passage) + " " + _text(3000 + k, 80)))
            rows.append((2 * k + 1, _text(4000 + k, 80) + " " + " ".join(edit(passage, r)) + " " + _text(5000 + k, 80)))
        found = passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        pairs = {(x["doc_id"], x["source_id"]) for x in found}
        assert pairs <= {(2 * k + 1, 2 * k) for k in range(100)} and len(pairs) >= least
        assert all(x["similarity"] >= 0.8 and x["end"] - x["start"] >= 50 and x["source_end"] - x["source_start"] >= 50 for x in found)


def test_owners_with_too_many_contexts_are_split(spark, monkeypatch):
    """A line that every document goes on from in its own way, with owners split down to single windows."""
    import hashlib
    import random
    from collections import Counter

    import numpy as np

    from strataforge.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "MOST_SYMBOLS", 600)
    r = random.Random(8)
    letters = lambda n: "".join(r.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    line = letters(260)
    texts = [letters(150) + line[: r.choice([150, 199, 200, 220, 260])] + letters(150) for _ in range(40)]
    seen = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    wanted = set()
    for d, t in enumerate(texts):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        wanted.add((d, int(gone.sum()), hashlib.sha256(bytes(np.frombuffer(t.encode(), np.uint8)[~gone])).hexdigest()))
    got = suffix_dedup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(x["doc_id"], x["n_removed"], x["kept_sha256"]) for x in got} == wanted and any(x["n_removed"] for x in got)


def test_training_sample_is_bounded(spark):
    """Null ids, repeated ids and repeated rows do not get around the bound."""
    from strataforge.llm import language_id

    rows = [(None, f"text number {k} is here", "en") for k in range(3000)] + [(5, "the same row", "fr")] * 3000 + [(k, f"rare {k}", f"l{k}") for k in range(300)]
    taken = []
    fit = language_id.Network.fit
    language_id.Network.fit = lambda self, x, y: taken.append((len(x), len(self.langs))) or self
    try:
        language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows_a_lang=50)
    finally:
        language_id.Network.fit = fit
    assert taken == [(50 + 50 + 300, 302)]


def test_recall_of_the_permutation_index(spark):
    """All queries of a table of 2,000 unstructured vectors against brute force."""
    import numpy as np

    from strataforge.llm import queries

    folder = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    x, ids = np.array([r["embedding"] for r in rows], np.float64), np.array([r["vec_id"] for r in rows])
    got = {(r["query_id"], r["vec_id"]) for r in queries.op8_nearest_neighbours(spark, folder).collect()}
    wanted = set()
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        wanted |= {(ids[q], i) for i in ids[np.lexsort((ids, -s))[:20]]}
    assert len(got & wanted) >= 0.95 * len(wanted)


def test_near_duplicate_families(spark):
    """Families of texts that are all alike, most pairs just below the limit and some just above it."""
    import random

    import numpy as np

    r, rows = random.Random(3), []
    for f in range(2):
        base = _text(70 + f, 900).split()
        own = lambda tag, n=17: {p: f"{tag}x{p}" for p in r.sample(range(3, 897, 6), n)}
        shared = [own(f"s{f}y{k}", 9) for k in range(12)]
        for k in range(120):
            edits = own(f"f{f}y{k}") if k >= 24 else shared[k // 2] | own(f"f{f}y{k}", 8)
            rows.append((len(rows), " ".join(edits.get(i, w) for i, w in enumerate(base))))
    bags = []
    for _, t in rows:
        w = t.split()
        bags.append({hash(tuple(w[i : i + 5])) for i in range(len(w) - 4)})
    parent = np.arange(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            both = len(bags[i] & bags[j])
            if both >= 0.8 * (len(bags[i]) + len(bags[j]) - both):
                parent[parent == max(parent[i], parent[j])] = min(parent[i], parent[j])
    assert len(set(parent.tolist())) > 2
    got = {x["doc_id"]: x["class_id"] for x in near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(parent.tolist()))


def test_near_duplicate_cells_in_ranges(spark, monkeypatch):
    """The same families when a cell's elements pass the limit, so each cell is verified in several ranges."""
    monkeypatch.setattr(near_dup, "CELL_BYTES", 1 << 16)
    parts, plain = [], near_dup._links_of_large
    monkeypatch.setattr(near_dup, "_links_of_large", lambda rows: parts.append(rows.agg({"parts": "max"}).first()[0]) or plain(rows))
    test_near_duplicate_families(spark)
    assert parts and parts[0] > 3


def test_shared_counts():
    import numpy as np

    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in (0, 5, 40, 40, 90, 1)]
    got = list(near_dup.shared_counts(sets, np.array([4, 0, 2])))
    for i, row in zip((4, 0, 2), got):
        assert row.tolist() == [len(np.intersect1d(sets[i], other)) for other in sets]


def _runs(text, k=50):
    own = text.split()
    return {tuple(own[i : i + k]): i for i in range(len(own) - k, -1, -1)}


def _lost(spark, rows):
    """Words of a verbatim run of 50 words that an earlier document holds, outside all passages of their document."""
    covered = {}
    for r in passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        covered.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"]))
    seen, lost, repeated = {}, [], 0
    for i, text in sorted(rows):
        own = text.split()
        for at in range(len(own) - 49):
            if tuple(own[at : at + 50]) in seen:
                repeated += 1
                lost += [(i, p) for p in range(at, at + 50) if p not in covered.get(i, ())]
        for key in _runs(text):
            seen.setdefault(key, i)
    return lost, repeated


def test_passage_behind_pieces_in_first_and_middle_documents(spark):
    """Two documents share 80 words; 16 older ones and 16 between them hold overlapping pieces of 20."""
    far = _text(51, 80).split()
    own = lambda k: " ".join(f"own{k}x{i}" for i in range(60))
    rows = [(k, " ".join(far[4 * (k % 16) : 4 * (k % 16) + 20]) + " " + own(k)) for k in [*range(16), *range(200, 216)]]
    rows += [(k, f"{own(k)} {' '.join(far)}") for k in (100, 300)]
    found = passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert (300, 100, 60, 140) in {(r["doc_id"], r["source_id"], r["start"], r["end"]) for r in found}


def test_no_verbatim_run_is_lost(spark):
    """Random documents of pieces of 10 to 49 words and some longer ones, cut from the same few texts."""
    r = random.Random(6)
    pools = [_text(60 + k, 160).split() for k in range(3)]
    rows = []
    for k in range(400):
        parts = []
        for n in range(r.randint(1, 4)):
            pool, size = r.choice(pools), r.choice([10, 20, 30, 42, 45, 48, 49, 49, 50, 52, 60, 90])
            at = r.randrange(len(pool) - size)
            parts += [*pool[at : at + size], *(f"own{k}x{n}x{i}" for i in range(r.randint(0, 30)))]
        rows.append((k, " ".join(parts)))
    lost, repeated = _lost(spark, rows)
    assert repeated > 1000 and lost == []


def test_sample_of_different_rows(spark, monkeypatch):
    """Thousands of copies of one row don't take the places of other rows of its label."""
    from strataforge.llm import language_id

    seen = []
    monkeypatch.setattr(language_id.Network, "fit", lambda self, x, y: seen.append(len({r.tobytes() for r in x})) or self)
    for i in range(4):
        rows = [(i, "the same text", "en")] * 2000 + [(1000 + k, f"another text {k}", "en") for k in range(200)]
        language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 50)
    assert seen == [50] * 4


def test_edited_passage_in_a_middle_holder_of_all_its_runs(spark):
    """Every run that is left of a passage is in ten documents before its source and in ten between: each holder is compared, not the first and the last ones only."""
    rows, wanted = [], set()
    r = random.Random(31)
    for g in range(4):
        words = _text(7000 + g, 60 + 5 * g).split()
        edited = [f"new{g}x{i}" if i % 5 == 4 else w for i, w in enumerate(words)]
        base = 100 * g
        for k in [*range(10), *range(30, 40)]:
            pieces = [" ".join(words[i : i + 4]) + " " + _text(r.randrange(1 << 40), 6) for i in range(0, len(words), 5)]
            r.shuffle(pieces)
            rows.append((base + k, _text(r.randrange(1 << 40), 30) + " " + " ".join(pieces)))
        rows.append((base + 20, _text(r.randrange(1 << 40), 40) + " " + " ".join(words) + " " + _text(r.randrange(1 << 40), 40)))
        rows.append((base + 50, _text(r.randrange(1 << 40), 50) + " " + " ".join(edited) + " " + _text(r.randrange(1 << 40), 50)))
        wanted.add((base + 50, base + 20))
    found = passages.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert wanted <= {(p["doc_id"], p["source_id"]) for p in found if p["end"] - p["start"] >= 55}


def test_places_of_a_crowded_key_are_compared_with_all_before():
    """Against a loop over all pairs: the first of equal surroundings, a run at its first key, nothing else left out."""
    import numpy as np

    from strataforge.llm import edited_passages as E

    rng = np.random.default_rng(8)
    n = 700
    key, doc, place = rng.integers(0, 4, n).astype(np.uint32), rng.integers(0, 300, n), np.arange(n, dtype=np.int32)
    before, kind = rng.integers(0, 6, n).astype(np.uint32), rng.integers(0, 4, n).astype(np.uint8)
    sets = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (4, 8, 30)).astype(np.uint64), axis=2)
    of = rng.integers(0, 4, n)
    theirs = sets[of] | (np.uint64(1) << rng.integers(0, 64, (n, 8)).astype(np.uint64))
    around = (of * 1000 + rng.integers(0, 200, n)).astype(np.uint64)
    theirs = theirs[np.unique(around, return_index=True)[1][np.unique(around, return_inverse=True)[1]]]
    mine = sets[rng.integers(0, 4, n)]
    asks = np.flatnonzero(kind & 1)
    first = {}
    for i in sorted(range(n), key=lambda i: (doc[i], i)):
        first.setdefault((key[i], around[i]), i)
    wanted = set()
    for nth, a in enumerate(asks.tolist()):
        for b in first.values():
            missing = [int(np.bitwise_count(mine[asks[nth]][s] & ~theirs[b][s]).sum()) for s in (slice(4), slice(4, 8))]
            if key[a] == key[b] and doc[b] < doc[a] and not (kind[a] & 2 and before[a] == before[b]) and min(missing) <= E.EDITED:
                wanted.add((a, b))
    assert len(wanted) > 1000
    before_large = E.LARGE
    try:
        for E.LARGE in (before_large, 20):
            got = [(int(x), int(y)) for a, b in E.compared(key, doc, place, kind, before, around, theirs, mine[asks]) for x, y in zip(a, b)]
            assert len(got) == len(set(got)) and set(got) == wanted
    finally:
        E.LARGE = before_large
