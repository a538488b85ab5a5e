"""Every row's likenesses against exact similarities of the whole texts."""

import hashlib
import random

from strataforge.llm import fingerprints


def _shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _similar(a, b):
    a, b = _shingles(a), _shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_likenesses_of_rows(spark):
    """Families that share half, nine tenths or all of their words, some long, null and empty texts between them, two million characters in one."""
    r = random.Random(12)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=5))
    rows, serial = [], 100
    for size in (40, 400, 4000):
        base = [word() for _ in range(size)]
        for share in (1.0, 0.9, 0.5, 0.0, 1.0):
            rows.append((serial, " ".join(base[: int(size * share)] + [word() for _ in range(size - int(size * share))])))
            serial += r.randint(1, 9)
    rows.insert(7, (rows[6][0] * 1000, None))
    rows += [(9_000_000, ""), (9_000_001, "one"), (9_000_002, " ".join(word() for _ in range(330_000))), (-4, "é" * 9 + " two three four five six")]
    shuffled = r.sample(rows, len(rows))
    got = {x["doc_id"]: x for x in fingerprints.fingerprint_with_edits(spark.createDataFrame(shuffled, "doc_id long, text string").repartition(5)).collect()}
    order = [(d, t or "") for d, t in sorted(rows)]
    assert sorted(got) == [d for d, _ in order]
    for (d, own), (_, after) in zip(order, order[1:] + order[:1]):
        n = len(own) // 4
        edited = own[: len(own) - n] + after[:n]
        row = got[d]
        assert row["n_chars"] == len(own) and row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(row["near_edited"] - _similar(own, edited)) < 0.1, (d, row["near_edited"], _similar(own, edited))
        assert abs(row["near_next"] - _similar(own, after)) < 0.1, (d, row["near_next"], _similar(own, after))
        assert (row["fingerprint"] == row["edited_fingerprint"]) >= (own == edited)
