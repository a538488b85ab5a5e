"""Invariants of chunk folds, which SQL cannot express."""

from pyspark.sql import functions as F

from strataforge.functions.text import clean_line, fold, slug, visible_text
from strataforge.operators import etl as E


def _words(n, start=0, per=9):
    out = [f"w{start + i}" + ("." if (i + 1) % per == 0 else "") for i in range(n)]
    return " ".join(out)


def test_pack_keeps_words_and_overlaps(spark):
    rows = spark.createDataFrame([(1, _words(200)), (2, _words(2000)), (3, "x"), (4, ""), (5, None), (6, " ".join(["long"] * 1500))], "id int, text string")
    found = {r["id"]: r["c"] for r in rows.select("id", E.pack(F.col("text")).alias("c")).collect()}
    assert [len(c) for c in found[1]] == [200]
    chunks = found[2]
    assert len(chunks) > 1 and all(len(c) <= E.MOST for c in chunks)
    rest = list(chunks[0])
    for before, now in zip(chunks, chunks[1:]):
        assert now[: E.OVERLAP] == before[-E.OVERLAP :]
        rest += now[E.OVERLAP :]
    assert rest == _words(2000).split()
    assert found[3] == [["x"]] and found[4] == [[]] and found[5] is None
    assert sum(len(c) for c in found[6]) >= 1500


def test_merge_small_keeps_order_and_limits(spark):
    rows = spark.createDataFrame([([["a"] * 10, ["b"] * 100, ["c"] * 470, ["d"] * 5],)], "c array<array<string>>")
    out = rows.select(E.merge_small(F.col("c")).alias("m")).first()["m"]
    assert sum(out, []) == ["a"] * 10 + ["b"] * 100 + ["c"] * 470 + ["d"] * 5
    assert all(len(c) <= E.MOST for c in out) and [len(c) for c in out] == [110, 475]


def test_text_functions(spark):
    rows = spark.createDataFrame([("Ñandú ËTÉ й",), (None,), ("",)], "t string")
    assert [r[0] for r in rows.select(fold(F.col("t"))).collect()] == ["nandu ete й", None, ""]
    assert [r[0] for r in rows.select(fold(fold(F.col("t"))) == fold(F.col("t"))).collect()] == [True, None, True]
    assert rows.select(slug(F.lit("  --  "))).first()[0] == "s"
    assert rows.select(clean_line(F.lit("ﬁne­\t x "))).first()[0] == "fine x"
    html = '<p>a<script>var t="</p>";</script></p><style>p{}</style><b>b</b>'
    assert rows.select(visible_text(F.lit(html))).first()[0] == "a b"


def test_lines_are_cleaned_once(spark):
    """Filters on a line don't clean it again: the plan spells out ligatures in one place."""
    docs = spark.createDataFrame([(1, "a \nﬁ\n\n12"), (2, None)], "doc_id long, text string")
    rows = E.lines(docs).filter("line <> '' and not line rlike '^[0-9]+$'")
    assert [tuple(r) for r in rows.collect()] == [(1, 0, "a"), (1, 1, "fi")]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("ﬁ") == 1
