"""Link classes on hand-made addresses; the registered queries against their SQL on the given tables."""

from pyspark.sql import functions as F

from strataforge.operators.links import link_class


def test_link_classes(spark):
    rows = [
        ("https://a.org/fever-in-kids.html", "https://a.org/fever-in-kids.html/", True, "same"),
        ("https://a.org/a%20b", "https://a.org/a b", True, "same"),
        ("https://a.org/x%zz", "https://a.org/x%zz", True, "same"),  # cannot be decoded
        ("https://a.org/a+b", "https://a.org/a b", True, "moved"),  # a plus is no blank; no words of its own
        ("https://a.org/fever-in-kids.html", "https://b.org/new/Fever", True, "moved"),
        ("https://a.org/bedwetting.html", "https://a.org/development.html", True, "topic"),  # the site doesn't count
        ("https://a.org/", "https://a.org/start", True, "moved"),
        ("https://a.org/fever", "https://a.org/404?was=fever", True, "retired"),
        ("https://a.org/fever", "https://a.org/4045", True, "topic"),
        ("https://a.org/fever", "https://a.org/fever", False, "broken"),
        ("https://a.org/fever", "https://a.org/fever", None, "broken"),
        ("https://a.org/fever", None, True, "broken"),
        ("", "", True, "same"),
        (None, "https://a.org", True, None),
    ]
    df = spark.createDataFrame(rows, "before string, after string, answers boolean, want string")
    got = df.select("before", "after", link_class(F.col("before"), F.col("after"), F.col("answers")).alias("got"), "want").collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_marks_of_references(spark, duck):
    """Both forms of the marks on neighbours, ends, other scripts and case."""
    from strataforge.plans import etl

    texts = {"": 0, "et al": 1, "et al et al, et al.": 3, "Et Al": 1, "bet al": 0, "et alii": 0, "et alé": 0, "éet al": 0, "doi:doi:10": 2, "xdoi:1 (doi:2)": 1, "see https://doi:9 http://b PMID1pmid": 5, "et\nal": 0, "日et al": 0, "et al\ndoi:": 2}
    df = spark.createDataFrame(list(texts.items()), "text string, want int")
    assert {r[0]: r[1] for r in df.select("text", F.regexp_count("text", F.lit(etl._MARKS))).collect()} == texts
    for text, want in texts.items():
        assert duck.execute(f"SELECT {etl._MARKS_SQL} FROM (SELECT ?::VARCHAR AS text)", [text]).fetchone()[0] == want, text
