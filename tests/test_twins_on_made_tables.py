"""Queries and their SQL twins on small made tables that hold what the given ones seldom do."""

import datetime as dt
import os
import tempfile

from conftest import canon

from strataforge import catalog


def same(spark, name, **tables):
    """The rows of a query over made tables (rows, schema), after they were held against its twin."""
    import duckdb

    folder, con = tempfile.mkdtemp(prefix="spark-"), duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{folder}/{table}.parquet")
        con.execute(f"create view {table} as select * from read_parquet('{os.path.join(folder, table)}.parquet/*.parquet')")
    found = catalog.QUERIES[name](spark, folder)
    got = [tuple(r) for r in found.collect()]
    wanted = con.execute(catalog.ORACLES[name])
    columns = [c[0] for c in wanted.description]
    assert canon(found.columns, got) == canon(columns, wanted.fetchall())
    return got


def test_character_references_that_were_cut(spark):
    """A title cut inside a reference: the names that HTML knows without a semicolon are read, others stay."""
    heads = ["a &amp;&amp", "b &am", "c &quot", "d &quo", "e &copy f", "g &amp;quot;", "h &middot&amp;"]
    pages = [(i, "http://x", f"<html><body><h1>{h}</h1><p>{'word ' * 60}</p></body></html>") for i, h in enumerate(heads)]
    got = same(spark, "S6_html_lines", pages=(pages, "page_id long, url string, html string"))
    titles = [line for _, _, tag, line, _ in sorted(got) if tag == "h1"]
    assert titles == ["a &&", "b &am", 'c "', "d &quo", "e © f", "g &quot;", "h ·&"]


def test_alerts_that_are_open_at_the_end(spark):
    """User 1 ends in errors, user 2 recovers, user 3 has two errors at one time before its recovery, user 4 an event without a type."""
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    series = {1: [(0, "error"), (1, "error"), (2, "error"), (15, "error")], 2: [(0, "error"), (1, "error"), (2, "error"), (9, "view"), (20, "view")]}
    series[3] = [(0, "error"), (1, "error"), (3, "error"), (3, "error"), (3, "view"), (4, "error")]
    series[4] = [(0, "error"), (1, "error"), (2, None), (3, "error"), (4, "error"), (5, "error"), (12, None)]
    events = [(100 * u + k, at(h), u, what, 0.0, "") for u, rows in series.items() for k, (h, what) in enumerate(rows)]
    got = same(spark, "ST8_alerts_by_clock", events=(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string"))
    kinds = {u: sorted(k for x, _, k in got if x == u) for u in series}
    assert kinds == {1: ["repeat"] * 3 + ["warn"], 2: ["recovered", "repeat", "warn"], 3: ["recovered", "warn"], 4: ["recovered", "repeat", "warn"]}
