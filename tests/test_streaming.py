"""Streams with state: late and out-of-order rows, gaps, failures between write and commit."""

import datetime as dt
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from strataforge.streaming import delivery as D
from strataforge.streaming import jobs as J
from strataforge.streaming import state as S

START = dt.datetime(2024, 1, 1)
HOUR = 3_600_000_000
BASE = int(START.replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000


def files(spark, batches, schema):
    """A file stream that brings one batch of rows after another."""
    folder = tempfile.mkdtemp(prefix="spark-")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{folder}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}")


def at(hours):
    return START + dt.timedelta(hours=hours)


def test_turns_of_a_day_whatever_their_order(spark):
    r = random.Random(1)
    turns = sorted((r.uniform(0, 200), k, r.choice("ab")) for k in range(120))
    order = sorted(turns, key=lambda t: t[0] + r.uniform(0, 0.9))  # out of order by less than the watermark's hour
    batches = [order[i : i + 30] for i in range(0, 120, 30)]
    schema = "user string, id long, ts timestamp"
    stream = files(spark, [[(u, k, at(h)) for h, k, u in b] for b in batches] + [[(None, -1, at(300))], [(None, -2, at(301))]], schema)
    got = {r["id"]: r["history"] for r in J.drained(S.keyed(stream, "user", S.TurnMemory(), "1 hour"), conf=S.PROVIDER).collect()}
    for h, k, u in turns:
        before = [x for x in turns if x[2] == u and x[0] <= h and x[0] >= h - 24][-6:]
        assert got[k] == [x[1] for x in before]
    assert set(got) == {k for _, k, _ in turns}


def test_late_turns_are_dropped_and_state_goes(spark):
    schema = "user string, id long, ts timestamp"
    batches = [[("a", 1, at(0)), ("a", 2, at(1))], [("a", 3, at(50))], [("b", 8, at(50.2))], [("a", 4, at(2)), ("a", 5, at(50.5))], [("b", 9, at(200))], [("b", 10, at(203))]]
    base = tempfile.mkdtemp(prefix="spark-")
    stream = S.keyed(files(spark, batches, schema), "user", S.TurnMemory(), "1 hour")
    rows = []
    before = {k: spark.conf.get(k, None) for k in S.PROVIDER}
    for k, v in S.PROVIDER.items():
        spark.conf.set(k, v)
    try:
        stream.writeStream.outputMode("append").option("checkpointLocation", f"file://{base}").trigger(availableNow=True).foreachBatch(lambda b, n: rows.extend(b.collect())).start().awaitTermination()
        left = spark.read.format("statestore").option("stateVarName", "remembered").load(f"file://{base}").count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert {r["id"]: r["history"] for r in rows} == {1: [1], 2: [1, 2], 3: [3], 5: [3, 5], 8: [8], 9: [9]}  # 10 waits for the watermark
    assert left == 1  # what "a" said is forgotten; "b" has one remembered turn


def machine(rows, end, after=3, again=6):
    """(at, kind) of alerts over (time, ok), by the clock."""
    failures, following, out = 0, None, []
    for t, ok in [*rows, (end, None)]:
        while following is not None and following <= t:
            out.append((following, "repeat"))
            following += again * HOUR
        if ok is None:
            break
        if ok:
            if following is not None:
                out.append((t, "recovered"))
            failures, following = 0, None
        else:
            failures += 1
            if failures == after:
                out.append((t, "warn"))
                following = t + again * HOUR
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_alerts_equal_a_state_machine(spark, seed):
    r = random.Random(seed)
    series = {}
    for user in "abc":
        t, rows = 0.0, []
        for _ in range(60):
            t += r.choice([0.5, 1, 1, 2, 9, 30])  # hours, with gaps
            rows.append((BASE + int(t * HOUR), r.random() < 0.35))
        series[user] = rows
    every = sorted((t, u, ok) for u, rows in series.items() for t, ok in rows)
    batches = [every[i : i + 25] for i in range(0, len(every), 25)]
    end = every[-1][0] + 40 * HOUR
    schema = "user string, id long, ts timestamp, ok boolean"
    when = lambda t: START + dt.timedelta(microseconds=t - BASE)
    stream = files(spark, [[(u, t, when(t), ok) for t, u, ok in b] for b in batches] + [[(None, -1, when(end + HOUR), True)], [(None, -2, when(end + HOUR), True)]], schema)
    got = {}
    for x in J.drained(S.keyed(stream, "user", S.Alerts(), "1 hour"), conf=S.PROVIDER).collect():
        got.setdefault(x["key"], []).append((x["at"], x["kind"]))
    for user, rows in series.items():
        assert sorted(got.get(user, [])) == sorted(machine(rows, end))


def test_delivery_survives_failures(spark):
    """Batches of two files a run; the sink takes some, dies after it wrote, refuses some; each row ends in the outbox once."""
    base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    schema = "id long, what string"
    stream = files(spark, [[(i, f"n{i}") for i in range(k, k + 10)] + [(k, f"n{k}"), (None, "no key")] for k in (0, 8, 16, 24)], schema)
    ledger = D.Ledger(spark, base, stream.schema, "id")
    send = D.outbox(f"{base}/outbox", "id")

    def dies(rows):
        send(rows.filter("id % 2 = 0"))
        raise RuntimeError("killed between write and commit")

    with pytest.raises(RuntimeError):
        ledger.run(stream, dies)
    assert ledger.delivered().count() == 0 and ledger.pending().count() == 34
    ledger.run(stream, lambda rows: send(rows.filter("id < 20")))  # nothing new comes, and some are refused
    assert ledger.delivered().count() == 20 and ledger.pending().count() == 14
    ledger.run(stream, send)
    assert ledger.pending().count() == 0
    out = spark.read.schema(schema).parquet(f"{base}/outbox")
    assert sorted(map(tuple, out.collect())) == [(i, f"n{i}") for i in range(34)]


def test_first_run_takes_history_as_known(spark):
    base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    schema = "id long, what string"
    stream = lambda: spark.readStream.schema(schema).parquet(folder)
    sent = []
    keep = lambda rows: (sent.extend(r["id"] for r in rows.collect()), rows)[1]
    spark.createDataFrame([(1, "old"), (2, "old")], schema).write.mode("append").parquet(folder)
    ledger = D.Ledger(spark, base, stream().schema, "id")
    ledger.run(stream(), keep, baseline=True)
    assert sent == [] and ledger.pending().count() == 0
    spark.createDataFrame([(2, "again"), (3, "new")], schema).write.mode("append").parquet(folder)
    ledger.run(stream(), keep, baseline=True)
    assert sent == [3]


def test_sessions_are_written_once(spark):
    rows = [("a", at(0)), ("a", at(0.4)), ("a", at(0.9)), ("b", at(1)), ("a", at(5))]
    stream = files(spark, [[r] for r in rows] + [[(None, at(9))], [(None, at(9.1))]], "user_id string, ts timestamp")
    got = J.drained(J.closed_sessions(stream)).select("user_id", F.unix_micros("start"), F.unix_micros("last"), "events").collect()
    micros = lambda h: BASE + int(h * HOUR)
    assert sorted(map(tuple, got)) == [("a", micros(0), micros(0.9), 3), ("a", micros(5), micros(5), 1), ("b", micros(1), micros(1), 1)]
