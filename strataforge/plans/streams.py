"""Streaming queries, run over what is there; their twins are batch SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..streaming import delivery as D
from ..streaming import jobs as J
from ..streaming import state as S
from ..sources.tables import table
from .registry import query


@query("ST4_tumbling_stream", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling(spark, sf):
    """Daily counts in complete mode: the last batch holds all of them."""
    rows = J.drained(J.tumbling_stream(J.event_stream(spark, sf)), "complete")
    return rows.join(rows.agg(F.max("batch").alias("batch")), "batch", "left_semi").select("day", "event_type", "n")


@query("ST6_dedup_watermark", "SELECT event_id, user_id, event_type FROM events")
def dedup(spark, sf):
    """A stream that meets itself twice and lets each event pass once."""
    stream = J.event_stream(spark, sf)
    twice = stream.unionByName(stream)
    return J.drained(J.once_each(twice, "event_id", "31 days")).select("event_id", "user_id", "event_type")


@query("ST5_session_stream", "WITH o AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) >= 1800000000 THEN 1 ELSE 0 END AS new FROM events), n AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS visit FROM o), v AS (SELECT user_id, visit, count(*) AS events FROM n GROUP BY ALL) SELECT user_id, count(*) AS visits, sum(events)::BIGINT AS events FROM v GROUP BY user_id")
def sessions(spark, sf):
    """Visits by stream; complete mode keeps those the watermark would still hold open."""
    rows = J.drained(J.session_stream(J.event_stream(spark, sf)), "complete")
    last = rows.join(rows.agg(F.max("batch").alias("batch")), "batch", "left_semi")
    return last.groupBy("user_id").agg(F.count(F.lit(1)).alias("visits"), F.sum("events").alias("events"))


_LATE = "1 hour"
ALL = 1 << 30  # files a micro-batch: a drained stream with an end takes all at once


def _with_end(spark, sf, rows, after=_LATE):
    return S.with_end(rows, J.end_stream(spark, table(spark, sf, "events"), after))


@query(
    "ST4_session_windows",
    """WITH o AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) >= 1800000000 THEN 1 ELSE 0 END AS new FROM events
), n AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS visit FROM o
) SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts)) AS last, count(*) AS events FROM n GROUP BY user_id, visit""",
)
def session_windows(spark, sf):
    """Closed visits in append mode: each is written once, and its state goes."""
    events = J.event_stream(spark, sf, ALL).select("user_id", "ts")
    rows = J.drained(J.closed_sessions(_with_end(spark, sf, events, "90 minutes"), late=_LATE)).filter("user_id is not null")
    return rows.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("last").alias("last"), "events")


@query(
    "ST5_turn_memory",
    """WITH h AS (SELECT user_id, event_id, list_filter(list({'id': event_id, 'age': epoch_us(ts)}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), lambda x: x.age >= epoch_us(ts) - 86400000000) AS h FROM events
) SELECT user_id, event_id, len(h) AS turns, h[1].id AS oldest FROM h""",
)
def turn_memory(spark, sf):
    """Each event's last six events of the same user within 24 hours, from state with a time to live."""
    events = J.event_stream(spark, sf, ALL).select("user_id", F.col("event_id").alias("id"), "ts")
    rows = J.drained(S.keyed(_with_end(spark, sf, events), "user_id", S.TurnMemory(), _LATE), conf=S.PROVIDER)
    return rows.select(F.col("key").cast("long").alias("user_id"), F.col("id").alias("event_id"), F.size("history").cast("long").alias("turns"), F.element_at("history", 1).alias("oldest"))


@query(
    "ST8_alerts_by_clock",
    """WITH o AS (SELECT user_id, event_id, epoch_us(ts) AS t, event_type = 'error' AS bad, row_number() OVER w - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts, event_id) AS run,
    lead(epoch_us(ts)) OVER w AS next_t FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), r AS (SELECT user_id, run, list_sort(list(t))[3] AS warned, last(next_t ORDER BY t, event_id) AS recovered FROM o WHERE bad GROUP BY user_id, run HAVING count(*) >= 3
), e AS (SELECT r.*, coalesce(recovered, (SELECT epoch_us(max(ts)) + 1000000 FROM events)) AS upto FROM r
) SELECT user_id, warned AS "at", 'warn' AS kind FROM e
UNION ALL SELECT user_id, recovered, 'recovered' FROM e WHERE recovered IS NOT NULL
UNION ALL SELECT user_id, warned + 21600000000 * unnest(range(1, (upto - warned) // 21600000000 + 1)), 'repeat' FROM e""",
)
def alerts_by_clock(spark, sf):
    """A user's third error in a row warns, again each six hours by the clock, and the first success after it is told once."""
    events = J.event_stream(spark, sf, ALL).select("user_id", F.col("event_id").alias("id"), "ts", (~F.col("event_type").eqNullSafe("error")).alias("ok"))
    rows = J.drained(S.keyed(_with_end(spark, sf, events), "user_id", S.Alerts(), _LATE), conf=S.PROVIDER)
    return rows.select(F.col("key").cast("long").alias("user_id"), "at", "kind")


@query("ST6_delivery", "SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('purchase', 'signup')")
def delivery(spark, sf):
    """Purchases and signups delivered once each through a ledger, from a stream that brings every event twice, in two runs."""
    stream = J.event_stream(spark, sf).select("event_id", "user_id", "event_type").filter(F.col("event_type").isin("purchase", "signup"))
    base = f"{J.shared_folder(spark)}/delivery-{uuid.uuid4().hex}"
    ledger = D.Ledger(spark, base, stream.schema, "event_id")
    for _ in range(2):
        ledger.run(stream.unionByName(stream), D.outbox(f"{base}/outbox", "event_id"))
    return spark.read.schema(stream.schema).parquet(f"{base}/outbox")
