"""Usage analytics over ``events`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import usage as U
from ..sources.tables import table
from .registry import query

_COUNTS = ("click", "view", "purchase", "signup", "error")


def events(spark, sf):
    """Events with a session-zone timestamp; the files hold times without a zone."""
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "A2_conditional_counts",
    "SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS {t}s" for t in _COUNTS) + ", count(*) FILTER (value > 50) AS high, count(DISTINCT user_id) AS users, coalesce(sum(value) FILTER (event_type = 'purchase'), 0) > 0 AS sold FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'",
)
def conditional_counts(spark, sf):
    """One pass over a time range instead of a query for each count."""
    rows = table(spark, sf, "events").filter("ts >= TIMESTAMP_NTZ '2024-01-05' AND ts < TIMESTAMP_NTZ '2024-01-20'")
    kind = F.col("event_type")
    return rows.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(kind == t).alias(f"{t}s") for t in _COUNTS],
        F.count_if(F.col("value") > 50).alias("high"),
        F.countDistinct("user_id").alias("users"),
        (F.coalesce(F.sum(F.when(kind == "purchase", F.col("value"))), F.lit(0.0)) > 0).alias("sold"),
    )


@query(
    "A3_grouping_sets_daily",
    """WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type FROM events
) SELECT day, event_type, count(*) AS n, grouping(day)::BIGINT AS all_days FROM e GROUP BY GROUPING SETS ((day), (event_type), (day, event_type), ())""",
)
def grouping_sets(spark, sf):
    """Counts by day, by type, by both and in all, from one scan."""
    rows = table(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type")
    return rows.groupingSets([["day"], ["event_type"], ["day", "event_type"], []], "day", "event_type").agg(F.count(F.lit(1)).alias("n"), F.grouping("day").cast("long").alias("all_days"))


@query("A4_totals_with_default", "SELECT event_type, round(coalesce(sum(value), 0), 2) AS total, strftime(min(ts), '%Y-%m-%d') AS first_day, coalesce(sum(value), 0) >= 1000 AS over_cap FROM events GROUP BY event_type")
def totals(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 2).alias("total"), F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first_day"), (F.coalesce(F.sum("value"), F.lit(0.0)) >= 1000).alias("over_cap"))


@query(
    "A5_traffic",
    """WITH v AS (SELECT strftime(ts, '%Y-%m-%d') AS day, user_id FROM events WHERE event_type = 'view'
), per_user AS (SELECT day, user_id, count(*) AS n FROM v GROUP BY ALL
) SELECT day, sum(n)::BIGINT AS views, count(*) AS visitors, count(*) FILTER (n > 1) AS returning FROM per_user GROUP BY day""",
)
def traffic(spark, sf):
    """Views, visitors and returning visitors by day; counted by visitor first, which spreads a busy day."""
    views = table(spark, sf, "events").filter("event_type = 'view'").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "user_id")
    per_user = views.groupBy("day", "user_id").agg(F.count(F.lit(1)).alias("n"))
    return per_user.groupBy("day").agg(F.sum("n").alias("views"), F.count(F.lit(1)).alias("visitors"), F.count_if(F.col("n") > 1).alias("returning"))


@query(
    "A6_breakdown",
    """WITH c AS (SELECT CASE WHEN value < 5 THEN 'small' WHEN value < 20 THEN 'medium' ELSE 'large' END AS channel, json_extract(props, '$.k')::INT % 4 AS device FROM events
) SELECT channel, device::BIGINT AS device, count(*) AS n, row_number() OVER (PARTITION BY channel ORDER BY count(*) DESC, device) AS place FROM c GROUP BY channel, device""",
)
def breakdown(spark, sf):
    channel = F.when(F.col("value") < 5, "small").when(F.col("value") < 20, "medium").otherwise("large")
    device = (F.get_json_object("props", "$.k").cast("int") % 4).cast("long")
    per = table(spark, sf, "events").select(channel.alias("channel"), device.alias("device")).groupBy("channel", "device").agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("place", F.row_number().over(Window.partitionBy("channel").orderBy(F.desc("n"), "device")).cast("long"))


_SESSIONS = """WITH o AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) > 1800000000 THEN 1 ELSE 0 END AS new FROM events
), n AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS visit FROM o
), s AS (SELECT user_id, visit, min(ts) AS start, max(ts) AS last, count(*) AS events FROM n GROUP BY ALL)
"""


@query("A7_sessions_dwell", _SESSIONS + "SELECT user_id, count(*) AS visits, count(*) FILTER (events > 1) AS timed, max(epoch_us(last) - epoch_us(start)) // 1000000 AS longest, count(*) FILTER (epoch_us(last) - epoch_us(start) > 60000000) AS over_a_minute FROM s GROUP BY user_id")
def sessions_dwell(spark, sf):
    dwell = F.unix_micros("last") - F.unix_micros("start")
    return U.sessions(events(spark, sf).select("user_id", "ts"), "user_id", "ts").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("visits"), F.count_if(F.col("events") > 1).alias("timed"), F.floor(F.max(dwell) / 1_000_000).alias("longest"), F.count_if(dwell > 60_000_000).alias("over_a_minute")
    )


@query("A7b_median_dwell", _SESSIONS + ", d AS (SELECT date_trunc('day', start) AS day, (epoch_us(last) - epoch_us(start)) // 1000000 AS sec FROM s WHERE events > 1), r AS (SELECT day, sec, row_number() OVER (PARTITION BY day ORDER BY sec) AS k, count(*) OVER (PARTITION BY day) AS n FROM d) SELECT strftime(day, '%Y-%m-%d') AS day, sec FROM r WHERE k = n // 2 + 1")
def median_dwell(spark, sf):
    """The upper middle dwell time of each day's timed visits."""
    rows = U.sessions(events(spark, sf).select("user_id", "ts"), "user_id", "ts").filter("events > 1")
    sec = F.floor((F.unix_micros("last") - F.unix_micros("start")) / 1_000_000)
    by = Window.partitionBy("day")
    ranked = rows.select(F.date_format("start", "yyyy-MM-dd").alias("day"), sec.alias("sec")).withColumns({"k": F.row_number().over(by.orderBy("sec")), "n": F.count(F.lit(1)).over(by)})
    return ranked.filter(F.col("k") == F.floor(F.col("n") / 2) + 1).select("day", "sec")


@query("A9_p95_index", "SELECT event_type, value AS p95 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) WHERE k = CASE WHEN floor(0.95 * n) < 1 THEN n ELSE floor(0.95 * n) END")
def p95_index(spark, sf):
    """The value at place int(0.95 n) of each type. Values are counted first, so a window sees distinct values only."""
    counts = table(spark, sf, "events").filter("value is not null").groupBy("event_type", "value").agg(F.count(F.lit(1)).alias("c"))
    by = Window.partitionBy("event_type")
    upto = counts.withColumns({"upto": F.sum("c").over(by.orderBy("value")), "n": F.sum("c").over(by)})
    at = F.when(F.floor(0.95 * F.col("n")) < 1, F.col("n")).otherwise(F.floor(0.95 * F.col("n")))
    return upto.filter((F.col("upto") >= at) & (F.col("upto") - F.col("c") < at)).select("event_type", F.col("value").alias("p95"))


@query("A10_repeat_ranges", "SELECT event_type, round(avg(m), 6) AS mean_of_days, round(min(m), 6) AS lowest, round(max(m), 6) AS highest FROM (SELECT event_type, date_trunc('day', ts) AS day, avg(value) AS m FROM events GROUP BY ALL) GROUP BY event_type")
def repeat_ranges(spark, sf):
    daily = table(spark, sf, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.avg("value").alias("m"))
    return daily.groupBy("event_type").agg(F.round(F.avg("m"), 6).alias("mean_of_days"), F.round(F.min("m"), 6).alias("lowest"), F.round(F.max("m"), 6).alias("highest"))


@query("A11_tool_usage", "SELECT json_extract(props, '$.k')::BIGINT % 10 AS tool, count(*) AS calls, count(DISTINCT user_id) AS clients, count(*) FILTER (event_type = 'error') AS no_data FROM events GROUP BY 1")
def tool_usage(spark, sf):
    tool = F.get_json_object("props", "$.k").cast("long") % 10
    return table(spark, sf, "events").groupBy(tool.alias("tool")).agg(F.count(F.lit(1)).alias("calls"), F.countDistinct("user_id").alias("clients"), F.count_if(F.col("event_type") == "error").alias("no_data"))


@query("A15_close_pairs", "SELECT user_id, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL HAVING avg(value) BETWEEN 3.5 AND 30 ORDER BY n DESC, user_id, event_type LIMIT 25")
def close_pairs(spark, sf):
    per = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"))
    return per.filter("m between 3.5 and 30").orderBy(F.desc("n"), "user_id", "event_type").limit(25).select("user_id", "event_type", "n", F.round("m", 6).alias("mean_value"))


@query("W1_latest_per_key", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def latest_per_key(spark, sf):
    """An upsert's result: the last row of each key."""
    return U.latest(table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query(
    "W1b_upsert_keep_old",
    """WITH k AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE value IS NOT NULL
) SELECT user_id, max(value) FILTER (event_type = 'purchase' AND k = 1) AS bought, max(value) FILTER (event_type = 'signup' AND k = 1) AS signed FROM k GROUP BY user_id""",
)
def upsert_keep_old(spark, sf):
    """Columns that a later row leaves null keep their last value."""
    rows = table(spark, sf, "events")
    last = lambda kind: F.max_by("value", F.when((F.col("event_type") == kind) & F.col("value").isNotNull(), F.struct("ts", "event_id")))
    return rows.groupBy("user_id").agg(last("purchase").alias("bought"), last("signup").alias("signed"))


@query("W2_last_six_turns", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 6")
def last_six_turns(spark, sf):
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return table(spark, sf, "conversations").withColumn("k", k).filter("k <= 6").select("conv_id", "turn", "role")


@query("W3_conversation_context", "SELECT conv_id, turn, string_agg(CASE WHEN role = 'user' THEN text END, ' | ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS context, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations")
def conversation_context(spark, sf):
    """What the user said before each turn, and who spoke last: running lists of a conversation's own turns."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    said = F.collect_list(F.when(F.col("role") == "user", F.col("text"))).over(by.rowsBetween(Window.unboundedPreceding, -1))
    context = F.when(F.size(said) > 0, F.array_join(said, " | "))
    return table(spark, sf, "conversations").select("conv_id", "turn", context.alias("context"), F.lag("role").over(by).alias("before"))


@query("W4_last_non_null", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_bought FROM events")
def last_non_null(spark, sf):
    by = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    bought = F.when(F.col("event_type") == "purchase", F.col("value"))
    return table(spark, sf, "events").select("event_id", F.last(bought, ignorenulls=True).over(by).alias("last_bought"))


@query(
    "W5_fresh_value",
    """WITH l AS (SELECT user_id, max_by(value, ts) AS value, max(ts) AS ts FROM events WHERE event_type = 'purchase' GROUP BY user_id
) SELECT user_id, CASE WHEN date_diff('day', ts, TIMESTAMP '2024-01-31') <= CASE WHEN user_id % 3 = 0 THEN 3 WHEN user_id % 3 = 1 THEN 6 ELSE 12 END THEN value END AS fresh FROM l""",
)
def fresh_value(spark, sf):
    """The newest purchase if it is no older than the user's kind allows, otherwise null."""
    last = table(spark, sf, "events").filter("event_type = 'purchase'").groupBy("user_id").agg(F.max_by("value", "ts").alias("value"), F.max("ts").alias("ts"))
    most = F.when(F.col("user_id") % 3 == 0, 3).when(F.col("user_id") % 3 == 1, 6).otherwise(12)
    return last.select("user_id", F.when(F.datediff(F.lit("2024-01-31").cast("date"), F.to_date("ts")) <= most, F.col("value")).alias("fresh"))


@query("W6_first_touch", "SELECT user_id, event_type AS landing, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def first_touch(spark, sf):
    first = table(spark, sf, "events").groupBy("user_id").agg(F.min(F.struct("ts", "event_id", "event_type")).alias("m"))
    return first.select("user_id", F.col("m.event_type").alias("landing"), "m.event_id")


@query("W8_most_overdue", "SELECT r_name, strftime(coalesce(max(o_orderdate), TIMESTAMP '2000-01-01'), '%Y-%m-%d') AS newest FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY r_name")
def most_overdue(spark, sf):
    """The newest pending order of each region, with a date for regions without one; aggregated before the joins."""
    newest = table(spark, sf, "orders").filter("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.max("o_orderdate").alias("d"))
    by_nation = table(spark, sf, "customer").select("c_custkey", "c_nationkey").join(newest, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey").agg(F.max("d").alias("d"))
    by_region = table(spark, sf, "nation").join(by_nation, F.col("n_nationkey") == F.col("c_nationkey")).groupBy("n_regionkey").agg(F.max("d").alias("d"))
    rows = table(spark, sf, "region").join(by_region, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return rows.select("r_name", F.date_format(F.coalesce("d", F.lit("2000-01-01").cast("timestamp_ntz")), "yyyy-MM-dd").alias("newest"))


@query(
    "W9_waterfall",
    """WITH b AS (SELECT event_id, ts, CASE WHEN event_type = 'error' THEN 1 WHEN value > 40 THEN 2 WHEN event_type = 'purchase' THEN 3 WHEN event_type = 'signup' THEN 4 ELSE 5 END AS bucket FROM events
) SELECT bucket::BIGINT AS bucket, event_id, k, n - 6 AS more FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY bucket) AS n FROM b) WHERE k <= 6""",
)
def waterfall(spark, sf):
    """Each row counts in the first bucket it fits; six of each are listed and the others counted.

    Counts are an aggregate of their own, so the window that numbers rows stays a limited one.
    """
    kind = F.col("event_type")
    bucket = F.when(kind == "error", 1).when(F.col("value") > 40, 2).when(kind == "purchase", 3).when(kind == "signup", 4).otherwise(5).cast("long")
    rows = table(spark, sf, "events").select("event_id", "ts", bucket.alias("bucket"))
    k = F.row_number().over(Window.partitionBy("bucket").orderBy("ts", "event_id")).cast("long")
    listed = rows.withColumn("k", k).filter("k <= 6")
    return listed.join(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "bucket").select("bucket", "event_id", "k", (F.col("n") - 6).alias("more"))


@query(
    "W10_change",
    """WITH k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS up, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS down FROM events
) SELECT user_id, round(max(value) FILTER (down = 1) - max(value) FILTER (up = 1), 6) AS change FROM k GROUP BY user_id""",
)
def change(spark, sf):
    at = F.struct("ts", "event_id")
    return table(spark, sf, "events").groupBy("user_id").agg(F.round(F.max_by("value", at) - F.min_by("value", at), 6).alias("change"))


@query(
    "W12_failure_runs",
    """WITH o AS (SELECT user_id, event_id, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts, event_id) AS run FROM events
) SELECT user_id, count(*) AS alerts, max(n) AS longest FROM (SELECT user_id, run, count(*) AS n FROM o WHERE bad GROUP BY ALL) WHERE n >= 3 GROUP BY user_id""",
)
def failure_runs(spark, sf):
    """Runs of three failures or more warn once each."""
    bad = F.col("event_type") == "error"
    rows = table(spark, sf, "events").select("user_id", "ts", "event_id", bad.alias("bad"))
    run = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - F.row_number().over(Window.partitionBy("user_id", "bad").orderBy("ts", "event_id"))
    per = rows.withColumn("run", run).filter("bad").groupBy("user_id", "run").agg(F.count(F.lit(1)).alias("n"))
    return per.filter("n >= 3").groupBy("user_id").agg(F.count(F.lit(1)).alias("alerts"), F.max("n").alias("longest"))


@query(
    "J9_interval_membership",
    """WITH i AS (SELECT o_custkey % 50 AS g, date_diff('day', TIMESTAMP '1992-01-01', o_orderdate) AS lo, date_diff('day', TIMESTAMP '1992-01-01', o_orderdate) + 2 + o_custkey % 3 AS hi FROM orders WHERE o_orderpriority = '1-URGENT'
), m AS (SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY g ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM i
), n AS (SELECT *, sum(new) OVER (PARTITION BY g ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM m
), u AS (SELECT g, min(lo) AS lo, max(hi) AS hi FROM n GROUP BY g, island
) SELECT l_suppkey % 50 AS g, count(*) AS inside FROM lineitem JOIN u ON l_suppkey % 50 = g AND date_diff('day', TIMESTAMP '1992-01-01', l_shipdate) BETWEEN lo AND hi GROUP BY ALL""",
)
def interval_membership(spark, sf):
    """Shipments inside the merged periods of urgent orders. Periods are cut at 30-day bins, so the join is on equal keys."""
    day = lambda c: F.datediff(F.col(c), F.lit("1992-01-01"))
    raw = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select((F.col("o_custkey") % 50).alias("g"), day("o_orderdate").alias("lo"), (day("o_orderdate") + 2 + F.col("o_custkey") % 3).alias("hi"))
    merged = U.merged_intervals(raw, "g", "lo", "hi")
    binned = merged.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / 30), F.floor(F.col("hi") / 30))))
    shipped = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 50).alias("g"), day("l_shipdate").alias("d")).groupBy("g", "d").agg(F.count(F.lit(1)).alias("n")).withColumn("bin", F.floor(F.col("d") / 30))
    return shipped.join(binned, ["g", "bin"]).filter("d between lo and hi").groupBy("g").agg(F.sum("n").alias("inside"))


@query(
    "J10_within_days_anti",
    "SELECT e.event_id FROM events e WHERE e.event_type = 'view' AND NOT EXISTS (SELECT 1 FROM events o WHERE o.event_type = 'error' AND o.user_id = e.user_id AND abs(epoch_us(o.ts) - epoch_us(e.ts)) <= 604800000000)",
)
def within_days_anti(spark, sf):
    """Views without an error of the same user within seven days either side.

    The nearest error before and after is carried along each user's events, so there is no range join.
    """
    rows = table(spark, sf, "events").filter(F.col("event_type").isin("view", "error")).select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), (F.col("event_type") == "error").alias("mark"))
    by = Window.partitionBy("user_id").orderBy("t")
    at = F.when(F.col("mark"), F.col("t"))
    rows = rows.withColumns({"prev": F.max(at).over(by.rangeBetween(Window.unboundedPreceding, 0)), "next": F.min(at).over(by.rangeBetween(0, Window.unboundedFollowing))})
    near = F.coalesce(F.col("t") - F.col("prev") <= 604_800_000_000, F.lit(False)) | F.coalesce(F.col("next") - F.col("t") <= 604_800_000_000, F.lit(False))
    return rows.filter(~F.col("mark") & ~near).select("event_id")


@query("J11_semi", "SELECT event_id FROM events WHERE event_type = 'click' AND user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 20)")
def semi(spark, sf):
    rows = table(spark, sf, "events")
    buyers = rows.filter("event_type = 'purchase' and value > 20").select("user_id").distinct()
    return rows.filter("event_type = 'click'").join(buyers, "user_id", "left_semi").select("event_id")


@query("J12_anti", "SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 30)")
def anti(spark, sf):
    rows = table(spark, sf, "events")
    return rows.select("user_id").distinct().join(rows.filter("event_type = 'purchase' and value > 30").select("user_id"), "user_id", "left_anti")


@query("O2_recent_filtered", "SELECT event_id, user_id FROM events WHERE event_type IN ('error', 'signup') AND event_id NOT IN (SELECT event_id FROM events WHERE user_id % 7 = 0) ORDER BY event_id DESC LIMIT 20")
def recent_filtered(spark, sf):
    return table(spark, sf, "events").filter(F.col("event_type").isin("error", "signup") & (F.coalesce(F.col("user_id") % 7, F.lit(1)) != 0)).orderBy(F.desc("event_id")).limit(20).select("event_id", "user_id")


@query("O5_severity", "SELECT user_id, max(CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END)::BIGINT AS worst FROM events GROUP BY user_id")
def severity(spark, sf):
    rank = F.create_map(*[F.lit(x) for pair in (("error", 3), ("purchase", 2), ("signup", 1)) for x in pair])
    return table(spark, sf, "events").groupBy("user_id").agg(F.max(F.coalesce(F.element_at(rank, F.col("event_type")), F.lit(0))).cast("long").alias("worst"))


@query("ST1_rolling_hits", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS hits FROM events")
def rolling_hits(spark, sf):
    """Events of the same user in the last day, this one included."""
    return events(spark, sf).select("event_id", U.rolling_count(None, "user_id", "ts", 86_400).alias("hits"))


@query("ST2_over_limit", "SELECT event_id FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS hits FROM events WHERE event_type = 'click') WHERE hits > 1")
def over_limit(spark, sf):
    clicks = events(spark, sf).filter("event_type = 'click'")
    return clicks.select("event_id", U.rolling_count(None, "user_id", "ts", 3_600).alias("hits")).filter("hits > 1").select("event_id")


@query("ST9_tumbling_floor", "SELECT strftime(time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '2024-01-01'), '%Y-%m-%d %H:%M') AS bucket, count(*) AS n, count(*) < 20 AS silent FROM events GROUP BY 1")
def tumbling_floor(spark, sf):
    per = events(spark, sf).groupBy(F.window("ts", "2 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return per.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("bucket"), "n", (F.col("n") < 20).alias("silent"))


@query("X8_nth_event", "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) AS k FROM events WHERE event_type <> 'error') WHERE k = 2")
def nth_event(spark, sf):
    """The second event of a user's day that is not an error."""
    k = F.row_number().over(Window.partitionBy("user_id", "day").orderBy("ts", "event_id"))
    rows = table(spark, sf, "events").filter("event_type <> 'error'").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return rows.withColumn("k", k).filter("k = 2").select("user_id", "day", "event_id")


@query("X7_relabel", "SELECT event_id, CASE WHEN starts_with(event_type, 'p') AND user_id % 5 = 0 THEN 'team' WHEN event_type = 'error' THEN 'noise' ELSE 'real' END AS label FROM events")
def relabel(spark, sf):
    label = F.when(F.col("event_type").startswith("p") & (F.col("user_id") % 5 == 0), "team").when(F.col("event_type") == "error", "noise").otherwise("real")
    return table(spark, sf, "events").select("event_id", label.alias("label"))


@query("F23_hashed_visitor", "SELECT substr(sha256('salt' || '|' || user_id::VARCHAR), 1, 16) AS visitor, count(*) AS n FROM events GROUP BY 1")
def hashed_visitor(spark, sf):
    visitor = F.substring(F.sha2(F.concat_ws("|", F.lit("salt"), F.col("user_id").cast("string")), 256), 1, 16)
    return table(spark, sf, "events").groupBy(visitor.alias("visitor")).agg(F.count(F.lit(1)).alias("n"))


@query("S15_tolerant_json", "SELECT event_type, count(*) AS n, count(TRY_CAST(json_extract(props, '$.k') AS INT)) AS parsed, sum(TRY_CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS total FROM events WHERE contains(props, 'k') GROUP BY event_type")
def tolerant_json(spark, sf):
    """A cheap text filter first, then a parse that gives null for bad lines."""
    parsed = F.from_json("props", "k int", {"mode": "PERMISSIVE"})["k"]
    rows = table(spark, sf, "events").filter(F.col("props").contains("k")).select("event_type", parsed.alias("k"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("k").alias("parsed"), F.sum("k").alias("total"))


@query("X26_two_snapshots", "SELECT user_id FROM events WHERE event_type = 'error' AND ts < TIMESTAMP '2024-01-15' INTERSECT SELECT user_id FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-15'")
def two_snapshots(spark, sf):
    """Users failing on both looks."""
    bad = table(spark, sf, "events").filter("event_type = 'error'")
    return bad.filter("ts < TIMESTAMP_NTZ '2024-01-15'").select("user_id").intersect(bad.filter("ts >= TIMESTAMP_NTZ '2024-01-15'").select("user_id"))
