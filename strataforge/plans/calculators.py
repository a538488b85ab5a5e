"""Calculator, lookup and schedule queries over the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import calculators as C
from ..operators import lookups as L
from ..operators.links import FILLERS, RETIRED, link_class, path_words
from ..sources.tables import table
from .registry import query


def _dose_sql(drug: str, weight: str, months: str, per_ml: float) -> str:
    d = C.DOSES[drug]
    high = f"least({weight} * {d['high']}::DOUBLE, {d['single']}::DOUBLE)"
    low = f"least({weight} * {d['low']}::DOUBLE, {high})"
    out = f"CASE WHEN {weight} IS NULL OR {weight} < 1 OR {weight} > 120 THEN 'refused' WHEN coalesce({months} < 3, false) THEN 'refer' WHEN coalesce({months} < {d['months']} OR {weight} < {d['kg']}, false) THEN 'too_small' WHEN {months} IS NULL AND {weight} < 10 THEN 'ask_age' ELSE 'ok' END"
    times = f"greatest(least(floor(least({weight} * {d['day_kg']}::DOUBLE, {d['day']}::DOUBLE) / {high})::BIGINT, {24 // d['hours']}), 1)"
    return f"{out} AS {drug}, CASE WHEN {out} = 'ok' THEN round_even({low}, 1) END AS {drug}_low, CASE WHEN {out} = 'ok' THEN round_even({high}, 1) END AS {drug}_high, CASE WHEN {out} = 'ok' THEN floor({high} / {per_ml}::DOUBLE * 10) / 10 END AS {drug}_ml, CASE WHEN {out} = 'ok' THEN {times} END AS {drug}_doses"


_MONTHS = "CASE WHEN l_linenumber = 7 THEN NULL ELSE (l_partkey % 220)::DOUBLE END"


@query("F1_dose_grid", "WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity * 2.5 AS w, " + _MONTHS + " AS mo FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, " + _dose_sql("paracetamol", "w", "mo", 24.0) + ", " + _dose_sql("ibuprofen", "w", "mo", 20.0) + " FROM l")
def dose_grid(spark, sf):
    """Both drugs' doses for every line item, its quantity read as a weight and its part as an age."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity") * 2.5).alias("w"), F.when(F.col("l_linenumber") != 7, (F.col("l_partkey") % 220).cast("double")).alias("mo"))
    for drug, per_ml in (("paracetamol", 24.0), ("ibuprofen", 20.0)):
        rows = rows.withColumn("d", C.dose(F.col("w"), F.col("mo"), drug, per_ml))
        rows = rows.withColumns({drug: F.col("d.outcome"), f"{drug}_low": F.col("d.mg_low"), f"{drug}_high": F.col("d.mg_high"), f"{drug}_ml": F.col("d.ml"), f"{drug}_doses": F.col("d.doses")}).drop("d")
    return rows.drop("w", "mo")


@query("F2_strength_parse", "SELECT p_partkey, round(p_size * 10 / CASE WHEN p_partkey % 3 = 0 THEN 1.0 ELSE 5.0 END, 6) AS per_ml FROM part")
def strength_parse(spark, sf):
    """Strengths read back from text such as ``110 mg/5 ml``."""
    text = F.concat((F.col("p_size") * 10).cast("string"), F.lit(" mg/"), F.when(F.col("p_partkey") % 3 == 0, "ml").otherwise("5 ml"))
    return table(spark, sf, "part").select("p_partkey", F.round(C.strength(text), 6).alias("per_ml"))


_interp_sql = lambda x, column: L.interpolated_sql(x, L.LMS, column)
_LMS = f"WITH x AS (SELECT p_partkey, p_size::DOUBLE AS x, p_retailprice / 200 AS y FROM part), t AS (SELECT *, {_interp_sql('x', 1)} AS l, {_interp_sql('x', 2)} AS m, {_interp_sql('x', 3)} AS s FROM x), z AS (SELECT *, CASE WHEN abs(l) < 1e-9 THEN ln(y / m) / s ELSE (pow(y / m, l) - 1) / (l * s) END AS z FROM t)"


def _lms_rows(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 200).alias("y"))
    rows = rows.withColumns({n: L.interpolated(F.col("x"), L.LMS, k) for k, n in ((1, "l"), (2, "m"), (3, "s"))})
    return rows.withColumn("z", C.lms_z(F.col("y"), F.col("l"), F.col("m"), F.col("s")))


@query("J6_lms_interpolate", _LMS + " SELECT p_partkey, round(l, 6) AS l, round(m, 6) AS m, round(s, 6) AS s FROM t")
def lms_interpolate(spark, sf):
    return _lms_rows(spark, sf).select("p_partkey", *[F.round(c, 6).alias(c) for c in ("l", "m", "s")])


_ERF = "(1 - t2 * (0.254829592 + t2 * (-0.284496736 + t2 * (1.421413741 + t2 * (-1.453152027 + t2 * 1.061405429)))) * exp(-x2 * x2))"


@query("F3_lms_z", _LMS + f", e AS (SELECT *, abs(z) / sqrt(2.0::DOUBLE) AS x2, 1 / (1 + 0.3275911 * (abs(z) / sqrt(2.0::DOUBLE))) AS t2 FROM z) SELECT p_partkey, round(z, 5) AS z, round(50 * (1 + sign(z) * {_ERF}), 4) AS percentile FROM e")
def lms_score(spark, sf):
    return _lms_rows(spark, sf).select("p_partkey", F.round("z", 5).alias("z"), F.round(C.percentile(F.col("z")), 4).alias("percentile"))


@query("F5_who_flags", _LMS + " SELECT CASE WHEN z IS NULL THEN NULL WHEN z < -3 THEN 'severe_low' WHEN z < -2 THEN 'low' WHEN z < 2 THEN 'usual' WHEN z < 3 THEN 'high' ELSE 'very_high' END AS flag, count(*) AS n, count(*) FILTER (z < -3 OR z >= 3) AS urgent FROM z GROUP BY 1")
def who_flags(spark, sf):
    z = F.col("z")
    return _lms_rows(spark, sf).groupBy(C.cut_label(z).alias("flag")).agg(F.count(F.lit(1)).alias("n"), F.count_if((z < -3) | (z >= 3)).alias("urgent"))


@query("F6_bands", _LMS + ", g AS (SELECT *, unnest([-1.88079, -1.03643, 0.0, 1.03643, 1.88079])::DOUBLE AS bz FROM t) SELECT p_partkey, bz, round(CASE WHEN abs(l) < 1e-9 THEN m * exp(s * bz) ELSE m * pow(1 + l * s * bz, 1 / l) END, 5) AS value FROM g")
def bands(spark, sf):
    rows = _lms_rows(spark, sf).withColumn("bz", F.explode(F.array(*[F.lit(z) for z in C.BAND_Z])))
    return rows.select("p_partkey", "bz", F.round(C.lms_value(F.col("bz"), F.col("l"), F.col("m"), F.col("s")), 5).alias("value"))


_BOTH_SEXES = ", ".join(f"(pow(kg / {L.interpolated_sql('age', rows, 2)}, {L.interpolated_sql('age', rows, 1)}) - 1) / ({L.interpolated_sql('age', rows, 1)} * {L.interpolated_sql('age', rows, 3)}) AS z_{sex}" for sex, rows in L.GROWTH.items())


@query("F7_extreme_note", f"SELECT p_partkey, round(greatest(z_boy, z_girl), 5) AS most, round(least(z_boy, z_girl), 5) AS least, CASE WHEN greatest(z_boy, z_girl) < -3 THEN 'too light for either' WHEN least(z_boy, z_girl) > 3 THEN 'too heavy for either' END AS note FROM (SELECT p_partkey, {_BOTH_SEXES} FROM (SELECT p_partkey, p_size::DOUBLE AS age, p_retailprice / 80 AS kg FROM part))")
def extreme_note(spark, sf):
    """A weight is noted if it is extreme by both sexes' tables, so that an unknown sex makes no difference."""
    rows = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("age"), (F.col("p_retailprice") / 80).alias("kg"))
    both = [L.growth_z(F.lit(sex), F.col("age"), F.col("kg")) for sex in L.GROWTH]
    most, least = F.greatest(*both), F.least(*both)
    note = F.when(most < -3, "too light for either").when(least > 3, "too heavy for either")
    return rows.select("p_partkey", F.round(most, 5).alias("most"), F.round(least, 5).alias("least"), note.alias("note"))


@query("F8_arm_band", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 80 NOT BETWEEN 6 AND 59 THEN 'wrong_age' WHEN l_quantity * 5 NOT BETWEEN 70 AND 250 THEN 'odd' WHEN l_quantity * 5 < 115 THEN 'severe' WHEN l_quantity * 5 < 125 THEN 'moderate' ELSE 'ok' END AS band FROM lineitem")
def arm_band(spark, sf):
    mm, age = F.col("l_quantity") * 5, F.col("l_partkey") % 80
    band = F.when(~age.between(6, 59), "wrong_age").when(~mm.between(70, 250), "odd").when(mm < 115, "severe").when(mm < 125, "moderate").otherwise("ok")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", band.alias("band"))


@query("F9_advice_bands", "SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'infant,child,teen' WHEN c_custkey % 200 < 24 THEN 'infant' WHEN c_custkey % 200 < 120 THEN 'child' ELSE 'teen' END AS advice FROM customer")
def advice_bands(spark, sf):
    """Advice by age; an unknown age gets all of it."""
    age = F.when(F.col("c_custkey") % 9 != 0, F.col("c_custkey") % 200)
    advice = F.when(age.isNull(), F.array(F.lit("infant"), F.lit("child"), F.lit("teen"))).when(age < 24, F.array(F.lit("infant"))).when(age < 120, F.array(F.lit("child"))).otherwise(F.array(F.lit("teen")))
    return table(spark, sf, "customer").select("c_custkey", F.array_join(advice, ",").alias("advice"))


@query("F11_first_numbers", r"SELECT page_id, TRY_CAST(nullif(regexp_extract(url, '([0-9]+)', 1), '') AS BIGINT) AS first_number, len(list_distinct(regexp_extract_all(url, '[0-9]+'))) AS numbers FROM pages")
def first_numbers(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.nullif(F.regexp_extract("url", "([0-9]+)", 1), F.lit("")).cast("long").alias("first_number"), F.size(F.array_distinct(F.regexp_extract_all("url", F.lit("[0-9]+"), 0))).cast("long").alias("numbers"))


@query("F12_age_parse", "SELECT o_orderkey, round(CASE o_orderkey % 4 WHEN 0 THEN (o_custkey % 17) * 12.0 WHEN 1 THEN (o_custkey % 17)::DOUBLE WHEN 2 THEN (o_custkey % 17) * 7 / 30.4375 ELSE (o_custkey % 17) / 30.4375 END, 6) AS months FROM orders")
def age_parse(spark, sf):
    """Ages in months read from phrases."""
    unit = F.element_at(F.array(*[F.lit(u) for u in ("years", "months", "weeks", "days")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    text = F.concat(F.lit("my child is "), (F.col("o_custkey") % 17).cast("string"), F.lit(" "), unit, F.lit(" old"))
    return table(spark, sf, "orders").select("o_orderkey", F.round(C.age_months(text), 6).alias("months"))


@query("F13_schedule_codes", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN CASE WHEN p_size < 2 THEN p_size * 12 ELSE p_size * 12 END WHEN p_size % 3 = 1 THEN p_size ELSE 0 END::BIGINT AS months, CASE WHEN p_size % 3 = 2 THEN 'B' WHEN CASE WHEN p_size % 3 = 0 THEN p_size * 12 ELSE p_size END >= 24 AND CASE WHEN p_size % 3 = 0 THEN p_size * 12 ELSE p_size END % 12 = 0 THEN 'Y' ELSE 'M' END AS unit FROM part")
def schedule_codes(spark, sf):
    """Codes such as Y3, M18, B0 as months and the unit they are best said in."""
    code = F.concat(F.element_at(F.array(F.lit("Y"), F.lit("M"), F.lit("B")), (F.col("p_size") % 3 + 1).cast("int")), F.col("p_size").cast("string"))
    letter, n = F.regexp_extract(code, "^([BWMY])([0-9]+)$", 1), F.regexp_extract(code, "^([BWMY])([0-9]+)$", 2).cast("long")
    months = F.when(letter == "Y", n * 12).when(letter == "M", n).otherwise(0).cast("long")
    unit = F.when(letter == "B", "B").when((months >= 24) & (months % 12 == 0), "Y").otherwise("M")
    return table(spark, sf, "part").select("p_partkey", months.alias("months"), unit.alias("unit"))


@query("F14_month_arithmetic", "SELECT o_orderkey, strftime(o_orderdate + to_months((o_custkey % 13)::INT), '%Y-%m-%d') AS due, date_diff('day', o_orderdate::DATE, DATE '2002-01-01') / 30.4375::DOUBLE >= 48 AS over_four FROM orders")
def month_arithmetic(spark, sf):
    """Calendar months with month ends kept, and average months from days."""
    due = F.add_months(F.to_date("o_orderdate"), (F.col("o_custkey") % 13).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", F.date_format(due, "yyyy-MM-dd").alias("due"), (F.datediff(F.lit("2002-01-01").cast("date"), F.to_date("o_orderdate")) / C.MONTH_DAYS >= 48).alias("over_four"))


_AGES = "WITH a AS (SELECT o_orderkey, o_custkey, round(date_diff('day', TIMESTAMP '1992-01-01', o_orderdate) / 30.4375, 3) % 75 AS age FROM orders), s(month, label, next_month) AS (VALUES " + ", ".join(f"({m}::DOUBLE, '{label}', {L.SCHEDULE[i + 1][0] if i + 1 < len(L.SCHEDULE) else 'NULL'})" for i, (m, label) in enumerate(L.SCHEDULE)) + ")"


def _ages(spark, sf):
    age = F.round(F.datediff(F.col("o_orderdate"), F.lit("1992-01-01")) / C.MONTH_DAYS, 3) % 75
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", age.alias("age"))


@query("J4_band_join_schedule", _AGES + " SELECT o_orderkey, label FROM a JOIN s ON abs(age - month) <= CASE WHEN age < 24 THEN 1.5 ELSE 6 END")
def band_join(spark, sf):
    """Schedule slots near each age. Slots are found through a 12-month bin and its neighbours, so the join is on equal keys."""
    slots = L.schedule(spark).withColumn("bin", F.explode(F.sequence(F.floor((F.col("month") - 6) / 12), F.floor((F.col("month") + 6) / 12))))
    rows = _ages(spark, sf).withColumn("bin", F.floor(F.col("age") / 12))
    return rows.join(slots, "bin").filter(F.abs(F.col("age") - F.col("month")) <= L.tolerance(F.col("age"))).select("o_orderkey", "label")


@query("J5_next_slot", _AGES + " SELECT o_orderkey, min(month) AS next_month FROM a LEFT JOIN s ON month > age + CASE WHEN age < 24 THEN 1.5 ELSE 6 END GROUP BY o_orderkey")
def next_slot(spark, sf):
    """The first slot after each age and its tolerance, as an expression over the eight slots."""
    months = F.array(*[F.lit(m) for m, _ in L.SCHEDULE])
    age = F.col("age")
    return _ages(spark, sf).select("o_orderkey", F.array_min(F.filter(months, lambda m: m > age + L.tolerance(age))).alias("next_month"))


@query("F15_visit_state", _AGES + " SELECT state, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 10 = 0 AND month = 12 THEN 'done' WHEN abs(age - month) <= CASE WHEN age < 24 THEN 1.5 ELSE 6 END THEN 'due' WHEN month < age THEN 'pending' ELSE 'future' END AS state FROM a, s) GROUP BY state")
def visit_state(spark, sf):
    """Every slot of every child is done, due, pending or future; slots are an array, so rows only multiply by eight and are summed at once."""
    age = F.col("age")
    each = _ages(spark, sf).select("o_orderkey", "age", F.explode(F.array(*[F.lit(m) for m, _ in L.SCHEDULE])).alias("month"))
    state = F.when((F.col("o_orderkey") % 10 == 0) & (F.col("month") == 12), "done").when(F.abs(age - F.col("month")) <= L.tolerance(age), "due").when(F.col("month") < age, "pending").otherwise("future")
    return each.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("X6_next_visit", "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1")
def next_visit(spark, sf):
    rank = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    rows = table(spark, sf, "orders").groupBy("o_custkey").agg(F.min(F.struct(rank.alias("r"), "o_orderdate", "o_orderkey", "o_orderstatus")).alias("m"))
    return rows.select("o_custkey", "m.o_orderkey", "m.o_orderstatus")


@query("J1_inner_join", "SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def inner_join(spark, sf):
    """Orders are summed by customer before they meet the other tables."""
    per = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("t"))
    rows = per.join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.sum("n").alias("orders"), F.round(F.sum("t"), 2).alias("total"))


@query("J2_lookup_default", "WITH r(n_nationkey, number) AS (VALUES (0, '112'), (3, '999'), (7, '911'), (11, '000')) SELECT c_custkey, coalesce(number, CASE WHEN c_mktsegment = 'BUILDING' THEN 'dial 112' ELSE 'local number' END) AS number FROM customer LEFT JOIN r ON c_nationkey = n_nationkey")
def lookup_default(spark, sf):
    numbers = spark.createDataFrame([(0, "112"), (3, "999"), (7, "911"), (11, "000")], "c_nationkey int, number string")
    default = F.when(F.col("c_mktsegment") == "BUILDING", "dial 112").otherwise("local number")
    return L.with_default(table(spark, sf, "customer"), numbers, "c_nationkey", {"number": default}).select("c_custkey", "number")


@query("J3_alias", "WITH a(alias, real) AS (VALUES (1, 2), (5, 6), (24, 0)) SELECT coalesce(real, s_nationkey) AS nation, count(*) AS n FROM supplier LEFT JOIN a ON alias = s_nationkey WHERE coalesce(real, s_nationkey) IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (0, 2)) GROUP BY 1")
def alias(spark, sf):
    """Aliases are resolved, then membership is tested."""
    real = F.create_map(*[F.lit(x) for x in (1, 2, 5, 6, 24, 0)])
    rows = table(spark, sf, "supplier").select(F.coalesce(F.element_at(real, F.col("s_nationkey")), F.col("s_nationkey")).alias("nation"))
    known = table(spark, sf, "nation").filter(F.col("n_regionkey").isin(0, 2)).select(F.col("n_nationkey").alias("nation"))
    return rows.join(known, "nation", "left_semi").groupBy("nation").agg(F.count(F.lit(1)).alias("n"))


@query("J8_threshold_bracket", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity + 20 >= CASE WHEN l_partkey % 70 < 2 THEN 60 WHEN l_partkey % 70 < 12 THEN 50 ELSE 40 END AS fast FROM lineitem")
def threshold_bracket(spark, sf):
    age = F.col("l_partkey") % 70
    limit = F.when(age < 2, 60).when(age < 12, 50).otherwise(40)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity") + 20 >= limit).alias("fast"))


@query("J14_set_operations", "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_discount >= 0.09 AND l_returnflag = 'A'")
def set_operations(spark, sf):
    rows = table(spark, sf, "lineitem")
    return rows.filter("l_returnflag = 'R'").select("l_partkey").subtract(rows.filter("l_discount >= 0.09 and l_returnflag = 'A'").select("l_partkey"))


_GAP = 28  # days at least between two doses, and more by the dose itself


@query(
    "J16_chained_interval",
    f"""WITH RECURSIVE d AS (SELECT o_orderkey, o_custkey, epoch_us(o_orderdate) // 86400000000 AS planned, ({_GAP} + o_orderkey % 90)::BIGINT AS gap, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dose FROM orders
), c AS (SELECT o_orderkey, o_custkey, dose, planned, planned AS given FROM d WHERE dose = 1
  UNION ALL SELECT d.o_orderkey, d.o_custkey, d.dose, d.planned, greatest(d.planned, c.given + d.gap) FROM c JOIN d ON d.o_custkey = c.o_custkey AND d.dose = c.dose + 1
) SELECT o_orderkey, dose, (given - planned)::BIGINT AS moved FROM c""",
)
def chained_interval(spark, sf):
    """Each dose on its planned day, or as long after the one before as it must be, whose day was moved in the same way.

    The recursion has a closed form: the latest of all days planned so far, each plus the gaps after it, that is
    a running maximum of planned days less running sums of gaps. So it is two windows, and no loop over doses.
    """
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    planned = F.floor(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 86_400_000_000)
    dose = F.row_number().over(by)
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", planned.alias("planned"), (_GAP + F.col("o_orderkey") % 90).alias("gap"), dose.cast("long").alias("dose"))
    rows = rows.withColumn("gaps", F.sum(F.when(F.col("dose") > 1, F.col("gap")).otherwise(0)).over(upto))
    given = F.max(F.col("planned") - F.col("gaps")).over(upto) + F.col("gaps")
    return rows.select("o_orderkey", "dose", (given - F.col("planned")).cast("long").alias("moved"))


@query("J17_longest_name", "WITH n(name, code) AS (VALUES ('the', 'a'), ('there', 'b'), ('therein', 'c'), ('eau', 'd'), ('sch', 'e'), ('tion', 'f')) SELECT conv_id, turn, arg_max(code, length(name) * 1000 + ascii(code)) AS code FROM conversations JOIN n ON contains(lower(text), name) GROUP BY conv_id, turn HAVING count(*) > 0")
def longest_name(spark, sf):
    """The longest of a list of names that a text holds; names are tested in place, without a join."""
    names = [("the", "a"), ("there", "b"), ("therein", "c"), ("eau", "d"), ("sch", "e"), ("tion", "f")]
    text = F.lower("text")
    best = F.array_max(F.array(*[F.when(text.contains(n), F.struct(F.lit(len(n)).alias("size"), F.lit(c).alias("code"))) for n, c in names]))
    return table(spark, sf, "conversations").select("conv_id", "turn", best["code"].alias("code")).filter("code is not null")


@query("J18_unique_match", "SELECT o_custkey, CASE WHEN count(*) = 1 THEN min(o_orderkey) END AS only_order FROM orders WHERE o_orderpriority = '2-HIGH' GROUP BY o_custkey")
def unique_match(spark, sf):
    return table(spark, sf, "orders").filter("o_orderpriority = '2-HIGH'").groupBy("o_custkey").agg(F.when(F.count(F.lit(1)) == 1, F.min("o_orderkey")).alias("only_order"))


@query("J19_keep_older", "SELECT a.o_orderkey AS kept, b.o_orderkey AS dropped FROM orders a JOIN orders b ON a.o_orderkey = b.o_orderkey - 1 AND a.o_orderkey % 40 = 0 WHERE a.o_orderdate <= b.o_orderdate UNION ALL SELECT b.o_orderkey, a.o_orderkey FROM orders a JOIN orders b ON a.o_orderkey = b.o_orderkey - 1 AND a.o_orderkey % 40 = 0 WHERE a.o_orderdate > b.o_orderdate")
def keep_older(spark, sf):
    """Of declared pairs the older one stays; both sides of a pair meet in one group, so a single shuffle does."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderdate").filter((F.col("o_orderkey") % 40).isin(0, 1)).withColumn("pair", F.floor(F.col("o_orderkey") / 40))
    at = F.struct("o_orderdate", "o_orderkey")
    per = rows.groupBy("pair").agg(F.min(at).alias("lo"), F.max(at).alias("hi"), F.count(F.lit(1)).alias("n")).filter("n = 2")
    return per.select(F.col("lo.o_orderkey").alias("kept"), F.col("hi.o_orderkey").alias("dropped"))


@query("J20_run_diff", "WITH a AS (SELECT o_orderkey, o_orderstatus AS s FROM orders WHERE o_orderkey % 7 <> 0), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 11 <> 0) SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, a.s AS before, b.s AS after FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.s IS DISTINCT FROM b.s")
def run_diff(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    a = rows.filter("o_orderkey % 7 <> 0").withColumnRenamed("o_orderstatus", "before")
    b = rows.filter("o_orderkey % 11 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderstatus")).alias("after"))
    return a.join(b, "o_orderkey", "full").filter(~F.col("before").eqNullSafe(F.col("after")))


@query("O7_country_forms", "SELECT p_brand, p_partkey, place FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN abs(p_size / 10.0 - 2.4) <= 0.05 + 1e-9 THEN 0 ELSE 1 END, p_partkey) AS place FROM part) WHERE place <= 3")
def country_forms(spark, sf):
    """Forms of a matching concentration first, three of each brand."""
    near = F.when(F.abs(F.col("p_size") / 10.0 - 2.4) <= 0.05 + 1e-9, 0).otherwise(1)
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy(near, "p_partkey")).cast("long")
    return table(spark, sf, "part").withColumn("place", place).filter("place <= 3").select("p_brand", "p_partkey", "place")


@query("O6_seasonal_order", "SELECT n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY CASE WHEN (n_nationkey + CASE WHEN n_regionkey >= 3 THEN 6 ELSE 0 END) % 12 IN (0, 1, 2) THEN 0 ELSE 1 END, n_nationkey) AS place FROM nation")
def seasonal_order(spark, sf):
    month = (F.col("n_nationkey") + F.when(F.col("n_regionkey") >= 3, 6).otherwise(0)) % 12
    by = Window.partitionBy("n_regionkey").orderBy(F.when(month.isin(0, 1, 2), 0).otherwise(1), "n_nationkey")
    return table(spark, sf, "nation").select("n_nationkey", F.row_number().over(by).cast("long").alias("place"))


@query("X1_name_resolve", "WITH n(key, alias, pri) AS (VALUES ('bolts', 'bolt', 1), ('rings', 'ring', 1), ('widgets', 'widg', 2), ('gears', 'gear', 2), ('reds', 'red', 3)) SELECT p_partkey, arg_min(key, pri * 100 + ascii(key)) AS drug FROM part JOIN n ON (pri = 1 AND list_contains(string_split(p_name, ' '), alias)) OR (pri > 1 AND len(list_filter(string_split(p_name, ' '), lambda w: starts_with(w, alias))) > 0) GROUP BY p_partkey")
def name_resolve(spark, sf):
    """Exact names before prefixes, in catalogue order."""
    names = [("bolts", "bolt", 1), ("rings", "ring", 1), ("gears", "gear", 2), ("widgets", "widg", 2), ("reds", "red", 3)]
    words = F.split("p_name", " ")
    found = F.coalesce(*[F.when(F.array_contains(words, a) if p == 1 else F.exists(words, _starts(a)), F.lit(k)) for k, a, p in names])
    return table(spark, sf, "part").select("p_partkey", found.alias("drug")).filter("drug is not null")


def _starts(prefix: str):
    return lambda w: w.startswith(prefix)


@query("X3_in_country_first", "SELECT s_suppkey, place FROM (SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey % 5 ORDER BY CASE WHEN s_nationkey < 10 THEN 0 ELSE 1 END, s_name) AS place FROM supplier) WHERE place <= 5")
def in_country_first(spark, sf):
    place = F.row_number().over(Window.partitionBy(F.col("s_nationkey") % 5).orderBy(F.when(F.col("s_nationkey") < 10, 0).otherwise(1), "s_name")).cast("long")
    return table(spark, sf, "supplier").select("s_suppkey", place.alias("place")).filter("place <= 5")


@query("X10_first_url", "SELECT host, url FROM (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, url, row_number() OVER (PARTITION BY regexp_extract(url, '://([^/?#]*)', 1) ORDER BY CASE WHEN url LIKE 'https%' THEN 0 ELSE 1 END, page_id) AS k FROM pages) WHERE k = 1")
def first_url(spark, sf):
    """The first url of each host, secure ones before others: a minimum, so a hot host is merged before the shuffle."""
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    rank = F.when(F.col("url").startswith("https"), 0).otherwise(1)
    return table(spark, sf, "pages").groupBy(host.alias("host")).agg(F.min(F.struct(rank.alias("r"), "page_id", "url")).alias("m")).select("host", "m.url")


@query("X24_nested_export", "SELECT c_custkey, '[' || string_agg('{\"o_orderkey\":' || o_orderkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}', ',' ORDER BY o_orderkey) || ']' AS orders FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def nested_export(spark, sf):
    """Each customer's orders as a JSON array."""
    per = table(spark, sf, "orders").groupBy("o_custkey").agg(F.to_json(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus")))).alias("orders"))
    return table(spark, sf, "customer").select("c_custkey").join(per, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "orders")


@query("X12_country_by_majority", "WITH c AS (SELECT l_orderkey, s_nationkey AS n, count(*) AS c FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL) SELECT l_orderkey, n FROM (SELECT *, sum(c) OVER (PARTITION BY l_orderkey) AS t FROM c) WHERE c >= 0.8 * t")
def country_by_majority(spark, sf):
    """The nation of an order's suppliers if four fifths of its lines agree; lines are counted before they are compared."""
    nation = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n"))
    per = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").join(nation, "l_suppkey").groupBy("l_orderkey", "n").agg(F.count(F.lit(1)).alias("c"))
    total = F.sum("c").over(Window.partitionBy("l_orderkey"))
    return per.withColumn("t", total).filter(F.col("c") >= 0.8 * F.col("t")).select("l_orderkey", "n")


@query("Y1_weight_table", "SELECT p_partkey, w AS kg, round(floor(least(w * 15.0, 1000) / (p_size * 1.0) * 10) / 10, 1) AS ml FROM part, (SELECT unnest(range(5, 41)) AS w)")
def weight_table(spark, sf):
    """A dose for every whole weight and every form; the grid is an exploded sequence, bounded by 36."""
    rows = table(spark, sf, "part").select("p_partkey", "p_size", F.explode(F.sequence(F.lit(5), F.lit(40))).alias("kg"))
    return rows.select("p_partkey", F.col("kg").cast("long").alias("kg"), F.round(C.tenth_down(F.least(F.col("kg") * 15.0, F.lit(1000.0)) / (F.col("p_size") * 1.0)), 1).alias("ml"))


@query("Y3_first_per_slug", "SELECT slug, p_partkey FROM (SELECT replace(p_name, ' ', '-') AS slug, p_partkey, row_number() OVER (PARTITION BY replace(p_name, ' ', '-') ORDER BY p_partkey) AS k FROM part) WHERE k = 1")
def first_per_slug(spark, sf):
    return table(spark, sf, "part").groupBy(F.replace("p_name", F.lit(" "), F.lit("-")).alias("slug")).agg(F.min("p_partkey").alias("p_partkey"))


@query("Y6_ring_related", "WITH r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos, count(*) OVER (PARTITION BY p_brand) AS n FROM part) SELECT a.p_partkey, b.p_partkey AS related, k::BIGINT AS k FROM r a, (SELECT unnest([1, 2]) AS k) JOIN r b ON b.p_brand = a.p_brand AND b.pos = (a.pos + k) % a.n WHERE a.n > 2")
def ring_related(spark, sf):
    """The two that follow each item around its category's ring, by lead with a wrap to the first."""
    by = Window.partitionBy("p_brand")
    order = by.orderBy("p_partkey")
    rows = table(spark, sf, "part").select("p_partkey", "p_brand").withColumns({"n": F.count(F.lit(1)).over(by), "pos": F.row_number().over(order) - 1, "r1": F.lead("p_partkey", 1).over(order), "r2": F.lead("p_partkey", 2).over(order)})
    heads = table(spark, sf, "part").withColumn("i", F.row_number().over(order)).filter("i <= 2").groupBy("p_brand").agg(F.min("p_partkey").alias("f0"), F.max("p_partkey").alias("f1"))
    rows = rows.filter("n > 2").join(heads, "p_brand")
    one = F.coalesce("r1", "f0")
    two = F.when(F.col("r2").isNotNull(), F.col("r2")).when(F.col("r1").isNotNull(), F.col("f0")).otherwise(F.col("f1"))
    return rows.select("p_partkey", F.explode(F.array(F.struct(F.lit(1).cast("long").alias("k"), one.alias("related")), F.struct(F.lit(2).cast("long").alias("k"), two.alias("related")))).alias("x")).select("p_partkey", "x.related", "x.k")


@query("Y7_langs_of_sale", "WITH c(nation, lang) AS (VALUES (0, 'en'), (1, 'en'), (2, 'fr'), (3, 'de'), (4, 'es'), (5, 'fr'), (6, 'es')), s AS (SELECT s_nationkey % 7 AS nation, s_suppkey % 20 AS brand FROM supplier) SELECT brand, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM s JOIN c USING (nation) GROUP BY brand")
def langs_of_sale(spark, sf):
    lang = F.element_at(F.create_map(*[F.lit(x) for p in ((0, "en"), (1, "en"), (2, "fr"), (3, "de"), (4, "es"), (5, "fr"), (6, "es")) for x in p]), F.col("s_nationkey") % 7)
    return table(spark, sf, "supplier").groupBy((F.col("s_suppkey") % 20).alias("brand")).agg(F.array_join(F.sort_array(F.collect_set(lang)), ",").alias("langs"))


@query("Y10_next_due", "SELECT o_custkey, strftime(max(o_orderdate) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M') AS due, max(o_orderdate) + INTERVAL 6 HOUR < TIMESTAMP '1998-01-01' AS ready FROM orders GROUP BY o_custkey")
def next_due(spark, sf):
    due = F.max(F.col("o_orderdate").cast("timestamp")) + F.expr("INTERVAL 6 HOURS")
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.date_format(due, "yyyy-MM-dd HH:mm").alias("due"), (due < F.lit("1998-01-01").cast("timestamp")).alias("ready"))


@query("C20_short_name", r"SELECT p_partkey, trim(regexp_replace(p_name || ' (10 mg) - ' || p_type, '\([^)]*[0-9][^)]*\)| - .*$', '', 'g')) AS short_name FROM part")
def short_name(spark, sf):
    name = F.concat("p_name", F.lit(" (10 mg) - "), "p_type")
    return table(spark, sf, "part").select("p_partkey", F.trim(F.regexp_replace(name, r"\([^)]*[0-9][^)]*\)| - .*$", "")).alias("short_name"))


@query("A13_families", "SELECT p_type, min(p_name) AS family FROM (SELECT p_type, p_name, row_number() OVER (PARTITION BY p_type ORDER BY length(p_name) DESC, p_name) AS k FROM part) WHERE k = 1 GROUP BY p_type")
def families(spark, sf):
    """The longest name of each type, the first by name on ties."""
    per = table(spark, sf, "part").groupBy("p_type").agg(F.min(F.struct((-F.length("p_name")).alias("o"), "p_name")).alias("m"))
    return per.select("p_type", F.col("m.p_name").alias("family"))


@query("A14_slots", "SELECT p_size, bool_and(p_retailprice > 950) AS all_dear, string_agg(DISTINCT p_type, ' or ' ORDER BY p_type) AS types FROM part GROUP BY p_size")
def slots(spark, sf):
    return table(spark, sf, "part").groupBy("p_size").agg(F.bool_and(F.col("p_retailprice") > 950).alias("all_dear"), F.array_join(F.sort_array(F.collect_set("p_type")), " or ").alias("types"))


_LINK_WORDS = "list_distinct(list_filter(string_split_regex(lower(regexp_replace(%s, '^https?://[^/]+', '')), '[^a-z0-9]+'), lambda w: len(w) > 2 AND w NOT IN (" + ", ".join(f"'{w}'" for w in FILLERS) + ")))"
_PLAIN = "regexp_replace(url_decode(%s), '/+$', '')"
LINKS = f"""WITH t AS (SELECT page_id, url, html, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages
), c AS (SELECT title, min_by(url, page_id) AS cited FROM t WHERE title <> '' GROUP BY title
), w AS (SELECT page_id, cited, url, html LIKE '%</html>%' AS answers, {_LINK_WORDS % 'cited'} AS own, {_LINK_WORDS % 'url'} AS now FROM t JOIN c USING (title)
), links AS (SELECT page_id, len(list_intersect(own, now))::BIGINT AS shared, CASE WHEN cited IS NULL THEN NULL WHEN url IS NULL OR NOT coalesce(answers, false) THEN 'broken' WHEN regexp_matches(url, '{RETIRED}') THEN 'retired'
  WHEN {_PLAIN % 'cited'} = {_PLAIN % 'url'} THEN 'same' WHEN len(own) > 0 AND NOT list_has_any(own, now) THEN 'topic' ELSE 'moved' END AS class FROM w)
"""


def cited_links(spark, sf):
    """page_id, class, shared of each page: the address first seen with its title is the cited one, its own is where the title is now."""
    rows = table(spark, sf, "pages").select("page_id", "url", F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), F.contains("html", F.lit("</html>")).alias("answers"))
    cited = rows.filter("title <> ''").groupBy("title").agg(F.min_by("url", "page_id").alias("cited"))
    shared = F.size(F.array_intersect(path_words(F.col("cited")), path_words(F.col("url")))).cast("long")
    return rows.join(cited, "title").select("page_id", link_class(F.col("cited"), F.col("url"), F.col("answers")).alias("class"), shared.alias("shared"))


@query("F17_url_overlap", LINKS + "SELECT page_id, class, shared FROM links")
def url_overlap(spark, sf):
    """What became of the address of each page's title: the words of both paths tell a move from another topic."""
    return cited_links(spark, sf)


@query("F19_url_channel", "SELECT CASE WHEN url LIKE '%utm_source=%' THEN 'campaign' WHEN regexp_extract(url, '://([^/?#]*)', 1) LIKE 'blog.%' THEN 'blog' WHEN regexp_extract(url, '://([^/?#]*)', 1) LIKE 'm.%' THEN 'mobile' ELSE 'site' END AS channel, count(*) AS n FROM pages GROUP BY 1")
def url_channel(spark, sf):
    host = F.parse_url(F.col("url"), F.lit("HOST"))
    channel = F.when(F.col("url").contains("utm_source="), "campaign").when(host.startswith("blog."), "blog").when(host.startswith("m."), "mobile").otherwise("site")
    return table(spark, sf, "pages").groupBy(channel.alias("channel")).agg(F.count(F.lit(1)).alias("n"))


@query("F24_truncate_post", "SELECT page_id, CASE WHEN length(url) + 31 <= 60 THEN regexp_extract(html, '(?is)<title[^>]*>(.{0,30})', 1) || ' ' || url ELSE substr(regexp_extract(html, '(?is)<title[^>]*>(.{0,30})', 1), 1, 20) || '… ' || url END AS post FROM pages")
def truncate_post(spark, sf):
    title = F.regexp_extract("html", "(?is)<title[^>]*>(.{0,30})", 1)
    post = F.when(F.length("url") + 31 <= 60, F.concat(title, F.lit(" "), "url")).otherwise(F.concat(F.substring(title, 1, 20), F.lit("… "), "url"))
    return table(spark, sf, "pages").select("page_id", post.alias("post"))
