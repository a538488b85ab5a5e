"""Truth table of intents and outcomes, in five languages."""

from pyspark.sql import functions as F

from strataforge.functions.text import search_terms
from strataforge.operators import lookups as L
from strataforge.operators import router

TRUTH = [
    ("how much paracetamol for 12 kg", "dose with weight", "dose_calculator"),
    ("paracetamol for 12 kg or 14,5 kg", "dose with weight", "dose_two_weights"),
    ("wie viel ibuprofen soll ich geben", "", "dose_ask_weight"),
    ("combien de sirop dois-je donner", "", "which_drug"),
    ("can i alternate ibuprofen and paracetamol", "combine", "drafted"),
    ("paracetamol und ibuprofen gleichzeitig", "combine", "drafted"),
    ("which vaccines does a baby get in germany", "vaccine schedule", "vaccine_schedule"),
    ("calendario vacunal", "vaccine schedule", "no_schedule"),
    ("calendrier vaccinal en france", "vaccine schedule", "vaccine_schedule"),
    ("muac of 11 cm", "arm tape", "muac"),
    ("he weighs 12 kg and is 88 cm", "growth", "growth_chart"),
    ("which percentile is that", "growth", "growth_chart"),
    ("número de emergencias", "emergency number", "emergency_number"),
    ("qual é o número de emergência", "emergency number", "emergency_number"),
    ("my dog has a cough", "off topic", "off_topic"),
    ("mein mann hat husten", "adult", "adult"),
    ("who are you", "", "about"),
    ("quién eres", "", "about"),
    ("impfaufklärung masern", "", "vis_list"),
    ("red spots after bathing yesterday", "", "drafted"),
    ("rash here", "", "no_source"),
    ("the", "", "clarify"),
    (None, "", "clarify"),
]


def test_truth_table(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(TRUTH)], "i int, text string")
    got = router.routed(rows, "text", F.size(search_terms(F.coalesce("text", F.lit("")))))
    assert got.columns == ["i", "text", "intents", "outcome"]
    found = [(r["text"], ",".join(r["intents"]), r["outcome"]) for r in got.orderBy("i").collect()]
    assert found == TRUTH
    assert {o for *_, o in TRUTH} == set(router.OUTCOMES)
    assert {x for _, i, _ in TRUTH for x in i.split(",") if x} == set(router.INTENTS)


def test_growth_at_an_age(spark):
    rows = spark.createDataFrame([("boy", 12.0, 9.6479), ("girl", 12.0, 8.9481), ("boy", 18.0, (9.6479 + 12.1515) / 2), (None, 12.0, 9.0), ("girl", 61.0, 18.0), ("boy", -1.0, 3.0)], "sex string, age double, kg double").coalesce(1)
    z = [r[0] for r in rows.select(L.growth_z(F.col("sex"), F.col("age"), F.col("kg"))).collect()]
    assert [None if x is None else round(x, 9) for x in z] == [0.0, 0.0, 0.0, None, None, None]
