"""Truth tables of guards, in five languages; two forms of the same guards."""

import random

from pyspark.sql import functions as F

from strataforge.operators import rules as T


FEVER = [T.Rule("fever", "urgent", ["fever", "fieber", "fièvre", "fiebre", "febre"]), T.Rule("breath", "emergency", ["not breathing", "breathing badly", "atmet nicht", "ne respire pas", "no respira", "não respira"]), T.Rule("pulse", "emergency", ["no pulse", "kein puls", "pas de pouls", "sin pulso", "sem pulso"])]


def hits(spark, rows, rules=FEVER):
    """Rules hit in each (text, lang), by intervals."""
    found = T.with_hits(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, l string"), "t", "l", rules)
    return [[h["label"] for h in r["found"]["hits"]] for r in found.orderBy("i").collect()]


TRUTH = [
    ("he has no fever", "en", []),
    ("he has fever", "en", ["fever"]),
    ("no cough. fever", "en", ["fever"]),
    ("no cough but fever", "en", ["fever"]),
    ("no cough, fever", "en", ["fever"]),
    ("no cough, or fever", "en", []),
    ("no, it was a very long time since that fever", "en", ["fever"]),
    ("he is not breathing", "en", ["breath"]),
    ("no fever, and not breathing", "en", ["breath"]),
    ("not breathing and fever", "en", ["breath", "fever"]),
    ("there is no pulse", "en", ["pulse"]),
    ("no cough, no fever, no pulse", "en", ["pulse"]),
    ("what is not breathing", "en", []),
    ("if he is not breathing, call", "en", []),
    ("if fever rises", "en", []),
    ("he falls and has fever", "en", ["fever"]),
    ("he falls and has fever", None, ["fever"]),
    ("how to avoid fever, he has fever", "en", ["fever"]),
    ("why does fever come? he has fever", "en", ["fever"]),
    ("why does fever come, i do not know", "en", ["fever"]),
    ("two years ago he had fever\nfever now", "en", ["fever"]),
    ("could you explain fever. fever", "en", ["fever"]),
    ("afever", "en", []),
    ("feverish", "en", ["fever"]),
    ("er hat kein fieber", "de", []),
    ("er hat fieber", "de", ["fever"]),
    ("er atmet nicht", "de", ["breath"]),
    ("kein husten aber fieber", "de", ["fever"]),
    ("falls er fieber bekommt", "de", []),
    ("was ist fieber", "de", []),
    ("wie kann ich fieber verhindern", "de", []),
    ("vor zwei jahren hatte er fieber", "de", []),
    ("kein puls", "de", ["pulse"]),
    ("il n'a pas de fièvre", "fr", []),
    ("il a de la fièvre", "fr", ["fever"]),
    ("il ne respire pas", "fr", ["breath"]),
    ("si il a de la fièvre", "fr", []),
    ("pas de toux mais fièvre", "fr", ["fever"]),
    ("pas de pouls", "fr", ["pulse"]),
    ("comment éviter la fièvre", "fr", []),
    ("no tiene fiebre", "es", []),
    ("tiene fiebre", "es", ["fever"]),
    ("no respira", "es", ["breath"]),
    ("no tiene tos pero tiene fiebre", "es", ["fever"]),
    ("no tiene tos ni fiebre", "es", []),
    ("sin pulso", "es", ["pulse"]),
    ("hace dos años tuvo fiebre", "es", []),
    ("¿el sarampión puede dar fiebre?", "es", []),
    ("não tem febre", "pt", []),
    ("tem febre", "pt", ["fever"]),
    ("não respira", "pt", ["breath"]),
    ("sem pulso", "pt", ["pulse"]),
    ("não tem tosse mas tem febre", "pt", ["fever"]),
    ("se tiver febre", "pt", []),
    (None, "en", []),
    ("", None, []),
]


def test_guards_in_five_languages(spark):
    got = hits(spark, [(t, lang) for t, lang, _ in TRUTH])
    assert [(t, lang, g) for (t, lang, _), g in zip(TRUTH, got)] == TRUTH


def test_intervals_agree_with_replacements(spark):
    """The guards around matches and those that rewrite whole texts leave the same matches, in random sentences."""
    r = random.Random(5)
    parts = ["no", "not", "fever", "not breathing", "no pulse", "breathing badly", "but", "and", "or", ",", ", ", ". ", "?", "\n", ";", "!", "if", "what is", "how to avoid", "why does", "two years ago", "kein", "nicht", "fieber", "falls er", "pas", "fièvre", "mais", "sin", "fiebre", "he", "has", "the child", "x", "could you explain", "feverish", "nofever", "can cause", "ni", "puede dar"]
    rows = [(i, "".join(r.choice(parts) + r.choice([" ", " ", " ", ""]) for _ in range(r.randint(1, 14)))) for i in range(3000)]
    frame = spark.createDataFrame(rows, "i int, t string")
    for lang in (None, "en", "de", "es"):
        by_intervals = T.with_hits(frame.withColumn("l", F.lit(lang).cast("string")), "t", "l", FEVER).select("i", "t", F.array_sort(F.transform("found.hits", lambda h: h["label"])).alias("a"))
        left = T.left_of(F.col("t"), FEVER, lang)
        counted = F.flatten(F.array(*[F.array_repeat(F.lit(rule.name), F.regexp_count(F.col("left"), F.lit(T.rule_pattern(FEVER, k)))) for k, rule in enumerate(FEVER)]))
        both = by_intervals.withColumn("left", left).withColumn("b", F.array_sort(counted))
        assert both.filter("a != b").select("t", "a", "b", "left").limit(5).collect() == []
        assert both.filter("size(a) > 0").count() > 500


def test_unit_rewrite(spark):
    rows = spark.createDataFrame([("it was 101 F and 500 F",), (None,), ("",), ("22 lbs, 101.5°F101F 10 Feet",)], "t string").coalesce(1)
    assert [r[0] for r in rows.select(T.with_converted_units(F.col("t"))).collect()] == ["it was 101 F (38.3 C) and 500 F", None, "", "22 lbs (10.0 kg), 101.5°F101F (38.3 C) 10 Feet"]


def test_levels(spark):
    rules = [T.Rule("a", "urgent", ["x"], contradicted_if=["not really"]), T.Rule("b", "emergency", ["yy"]), T.Rule("c", "urgent", ["z"], mild_if=["little"], serious_if=["very"]), T.Rule("d", "mental_health", ["w"], requires=["young", "hot"])]
    rows = spark.createDataFrame([(t, None) for t in ("x yy", "x", "q", "z little", "z little very", "no x", "why does x?", "x, not really", "z little baby", "baby hot", "w", "baby")], "t string, l string").coalesce(1)
    flags = {"young": F.col("t").contains("baby"), "hot": F.col("t").contains("hot")}
    m = T.matched(F.col("found"), flags, rules)
    wanted = [("b,a", "emergency"), ("a", "urgent"), ("", "routine"), ("", "routine"), ("c", "urgent"), ("", "routine"), ("", "routine"), ("", "routine"), ("c", "urgent"), ("d", "mental_health"), ("d", "mental_health"), ("", "routine")]
    assert [tuple(r) for r in T.with_hits(rows, "t", "l", rules).select(F.array_join(m, ","), T.level_of(m, rules)).collect()] == wanted


def test_locale_sort(spark):
    from strataforge.plans import extra

    assert [r["place"] for r in extra.locale_sort(spark, "/root/testdata/sf0.001").orderBy("n_name").collect()] == list(range(1, 26))
    names = [r[0] for r in spark.createDataFrame([("Zypern",), ("Österreich",), ("Oman",)], "n string").orderBy(F.collate("n", "de")).collect()]
    assert names == ["Oman", "Österreich", "Zypern"]
