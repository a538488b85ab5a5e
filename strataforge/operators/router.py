"""Intents of a question and the outcome that an answer takes: keyword tables in five languages, numbers, and one ordered chain.

All tables are matched by one automaton (:mod:`.keywords`); the chain is a column, so that the first outcome that fits decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keywords import Row, labels_of, pattern_of, with_matches

# Rows of keyword tables in words of our own; ``$`` asks for a whole word.
WORDS: dict[str, list[str]] = {
    "drug": ["paracetamol", "paracétamol", "acetaminophen", "ibuprofen", "ibuprofène"],
    "amount": ["how much", "how many ml", "dose$", "dosage", "wie viel", "wieviel", "dosierung", "combien", "posologie", "cuánto", "cuánta", "dosis", "quanto", "quanta", "dosagem"],
    "syrup": ["syrup", "drops", "saft$", "tropfen", "sirop", "gouttes", "jarabe", "gotas", "xarope"],
    "both": ["together", "alternat", "at the same time", "zusammen", "abwechseln", "gleichzeitig", "ensemble", "alterner", "en même temps", "juntos", "alternar", "a la vez", "ao mesmo tempo"],
    "growth": ["percentile", "growth chart", "perzentil", "wachstumskurve", "courbe de croissance", "percentil", "curva de crecimiento", "curva de crescimento"],
    "arm": ["muac", "arm circumference", "oberarmumfang", "périmètre brachial", "perímetro braquial"],
    "schedule": ["vaccine schedule", "vaccination schedule", "which vaccines", "impfkalender", "impfplan", "calendrier vaccinal", "calendario de vacunas", "calendario vacunal", "calendário de vacinas"],
    "country": ["germany", "france", "spain", "portugal", "brazil", "mexico", "deutschland", "frankreich", "spanien", "allemagne", "espagne", "alemania", "francia", "españa", "alemanha", "brasil", "méxico"],
    "number": ["emergency number", "which number do i call", "what number do i call", "notrufnummer", "numéro d'urgence", "número de emergencias", "número de emergência"],
    "leaflet": ["vaccine leaflet", "vaccine information", "impfaufklärung", "notice du vaccin", "ficha de la vacuna", "folheto da vacina"],
    "pet": ["my dog", "my cat", "mein hund", "meine katze", "mon chien", "mon chat", "mi perro", "mi gato", "meu cão", "meu gato"],
    "adult": ["my husband", "my wife", "i am pregnant", "mein mann", "meine frau", "mon mari", "ma femme", "mi marido", "mi mujer", "estoy embarazada", "meu marido"],
    "about": ["who are you", "what can you do", "wer bist du", "was kannst du", "qui es-tu", "que sais-tu faire", "quién eres", "qué sabes hacer", "quem é você"],
}
INTENTS = ("dose with weight", "combine", "growth", "arm tape", "vaccine schedule", "emergency number", "off topic", "adult")
OUTCOMES = (
    "emergency_number", "about", "off_topic", "adult", "dose_two_weights", "dose_calculator", "dose_ask_weight", "which_drug", "vis_list",
    "vaccine_schedule", "no_schedule", "muac", "growth_chart", "clarify", "drafted", "no_source",
)
_KG = r"([0-9]+(?:[.,][0-9]+)?) ?(?:kg|kilo)"
_CM = r"[0-9]+(?:[.,][0-9]+)? ?cm"
LEAST_TERMS = 3


def table() -> list[Row]:
    return [(label, k) for label, words in WORDS.items() for k in words]


def _tests(said, weights: str, sized: str, terms: str, text: str) -> tuple[dict[str, str], dict[str, str]]:
    """Intents and outcomes as expressions that Spark's SQL and DuckDB's read alike; ``said`` makes one from a label."""
    dose = f"({said('drug')} AND {weights} > 0)"
    combine = f"({said('drug')} AND {said('both')} AND {weights} = 0)"
    growth = f"({said('growth')} OR ({weights} > 0 AND {sized}))"
    intents = dict(zip(INTENTS, (dose, combine, growth, said("arm"), said("schedule"), said("number"), said("pet"), said("adult"))))
    outcomes = dict(
        zip(
            OUTCOMES,
            (
                said("number"), said("about"), said("pet"), said("adult"), f"({dose} AND {weights} > 1)", f"({dose} AND NOT {sized})", f"({said('drug')} AND {said('amount')} AND NOT {combine})", f"({said('amount')} AND {said('syrup')} AND NOT {said('drug')})", said("leaflet"),
                f"({said('schedule')} AND {said('country')})", said("schedule"), said("arm"), growth, f"({text} IS NULL OR {terms} = 0)", f"({terms} >= {LEAST_TERMS})", "true",
            ),
        )
    )
    return intents, outcomes


def routed(rows: DataFrame, text: str, terms: Column) -> DataFrame:
    """``rows`` with intents (all that fit, in order) and outcome (the first that fits); ``terms`` counts what a search could ask for."""
    lowered = rows.withColumns({"__low": F.coalesce(F.lower(text), F.lit("")), "__terms": terms})
    facts = with_matches(lowered, "__low", table(), "__matches").withColumn("__said", labels_of("__matches"))
    weights = F.array_distinct(F.regexp_extract_all("__low", F.lit(_KG), 1))
    facts = facts.withColumns({"__weights": F.size(weights), "__sized": F.col("__low").rlike(_CM)})
    intents, outcomes = _tests(lambda label: f"array_contains(__said, '{label}')", "__weights", "__sized", "__terms", text)
    found = F.array_compact(F.array(*[F.when(F.expr(t), F.lit(name)) for name, t in intents.items()]))
    outcome = F.coalesce(*[F.when(F.expr(t), F.lit(name)) for name, t in outcomes.items()])
    return facts.withColumns({"intents": found, "outcome": outcome}).drop("__low", "__terms", "__matches", "__said", "__weights", "__sized")


def routed_sql(source: str, text: str, terms: str) -> str:
    """:func:`routed` in DuckDB's SQL, over a table or subquery that has the column ``text``."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    said = ", ".join(f"regexp_matches(low, {quoted(pattern_of(words))}) AS said_{label}" for label, words in WORDS.items())
    intents, outcomes = _tests(lambda label: f"said_{label}", "weights", "sized", "terms", text)
    listed = ", ".join(f"CASE WHEN {t} THEN '{name}' END" for name, t in intents.items())
    chain = " ".join(f"WHEN {t} THEN '{name}'" for name, t in outcomes.items())
    facts = f"SELECT *, {said}, len(list_distinct(regexp_extract_all(low, '{_KG}', 1))) AS weights, regexp_matches(low, '{_CM}') AS sized FROM (SELECT *, coalesce(lower({text}), '') AS low, {terms} AS terms FROM {source})"
    return f"SELECT *, list_filter([{listed}], lambda x: x IS NOT NULL) AS intents, CASE {chain} END AS outcome FROM ({facts})"
