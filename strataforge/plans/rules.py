"""Rule, guard and routing queries over ``conversations`` and ``documents``, and evaluation metrics over ``labels``."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import rules as T
from ..sources.tables import table
from .calculators import LINKS, cited_links
from .registry import query

# Rows of a rule table, in words of our own; a negation inside a keyword is part of the signal.
RULES = [
    T.Rule("r_trash", "emergency", ["trash", "worthless"], contradicted_if=["not worthless"]),
    T.Rule("r_breath", "emergency", ["not breathing", "cannot breathe", "can't breathe", "atmet nicht", "bekommt keine luft", "ne respire pas", "no respira", "no puede respirar", "não respira", "nao respira", "turned blue", "wird blau"]),
    T.Rule("r_pulse", "emergency", ["no pulse", "kein puls", "pas de pouls", "sin pulso", "sem pulso"]),
    T.Rule("r_wake", "emergency", ["won't wake", "not waking", "cannot be woken", "wacht nicht auf", "ne se réveille pas", "no despierta", "não acorda", "unconscious", "bewusstlos", "inconsci"]),
    T.Rule("r_fit", "emergency", ["seizure", "convuls", "krampfanfall", "krampfanfäll", "fits$"]),
    T.Rule("r_bleed", "emergency", ["won't stop bleeding", "blutung stoppt nicht", "ne cesse pas de saigner", "no deja de sangrar", "não para de sangrar", "bleeds heavily", "blutet stark"]),
    T.Rule("r_poison", "emergency", ["swallowed a battery", "swallowed bleach", "batterie verschluckt", "avalé une pile", "tragado una pila", "tragó una pila", "engoliu uma pilha"]),
    T.Rule("r_moron", "urgent", ["moron", "stupid", "idiot"], mild_if=["the$"], serious_if=["pathetic"]),
    T.Rule("r_secret", "urgent", ["password", "api key", "api_key", "apikey"], contradicted_if=["example password"]),
    T.Rule("r_neck", "urgent", ["stiff neck", "nackensteif", "steifer nacken", "nuque raide", "cuello rígido", "pescoço rígido"]),
    T.Rule("r_dry", "urgent", ["no tears", "no wet nappies", "keine tränen", "pas de larmes", "sin lágrimas", "sem lágrimas", "sunken eyes", "eingesunkene augen"]),
    T.Rule("r_drink", "urgent", ["not drinking", "refuses to drink", "trinkt nicht", "ne boit pas", "no bebe", "não bebe"]),
    T.Rule("r_rash", "urgent", ["purple rash", "purple spots", "lila flecken", "taches violettes", "manchas moradas", "manchas roxas"]),
    T.Rule("r_burn", "urgent", ["scald", "verbrüht", "brûlure", "quemadura", "queimadura"], mild_if=["small", "kleine", "petite", "pequeña", "pequena"], serious_if=["face", "gesicht", "visage", "cara$", "rosto"]),
    T.Rule("r_fever", "urgent", ["newborn has fever", "neugeborenes hat fieber", "nouveau-né a de la fièvre", "recién nacido tiene fiebre", "recém-nascido tem febre"], requires=["young", "hot"]),
    T.Rule("r_quiet", "mental_health", ["alone"]),
    T.Rule("r_hopeless", "mental_health", ["hopeless", "give up", "pathetic", "hoffnungslos", "sans espoir", "sin esperanza", "sem esperança"]),
    T.Rule("r_short_question", "urgent", [], requires=["short", "asks"]),
    T.Rule("r_long", "routine", [], requires=["long"]),
    T.Rule("r_water", "routine", ["eau", "wasser", "agua", "água"], mild_if=["the$"], serious_if=["with$"]),
    T.Rule("r_school", "routine", ["sch", "escuela", "school", "école", "escola"]),
]
_YOUNG = "(?:^|[^0-9])(?:[0-9]|1[01]) (?:months?|monate?|mois|meses)"
_HOT = "fever|fieber|fièvre|fiebre|febre"
_FLAGS = {"short": "length(text) < 200", "asks": "contains(text, '?')", "long": "length(text) > 4000", "young": f"regexp_matches(lowered, '{_YOUNG}')", "hot": f"regexp_matches(lowered, '{_HOT}')"}


def _matched_sql(source: str, lang: str | None) -> str:
    return f"SELECT *, {T.matched_sql('lowered', 'kept', _FLAGS, RULES)} AS m FROM (SELECT *, {T.left_by_lang_sql('lowered', RULES, lang)} AS kept FROM (SELECT *, lower(text) AS lowered FROM {source}))"


_MATCHED = {"documents": _matched_sql("documents", "lang"), "conversations": _matched_sql("conversations", None)}


def assessed(rows, lang=None):
    """``rows`` with ``m``, the names of the rules that their text meets; guards are those of the language in the column ``lang``."""
    low = F.col("lowered")
    flags = {"short": F.length("text") < 200, "asks": F.col("text").contains("?"), "long": F.length("text") > 4000, "young": low.rlike(_YOUNG), "hot": low.rlike(_HOT)}
    flagged = rows.withColumn("lowered", F.lower("text")).withColumns({f"is_{k}": v for k, v in flags.items()}).drop("text")
    found = T.with_hits(flagged, "lowered", lang, RULES).drop("lowered")
    return found.withColumn("m", T.matched(F.col("found"), {k: F.col(f"is_{k}") for k in flags}, RULES))


_ASSESS = "SELECT doc_id, array_to_string(m, ',') AS rules, CASE WHEN len(m) = 0 THEN 'routine' " + " ".join(f"WHEN m[1] = '{r.name}' THEN '{r.level}'" for r in RULES) + f" END AS level FROM ({_MATCHED['documents']})"


@query("T6_rule_assess", _ASSESS)
def rule_assess(spark, sf):
    """Rules of the table with their guards: a match counts where no negation reaches it and nothing makes it hypothetical."""
    rows = table(spark, sf, "documents").select("doc_id", "lang", "text")
    return assessed(rows, "lang").select("doc_id", F.array_join("m", ",").alias("rules"), T.level_of(F.col("m"), RULES).alias("level"))


@query("T3_rule_hits", f"SELECT conv_id, turn, array_to_string(m, ',') AS rules FROM ({_MATCHED['conversations']}) WHERE len(m) > 0")
def rule_hits(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return assessed(rows).filter(F.size("m") > 0).select("conv_id", "turn", F.array_join("m", ",").alias("rules"))


def _hypothetical_sql() -> str:
    of = lambda lang: f"len(list_filter(s, lambda x: {T.hypothetical_sql('x', lang)}))"
    return f"SELECT doc_id, sentences, hypothetical FROM (SELECT doc_id, len(s)::BIGINT AS sentences, (CASE {' '.join(f'WHEN lang = {chr(39)}{x}{chr(39)} THEN {of(x)}' for x in T.NEGATIONS)} ELSE {of(None)} END)::BIGINT AS hypothetical FROM (SELECT doc_id, lang, {T.sentences_sql('lower(text)')} AS s FROM documents WHERE text IS NOT NULL))"


@query("T2_hypothetical_guard", _hypothetical_sql())
def hypothetical_guard(spark, sf):
    """How many sentences of each document are hypothetical by the guards of its language, and how many it has."""
    rows = table(spark, sf, "documents").filter("text is not null").select("doc_id", "lang", T.sentences(F.lower("text")).alias("s"))
    count = F.size(F.filter("s", lambda x: T.hypothetical(x, None)))
    for lang in T.NEGATIONS:
        count = F.when(F.col("lang") == lang, F.size(F.filter("s", lambda x: T.hypothetical(x, lang)))).otherwise(count)  # noqa: B023
    return rows.select("doc_id", F.size("s").cast("long").alias("sentences"), count.cast("long").alias("hypothetical"))


@query("W7_newly_matched", f"WITH a AS (SELECT conv_id, turn, unnest(m) AS rule FROM ({_MATCHED['conversations']}) WHERE role = 'user'), f AS (SELECT conv_id, rule, min(turn) AS turn FROM a GROUP BY ALL) SELECT conv_id, turn, string_agg(rule, ',' ORDER BY rule) AS rules FROM f GROUP BY conv_id, turn")
def newly_matched(spark, sf):
    """Rules that a user's turn meets and no turn before it: the first turn of each rule, as a minimum."""
    rows = table(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", "text")
    first = assessed(rows).select("conv_id", "turn", F.explode("m").alias("rule")).groupBy("conv_id", "rule").agg(F.min("turn").alias("turn"))
    return first.groupBy("conv_id", "turn").agg(F.array_join(F.sort_array(F.collect_list("rule")), ",").alias("rules"))


@query("T5_flags", r"SELECT conv_id, turn, regexp_matches(lower(text), '(?:^|[^\p{L}])(?:est|ist|is|es)(?:[^\p{L}]|$)') AS states, length(text) < 120 AS short, contains(text, '?') AS asks FROM conversations")
def flags(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.lower("text").rlike(r"(?:^|[^\p{L}])(?:est|ist|is|es)(?:[^\p{L}]|$)").alias("states"), (F.length("text") < 120).alias("short"), F.col("text").contains("?").alias("asks"))


_WATER = [T.Rule("word", "routine", ["the", "eau", "sch"])]


@query("T1_negation_guard", f"SELECT conv_id, turn, hits FROM (SELECT conv_id, turn, len(regexp_extract_all({T.left_of_sql('lower(text)', _WATER)}, '{T.rule_pattern(_WATER, 0)}'))::BIGINT AS hits FROM conversations) WHERE hits > 0")
def negation_guard(spark, sf):
    """Words that no guard reaches, counted by their places."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.lower("text").alias("lowered"))
    return T.with_hits(rows, "lowered", None, _WATER).select("conv_id", "turn", F.size("found.hits").cast("long").alias("hits")).filter("hits > 0")


_MEASURED_SQL = "text || ' ' || (95 + turn % 10) || ' F, ' || (10 + turn % 90) || ' lb'"


@query("F10_unit_rewrite", f"SELECT conv_id, turn, {T.with_converted_units_sql('t')} AS text FROM (SELECT conv_id, turn, {_MEASURED_SQL} AS t FROM conversations)")
def unit_rewrite(spark, sf):
    """Fahrenheit and pounds in texts get their metric value; each turn of this corpus gets one of both at its end."""
    measured = F.concat("text", F.lit(" "), (95 + F.col("turn") % 10).cast("string"), F.lit(" F, "), (10 + F.col("turn") % 90).cast("string"), F.lit(" lb"))
    return table(spark, sf, "conversations").select("conv_id", "turn", T.with_converted_units(measured).alias("text"))


@query("T7_explain_match", r"SELECT doc_id, regexp_extract(text, '(?i)(.{0,20}(?:trash|worthless|moron).{0,20})', 1) AS context FROM documents WHERE regexp_matches(text, '(?i)(?:trash|worthless|moron)')")
def explain_match(spark, sf):
    """The matched word with what stands around it."""
    rows = table(spark, sf, "documents").filter(F.col("text").rlike("(?i)(?:trash|worthless|moron)"))
    return rows.select("doc_id", F.regexp_extract("text", r"(?i)(.{0,20}(?:trash|worthless|moron).{0,20})", 1).alias("context"))


@query("T8_banner", f"WITH a AS ({_ASSESS}) SELECT doc_id, CASE level WHEN 'emergency' THEN 'Call now: ' WHEN 'urgent' THEN 'See someone today: ' WHEN 'mental_health' THEN 'Talk to someone: ' ELSE '' END || replace(rules, ',', '; ') AS banner FROM a WHERE rules <> ''")
def banner(spark, sf):
    level = T.level_of(F.col("m"), RULES)
    head = F.when(level == "emergency", "Call now: ").when(level == "urgent", "See someone today: ").when(level == "mental_health", "Talk to someone: ").otherwise("")
    rows = table(spark, sf, "documents").select("doc_id", "lang", "text")
    return assessed(rows, "lang").filter(F.size("m") > 0).select("doc_id", F.concat(head, F.array_join("m", "; ")).alias("banner"))


@query("T9_citations", r"SELECT doc_id, len(c) AS markers, len(list_filter(c, lambda x: x::INT < 1 OR x::INT > 3)) AS out_of_range FROM (SELECT doc_id, regexp_extract_all(regexp_replace(text, '(\w+), ', '\1 [' || (doc_id % 5) || '] ', 'g'), '\[([0-9]+)\]', 1) AS c FROM documents)")
def citations(spark, sf):
    """Citation markers and those that name no source; commas become markers in this corpus."""
    marked = F.regexp_replace(F.col("text"), F.lit(r"(\w+), "), F.concat(F.lit("$1 ["), (F.col("doc_id") % 5).cast("string"), F.lit("] ")))
    c = F.regexp_extract_all(marked, F.lit(r"\[([0-9]+)\]"), 1)
    bad = F.filter(c, lambda x: (x.cast("int") < 1) | (x.cast("int") > 3))
    return table(spark, sf, "documents").select("doc_id", F.size(c).cast("long").alias("markers"), F.size(bad).cast("long").alias("out_of_range"))


@query("T10_numbers_in_facts", "WITH f AS (SELECT DISTINCT p_size::VARCHAR AS n FROM part) SELECT page_id, count(*) FILTER (f.n IS NULL) AS unknown FROM (SELECT page_id, unnest(list_distinct(regexp_extract_all(url, '[0-9]+'))) AS n FROM pages) u LEFT JOIN f USING (n) GROUP BY page_id")
def numbers_in_facts(spark, sf):
    """Numbers of a text that no fact holds."""
    facts = table(spark, sf, "part").select(F.col("p_size").cast("string").alias("n")).distinct().withColumn("known", F.lit(True))
    each = table(spark, sf, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("url", F.lit("[0-9]+"), 0))).alias("n"))
    return each.join(facts, "n", "left").groupBy("page_id").agg(F.count_if(F.col("known").isNull()).alias("unknown"))


@query("T13_structure_checks", "SELECT doc_id, len(string_split(text, chr(10))) >= 3 AS has_paragraphs, len(regexp_extract_all(text, '[.]')) >= 5 AS has_sentences, NOT contains(text, 'All rights reserved') AS clean FROM documents")
def structure_checks(spark, sf):
    return table(spark, sf, "documents").select("doc_id", (F.size(F.split("text", "\n")) >= 3).alias("has_paragraphs"), (F.regexp_count("text", F.lit("[.]")) >= 5).alias("has_sentences"), (~F.col("text").contains("All rights reserved")).alias("clean"))


@query("T19_number_drift", r"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents) SELECT doc_id, line_no, regexp_extract(line, '([0-9]{2,})', 1) AS number FROM l WHERE regexp_matches(line, '[0-9]{2,}') AND regexp_extract(line, '([0-9]{2,})', 1) <> (doc_id % 100)::VARCHAR")
def number_drift(spark, sf):
    """Lines whose first number differs from the computed truth."""
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    number = F.regexp_extract("line", "([0-9]{2,})", 1)
    return lines.filter(F.col("line").rlike("[0-9]{2,}")).select("doc_id", (F.col("pos") + 1).cast("long").alias("line_no"), number.alias("number")).filter(F.col("number") != (F.col("doc_id") % 100).cast("string"))


_PRED = "WITH p AS (SELECT doc_id, toxic, quality, CASE WHEN regexp_matches(lower(text), '(?:trash|worthless|moron|stupid|pathetic)') THEN 1 ELSE 0 END AS pred, lang, length(text) > 200 AS measured FROM documents JOIN labels USING (doc_id))"


def _predicted(spark, sf):
    pred = F.lower("text").rlike("(?:trash|worthless|moron|stupid|pathetic)").cast("int")
    return table(spark, sf, "documents").select("doc_id", "lang", pred.alias("pred"), (F.length("text") > 200).alias("measured")).join(table(spark, sf, "labels"), "doc_id")


@query("A8_metric_ratios", _PRED + " SELECT round_even(avg((pred = toxic)::INT), 3) AS exact, round_even(avg(CASE WHEN toxic = 1 THEN pred END), 3) AS recall, round_even(avg(CASE WHEN pred = 1 THEN toxic END), 3) AS precision, round_even(avg(CASE WHEN measured THEN (quality = 1)::INT END), 3) AS routed FROM p")
def metric_ratios(spark, sf):
    """Ratios over the rows where each is measurable."""
    p = _predicted(spark, sf)
    pred, toxic = F.col("pred"), F.col("toxic")
    return p.agg(
        F.bround(F.avg((pred == toxic).cast("int")), 3).alias("exact"), F.bround(F.avg(F.when(toxic == 1, pred)), 3).alias("recall"), F.bround(F.avg(F.when(pred == 1, toxic)), 3).alias("precision"), F.bround(F.avg(F.when(F.col("measured"), (F.col("quality") == 1).cast("int"))), 3).alias("routed")
    )


@query("A12_battery_by_language", _PRED + " SELECT lang, count(*) AS n, count(*) FILTER (pred = 1) AS flagged, count(*) FILTER (pred <> toxic) AS wrong FROM p GROUP BY lang")
def battery(spark, sf):
    return _predicted(spark, sf).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pred") == 1).alias("flagged"), F.count_if(F.col("pred") != F.col("toxic")).alias("wrong"))


@query("A16_classification_counts", LINKS + "SELECT class, count(*) AS n FROM links GROUP BY class")
def classification_counts(spark, sf):
    """How many cited addresses are the same, moved, retired, broken or on another topic now."""
    return cited_links(spark, sf).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query("T20_public_facts", "SELECT 'documents' AS fact, count(*) AS n FROM documents UNION ALL SELECT 'sources', count(DISTINCT source) FROM documents UNION ALL SELECT 'languages', count(DISTINCT lang) FROM documents UNION ALL SELECT 'pages', count(*) FROM pages")
def public_facts(spark, sf):
    docs = table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("documents"), F.countDistinct("source").alias("sources"), F.countDistinct("lang").alias("languages"))
    facts = docs.select(F.explode(F.create_map(*[x for c in ("documents", "sources", "languages") for x in (F.lit(c), F.col(c))])).alias("fact", "n"))
    return facts.unionByName(table(spark, sf, "pages").agg(F.count(F.lit(1)).alias("n")).select(F.lit("pages").alias("fact"), "n"))


@query("O9_constrained_citations", "SELECT conv_id, turn, n FROM (SELECT conv_id, turn, unnest(range(turn - 2, turn + 3)) AS n, count(*) OVER (PARTITION BY conv_id) AS len FROM conversations) WHERE n BETWEEN 1 AND len")
def constrained_citations(spark, sf):
    rows = table(spark, sf, "conversations").withColumn("len", F.count(F.lit(1)).over(Window.partitionBy("conv_id")))
    return rows.select("conv_id", "turn", "len", F.explode(F.sequence(F.col("turn") - 2, F.col("turn") + 2)).alias("n")).filter("n between 1 and len").drop("len")


@query("X4_follow_ups", "SELECT a.conv_id, a.turn, b.turn AS next_turn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn > a.turn AND b.turn <= a.turn + 4 WHERE a.role = 'user' AND b.role = 'user' AND lower(a.text) <> lower(b.text)")
def follow_ups(spark, sf):
    """Later questions of a conversation that don't repeat this one, from a window of four turns."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.xxhash64(F.lower("text")).alias("h"))
    later = F.collect_list(F.struct("turn", "role", "h")).over(Window.partitionBy("conv_id").orderBy("turn").rangeBetween(1, 4))
    each = rows.filter("role is not null").withColumn("later", later).filter("role = 'user'").select("conv_id", "turn", "h", F.explode("later").alias("b"))
    return each.filter((F.col("b.role") == "user") & (F.col("b.h") != F.col("h"))).select("conv_id", "turn", F.col("b.turn").alias("next_turn"))
