"""The remaining small operators: normalisation variants, detectors, exports, set operations, limits."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.calculators import percentile
from ..functions.text import search_terms, tokens
from ..operators import etl as E
from ..operators import lookups as L
from ..operators import router, scripts
from ..operators import vectors as V
from ..operators.keywords import labels_of, pattern_of, with_matches
from ..sources.tables import table
from .registry import query
from .retrieval import _FOLD, _STOP, _TOK, stored_index


@query("C7_sentences", r"SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '([.?!])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')) AS sentences FROM documents")
def sentence_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(E.sentences(F.col("text"))).cast("long").alias("sentences"))


@query("N4_search_terms", f"WITH w AS (SELECT doc_id, list_distinct(list_filter({_TOK % (_FOLD % 'text')}, lambda w: length(w) >= 3 AND NOT list_contains({_STOP}, w))) AS t FROM documents) SELECT doc_id, len(t) AS terms FROM w")
def term_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(search_terms(F.col("text"))).cast("long").alias("terms"))


@query("N2_flatten", f"SELECT conv_id, turn, sha256(regexp_replace(translate({_FOLD % 'text'}, 'أإآىة', 'ااايه'), '[ً-़ْ]', '', 'g')) AS flat FROM conversations")
def flattened(spark, sf):
    """Folding plus unified Arabic letters, without short vowels and dots below."""
    from ..functions.text import fold

    flat = F.regexp_replace(F.translate(fold(F.col("text")), "أإآىة", "ااايه"), "[ً-़ْ]", "")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.sha2(flat, 256).alias("flat"))


@query("N7_doubled_vowels", f"SELECT doc_id, sha256({scripts.fold_hindi_sql('text')}) AS hash FROM documents")
def doubled_vowels(spark, sf):
    """Doubled vowels as one, as Hindi is typed on a Latin keyboard; the SQL has a replacement for each vowel."""
    return table(spark, sf, "documents").select("doc_id", F.sha2(scripts.fold_hindi(F.col("text")), 256).alias("hash"))


@query("N7_arabizi", f"SELECT doc_id, sha256({scripts.fold_arabic_sql('text')}) AS hash FROM documents")
def arabizi(spark, sf):
    """Arabic, in its own letters or typed with digits: what differs from hand to hand is folded."""
    return table(spark, sf, "documents").select("doc_id", F.sha2(scripts.fold_arabic(F.col("text")), 256).alias("hash"))


@query("N12_hyphens_and_points", r"SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '[‐-―-]', ' ', 'g'), '([0-9])\.([0-9])', '\1,\2', 'g')) AS hash FROM documents")
def hyphens_and_points(spark, sf):
    text = F.regexp_replace(F.regexp_replace("text", "[‐-―-]", " "), r"([0-9])\.([0-9])", "$1,$2")
    return table(spark, sf, "documents").select("doc_id", F.sha2(text, 256).alias("hash"))


@query("N13_stray_words", r"SELECT doc_id, sha256(CASE lang WHEN 'fr' THEN regexp_replace(text, ' the ', ' le ', 'g') WHEN 'de' THEN regexp_replace(text, ' the ', ' der ', 'g') ELSE text END) AS hash FROM documents")
def stray_words(spark, sf):
    """A stray word of another language is replaced by the document's own."""
    text = F.when(F.col("lang") == "fr", F.regexp_replace("text", " the ", " le ")).when(F.col("lang") == "de", F.regexp_replace("text", " the ", " der ")).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.sha2(text, 256).alias("hash"))


@query("C15_romanise")
def romanised(spark, sf):
    """Whole texts in Devanagari as Latin letters. This corpus has none, so texts are spelled in it first, letter by letter; a test holds the reader against a scanner."""
    spelled = F.translate(F.lower("text"), "abcdefghijklmnopqrstuvwxyz", "ाबचदेफगहिजकलमनोपखरसतुवयषीझ")
    rows = scripts.with_romanised(table(spark, sf, "documents").select("doc_id", spelled.alias("t")), "t", "latin")
    return rows.select("doc_id", F.length("latin").cast("long").alias("length"), F.sha2("latin", 256).alias("hash"))


@query(
    "S13_index_build",
    f"""WITH d AS (SELECT doc_id, {_TOK % (_FOLD % 'text')} AS body, {_TOK % (_FOLD % "split_part(text, chr(10), 1)")} AS head, {_TOK % (_FOLD % 'source')} AS title FROM documents
), each AS (SELECT doc_id, unnest(body) AS term, 1.0::DOUBLE AS w FROM d UNION ALL SELECT doc_id, unnest(head), 2.0 FROM d UNION ALL SELECT doc_id, unnest(title), 3.0 FROM d
), posts AS (SELECT doc_id, term, sum(w) AS tf FROM each GROUP BY ALL
) SELECT term, count(*)::BIGINT AS df, max(tf) AS most, sum(tf) AS weight FROM posts GROUP BY term""",
)
def index_build(spark, sf):
    """Every term of the stored index: documents, largest and summed weight, read from its postings."""
    postings = stored_index(spark, sf)._table("postings")
    total = F.aggregate("tfs", F.lit(0.0), lambda s, x: s + x)
    return postings.groupBy("term").agg(F.sum(F.size("slots")).alias("df"), F.max(F.array_max("tfs")).alias("most"), F.sum(total).alias("weight"))


@query("S16_dates_in_many_formats", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def many_formats(spark, sf):
    """Dates written in three formats, read back by the first that fits."""
    d = F.col("o_orderdate")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(d, "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format(d, "dd MMM yyyy")).otherwise(F.date_format(d, "yyyy/MM/dd HH:mm"))
    rows = table(spark, sf, "orders").select("o_orderkey", text.alias("t"))
    found = F.coalesce(F.try_to_timestamp("t", F.lit("yyyy-MM-dd")), F.try_to_timestamp("t", F.lit("dd MMM yyyy")), F.try_to_timestamp("t", F.lit("yyyy/MM/dd HH:mm")))
    return rows.select("o_orderkey", F.date_format(found, "yyyy-MM-dd").alias("day"))


@query("S18_nested_json", """SELECT source, '{"source":"' || source || '","langs":[' || string_agg(DISTINCT '"' || lang || '"', ',' ORDER BY '"' || lang || '"') || ']}' AS doc FROM documents GROUP BY source""")
def nested_json(spark, sf):
    per = table(spark, sf, "documents").groupBy("source").agg(F.sort_array(F.collect_set("lang")).alias("langs"))
    return per.select("source", F.to_json(F.struct("source", "langs")).alias("doc"))


@query("R3_filtered_match", f"SELECT doc_id FROM documents WHERE lang = 'en' AND source IN ('src0', 'src1') AND list_contains({_TOK % (_FOLD % 'text')}, 'with')")
def filtered_match(spark, sf):
    """Language and source filters reach the scan before any text is split."""
    from ..functions.text import fold

    return table(spark, sf, "documents").filter((F.col("lang") == "en") & F.col("source").isin("src0", "src1")).filter(F.array_contains(tokens(fold(F.col("text"))), "with")).select("doc_id")


_COMPARED = "(?i)(^|[^A-Za-z0-9_])the [A-Za-z0-9_]+"


@query("R16_scrub_and_add", rf"SELECT conv_id, turn, CASE WHEN regexp_matches(text, '{_COMPARED}') THEN trim(regexp_replace(text, '{_COMPARED}', '\1', 'g')) ELSE text END AS scrubbed FROM conversations")
def scrub(spark, sf):
    """A comparison is taken out of a question before it is searched."""
    text = F.col("text")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.when(text.rlike(_COMPARED), F.trim(F.regexp_replace(text, _COMPARED, "$1"))).otherwise(text).alias("scrubbed"))


@query("R24_vector_similarity", "WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0) SELECT query_id, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS cosine FROM embeddings, q WHERE list_cosine_similarity(embedding::DOUBLE[], q) > 0.3")
def vector_similarity(spark, sf):
    """An extension: cosine of every vector with each whose id is divisible by 100, exactly, by products of blocks."""
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return V.near(vectors, vectors.filter("vec_id % 100 = 0"), "vec_id", "embedding", 0.3).select("query_id", "vec_id", F.round("cosine", 6).alias("cosine"))


_BY_TEXT = [("a", "trash"), ("b", "moron"), ("c", "pathetic"), ("d", "all rights"), ("e", "stupid"), ("f", "password"), ("g", "que$"), ("h", "und$"), ("i", "worthless"), ("i", "idiot")]


@query("J13_rules_by_text", " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM documents WHERE regexp_matches(lower(text), '{pattern_of([w for m, w in _BY_TEXT if m == n])}') HAVING count(*) > 0" for n in dict.fromkeys(n for n, _ in _BY_TEXT)))
def rules_by_text(spark, sf):
    """How many texts each rule fires in: rules times texts without a join, by one automaton that every text runs through once."""
    rows = with_matches(table(spark, sf, "documents").select(F.lower("text").alias("lowered")), "lowered", _BY_TEXT)
    return rows.select(F.explode(labels_of()).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("J15_regional_only", "SELECT s_nationkey AS nation FROM supplier WHERE s_acctbal < 3000 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000")
def regional_only(spark, sf):
    rows = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), "s_acctbal")
    return rows.filter("s_acctbal < 3000").select("nation").subtract(rows.filter("s_acctbal > 9000").select("nation"))


@query("J7_table_by_age", "SELECT o_orderkey, CASE WHEN o_custkey % 240 < 24 THEN 'length' WHEN o_custkey % 240 <= 61 THEN 'height' ELSE 'stature' END AS measure, (CASE WHEN o_custkey % 240 < 24 THEN o_custkey % 240 * 30 ELSE o_custkey % 240 END)::BIGINT AS at FROM orders")
def table_by_age(spark, sf):
    """Which table an age uses, and the key in that table's own unit."""
    age = F.col("o_custkey") % 240
    return table(spark, sf, "orders").select("o_orderkey", F.when(age < 24, "length").when(age <= 61, "height").otherwise("stature").alias("measure"), F.when(age < 24, age * 30).otherwise(age).alias("at"))


@query("J21_field_router", "SELECT l_shipmode, count(*) AS n FROM (SELECT CASE WHEN l_discount >= 0.08 THEN 'discount' WHEN l_tax = 0 THEN 'tax_free' WHEN l_quantity > 40 THEN 'bulk' ELSE 'plain' END AS l_shipmode FROM lineitem) GROUP BY l_shipmode")
def field_router(spark, sf):
    route = F.when(F.col("l_discount") >= 0.08, "discount").when(F.col("l_tax") == 0, "tax_free").when(F.col("l_quantity") > 40, "bulk").otherwise("plain")
    return table(spark, sf, "lineitem").groupBy(route.alias("l_shipmode")).agg(F.count(F.lit(1)).alias("n"))


@query("O4_null_placement", "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY coalesce(CASE WHEN doc_id % 3 = 0 THEN NULL ELSE n_chars END, -1), doc_id) AS place FROM documents QUALIFY place <= 5")
def null_placement(spark, sf):
    key = F.coalesce(F.when(F.col("doc_id") % 3 != 0, F.col("n_chars")), F.lit(-1))
    place = F.row_number().over(Window.partitionBy("source").orderBy(key, "doc_id")).cast("long")
    return table(spark, sf, "documents").select("source", "doc_id", place.alias("place")).filter("place <= 5")


@query("O8_alert_feed", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM (SELECT *, row_number() OVER (PARTITION BY source, substr(lower(text), 1, 60) ORDER BY doc_id) AS d FROM documents WHERE lang = 'en' AND NOT contains(lower(text), 'trash')) WHERE d = 1) WHERE k <= 3")
def alert_feed(spark, sf):
    """Of each source the three longest items that fit, one for each beginning."""
    rows = table(spark, sf, "documents").filter((F.col("lang") == "en") & ~F.lower("text").contains("trash"))
    first = rows.groupBy("source", F.substring(F.lower("text"), 1, 60).alias("head")).agg(F.min(F.struct("doc_id", "n_chars")).alias("m")).select("source", "m.doc_id", "m.n_chars")
    k = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return first.withColumn("k", k).filter("k <= 3").select("source", "doc_id")


@query("F18_years_near_a_word", r"SELECT page_id, nullif(regexp_extract(html, '(?s)(?:lang|charset).{0,90}?(20[0-9]{2})', 1), '') AS year FROM pages")
def years_near(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.nullif(F.regexp_extract("html", r"(?s)(?:lang|charset).{0,90}?(20[0-9]{2})", 1), F.lit("")).alias("year"))


# Emergency numbers as countries write them, for the first nations of the table; the others have none.
_WRITTEN = ["SAMU: 15 (or 112)", "Notruf 112", "999 or 112", "911", "SAMU 192", "107 (ambulance)", "119", "120", "112 / 108", "103, 112", "no number", "123", "106", "997", "115", "118 / 119", "1 1 2", "911"]
_EMERGENCY = {f"NATION_{k}": written for k, written in enumerate(_WRITTEN)}


@query("F20_dialable", f"WITH k(n_name, written) AS (VALUES {', '.join(f'({chr(39)}{a}{chr(39)}, {chr(39)}{b}{chr(39)})' for a, b in _EMERGENCY.items())}) SELECT c_custkey, nullif(regexp_extract(written, '[0-9]{{2,6}}'), '') AS number FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN k USING (n_name)")
def dialable(spark, sf):
    """The first number that can be dialled in the customer's country; null where the country isn't known or has none."""
    written = F.create_map(*[F.lit(x) for pair in _EMERGENCY.items() for x in pair])[F.col("n_name")]
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.nullif(F.regexp_extract(written, "[0-9]{2,6}", 0), F.lit("")).alias("number"))
    return table(spark, sf, "customer").join(nation, "c_nationkey", "left").select("c_custkey", "number")


@query("F21_localised_names", "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: CASE w WHEN 'red' THEN 'rouge' WHEN 'blue' THEN 'bleu' WHEN 'small' THEN 'petit' ELSE w END), ' ') AS name FROM part")
def localised_names(spark, sf):
    names = F.create_map(*[F.lit(x) for x in ("red", "rouge", "blue", "bleu", "small", "petit")])
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.transform(F.split("p_name", " "), lambda w: F.coalesce(F.element_at(names, w), w)), " ").alias("name"))


@query("F25_post_validator", r"SELECT conv_id, turn, length(text) <= 300 AS short, NOT regexp_matches(text, 'https?://') AS no_links, len(list_filter(list_distinct(regexp_extract_all(text, '[0-9]+')), lambda n: NOT list_contains(['1', '2', '3'], n)))::BIGINT AS unknown_numbers FROM conversations")
def post_validator(spark, sf):
    unknown = F.array_except(F.regexp_extract_all("text", F.lit("[0-9]+"), 0), F.array(F.lit("1"), F.lit("2"), F.lit("3")))
    return table(spark, sf, "conversations").select("conv_id", "turn", (F.length("text") <= 300).alias("short"), (~F.col("text").rlike("https?://")).alias("no_links"), F.size(unknown).cast("long").alias("unknown_numbers"))


@query("T4_numeric_rule", r"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity >= CASE WHEN l_partkey % 9 = 0 THEN 45 WHEN l_partkey % 70 < 2 THEN 45 WHEN l_partkey % 70 < 12 THEN 38 ELSE 30 END AND l_quantity BETWEEN 20 AND 120 AS fast FROM lineitem")
def numeric_rule(spark, sf):
    """A count a minute against a limit by age; an unknown age takes the strictest."""
    age = F.when(F.col("l_partkey") % 9 != 0, F.col("l_partkey") % 70)
    limit = F.when(age.isNull() | (age < 2), 45).when(age < 12, 38).otherwise(30)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", ((F.col("l_quantity") >= limit) & F.col("l_quantity").between(20, 120)).alias("fast"))


# Rows of a keyword table in words of our own: what an answer must not do.
_STYLE = {
    "names_service": ["call 999", "call 911", "call 112", "nhs$", "samu$", "notruf 112", "appelez le 15", "llame al 061", "ligue 112"],
    "denies_number": ["there is no emergency number", "no emergency number", "keine notrufnummer", "pas de numéro d'urgence", "no hay número de emergencias", "não há número de emergência"],
    "names_source": ["according to", "the guideline says", "laut der leitlinie", "selon la fiche", "según la guía", "segundo a guia", "all rights reserved", "copyright"],
    "orders_drug": ["give antibiotics", "stop the medicine", "antibiotika geben", "donnez des antibiotiques", "dele antibióticos", "dê antibióticos"],
}


@query("T11_style_guards", f"SELECT doc_id, {', '.join(f'regexp_matches(lower(text), {chr(39)}{pattern_of(words).replace(chr(39), chr(39) * 2)}{chr(39)}) AS {name}' for name, words in _STYLE.items())} FROM documents")
def style_guards(spark, sf):
    """What an answer must not do, by a keyword table: name another country's service, deny that there is a number, talk of its sources, order a drug."""
    rows = with_matches(table(spark, sf, "documents").select("doc_id", F.lower("text").alias("low")), "low", [(name, k) for name, words in _STYLE.items() for k in words])
    return rows.select("doc_id", *[F.array_contains(labels_of(), name).alias(name) for name in _STYLE])


_TERMS_SQL = f"len(list_distinct(list_filter({_TOK % (_FOLD % 'text')}, lambda w: length(w) >= 3 AND NOT list_contains({_STOP}, w))))"
_ROUTED_SQL = router.routed_sql("conversations", "text", _TERMS_SQL)


def _routed(spark, sf):
    return router.routed(table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"), "text", F.size(search_terms(F.col("text"))))


@query("T15_intents", f"SELECT conv_id, turn, array_to_string(intents, ',') AS intents FROM ({_ROUTED_SQL})")
def intents(spark, sf):
    """Which of eight intents each turn has, by keyword tables in five languages and numbers."""
    return _routed(spark, sf).select("conv_id", "turn", F.array_join("intents", ",").alias("intents"))


@query("T16_router", f"SELECT role, outcome, count(*) AS n FROM ({_ROUTED_SQL}) GROUP BY ALL")
def outcomes(spark, sf):
    """The first of sixteen outcomes that fits each turn, counted by role."""
    return _routed(spark, sf).groupBy("role", "outcome").agg(F.count(F.lit(1)).alias("n"))


# Rows of a note table: what a text says, or the mark that it has, and the note that goes with it.
_NOTES = [("rights", "all rights reserved", "sources differ on use"), ("rights", "copyright", "sources differ on use"), ("rights", "license", "sources differ on use"), ("insult", "moron", "sources differ on tone"), ("insult", "stupid", "sources differ on tone"), ("insult", "worthless", "sources differ on tone"), ("secret", "password", "sources differ on disclosure"), ("secret", "api_key", "sources differ on disclosure")]
_NOTE_OF = dict((name, note) for name, _, note in _NOTES)


@query(
    "T17_disagreement_notes",
    f"""SELECT doc_id, array_to_string(list_filter([{', '.join(f"CASE WHEN regexp_matches(lower(text), '{pattern_of([k for n, k, _ in _NOTES if n == name])}'){' OR toxic = 1' if name == 'insult' else ''} THEN '{note}' END" for name, note in _NOTE_OF.items())}], lambda x: x IS NOT NULL), '; ') AS notes FROM documents JOIN labels USING (doc_id)""",
)
def disagreement_notes(spark, sf):
    """The notes that a labelled text gets, by what it says or by its mark, in the table's order."""
    docs = with_matches(table(spark, sf, "documents").select("doc_id", F.lower("text").alias("low")), "low", [(name, k) for name, k, _ in _NOTES])
    said = docs.select("doc_id", labels_of().alias("said")).join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id")
    noted = lambda name: F.array_contains("said", name) | F.coalesce(F.col("toxic") == 1, F.lit(False)) if name == "insult" else F.array_contains("said", name)
    return said.select("doc_id", F.array_join(F.array_compact(F.array(*[F.when(noted(name), F.lit(note)) for name, note in _NOTE_OF.items()])), "; ").alias("notes"))


@query("ST3_hourly_allowance", "SELECT user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS calls, greatest(count(*) - 1, 0) AS refused FROM events GROUP BY user_id, date_trunc('hour', ts)")
def hourly_allowance(spark, sf):
    per = table(spark, sf, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd HH").alias("hour")).agg(F.count(F.lit(1)).alias("calls"))
    return per.withColumn("refused", F.greatest(F.col("calls") - 1, F.lit(0)))


@query("ST7_forward_exclusion", "SELECT event_id FROM events e WHERE event_type = 'click' AND NOT EXISTS (SELECT 1 FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts > e.ts AND epoch_us(p.ts) - epoch_us(e.ts) <= 172800000000)")
def forward_exclusion(spark, sf):
    """Clicks that no purchase of the same user follows within two days; it looks ahead, so it is a batch job."""
    rows = table(spark, sf, "events").filter(F.col("event_type").isin("click", "purchase")).select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    ahead = F.min(F.when(F.col("event_type") == "purchase", F.col("t"))).over(Window.partitionBy("user_id").orderBy("t").rangeBetween(1, 172_800_000_000))
    return rows.withColumn("ahead", ahead).filter("event_type = 'click' and ahead is null").select("event_id")


_AGE_SQL = "date_diff('day', date_trunc('day', min(o_orderdate) OVER (PARTITION BY o_custkey)), date_trunc('day', o_orderdate)) / 30.4375::DOUBLE"


@query(
    "X5_growth_series",
    f"""WITH x AS (SELECT o_orderkey, o_custkey, {_AGE_SQL} AS age, o_totalprice / 40000 AS kg, CASE o_custkey % 3 WHEN 0 THEN 'boy' WHEN 1 THEN 'girl' END AS sex FROM orders
), t AS (SELECT *, CASE sex {' '.join(f"WHEN '{sex}' THEN {L.interpolated_sql('age', rows, 1)}" for sex, rows in L.GROWTH.items())} END AS l, CASE sex {' '.join(f"WHEN '{sex}' THEN {L.interpolated_sql('age', rows, 2)}" for sex, rows in L.GROWTH.items())} END AS m, CASE sex {' '.join(f"WHEN '{sex}' THEN {L.interpolated_sql('age', rows, 3)}" for sex, rows in L.GROWTH.items())} END AS s FROM x
), z AS (SELECT *, (pow(kg / m, l) - 1) / (l * s) AS z FROM t), e AS (SELECT *, abs(z) / sqrt(2.0::DOUBLE) AS x2, 1 / (1 + 0.3275911 * (abs(z) / sqrt(2.0::DOUBLE))) AS t2 FROM z)
SELECT o_orderkey, round(age, 4) AS age_months, round(50 * (1 + sign(z) * (1 - t2 * (0.254829592 + t2 * (-0.284496736 + t2 * (1.421413741 + t2 * (-1.453152027 + t2 * 1.061405429)))) * exp(-x2 * x2))), 3) AS percentile FROM e""",
)
def growth_series(spark, sf):
    """Each stored measurement's percentile at the age of that day, by the child's own table; none without a sex or outside the table's ages.

    The first visit stands in for the birth, a price for a weight.
    """
    born = F.min("o_orderdate").over(Window.partitionBy("o_custkey"))
    age = F.datediff(F.to_date("o_orderdate"), F.to_date(born)) / 30.4375
    sex = F.when(F.col("o_custkey") % 3 == 0, "boy").when(F.col("o_custkey") % 3 == 1, "girl")
    rows = table(spark, sf, "orders").select("o_orderkey", age.alias("age"), (F.col("o_totalprice") / 40000).alias("kg"), sex.alias("sex"))
    z = L.growth_z(F.col("sex"), F.col("age"), F.col("kg"))
    return rows.select("o_orderkey", F.round("age", 4).alias("age_months"), F.round(percentile(z), 3).alias("percentile"))


@query("X9_owner_guard", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey AND l_partkey % 25 = s_nationkey")
def owner_guard(spark, sf):
    """Lines whose supplier owns them by a second key."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_partkey") % 25).cast("int").alias("n"))
    owners = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n"))
    return lines.join(owners, ["l_suppkey", "n"], "left_semi").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("X13_flatten_json", "SELECT event_type, count(*) AS n, sum(CASE WHEN event_type = 'purchase' THEN json_extract(props, '$.k')::BIGINT ELSE 0 END)::BIGINT AS bought, max(json_extract(props, '$.k')::BIGINT) AS most FROM events GROUP BY event_type")
def flatten_json(spark, sf):
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, sf, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("event_type") == "purchase", F.col("k")).otherwise(0)).alias("bought"), F.max("k").alias("most"))


@query("X14_not_sent_yet", "SELECT DISTINCT url FROM pages WHERE page_id % 4 <> 0 AND url NOT IN (SELECT url FROM pages WHERE page_id % 4 = 0)")
def not_sent_yet(spark, sf):
    rows = table(spark, sf, "pages").select("url", (F.col("page_id") % 4 == 0).alias("sent"))
    return rows.groupBy("url").agg(F.bool_or("sent").alias("sent")).filter("not sent").select("url")


@query("X17_own_language_share", "SELECT source, round(avg((lang = 'en')::INT), 6) AS own FROM documents GROUP BY source")
def own_language_share(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.round(F.avg((F.col("lang") == "en").cast("int")), 6).alias("own"))


@query("X21_age_context", "SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'unknown' WHEN c_custkey % 300 >= 216 THEN 'adult' WHEN c_custkey % 300 < 3 THEN 'newborn' WHEN c_custkey % 300 < 6 THEN 'infant' ELSE 'child' END AS context FROM customer")
def age_context(spark, sf):
    age = F.when(F.col("c_custkey") % 11 != 0, F.col("c_custkey") % 300)
    return table(spark, sf, "customer").select("c_custkey", F.when(age.isNull(), "unknown").when(age >= 216, "adult").when(age < 3, "newborn").when(age < 6, "infant").otherwise("child").alias("context"))


@query("X23_category_codes", "SELECT c_mktsegment, string_agg(DISTINCT c_nationkey::VARCHAR, ',' ORDER BY c_nationkey::VARCHAR) AS codes FROM customer WHERE c_nationkey IN (1, 5, 9, 13) GROUP BY c_mktsegment")
def category_codes(spark, sf):
    rows = table(spark, sf, "customer").filter(F.col("c_nationkey").isin(1, 5, 9, 13))
    return rows.groupBy("c_mktsegment").agg(F.array_join(F.sort_array(F.collect_set(F.col("c_nationkey").cast("string"))), ",").alias("codes"))


@query("X25_audience", "SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND coalesce(CASE WHEN c_nationkey < 8 THEN 'fr' END, 'en') = 'en'")
def audience(spark, sf):
    lang = F.coalesce(F.when(F.col("c_nationkey") < 8, "fr"), F.lit("en"))
    return table(spark, sf, "customer").filter((F.col("c_acctbal") > 0) & (lang == "en")).select("c_custkey")


@query("Y4_same_subject", "WITH p AS (SELECT DISTINCT l_orderkey AS a, l_suppkey AS b FROM lineitem WHERE l_quantity >= 48) SELECT x.a, min(y.a) AS nearest FROM p x JOIN p y ON x.b = y.b AND x.a <> y.a GROUP BY x.a")
def same_subject(spark, sf):
    """The first other order that shares a supplier. A supplier's two smallest orders answer for all of its members, so nothing is paired."""
    rows = table(spark, sf, "lineitem").filter("l_quantity >= 48").select(F.col("l_orderkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()
    first = rows.groupBy("b").agg(F.min("a").alias("one"))
    second = rows.join(first, "b").filter("a <> one").groupBy("b").agg(F.min("a").alias("two"))
    other = F.when(F.col("a") == F.col("one"), F.col("two")).otherwise(F.col("one"))
    return rows.join(first, "b").join(second, "b", "left").groupBy("a").agg(F.min(other).alias("nearest")).filter("nearest is not null")


@query("Y8_country_languages", "WITH c(n, lang) AS (VALUES (0, 'en'), (1, 'fr'), (2, 'de'), (3, 'es')) SELECT lang, count(*) AS customers FROM customer JOIN c ON c_nationkey % 4 = n GROUP BY lang")
def country_languages(spark, sf):
    lang = F.element_at(F.array(*[F.lit(x) for x in ("en", "fr", "de", "es")]), (F.col("c_nationkey") % 4 + 1).cast("int"))
    return table(spark, sf, "customer").groupBy(lang.alias("lang")).agg(F.count(F.lit(1)).alias("customers"))


@query("Y13_last_modified", "SELECT o_orderkey, strftime(coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END, max(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END) OVER (PARTITION BY o_custkey), TIMESTAMP '1992-01-01'), '%Y-%m-%d') AS lastmod FROM orders")
def last_modified(spark, sf):
    """An item's own date, else its group's newest, else a default."""
    own = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate"))
    newest = F.max(own).over(Window.partitionBy("o_custkey"))
    return table(spark, sf, "orders").select("o_orderkey", F.date_format(F.coalesce(own, newest, F.lit("1992-01-01").cast("timestamp_ntz")), "yyyy-MM-dd").alias("lastmod"))


@query("A18_counters", "SELECT count(*) AS customers, count(*) FILTER (c_acctbal < 0) AS in_debt, count(DISTINCT c_nationkey) AS nations FROM customer")
def counters(spark, sf):
    return table(spark, sf, "customer").agg(F.count(F.lit(1)).alias("customers"), F.count_if(F.col("c_acctbal") < 0).alias("in_debt"), F.countDistinct("c_nationkey").alias("nations"))
