"""Further operators of the survey: stems, downplaying, conditional terms, catalogue filters, rotation, alerts, sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import ACCENTED, PLAIN, fold, tokens
from ..operators.keywords import CLITICS, labels_of, pattern_of, with_matches
from ..operators.ordering import numbered
from ..operators.variants import find_first, priced
from ..sources.sinks import manifest, read_lines, write_document_files, write_export
from ..sources.tables import table
from ..streaming.jobs import shared_folder
from .registry import query

_FOLD = f"translate(regexp_replace(lower(%s), '[‌‍]', '', 'g'), '{ACCENTED}', '{PLAIN}')"
_TOK = "regexp_extract_all(%s, '[\\p{L}\\p{M}\\p{N}_]+')"

# Arabic prefixes and suffixes that are written with their word.
PREFIXES, SUFFIXES = "وال|بال|كال|فال|ال|لل|و|ب|ل|ف|ك", "ها|هم|ات|ون|ين|ية|ه|ة|ي"
_LATIN, _ARABIC = "abcdefghij", "والبةيمنتك"


@query("N5_clitic_stem", f"SELECT doc_id, w, CASE WHEN length(regexp_replace(a, '^(?:{PREFIXES})', '')) >= 3 THEN CASE WHEN length(regexp_replace(regexp_replace(a, '^(?:{PREFIXES})', ''), '(?:{SUFFIXES})$', '')) >= 3 THEN regexp_replace(regexp_replace(a, '^(?:{PREFIXES})', ''), '(?:{SUFFIXES})$', '') ELSE regexp_replace(a, '^(?:{PREFIXES})', '') END ELSE a END AS stem FROM (SELECT doc_id, w, translate(w, '{_LATIN}', '{_ARABIC}') AS a FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[a-j]{{4,}}')) AS w FROM documents))")
def clitic_stem(spark, sf):
    """Arabic stems: a prefix, then a suffix goes if three letters stay. The words are those of the texts' first ten letters, written in Arabic."""
    words = table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[a-j]{4,}"), 0))).alias("w")).distinct()
    whole = F.translate("w", _LATIN, _ARABIC)
    front = F.regexp_replace(whole, f"^(?:{PREFIXES})", "")
    back = F.regexp_replace(front, f"(?:{SUFFIXES})$", "")
    return words.select("doc_id", "w", F.when(F.length(front) >= 3, F.when(F.length(back) >= 3, back).otherwise(front)).otherwise(whole).alias("stem"))


_CLITICS = "|".join(CLITICS)
_STEMS_SQL = f"SELECT DISTINCT doc_id, a, CASE WHEN length(regexp_replace(a, '^(?:{_CLITICS})', '')) >= 3 THEN regexp_replace(a, '^(?:{_CLITICS})', '') ELSE a END AS stem FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[a-j]{{4,}}')), '{_LATIN}', '{_ARABIC}') AS a FROM documents)"


@query("N5_form_expansion", f"WITH w AS ({_STEMS_SQL}), f AS (SELECT DISTINCT doc_id, stem, unnest(list_prepend(stem, list_transform([{', '.join(repr(c) for c in CLITICS)}], lambda c: c || stem))) AS form FROM w) SELECT f.doc_id, f.stem, count(*) AS reached FROM f JOIN w ON w.doc_id = f.doc_id AND w.a = f.form GROUP BY ALL HAVING count(*) > 1")
def form_expansion(spark, sf):
    """Arabic stems of which a document has more than one form: a stem is asked for with each article and preposition that may be written with it."""
    a = F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit("[a-j]{4,}"), 0), lambda w: F.translate(w, _LATIN, _ARABIC)))).alias("a")
    words = table(spark, sf, "documents").select("doc_id", a).distinct()
    bare = F.regexp_replace("a", f"^(?:{_CLITICS})", "")
    stems = words.select("doc_id", F.when(F.length(bare) >= 3, bare).otherwise(F.col("a")).alias("stem")).distinct()
    forms = stems.select("doc_id", "stem", F.explode(F.array_distinct(F.concat(F.array("stem"), F.transform(F.array(*[F.lit(c) for c in CLITICS]), lambda c: F.concat(c, F.col("stem")))))).alias("a"))
    return forms.join(words, ["doc_id", "a"]).groupBy("doc_id", "stem").agg(F.count(F.lit(1)).alias("reached")).filter("reached > 1")


# Rows of keyword tables in words of our own: what soothes, and what an alarm is about.
_CALM = {
    "soothes": ["do not worry", "don't worry", "no need to", "nothing serious", "harmless", "will pass by itself", "kein grund zur sorge", "nichts schlimmes", "harmlos", "geht von selbst", "rien de grave", "ne vous inquiétez pas", "sans gravité", "no es grave", "no se preocupe", "no te preocupes", "se pasa solo", "não é grave", "não se preocupe"],
    "alarm": ["emergency", "urgent", "ambulance", "call now", "trash", "worthless", "password", "notfall", "notarzt", "dringend", "urgence", "ambulancia", "urgencia", "emergencia", "emergência"],
}
_CALM_SQL = {label: f"regexp_matches(lower(text), {chr(39)}{pattern_of(words).replace(chr(39), chr(39) * 2)}{chr(39)})" for label, words in _CALM.items()}


@query("T12_downplays_alarm", f"SELECT conv_id, turn, soothes, alarm, CASE WHEN alarm AND soothes THEN 'downplays' WHEN alarm AND length(text) < 40 THEN 'too short' ELSE 'safe' END AS verdict FROM (SELECT *, {_CALM_SQL['soothes']} AS soothes, {_CALM_SQL['alarm']} AS alarm FROM conversations)")
def downplays_alarm(spark, sf):
    """An answer that soothes where there is an alarm, or says next to nothing of it, is unsafe."""
    rows = with_matches(table(spark, sf, "conversations").select("conv_id", "turn", "text", F.lower("text").alias("low")), "low", [(x, k) for x, words in _CALM.items() for k in words])
    soothes, alarm = (F.array_contains(labels_of(), x) for x in _CALM)
    return rows.select("conv_id", "turn", soothes.alias("soothes"), alarm.alias("alarm"), F.when(alarm & soothes, "downplays").when(alarm & (F.length("text") < 40), "too short").otherwise("safe").alias("verdict"))


@query("T18_conditional_terms", "SELECT c_custkey, n_name, CASE WHEN r_name IN ('AFRICA', 'ASIA') AND c_acctbal < 0 THEN 'region and income' WHEN r_name IN ('AFRICA', 'ASIA') THEN 'region' WHEN c_acctbal < 0 THEN 'income' END AS terms FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name IN ('AFRICA', 'ASIA') OR c_acctbal < 0")
def conditional_terms(spark, sf):
    """Terms that are added for callers of some regions or of low income."""
    region = table(spark, sf, "region").filter("r_name in ('AFRICA', 'ASIA')").select(F.col("r_regionkey").alias("n_regionkey"), F.lit(True).alias("there"))
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey").join(region, "n_regionkey", "left").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", F.coalesce("there", F.lit(False)).alias("there"))
    rows = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal").join(nation, "c_nationkey")
    low = F.coalesce(F.col("c_acctbal") < 0, F.lit(False))
    return rows.filter(F.col("there") | low).select("c_custkey", "n_name", F.when(F.col("there") & low, "region and income").when(F.col("there"), "region").otherwise("income").alias("terms"))


@query("X2_first_name_in_message", f"WITH b AS (SELECT DISTINCT ({_TOK % (_FOLD % 'text')})[1] AS term FROM benchmark), t AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM (SELECT doc_id, {_TOK % (_FOLD % 'text')} AS t FROM documents)) SELECT doc_id, arg_min(term, pos) AS first, count(*) AS named FROM t JOIN b USING (term) GROUP BY doc_id")
def first_name(spark, sf):
    """The first of a list of names (the first words of benchmark items) in each text: positions are exploded, names join by word, a minimum decides."""
    names = table(spark, sf, "benchmark").select(F.get(tokens(fold(F.col("text"))), F.lit(0)).alias("term")).distinct()
    words = table(spark, sf, "documents").select("doc_id", F.posexplode(tokens(fold(F.col("text")))).alias("pos", "term"))
    return words.join(names, "term").groupBy("doc_id").agg(F.min_by("term", "pos").alias("first"), F.count(F.lit(1)).alias("named"))


_SAME_SUBJECT = [("Brand#1", "Brand#2"), ("Brand#3", "Brand#4"), ("Brand#4", "Brand#5"), ("Brand#7", "Brand#9")]  # pairs of topics on one subject
_PUBLISHED_SQL = "SELECT p_brand FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_quantity >= 49 AND l_discount >= 0.09 AND p_size < 4 GROUP BY p_brand HAVING count(*) >= 3"


@query(
    "X11_pending_topics",
    f"""WITH p(a, b) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in _SAME_SUBJECT)}), s AS (SELECT a, b FROM p UNION SELECT b, a FROM p), done AS ({_PUBLISHED_SQL}
) SELECT DISTINCT p_brand AS topic FROM part WHERE p_brand NOT IN (SELECT p_brand FROM done) AND p_brand NOT IN (SELECT s.a FROM s JOIN done ON s.b = done.p_brand)""",
)
def pending_topics(spark, sf):
    """The plan less what is published and less what speaks of the same subject as something published (one pair away)."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size")
    lines = table(spark, sf, "lineitem").filter("l_quantity >= 49 and l_discount >= 0.09").groupBy("l_partkey").count()
    done = lines.join(part.filter("p_size < 4"), "l_partkey").groupBy(F.col("p_brand").alias("topic")).agg(F.sum("count").alias("n")).filter("n >= 3").select("topic")
    pairs = spark.createDataFrame([p for a, b in _SAME_SUBJECT for p in ((a, b), (b, a))], "topic string, other string")
    siblings = pairs.join(done.withColumnRenamed("topic", "other"), "other", "left_semi").select("topic")
    return part.select(F.col("p_brand").alias("topic")).distinct().join(done.unionByName(siblings).distinct(), "topic", "left_anti")


@query("X18_catalogue_filter", "SELECT doc_id, source, lang FROM documents WHERE regexp_matches(source, '^src1[0-9]?$') AND lang IN ('en', 'fr')")
def catalogue_filter(spark, sf):
    """Entries by a pattern of their key and the languages asked for; the languages reach the scan."""
    return table(spark, sf, "documents").filter(F.col("lang").isin("en", "fr") & F.col("source").rlike("^src1[0-9]?$")).select("doc_id", "source", "lang")


_SHAPES = ['{"a":{"b":[1,{"c":%s}],"k2":"k"}}', '[[],{"note":"k: 5","z":[[%s]]},{"k":7}]', '{"k":null,"sub":{"k":"","x":%s},"k_":3}', '{"text":"\\"k\\": 9"}', '{"deep":{"deep":{"deep":{"deep":%s}}}}', "not json %s"]


@query("X22_keys_in_untyped_json", "SELECT event_id, CASE WHEN event_id % 6 NOT IN (3, 5) THEN json_extract_string(props, '$.k') END AS value FROM events")
def keys_in_json(spark, sf):
    """The first value of a key in documents whose shape isn't known: the events' own properties, wrapped six ways, some without the key or no JSON at all."""
    body = F.element_at(F.array(*[F.concat(F.lit(a), F.col("props"), F.lit(z)) if "%s" in shape else F.lit(shape) for shape in _SHAPES for a, _, z in [shape.partition("%s")]]), (F.col("event_id") % len(_SHAPES) + 1).cast("int"))
    docs = table(spark, sf, "events").select("event_id", body.alias("body"))
    found = find_first(docs, "event_id", "body", ["k"])
    return docs.select("event_id").join(found, "event_id", "left")


@query(
    "X22_price_of_job",
    "WITH o AS (SELECT p_brand AS name, min(p_retailprice) AS price FROM part GROUP BY p_brand) SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 4 < 3 THEN (SELECT price FROM o WHERE name = 'Brand#' || (1 + o_custkey % 9)) END, (SELECT min(price) FROM o)) AS price FROM orders",
)
def price_of_job(spark, sf):
    """Each job at the price of the offer that it names somewhere, under one of several keys; the cheapest if it names none that is known."""
    name = F.concat(F.lit("Brand#"), (1 + F.col("o_custkey") % 9).cast("string"))
    shape = F.col("o_orderkey") % 4
    body = F.when(shape == 0, F.to_json(F.struct(F.struct(F.struct(name.alias("offeringId")).alias("b")).alias("a")))).when(shape == 1, F.to_json(F.struct(F.array(F.lit("x"), F.lit("service")).alias("list"), F.array(F.struct(name.alias("Service"))).alias("z"))))
    body = body.when(shape == 2, F.to_json(F.struct(F.lit("service").alias("kind"), F.struct(name.alias("offering")).alias("job")))).otherwise(F.to_json(F.struct(F.lit("offering: Brand#1").alias("note"))))
    jobs = table(spark, sf, "orders").select("o_orderkey", body.alias("body"))
    offers = table(spark, sf, "part").groupBy(F.col("p_brand").alias("name")).agg(F.min("p_retailprice").alias("price"))
    return priced(jobs, "o_orderkey", offers, find_first(jobs, "o_orderkey", "body", ["offeringid", "offering", "service"]))


_PLAIN = r"trim(regexp_replace(regexp_replace(regexp_replace(%s, '<[^>]*>', ' ', 'g'), '\[[0-9]+\]', '', 'g'), '\s+', ' ', 'g'))"


@query("Y5_faq_extraction", f"SELECT page_id, pos, {_PLAIN % 'q'} AS question, {_PLAIN % 'a'} AS answer FROM (SELECT page_id, pos, regexp_extract(part, '(?s)^(.*?)(?:</b>|<br>|$)', 1) AS q, regexp_replace(part, '(?s)^.*?(?:</b>|<br>)', '') AS a FROM (SELECT page_id, unnest(p) AS part, generate_subscripts(p, 1) - 1 AS pos FROM (SELECT page_id, string_split(regexp_extract(html, '(?s)</h1>(.*?)(?:<footer|$)', 1), '<b>') AS p FROM pages)) WHERE pos > 0) WHERE {_PLAIN % 'q'} <> ''")
def faq_extraction(spark, sf):
    """The section after a page's heading, split at its bold questions: each with the text up to the next one, citation marks left out."""
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\[[0-9]+\]", ""), r"[\t\n\f\r ]+", " "))
    section = F.regexp_extract("html", r"(?s)</h1>(.*?)(?:<footer|$)", 1)
    each = table(spark, sf, "pages").select("page_id", F.posexplode(F.split(section, "<b>")).alias("pos", "part")).filter("pos > 0")
    question, answer = F.regexp_extract("part", r"(?s)^(.*?)(?:</b>|<br>|$)", 1), F.regexp_replace("part", r"(?s)^.*?(?:</b>|<br>)", "")
    return each.select("page_id", F.col("pos").cast("long").alias("pos"), plain(question).alias("question"), plain(answer).alias("answer")).filter("question <> ''")


@query("Y9_locale_sort")
def locale_sort(spark, sf):
    """Names in the order of a language's alphabet; DuckDB has no such collation here, so a test holds the order."""
    return table(spark, sf, "nation").select("n_nationkey", "n_name", F.row_number().over(Window.orderBy(F.collate("n_name", "de"), "n_nationkey")).alias("place"))  # 25 nations


@query("W11_rotation", "SELECT o_orderkey, p_partkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS k FROM (SELECT o_orderdate, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_orderdate)) JOIN (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS j, count(*) OVER () AS n FROM part) ON j = k % n")
def rotation(spark, sf):
    """One item a day, none again before all have been: days and items are numbered over ranges and meet by the remainder."""
    days = numbered(table(spark, sf, "orders").groupBy("o_orderdate").agg(F.min("o_orderkey").alias("o_orderkey")), ["o_orderdate", "o_orderkey"], "k")
    items = table(spark, sf, "part").select("p_partkey")
    n = items.agg(F.count(F.lit(1)).alias("n"))  # one row
    return days.crossJoin(F.broadcast(n)).withColumn("j", F.col("k") % F.col("n")).join(numbered(items, ["p_partkey"], "j"), "j").select("o_orderkey", "p_partkey")


_HOURLY = "SELECT date_trunc('hour', ts) AS h, count(*) FILTER (event_type = 'purchase') = 0 AS bad FROM events GROUP BY 1"


@query("ST8_hysteresis", f"WITH h AS ({_HOURLY}), r AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (ORDER BY h) AS run FROM h), c AS (SELECT *, sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY h) AS streak FROM r) SELECT strftime(h, '%Y-%m-%d %H') AS hour, streak::BIGINT AS streak FROM c WHERE bad AND streak >= 3 AND (streak - 3) % 6 = 0")
def hysteresis(spark, sf):
    """A warning at the third bad hour in a row, and again each six hours as long as it lasts. Hours are few, so their windows are one task's."""
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    hours = table(spark, sf, "events").groupBy(hour.alias("h")).agg((F.sum((F.col("event_type") == "purchase").cast("int")) == 0).alias("bad"))
    runs = hours.withColumn("run", F.sum(F.when(F.col("bad"), 0).otherwise(1)).over(Window.orderBy("h")))
    streak = F.sum(F.col("bad").cast("int")).over(Window.partitionBy("run").orderBy("h"))
    return runs.withColumn("streak", streak).filter("bad and streak >= 3 and (streak - 3) % 6 = 0").select(F.date_format("h", "yyyy-MM-dd HH").alias("hour"), "streak")


@query("S9_jsonl_sink", "SELECT doc_id, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id")
def jsonl_sink(spark, sf):
    """A file of JSON lines for each document, committed together, and what is read back from them."""
    path = f"{shared_folder(spark)}/jsonl-{uuid.uuid4().hex}"
    write_document_files(table(spark, sf, "documents").select("doc_id", "text", "lang", "source"), path, "doc_id")
    back = read_lines(spark, path, "doc_id long, text string, lang string, source string")
    return back.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("S17_sorted_export", "SELECT doc_id, lang, source, row_number() OVER (ORDER BY source, doc_id) AS line, count(*) OVER (PARTITION BY source) AS of_source FROM documents WHERE source IS NOT NULL AND doc_id IS NOT NULL")
def sorted_export(spark, sf):
    """The catalogue as CSV and JSON in order, with its counts in the same commit; each entry's line over all files, read back with the counts."""
    path = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    rows = table(spark, sf, "documents").filter("source is not null and doc_id is not null").select("source", "doc_id", "lang")
    write_export(rows, path, ["source", "doc_id"], ["source", "lang"])
    back = read_lines(spark, path, "source string, doc_id long, lang string")
    own = F.row_number().over(Window.partitionBy("before").orderBy("source", "doc_id"))  # a part is one task's rows
    counts = spark.createDataFrame(list(manifest(path)["counts"].get("source", {}).items()), "source string, of_source long")
    return back.select("doc_id", "lang", "source", (F.col("before") + own).cast("long").alias("line")).join(counts, "source")
