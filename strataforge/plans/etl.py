"""Extraction, cleaning, structure and ingest queries over ``documents`` and ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import ACCENTED, PLAIN, clean_line, dehyphenate, fold, share, slug, tokens, unify_digits, visible_text, word_count
from ..operators import etl as E
from ..operators.keywords import labels_of, pattern_of, with_matches
from ..operators.pages import page_lines
from ..sources.tables import table
from .registry import query

_CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(%s, 'ﬁ', 'fi'), 'ﬂ', 'fl'), '[​‌‍­]', '', 'g'), '[\x00-\x1f\x7f ]', ' ', 'g'), ' +', ' ', 'g'))"
_LINES = f"WITH l AS (SELECT doc_id, source, generate_subscripts(parts, 1) - 1 AS line_no, {_CLEAN % 'unnest(parts)'} AS line FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents))"
_WORDS = r"len(regexp_extract_all(%s, '\S+'))"
_FOLD = f"translate(regexp_replace(lower(%s), '[‌‍]', '', 'g'), '{ACCENTED}', '{PLAIN}')"
_VISIBLE = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"


@query("S5_content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))


_INLINE = r"(?:[^<]|</?(?:b|br|i|em|strong|a|span|u|code)\b[^>]*>)*"


@query(
    "S6_html_lines",
    rf"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<(?:style|head)\b.*?</(?:style|head)>', ' ', 'g'), '(?is)<nav\b.*?</nav>', ' ', 'g'), '(?is)<footer\b.*?</footer>', ' ', 'g'), '(?s)<!--.*?-->', '', 'g') AS h FROM pages
), b AS (SELECT page_id, unnest(regexp_extract_all(h, '(?is)<(?:h[1-4]|p|li)\b[^>]*>{_INLINE}')) AS block, generate_subscripts(regexp_extract_all(h, '(?is)<(?:h[1-4]|p|li)\b[^>]*>{_INLINE}'), 1) AS n FROM p
), t AS (SELECT page_id, lower(regexp_extract(block, '^<([a-zA-Z0-9]+)', 1)) AS tag, regexp_replace(regexp_replace(block, '^<[^>]*>', ''), '(?i)<br[^>]*>', ' ', 'g') AS x, n FROM b
), l AS (SELECT page_id, n, tag, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS line FROM t
) SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS pos, tag, line, (CASE tag WHEN 'h1' THEN 20 WHEN 'h2' THEN 15 WHEN 'h3' THEN 13 WHEN 'h4' THEN 12 ELSE 10 END)::BIGINT AS size FROM l WHERE line <> ''""",
)
def html_lines(spark, sf):
    """Lines of pages with a size by tag, read by a stack of tags; the SQL relies on how these pages are built, and tests hold the rest."""
    return page_lines(table(spark, sf, "pages"))


@query("S7_visible_text", f"SELECT page_id, {_VISIBLE} AS visible, {_WORDS % _VISIBLE} AS words FROM pages")
def visible(spark, sf):
    text = visible_text(F.col("html"))
    return table(spark, sf, "pages").select("page_id", text.alias("visible")).withColumn("words", word_count(F.col("visible")))


@query("S8_page_metadata", r"""SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title, nullif(regexp_extract(html, '(?i)<html[^>]*\blang="([a-z-]+)"', 1), '') AS lang, coalesce(TRY_CAST(nullif(regexp_extract(html, '\b(20[0-9]{2})\b', 1), '') AS INT), 0) AS year FROM pages""")
def page_metadata(spark, sf):
    title = F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    lang = F.regexp_extract("html", r'(?i)<html[^>]*\blang="([a-z-]+)"', 1)
    year = F.regexp_extract("html", r"\b(20[0-9]{2})\b", 1)
    return table(spark, sf, "pages").select("page_id", F.nullif(title, F.lit("")).alias("title"), F.nullif(lang, F.lit("")).alias("lang"), F.coalesce(F.nullif(year, F.lit("")).cast("int"), F.lit(0)).alias("year"))


@query("S10_orphan_prune", "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS kept FROM documents")
def orphan_prune(spark, sf):
    """Which documents the catalogue (labels) still knows."""
    known = table(spark, sf, "labels").select("doc_id", F.lit(True).alias("known")).distinct()
    return table(spark, sf, "documents").select("doc_id").join(known, "doc_id", "left").select("doc_id", F.coalesce("known", F.lit(False)).alias("kept"))


_OLD = "SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN sha256('x') ELSE sha256(text) END AS hash, CASE WHEN doc_id % 15 = 4 THEN NULL ELSE source END AS source FROM documents WHERE doc_id % 11 <> 5"


@query("S11_incremental", f"SELECT d.doc_id, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN o.hash <> sha256(d.text) THEN 'changed' WHEN o.source IS DISTINCT FROM d.source THEN 'catalogue' ELSE 'unchanged' END AS status FROM documents d LEFT JOIN ({_OLD}) o USING (doc_id)")
def incremental(spark, sf):
    """What an ingest run would do given the state of an earlier one: only hashes meet in the join."""
    now = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("hash"), "source")
    old = now.filter("doc_id % 11 <> 5").select("doc_id", F.when(F.col("doc_id") % 10 == 3, F.sha2(F.lit("x"), 256)).otherwise(F.col("hash")).alias("old_hash"), F.when(F.col("doc_id") % 15 != 4, F.col("source")).alias("old_source"), F.lit(True).alias("was"))
    status = F.when(F.col("was").isNull(), "new").when(F.col("old_hash") != F.col("hash"), "changed").when(~F.col("old_source").eqNullSafe(F.col("source")), "catalogue").otherwise("unchanged")
    return now.join(old, "doc_id", "left").select("doc_id", status.alias("status"))


@query("S12_ingest_status", f"WITH s AS (SELECT CASE WHEN d.doc_id IS NULL THEN 'missing_file' WHEN l.doc_id IS NULL THEN 'not_in_catalogue' WHEN {_WORDS % 'd.text'} < 50 THEN 'no_text' WHEN l.toxic = 1 THEN 'skipped_excluded' ELSE 'ok' END AS status FROM documents d FULL JOIN (SELECT doc_id + CASE WHEN doc_id % 50 = 0 THEN 100000000 ELSE 0 END AS doc_id, toxic FROM labels) l ON d.doc_id = l.doc_id) SELECT status, count(*) AS n FROM s GROUP BY status")
def ingest_status(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("d"), word_count(F.col("text")).alias("words"))
    known = table(spark, sf, "labels").select((F.col("doc_id") + F.when(F.col("doc_id") % 50 == 0, 100_000_000).otherwise(0)).alias("l"), "toxic")
    status = F.when(F.col("d").isNull(), "missing_file").when(F.col("l").isNull(), "not_in_catalogue").when(F.col("words") < 50, "no_text").when(F.col("toxic") == 1, "skipped_excluded").otherwise("ok")
    return docs.join(known, F.col("d") == F.col("l"), "full").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("S14_index_stats", f"SELECT count(*) AS docs, count(DISTINCT source) AS sources, sum({_WORDS % 'text'})::BIGINT AS words, count(*) FILTER (lang = 'en') AS english FROM documents")
def index_stats(spark, sf):
    return table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("docs"), F.countDistinct("source").alias("sources"), F.sum(word_count(F.col("text"))).alias("words"), F.count_if(F.col("lang") == "en").alias("english"))


@query("S1_union_and_duplicates", "WITH u AS (SELECT doc_id, source FROM documents WHERE lang IN ('en', 'de') UNION ALL SELECT doc_id, source FROM documents WHERE lang IN ('de', 'fr')) SELECT doc_id, count(*) AS n FROM u GROUP BY doc_id HAVING count(*) > 1")
def union_duplicates(spark, sf):
    """Two catalogues united by name, and the keys that both hold."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang")
    both = docs.filter(F.col("lang").isin("en", "de")).unionByName(docs.filter(F.col("lang").isin("de", "fr")))
    return both.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("S2_url_key", r"SELECT page_id, lower(regexp_extract(url, '([^/?#]+?)(?:\.html)?/?(?:[?#].*)?$', 1)) AS name FROM pages")
def url_key(spark, sf):
    """The last part of a url without suffix, query and fragment."""
    return table(spark, sf, "pages").select("page_id", F.lower(F.regexp_extract("url", r"([^/?#]+?)(?:\.html)?/?(?:[?#].*)?$", 1)).alias("name"))


@query("C1_clean_lines", _LINES + " SELECT doc_id, line_no, line FROM l WHERE line <> ''")
def clean_lines(spark, sf):
    return E.lines(table(spark, sf, "documents")).filter("line <> ''").select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")


@query("C2_dehyphenate", r"SELECT doc_id, sha256(regexp_replace(regexp_replace(text, ',', '-' || chr(10), 'g'), '(\w)-\s*\n\s*(\w)', '\1\2', 'g')) AS joined FROM documents")
def dehyphenated(spark, sf):
    """Hyphens before line breaks are removed; commas stand in for them in this corpus."""
    return table(spark, sf, "documents").select("doc_id", F.sha2(dehyphenate(F.regexp_replace("text", ",", "-\n")), 256).alias("joined"))


_NOISE = _LINES + """, p AS (SELECT DISTINCT source, doc_id, regexp_replace(lower(line), '[0-9]', '#', 'g') AS pattern FROM l WHERE length(line) > 3
), n AS (SELECT source, pattern, count(*) AS n FROM p GROUP BY ALL
), t AS (SELECT source, count(DISTINCT doc_id) AS pages FROM l GROUP BY source
), noise AS (SELECT source, pattern FROM n JOIN t USING (source) WHERE pages >= 3 AND n >= greatest(3, floor(pages * 0.04)))
"""


@query("C3_repeated_lines", _NOISE + "SELECT source, pattern FROM noise")
def repeated(spark, sf):
    """Lines that repeat over a source's documents, as headers do over a document's pages."""
    rows = E.lines(table(spark, sf, "documents"), "doc_id", "text", "source")
    return E.repeated_lines(rows, "source", "doc_id", 0.04)


@query("C4_drop_noise", _NOISE + r"SELECT l.doc_id, l.line_no FROM l WHERE line <> '' AND NOT regexp_matches(line, '^[0-9]+$') AND NOT EXISTS (SELECT 1 FROM noise WHERE noise.source = l.source AND pattern = regexp_replace(lower(line), '[0-9]', '#', 'g'))")
def drop_noise(spark, sf):
    rows = E.lines(table(spark, sf, "documents"), "doc_id", "text", "source")
    noise = E.repeated_lines(rows, "source", "doc_id", 0.04)
    kept = rows.filter((F.col("line") != "") & ~F.col("line").rlike("^[0-9]+$")).withColumn("pattern", E.line_pattern(F.col("line")))
    return kept.join(noise, ["source", "pattern"], "left_anti").select("doc_id", F.col("line_no").cast("long").alias("line_no"))


_HEAD = r"(length(line) BETWEEN 3 AND 140 AND NOT regexp_matches(line, '[.,;:]$') AND (line LIKE '%?' OR (length(regexp_replace(line, '[^\p{L}]', '', 'g')) > 0 AND length(regexp_replace(line, '[^\p{Lu}]', '', 'g')) / length(regexp_replace(line, '[^\p{L}]', '', 'g')) > 0.9 AND " + _WORDS % "line" + r" <= 12) OR (" + _WORDS % "line" + r" <= 4 AND regexp_matches(line, '^\p{Lu}'))))"
_SECTIONS = _LINES + f""", h AS (SELECT *, {_HEAD} AS heading FROM l WHERE line <> ''
), s AS (SELECT *, heading AND NOT coalesce(lag(heading) OVER (PARTITION BY doc_id ORDER BY line_no), false) AS start FROM h
), x AS (SELECT *, sum(start::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)::BIGINT AS section FROM s)
"""


@query("C6_sections_islands", _SECTIONS + "SELECT doc_id, section, count(*) AS lines, count(*) FILTER (heading) AS headings FROM x GROUP BY ALL")
def section_islands(spark, sf):
    rows = E.sections(E.lines(table(spark, sf, "documents")).filter("line <> ''"))
    return rows.groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("lines"), F.count_if("heading").alias("headings"))


@query("C8_word_windows", r"SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS words, greatest(ceil(len(regexp_extract_all(text, '\S+')) / 320), 1)::BIGINT AS windows FROM documents")
def word_windows(spark, sf):
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    rows = table(spark, sf, "documents").select("doc_id", words.alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("words"), F.size(E.windows(F.col("w"))).cast("long").alias("windows"))


@query("C9_chunk_fold")
def chunk_fold(spark, sf):
    """Every document's chunks with their word counts; a fold that SQL cannot express, tested by invariants."""
    chunks = table(spark, sf, "documents").select("doc_id", F.posexplode(E.pack(F.col("text"))).alias("n", "chunk"))
    return chunks.select("doc_id", F.col("n").cast("long").alias("n"), F.size("chunk").cast("long").alias("words"), F.sha2(F.array_join("chunk", " "), 256).alias("hash"))


@query("C10_merge_small")
def merged_small(spark, sf):
    """Sections' texts as chunks, small ones merged with their neighbours; tested by invariants."""
    rows = E.sections(E.lines(table(spark, sf, "documents")).filter("line <> ''"))
    texts = rows.groupBy("doc_id", "section").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), " ").alias("text"))
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    per = texts.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("section", words.alias("w")))), lambda s: s["w"]).alias("chunks"))
    return per.select("doc_id", F.posexplode(E.merge_small(F.col("chunks"))).alias("n", "chunk")).select("doc_id", F.col("n").cast("long").alias("n"), F.size("chunk").cast("long").alias("words"))


# Marks of a list of references.
_MARKS = r"(?i)(?<![\p{L}\p{N}_])et al(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])doi:|https?://|PMID"
# The same without looking around: all that is no letter, digit or _ is tripled first, so two neighbours need not share one.
_MARKS_SQL = r"(len(regexp_extract_all(regexp_replace(text, '([^\p{L}\p{N}_])', '\1\1\1', 'g'), '(?i)(?:^|[^\p{L}\p{N}_])et   al(?:[^\p{L}\p{N}_]|$)')) + len(regexp_extract_all(regexp_replace(text, '([^\p{L}\p{N}_])', '\1\1\1', 'g'), '(?i)(?:^|[^\p{L}\p{N}_])doi::')) + len(regexp_extract_all(text, '(?i)https?://|PMID')))"


@query("C11_bibliography", rf"SELECT doc_id, marks::BIGINT AS marks, marks >= 3 AND marks > 0.02 * words AS is_bibliography FROM (SELECT doc_id, {_MARKS_SQL} AS marks, len(regexp_extract_all(text, '\S+')) AS words FROM documents)")
def bibliography(spark, sf):
    """Texts that are lists of references: three marks or more, in more than 2 % of the words."""
    marks = F.regexp_count("text", F.lit(_MARKS))
    return table(spark, sf, "documents").select("doc_id", marks.cast("long").alias("marks"), ((marks >= 3) & (marks > 0.02 * word_count(F.col("text")))).alias("is_bibliography"))


# Rows of keyword tables in words of our own.
_FLAGS = {
    "dose": ["mg$", "ml$", "dose", "dosage", "dosis", "posologie", "dosierung", "tablet", "tropfen", "gouttes", "gotas", "password", "api$"],
    "red": ["seek help", "call an ambulance", "danger sign", "warning sign", "notarzt", "warnzeichen", "signes d'alerte", "signos de alarma", "sinais de alarme", "worthless", "trash", "moron", "all rights reserved"],
}


@query("C12_flags", f"SELECT doc_id, regexp_matches(lower(text), '{pattern_of(_FLAGS['dose'])}') AS has_dose, regexp_matches(lower(text), '{pattern_of(_FLAGS['red']).replace(chr(39), chr(39) * 2)}') AS red_flag, regexp_matches(lower(split_part(text, chr(10), 1)), '{pattern_of(_FLAGS['red']).replace(chr(39), chr(39) * 2)}') AS titled FROM documents")
def flags(spark, sf):
    """Whether a text speaks of doses or of alarm signs, and whether its first line does; one automaton, places tell the rest."""
    rows = table(spark, sf, "documents").select("doc_id", F.lower("text").alias("low"), F.length(F.split_part(F.lower("text"), F.lit("\n"), F.lit(1))).alias("head"))
    found = with_matches(rows, "low", _rows(_FLAGS))
    red = F.filter("matches", lambda m: m["label"] == "red")
    return found.select("doc_id", F.array_contains(labels_of(), "dose").alias("has_dose"), (F.size(red) > 0).alias("red_flag"), F.exists(red, lambda m: m["start"] < F.col("head")).alias("titled"))


_SLUG = f"CASE WHEN regexp_replace(substr(regexp_replace(regexp_replace({_FOLD}, '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 40), '_+$', '') = '' THEN 's' ELSE regexp_replace(substr(regexp_replace(regexp_replace({_FOLD}, '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 40), '_+$', '') END"


@query("C13_chunk_ids", _LINES + f", s AS (SELECT doc_id, line_no, {_SLUG % ('line', 'line')} AS slug FROM l WHERE line <> '') SELECT doc_id, line_no, slug || '#' || row_number() OVER (PARTITION BY doc_id, slug ORDER BY line_no) AS chunk_id FROM s")
def chunk_ids(spark, sf):
    rows = E.lines(table(spark, sf, "documents")).filter("line <> ''").withColumn("slug", slug(F.col("line")))
    n = F.row_number().over(Window.partitionBy("doc_id", "slug").orderBy("line_no"))
    return rows.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.concat_ws("#", "slug", n.cast("string")).alias("chunk_id"))


# Rows of keyword tables in four languages, in words of our own; ``$`` asks for a whole word.
_TOPICS = {
    "motion": ["walk", "run$", "running", "fall$", "marche", "courir", "gehen", "laufen", "caminar", "correr", "tion", "ing$"],
    "house": ["house", "home$", "the$", "maison", "chez$", "la$", "haus", "heim$", "der$", "casa", "hogar"],
    "water": ["water", "sea$", "eau", "mer$", "wasser", "agua", "mar$", "cold water", "eau froide"],
    "person": ["who$", "person", "qui$", "personne", "wer$", "mensch", "quién", "persona", "child", "enfant", "kind$", "niño"],
}
_LABELS = {
    "english": ["the$", "and$", "with$", "which$"], "romance": ["que$", "para$", "pour$", "avec$"], "german": ["und$", "nicht$", "mit$", "für$"],
    "feeding": ["breast", "bottle", "feeding", "sein$", "biberon", "stillen", "flasche", "pecho", "biberón"],
    "sleep": ["sleep", "nap$", "dormir", "sieste", "schlaf", "sueño", "siesta"],
    "rights": ["all rights reserved", "copyright", "licen"],
    "insult": ["trash", "moron", "worthless", "stupid", "idiot", "pathetic"],
}


def _hits_sql(keywords: list[str]) -> str:
    """Matches of one table; the text's spaces are doubled, since a pattern takes the character before a match."""
    return f"len(regexp_extract_all(regexp_replace(lower(text), '([^\\p{{L}}\\p{{M}}\\p{{N}}_])', '\\1\\1', 'g'), '{pattern_of([k.replace(' ', '  ') for k in keywords])}'))"


def _rows(tables: dict[str, list[str]]) -> list[tuple[str, str]]:
    return [(label, k) for label, keywords in tables.items() for k in keywords]


@query(
    "C16_topic_argmax",
    f"WITH c AS (SELECT doc_id, {', '.join(f'{_hits_sql(k)} AS {t}' for t, k in _TOPICS.items())} FROM documents) "
    f"SELECT doc_id, CASE WHEN greatest({', '.join(_TOPICS)}) = 0 THEN NULL {' '.join(f'WHEN {t} = greatest({chr(44).join(_TOPICS)}) THEN {chr(39)}{t}{chr(39)}' for t in _TOPICS)} END AS topic, {' + '.join(_TOPICS)} AS hits FROM c",
)
def topic_argmax(spark, sf):
    """The topic with most keyword hits, the first of the table on ties, null without a hit: one pass of one automaton."""
    rows = with_matches(table(spark, sf, "documents").select("doc_id", F.lower("text").alias("lowered")), "lowered", _rows(_TOPICS))
    topic = E.most_hits("matches", list(_TOPICS))
    return rows.select("doc_id", topic.alias("topic"), F.size("matches").cast("long").alias("hits"))


@query(
    "C17_labels",
    f"WITH f AS (SELECT doc_id, list_filter([{', '.join(f'CASE WHEN {_hits_sql(k)} > 0 THEN {chr(39)}{t}{chr(39)} END' for t, k in _LABELS.items())}], lambda x: x IS NOT NULL) AS found FROM documents) "
    "SELECT doc_id, CASE WHEN len(found) = 0 THEN 'all' ELSE array_to_string(found, ',') END AS labels FROM f",
)
def all_labels(spark, sf):
    """All labels with a keyword in the text, in the table's order, or ``all``."""
    rows = with_matches(table(spark, sf, "documents").select("doc_id", F.lower("text").alias("lowered")), "lowered", _rows(_LABELS))
    found = F.array_intersect(F.array(*[F.lit(x) for x in _LABELS]), labels_of())
    return rows.select("doc_id", F.array_join(F.when(F.size(found) == 0, F.array(F.lit("all"))).otherwise(found), ",").alias("labels"))


@query("C19_citation", "SELECT doc_id, source || CASE WHEN doc_id % 3 = 0 THEN '' ELSE ' (' || (2000 + doc_id % 25) || ')' END || ', p. ' || (doc_id % 7 + 1) || CASE WHEN doc_id % 2 = 0 THEN ', ' || (doc_id % 7 + 3) ELSE '' END AS citation FROM documents")
def citation(spark, sf):
    d = F.col("doc_id")
    year = F.when(d % 3 == 0, "").otherwise(F.concat(F.lit(" ("), (2000 + d % 25).cast("string"), F.lit(")")))
    pages = F.array_join(F.array_compact(F.array((d % 7 + 1).cast("string"), F.when(d % 2 == 0, (d % 7 + 3).cast("string")))), ", ")
    return table(spark, sf, "documents").select("doc_id", F.concat("source", year, F.lit(", p. "), pages).alias("citation"))


@query("N1_fold_translate", f"SELECT doc_id, sha256({_FOLD % 'text'}) AS folded FROM documents")
def folded(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(fold(F.col("text")), 256).alias("folded"))


@query("N3_tokens", "SELECT doc_id, len(t) AS tokens, len(list_distinct(t)) AS distinct_tokens FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+') AS t FROM documents)")
def token_counts(spark, sf):
    t = tokens(F.lower("text"))
    return table(spark, sf, "documents").select("doc_id", t.alias("t")).select("doc_id", F.size("t").cast("long").alias("tokens"), F.size(F.array_distinct("t")).cast("long").alias("distinct_tokens"))


@query("N6_prefix_terms", f"SELECT doc_id, len(list_filter(['thor', 'eau', 'sch', 'ment'], lambda p: len(list_filter(t, lambda w: starts_with(w, p))) > 0))::BIGINT AS matched FROM (SELECT doc_id, list_distinct(regexp_extract_all({_FOLD % 'text'}, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')) AS t FROM documents)")
def prefix_terms(spark, sf):
    words = F.array_distinct(tokens(fold(F.col("text"))))
    asked = F.array(*[F.lit(p) for p in ("thor", "eau", "sch", "ment")])
    return table(spark, sf, "documents").select("doc_id", F.size(F.filter(asked, lambda p: F.exists(words, lambda w: w.startswith(p)))).cast("long").alias("matched"))


# Frequent words by language, and the scripts that decide by themselves.
_MARK = {
    "en": ["the", "and", "of", "was", "that", "with", "for", "is", "to", "he", "she", "my"], "fr": ["le", "la", "les", "et", "des", "une", "du", "que", "pour", "est", "dans", "mon"],
    "de": ["der", "die", "und", "das", "nicht", "ist", "ein", "eine", "mit", "für", "den", "mein"], "es": ["el", "los", "y", "por", "las", "una", "del", "para", "con", "su", "mi", "se"],
}
_SCRIPTS = {"ru": r"\p{Cyrillic}", "ar": r"\p{Arabic}", "hi": r"\p{Devanagari}"}
_JAVA_SCRIPTS = {"ru": r"\p{IsCyrillic}", "ar": r"\p{IsArabic}", "hi": r"\p{IsDevanagari}"}


def _marks_sql(lang: str) -> str:
    return f"len(list_filter(t, lambda w: list_contains([{', '.join(repr(m) for m in _MARK[lang])}], w)))"


def _script_sql(lang: str) -> str:
    return rf"2 * length(regexp_replace(text, '[^{_SCRIPTS[lang]}]|[^\p{{L}}]', '', 'g')) > length(regexp_replace(text, '[^\p{{L}}]', '', 'g'))"


_CHOOSE = "WHEN es > en AND es >= fr AND es >= de THEN 'es' WHEN fr > en AND fr >= de THEN 'fr' WHEN de > en THEN 'de' ELSE 'en'"


@query(
    "N8_detect_language",
    f"WITH t AS (SELECT *, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+') AS t FROM documents), c AS (SELECT *, {', '.join(f'{_marks_sql(k)} AS {k}' for k in _MARK)} FROM t) "
    f"SELECT doc_id, CASE {' '.join(f'WHEN {_script_sql(k)} THEN {chr(39)}{k}{chr(39)}' for k in _SCRIPTS)} {_CHOOSE} END AS detected, lang FROM c",
)
def detect_language(spark, sf):
    """A script that more than half of the letters are of decides; else marker words by language with fixed tie rules. The given language is beside it."""
    rows = table(spark, sf, "documents").select("doc_id", "lang", "text", tokens(F.lower("text")).alias("t"))
    n = {lang: F.size(F.filter("t", lambda w: w.isin(*words))) for lang, words in _MARK.items()}  # noqa: B023
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]", ""))
    by_script = F.coalesce(*[F.when(2 * F.length(F.regexp_replace("text", rf"[^{p}]|[^\p{{L}}]", "")) > letters, F.lit(lang)) for lang, p in _JAVA_SCRIPTS.items()])
    by_words = F.when((n["es"] > n["en"]) & (n["es"] >= n["fr"]) & (n["es"] >= n["de"]), "es").when((n["fr"] > n["en"]) & (n["fr"] >= n["de"]), "fr").when(n["de"] > n["en"], "de").otherwise("en")
    return rows.select("doc_id", F.coalesce(by_script, by_words).alias("detected"), "lang")


@query("N9_latin_share", r"SELECT doc_id, round(length(regexp_replace(text, '[^A-Za-zÀ-ÿ]', '', 'g')) / greatest(length(regexp_replace(text, '[^\p{L}]', '', 'g')), 1), 6) AS part FROM documents")
def latin_share(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(share(F.col("text"), "A-Za-zÀ-ÿ"), 6).alias("part"))


# Rows of a marker table: words that stand in one of these languages only.
_FOREIGN = {
    "en": ["the$", "and$", "with$", "which$", "that$", "of$"], "fr": ["les$", "des$", "est$", "pour$", "une$", "dans$"],
    "de": ["der$", "und$", "nicht$", "ist$", "eine$", "mit$"], "es": ["los$", "las$", "una$", "por$", "para$", "del$"],
}
_NAME = r"([\p{L}\p{N},;] )\p{Lu}[\p{L}\p{N}]+"


def _leak_sql(lang: str) -> str:
    return f"regexp_matches(t, '{pattern_of([k for other, words in _FOREIGN.items() if other != lang for k in words])}')"


@query(
    "N10_leak",
    rf"""SELECT page_id, CASE l {' '.join(f"WHEN '{x}' THEN {_leak_sql(x)}" for x in _FOREIGN)} ELSE false END AS leak FROM (SELECT page_id, regexp_extract(html, '(?i)<html[^>]*\blang="([a-z-]+)"', 1) AS l, lower(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '{_NAME}', '\1', 'g')) AS t FROM pages)""",
)
def leak(spark, sf):
    """Titles that hold a marker word of another language than their page's, names (capitals inside a sentence) left out."""
    lang = F.regexp_extract("html", r'(?i)<html[^>]*\blang="([a-z-]+)"', 1)
    title = F.lower(F.regexp_replace(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1), _NAME, "$1"))
    rows = with_matches(table(spark, sf, "pages").select("page_id", lang.alias("l"), title.alias("t")), "t", _rows(_FOREIGN))
    foreign = F.size(F.filter("matches", lambda m: m["label"] != F.col("l"))) > 0
    return rows.select("page_id", (F.col("l").isin(*_FOREIGN) & foreign).alias("leak"))


@query("N11_unify_digits", "SELECT part.p_partkey, translate(translate(p_size::VARCHAR, '0123456789', '٠١٢٣٤٥٦٧٨٩'), '٠١٢٣٤٥٦٧٨٩', '0123456789')::INT AS size FROM part")
def unified(spark, sf):
    return table(spark, sf, "part").select("p_partkey", unify_digits(F.translate(F.col("p_size").cast("string"), "0123456789", "٠١٢٣٤٥٦٧٨٩")).cast("int").alias("size"))


@query("X16_carry_header", _LINES + r", h AS (SELECT doc_id, line_no, last_value(CASE WHEN regexp_matches(line, '^\p{Lu}\S* \S+$|\?$') THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS header FROM l) SELECT doc_id, line_no, header FROM h WHERE header IS NOT NULL")
def carry_header(spark, sf):
    """Each line with the last header line above it."""
    by = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    header = F.when(F.col("line").rlike(r"^\p{Lu}\S* \S+$|\?$"), F.col("line"))
    return E.lines(table(spark, sf, "documents")).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.last(header, ignorenulls=True).over(by).alias("header")).filter("header is not null")


@query("X15_semi_anti_union", "SELECT doc_id FROM documents WHERE lang = 'fr' AND doc_id IN (SELECT doc_id FROM labels) UNION SELECT doc_id FROM documents WHERE lang = 'de' AND doc_id NOT IN (SELECT doc_id FROM labels)")
def semi_anti_union(spark, sf):
    docs, known = table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels").select("doc_id")
    kept = docs.filter("lang = 'fr'").join(known, "doc_id", "left_semi")
    return kept.unionByName(docs.filter("lang = 'de'").join(known, "doc_id", "left_anti")).select("doc_id").distinct()


@query("X19_strip_markers", r"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(text, '\[[0-9]+\]', '', 'g'), ' +([.,;:])', '\1', 'g'), ' {2,}', ' ', 'g'))) AS clean FROM documents")
def strip_markers(spark, sf):
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"\[[0-9]+\]", ""), " +([.,;:])", "$1"), " {2,}", " ")
    return table(spark, sf, "documents").select("doc_id", F.sha2(F.trim(text), 256).alias("clean"))


@query("A1_modal_counts", "SELECT source, lang, n FROM (SELECT source, lang, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS k FROM documents GROUP BY source, lang) WHERE k = 1")
def modal_counts(spark, sf):
    """The most common language of each source, the first by name on ties."""
    per = table(spark, sf, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("source").agg(F.min(F.struct((-F.col("n")).alias("o"), "lang", "n")).alias("m")).select("source", "m.lang", "m.n")


@query("A17_weighted_mode", "SELECT source, size FROM (SELECT source, n_chars // 500 AS size, sum(n_chars) AS w, row_number() OVER (PARTITION BY source ORDER BY sum(n_chars) DESC, n_chars // 500) AS k FROM documents GROUP BY source, n_chars // 500) WHERE k = 1")
def weighted_mode(spark, sf):
    """The size class that holds most characters of each source."""
    size = F.floor(F.col("n_chars") / 500).alias("size")
    per = table(spark, sf, "documents").groupBy("source", size).agg(F.sum("n_chars").alias("w"))
    return per.groupBy("source").agg(F.min(F.struct((-F.col("w")).alias("o"), "size")).alias("m")).select("source", "m.size")
