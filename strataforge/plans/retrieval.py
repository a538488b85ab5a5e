"""Retrieval queries: benchmark passages ask, documents answer."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import ACCENTED, PLAIN, STOP_WORDS, fold, search_terms, tokens
from ..operators import index as I
from ..operators import retrieval as R
from ..operators.etl import most_hits
from ..operators.keywords import labels_of, pattern_of, with_matches
from ..sources.tables import table
from .registry import query

_FOLD = f"translate(regexp_replace(lower(%s), '[‌‍]', '', 'g'), '{ACCENTED}', '{PLAIN}')"
_TOK = "regexp_extract_all(%s, '[\\p{L}\\p{M}\\p{N}_]+')"
_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"

#: Oracle text of everything up to ranked hits of each benchmark passage.
_BASE = f"""
WITH d AS (
  SELECT doc_id, lang, source, {_TOK % (_FOLD % 'text')} AS body, {_TOK % (_FOLD % "split_part(text, chr(10), 1)")} AS head, {_TOK % (_FOLD % 'source')} AS title FROM documents
), lens AS (SELECT doc_id, len(body) AS len FROM d
), facts AS (SELECT count(*) AS n, avg(len) AS mean FROM lens
), words AS (
  SELECT item_id, term, min(pos) AS pos FROM (
    SELECT item_id, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM (SELECT item_id, {_TOK % (_FOLD % 'text')} AS t FROM benchmark))
  WHERE length(term) >= 3 AND NOT list_contains({_STOP}, term) GROUP BY ALL
), asked AS (SELECT item_id, term FROM words
), each AS (
  SELECT doc_id, unnest(body) AS term, 1.0::DOUBLE AS w FROM d UNION ALL SELECT doc_id, unnest(head), 2.0 FROM d UNION ALL SELECT doc_id, unnest(title), 3.0 FROM d
), posts AS (SELECT doc_id, term, sum(w) AS tf FROM each WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), idf AS (SELECT term, greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) AS idf FROM (SELECT term, count(*) AS df FROM posts GROUP BY term), facts
), scored AS (
  SELECT item_id, doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean))), 6) AS score, count(*) AS matched
  FROM posts JOIN idf USING (term) JOIN asked USING (term) JOIN lens USING (doc_id), facts GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored
), hits AS (
  SELECT ranked.*, lang, source FROM ranked JOIN documents USING (doc_id) WHERE rank <= 30
)
"""


#: What an index counts of a document: its words, its first line and its source.
FIELDS = {"body": 1.0, "head": 2.0, "title": 3.0}
_INDEXES: dict[tuple[str, str], tuple[int, I.Index]] = {}


def indexed(docs: DataFrame) -> DataFrame:
    """key, hash, tags (lang, source), body, head, title of documents."""
    text, source = F.col("text"), F.col("source")
    content = F.concat_ws("\n", "source", F.coalesce("lang", F.lit("")), "text")
    return docs.select(F.col("doc_id").alias("key"), F.sha2(content, 256).alias("hash"), F.array("lang", "source").alias("tags"), tokens(fold(text)).alias("body"), tokens(fold(F.split_part(text, F.lit("\n"), F.lit(1)))).alias("head"), tokens(fold(source)).alias("title"))


def stored_index(spark: SparkSession, sf: str) -> I.Index:
    """The index of a folder's documents: built once an application, updated if the files have changed since."""
    docs = table(spark, sf, "documents")
    state = docs.select(F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").alias("h")).distinct().agg(F.sum(F.col("h").cast("decimal(38,0)")).alias("h")).first()["h"]
    name = (spark.sparkContext.applicationId, sf)
    if name not in _INDEXES or _INDEXES[name][0] != state:
        index = I.update(_INDEXES[name][1], indexed(docs), FIELDS, "body") if name in _INDEXES else I.build(indexed(docs), FIELDS, "body")
        _INDEXES[name] = (state, index)
    return _INDEXES[name][1]


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", F.explode(search_terms(F.col("text"))).alias("term"))


def searched(spark: SparkSession, sf: str, *wanted: I.Wanted) -> list[DataFrame]:
    """item_id, doc_id, score, matched, rank of each of what is wanted of every benchmark passage."""
    found = I.search(stored_index(spark, sf), _asked(spark, sf), "doc_id", "item_id", list(wanted))
    return [found.filter(F.col("wanted") == i).drop("wanted") for i in range(len(wanted))]


def hits(spark: SparkSession, sf: str, k: int = 30) -> DataFrame:
    """item_id, doc_id, score, matched, rank, lang, source: the k best documents of each benchmark passage."""
    return searched(spark, sf, I.Wanted(k))[0].join(table(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id")


@query("R2_bm25_topk", _BASE + "SELECT item_id, doc_id, rank, score, matched FROM hits WHERE rank <= 10 AND matched >= 3")
def bm25_topk(spark, sf):
    return R.gate(hits(spark, sf, 10), F.lit(False)).select("item_id", "doc_id", "rank", "score", "matched")


_WEIGHT = "CASE WHEN source IN ('src0', 'src1', 'src2') THEN 1.6 WHEN source IN ('src3', 'src4') THEN 0.75 ELSE 1.0 END"
_LANGW = "CASE WHEN lang IN ('es') THEN 1.6 WHEN lang = 'en' THEN 1.4 ELSE 1.0 END"


@query(
    "R4_rerank_weights",
    _BASE
    + f""", again AS (
  SELECT item_id, hits.doc_id, round(score * {_WEIGHT} * {_LANGW} * CASE WHEN toxic = 1 THEN 0.7 ELSE 1.0 END * CASE WHEN quality = 1 THEN 1.3 ELSE 1.0 END, 6) AS final_score
  FROM hits LEFT JOIN labels USING (doc_id)
) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY final_score DESC, doc_id) AS rank FROM again) WHERE rank <= 6""",
)
def rerank_weights(spark, sf):
    """The 30 candidates only are scored again, with multiplied weights; the best 6 stay."""
    source, lang = F.col("source"), F.col("lang")
    org = F.when(source.isin("src0", "src1", "src2"), 1.6).when(source.isin("src3", "src4"), 0.75).otherwise(1.0)
    language = F.when(lang == "es", 1.6).when(lang == "en", 1.4).otherwise(1.0)
    labels = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    marks = F.when(F.col("toxic") == 1, 0.7).otherwise(1.0) * F.when(F.col("quality") == 1, 1.3).otherwise(1.0)
    again = hits(spark, sf).join(labels, "doc_id", "left").withColumn("final_score", F.round(F.col("score") * org * language * marks, 6))
    return R.best(again.drop("rank"), "item_id", "doc_id", 6, "final_score").select("item_id", "doc_id", "final_score", "rank")


@query("R6_thin_languages", "SELECT lang, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 6) AS part FROM documents GROUP BY lang HAVING count(*) < 0.13 * (SELECT count(*) FROM documents)")
def thin_languages(spark, sf):
    """Languages that hold less than 13 % of the documents."""
    per = table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # one row a language
    return per.withColumn("total", total).filter(F.col("n") < 0.13 * F.col("total")).select("lang", "n", F.round(F.col("n") / F.col("total"), 6).alias("part"))


@query("R7_gate", _BASE + "SELECT item_id, doc_id, rank FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored JOIN documents USING (doc_id) WHERE matched >= CASE WHEN lang = 'en' THEN 2 ELSE 4 END) WHERE rank <= 30")
def gated(spark, sf):
    """A source or silence: documents with too few of the terms go before the best are taken."""
    return searched(spark, sf, I.Wanted(30, lambda tags: np.where(tags[:, 0] == "en", 2, 4)))[0].select("item_id", "doc_id", "rank")


@query(
    "R12_readable_in_top3",
    _BASE
    + """, f AS (SELECT *, min(CASE WHEN lang = 'fr' THEN rank END) OVER (PARTITION BY item_id) AS first_flagged FROM hits
) SELECT item_id, doc_id, rank, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN first_flagged > 3 AND rank = first_flagged THEN 2.5 ELSE rank END) AS new_rank FROM f""",
)
def readable_in_top3(spark, sf):
    """A French document is among the first three of each passage if there is one at all."""
    return R.promote(hits(spark, sf), "item_id", F.col("lang") == "fr", 3).select("item_id", "doc_id", "rank", "new_rank")


@query(
    "R13_own_language_first",
    _BASE
    + """, t AS (SELECT *, first_value(score) OVER (PARTITION BY item_id ORDER BY rank) AS top FROM hits
) SELECT item_id, doc_id, rank, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN lang = 'en' AND score >= 0.6 * top AND source <> 'src7' THEN 0 ELSE 1 END, rank) AS new_rank FROM t""",
)
def own_language_first(spark, sf):
    top = F.first("score").over(Window.partitionBy("item_id").orderBy("rank"))
    rows = hits(spark, sf).withColumn("top", top)
    own = (F.col("lang") == "en") & (F.col("score") >= 0.6 * F.col("top")) & (F.col("source") != "src7")
    return R.stable_partition(rows, "item_id", own).select("item_id", "doc_id", "rank", "new_rank")


@query(
    "R14_country_first",
    _BASE
    + f""", h AS (SELECT hits.*, first_value(score) OVER (PARTITION BY item_id ORDER BY rank) AS top, d.head AS head, first_value(d.head) OVER (PARTITION BY item_id ORDER BY rank) AS top_head FROM hits JOIN d USING (doc_id)
) SELECT item_id, doc_id, rank, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN source IN ('src5', 'src6', 'src0') AND score >= 0.8 * top AND len(list_intersect(head, top_head)) > 0 THEN 0 ELSE 1 END, rank) AS new_rank FROM h""",
)
def country_first(spark, sf):
    """Sources of a list come first if they score near the top and share a title word with the top hit."""
    heads = table(spark, sf, "documents").select("doc_id", tokens(fold(F.split_part("text", F.lit("\n"), F.lit(1)))).alias("head"))
    by = Window.partitionBy("item_id").orderBy("rank")
    rows = hits(spark, sf).join(heads, "doc_id").withColumns({"top": F.first("score").over(by), "top_head": F.first("head").over(by)})
    own = F.col("source").isin("src5", "src6", "src0") & (F.col("score") >= 0.8 * F.col("top")) & F.arrays_overlap("head", "top_head")
    return R.stable_partition(rows, "item_id", own).select("item_id", "doc_id", "rank", "new_rank")


@query(
    "R17_inject_and_warn",
    _BASE
    + """, top AS (SELECT item_id, doc_id, source, score, rank FROM hits WHERE rank <= 3
), warned AS (SELECT source, min(doc_id) AS doc_id FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY source
), added AS (
  SELECT t.item_id, w.doc_id, w.source, 99.0 AS score, 0 AS rank FROM (SELECT DISTINCT item_id, source FROM top) t JOIN warned w USING (source)
  WHERE NOT EXISTS (SELECT 1 FROM top x WHERE x.item_id = t.item_id AND x.doc_id = w.doc_id)
) SELECT item_id, doc_id, source, score::DOUBLE AS score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, rank, doc_id) AS place FROM (SELECT * FROM top UNION ALL SELECT * FROM added)""",
)
def inject_and_warn(spark, sf):
    """The first flagged document of each source among the hits is put before them, unless it is there already."""
    top = hits(spark, sf, 3).select("item_id", "doc_id", "source", "score", "rank")
    flagged = table(spark, sf, "labels").filter("toxic = 1").select("doc_id")
    warned = table(spark, sf, "documents").select("doc_id", "source").join(flagged, "doc_id", "left_semi").groupBy("source").agg(F.min("doc_id").alias("doc_id"))
    added = top.select("item_id", "source").distinct().join(warned, "source").join(top.select("item_id", "doc_id"), ["item_id", "doc_id"], "left_anti")
    rows = top.unionByName(added.select("item_id", "doc_id", "source", F.lit(99.0).alias("score"), F.lit(0).cast("long").alias("rank")))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "rank", "doc_id"))
    return rows.select("item_id", "doc_id", "source", "score", place.cast("long").alias("place"))


@query(
    "R18_own_schedule",
    _BASE
    + """, own AS (SELECT item_id, doc_id, source, matched, score FROM scored JOIN documents USING (doc_id)
), kept AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM own WHERE source NOT IN ('src8', 'src9')
), best AS (SELECT item_id, doc_id FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY matched DESC, score DESC, doc_id) AS k FROM own WHERE source = 'src8') WHERE k = 1
) SELECT item_id, doc_id, rank FROM kept WHERE rank <= 30 UNION ALL SELECT item_id, doc_id, 0 FROM best""",
)
def own_schedule(spark, sf):
    """A search without the documents of some sources, and before it the nearest document of one of them by a search of its own."""
    other = lambda tags: np.where(np.isin(tags[:, 1], ["src8", "src9"]) | np.equal(tags[:, 1], None), I.NEVER, 1)
    own = lambda tags: np.where(tags[:, 1] == "src8", 1, I.NEVER)
    kept, near = searched(spark, sf, I.Wanted(30, other), I.Wanted(1, own, by_matched=True))
    return kept.select("item_id", "doc_id", "rank").unionByName(near.select("item_id", "doc_id", F.lit(0).cast("long").alias("rank")))


@query(
    "R19_first_flagged_per_doc",
    "SELECT source, doc_id, toxic FROM (SELECT source, documents.doc_id, coalesce(toxic, 0) AS toxic, row_number() OVER (PARTITION BY source ORDER BY coalesce(toxic, 0) DESC, documents.doc_id) AS k FROM documents LEFT JOIN labels USING (doc_id)) WHERE k = 1",
)
def first_flagged(spark, sf):
    """Of each source the first flagged document, or its first one; a minimum of a struct instead of a sort of the group."""
    rows = table(spark, sf, "documents").select("source", "doc_id").join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left")
    toxic = F.coalesce("toxic", F.lit(0))
    return rows.groupBy("source").agg(F.min(F.struct((-toxic).alias("o"), F.col("doc_id"), toxic.alias("toxic"))).alias("m")).select("source", "m.doc_id", "m.toxic")


@query(
    "R20_title_overlap",
    """WITH p AS (SELECT p_partkey, p_brand, list_distinct(regexp_extract_all(lower(p_name), '[a-z]+')) AS words FROM part
), o AS (SELECT p_partkey, 2 * len(list_intersect(words, ['red', 'steel', 'large', 'part'])) + CASE WHEN p_brand LIKE '%1' THEN 1 ELSE 0 END AS overlap FROM p
) SELECT p_partkey, overlap FROM o WHERE overlap > 0 ORDER BY overlap DESC, p_partkey LIMIT 50""",
)
def title_overlap(spark, sf):
    """Parts by twice the title words shared with a query plus a brand match; the best 50."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("p_name"), F.lit("[a-z]+"), 0))
    asked = F.array(*[F.lit(w) for w in ("red", "steel", "large", "part")])
    overlap = 2 * F.size(F.array_intersect(words, asked)) + F.when(F.col("p_brand").endswith("1"), 1).otherwise(0)
    return table(spark, sf, "part").select("p_partkey", overlap.cast("long").alias("overlap")).filter("overlap > 0").orderBy(F.desc("overlap"), "p_partkey").limit(50)


@query(
    "R21_best_guide_tuple",
    _BASE
    + """, g AS (SELECT item_id, source, count(*) AS docs, max(matched) AS shared, round(sum(score), 4) AS weight FROM hits GROUP BY ALL
) SELECT item_id, source, docs, shared, weight FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, weight DESC, docs, source) AS k FROM g) WHERE k = 1""",
)
def best_guide(spark, sf):
    """The source with the largest (shared terms, weight, fewest documents) of each passage."""
    per = hits(spark, sf).groupBy("item_id", "source").agg(F.count(F.lit(1)).alias("docs"), F.max("matched").alias("shared"), F.round(F.sum("score"), 4).alias("weight"))
    best = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("shared"), F.desc("weight"), "docs", "source"))
    return per.withColumn("k", best).filter("k = 1").drop("k")


@query(
    "R22_sources_two_per_org",
    _BASE
    + """, two AS (SELECT *, row_number() OVER (PARTITION BY item_id, source ORDER BY rank) AS k FROM hits
) SELECT item_id, doc_id, source, place FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN lang = 'en' THEN 0 ELSE 1 END, rank) AS place FROM two WHERE k <= 2) WHERE place <= 10""",
)
def two_per_org(spark, sf):
    """At most two hits of a source, English ones first, ten in all."""
    own = F.row_number().over(Window.partitionBy("item_id", "source").orderBy("rank"))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.when(F.col("lang") == "en", 0).otherwise(1), "rank"))
    return hits(spark, sf).withColumn("k", own).filter("k <= 2").withColumn("place", place.cast("long")).filter("place <= 10").select("item_id", "doc_id", "source", "place")


@query("R23_score_floor", _BASE + "SELECT item_id, doc_id, rank FROM (SELECT *, max(score) OVER (PARTITION BY item_id) AS top FROM hits) WHERE score >= 0.5 * top")
def score_floor(spark, sf):
    top = F.max("score").over(Window.partitionBy("item_id"))
    return hits(spark, sf).withColumn("top", top).filter("score >= 0.5 * top").select("item_id", "doc_id", "rank")


@query(
    "R1_prefix_match",
    f"""WITH t AS (SELECT doc_id, unnest({_TOK % (_FOLD % 'text')}) AS term FROM documents
) SELECT doc_id, count(*) AS occurrences, count(DISTINCT term) AS terms FROM t WHERE starts_with(term, 'thor') OR starts_with(term, 'eau') OR starts_with(term, 'sch') GROUP BY doc_id""",
)
def prefix_match(spark, sf):
    """Documents with a word that starts with any of the query's prefixes."""
    each = table(spark, sf, "documents").select("doc_id", F.explode(tokens(fold(F.col("text")))).alias("term"))
    term = F.col("term")
    return each.filter(term.startswith("thor") | term.startswith("eau") | term.startswith("sch")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("occurrences"), F.countDistinct("term").alias("terms"))


# Rows of a synonym table in words of our own: language, trigger (a prefix; two words are a phrase, ``$`` asks for the whole word), term that is added.
SYNONYMS = [
    ("en", "tion", "action"), ("en", "the$", "article"), ("en", "that the", "clause"), ("en", "wh", "question"), ("en", "fever", "temperature"), ("en", "tummy", "abdomen"),
    ("fr", "eau", "water"), ("fr", "que la", "clause"), ("fr", "fièvre", "temperature"), ("de", "sch", "sound"), ("de", "und$", "article"), ("de", "fieber", "temperature"), ("de", "bauch", "abdomen"),
    ("es", "cion", "action"), ("es", "ción", "action"), ("es", "los$", "article"), ("es", "fiebre", "temperature"), ("es", "barriga", "abdomen"),
]
_ADDED = list(dict.fromkeys(term for *_, term in SYNONYMS))


def _added_sql(term: str) -> str:
    return f"CASE WHEN regexp_matches(lower(text), '{pattern_of([t for _, t, a in SYNONYMS if a == term])}') THEN '{term}' END"


_EXPANDED_SQL = f"list_sort(list_filter([{', '.join(map(_added_sql, _ADDED))}], lambda x: x IS NOT NULL))"


def expanded(rows: DataFrame) -> DataFrame:
    """``rows`` with added, the terms whose triggers stand in their text, in order: the table's triggers are one automaton."""
    found = with_matches(rows.withColumn("lowered", F.lower("text")), "lowered", [(added, trigger) for _, trigger, added in SYNONYMS])
    return found.withColumn("added", F.array_sort(labels_of())).drop("lowered", "matches")


@query("R8_synonym_expansion", f"SELECT conv_id, turn, array_to_string({_EXPANDED_SQL}, ' ') AS added FROM conversations WHERE role = 'user' AND len({_EXPANDED_SQL}) > 0")
def synonym_expansion(spark, sf):
    """Terms that a synonym table adds to each question."""
    asked = table(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", "text")
    return expanded(asked).filter(F.size("added") > 0).select("conv_id", "turn", F.array_join("added", " ").alias("added"))


# Rows of a topic table that sees a question and what was added to it.
TOPICS = {"words": ["article$", "clause$", "question$"], "deeds": ["action$", "tion"], "nature": ["water$", "eau", "mer$"], "body": ["temperature$", "abdomen$", "sound$"]}


@query(
    "R10_topic_of_expanded",
    f"WITH q AS (SELECT item_id, regexp_replace(lower(text) || ' ' || array_to_string({_EXPANDED_SQL}, ' '), '([^\\p{{L}}\\p{{M}}\\p{{N}}_])', '\\1\\1', 'g') AS q FROM benchmark), c AS (SELECT item_id, {', '.join(f'len(regexp_extract_all(q, {chr(39)}{pattern_of(k)}{chr(39)})) AS {t}' for t, k in TOPICS.items())} FROM q) "
    f"SELECT item_id, CASE WHEN greatest({', '.join(TOPICS)}) = 0 THEN NULL {' '.join(f'WHEN {t} = greatest({chr(44).join(TOPICS)}) THEN {chr(39)}{t}{chr(39)}' for t in TOPICS)} END AS topic FROM c",
)
def topic_of_expanded(spark, sf):
    """The topic of a question with its expansion: most keyword hits, the first of the table on ties."""
    rows = expanded(table(spark, sf, "benchmark").select("item_id", "text"))
    whole = rows.select("item_id", F.concat(F.lower("text"), F.lit(" "), F.array_join("added", " ")).alias("q"))
    return with_matches(whole, "q", [(t, k) for t, words in TOPICS.items() for k in words]).select("item_id", most_hits("matches", list(TOPICS)).alias("topic"))


@query(
    "R15_english_first",
    _BASE
    + """, good AS (SELECT item_id, doc_id, rank FROM hits WHERE rank <= 6 AND matched >= 3
), own AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored JOIN documents USING (doc_id) WHERE lang = 'en' AND matched >= 3 QUALIFY rank <= 6
), enough AS (SELECT item_id FROM own GROUP BY item_id HAVING count(*) >= 2
), joint AS (SELECT item_id, doc_id, 0 AS later, rank FROM own WHERE item_id IN (SELECT item_id FROM enough)
  UNION ALL SELECT item_id, doc_id, 1, rank FROM good g WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.item_id = g.item_id AND o.doc_id = g.doc_id AND o.item_id IN (SELECT item_id FROM enough))
), sizes AS (SELECT item_id, greatest(coalesce(g, 0), coalesce(o, 0)) AS most FROM (SELECT item_id, count(*) AS g FROM good GROUP BY item_id) FULL JOIN (SELECT item_id, count(*) AS o FROM own WHERE item_id IN (SELECT item_id FROM enough) GROUP BY item_id) USING (item_id)
) SELECT item_id, doc_id, place FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY later, rank) AS place FROM joint) JOIN sizes USING (item_id) WHERE place <= most""",
)
def english_first(spark, sf):
    """A second search in English only: if it brings two documents or more, they come first and the others after them, as many as the longer list has."""
    english = lambda tags: np.where(tags[:, 0] == "en", 3, I.NEVER)
    good, own = (rows.select("item_id", "doc_id", "rank", "matched") for rows in searched(spark, sf, I.Wanted(6), I.Wanted(6, english)))
    good, own = good.filter("matched >= 3").drop("matched"), own.drop("matched")
    own = own.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("item_id"))).filter("n >= 2")
    rest = good.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("item_id"))).join(own.select("item_id", "doc_id"), ["item_id", "doc_id"], "left_anti")
    both = own.withColumn("later", F.lit(0)).unionByName(rest.withColumn("later", F.lit(1)))
    by = Window.partitionBy("item_id")
    placed = both.withColumns({"place": F.row_number().over(by.orderBy("later", "rank")).cast("long"), "most": F.max("n").over(by)})
    return placed.filter("place <= most").select("item_id", "doc_id", "place")


@query(
    "R11_own_language_second",
    _BASE
    + """, own AS (SELECT item_id, min(rank) AS r FROM hits WHERE lang = 'de' AND rank > 3 AND matched >= 2 GROUP BY item_id
), bare AS (SELECT item_id FROM hits GROUP BY item_id HAVING count(*) FILTER (rank <= 3 AND lang = 'de') = 0
) SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN rank = r AND item_id IN (SELECT item_id FROM bare) THEN 1.5 ELSE rank END) AS new_rank FROM hits LEFT JOIN own USING (item_id)""",
)
def own_language_second(spark, sf):
    """One German hit moves to the second place when there is none among the first three."""
    by = Window.partitionBy("item_id")
    german = F.col("lang") == "de"
    rows = hits(spark, sf).withColumns({"r": F.min(F.when(german & (F.col("rank") > 3) & (F.col("matched") >= 2), F.col("rank"))).over(by), "near": F.max((german & (F.col("rank") <= 3)).cast("int")).over(by)})
    place = F.when((F.col("rank") == F.col("r")) & (F.col("near") == 0), F.lit(1.5)).otherwise(F.col("rank").cast("double"))
    return rows.withColumn("place", place).withColumn("new_rank", F.row_number().over(by.orderBy("place")).cast("long")).select("item_id", "doc_id", "new_rank")


@query(
    "T14_probe_self_check",
    _BASE + "SELECT item_id, coalesce(bool_or(position(b.text IN documents.text) > 0), false) AS found FROM benchmark b LEFT JOIN (SELECT * FROM hits WHERE rank <= 10) h USING (item_id) LEFT JOIN documents ON documents.doc_id = h.doc_id GROUP BY item_id",
)
def probe_self_check(spark, sf):
    """Whether a probe's ten best documents include one that holds it."""
    probes = table(spark, sf, "benchmark")
    found = searched(spark, sf, I.Wanted(10))[0].select("item_id", "doc_id").join(table(spark, sf, "documents").select("doc_id", F.col("text").alias("body")), "doc_id")
    held = probes.join(found, "item_id", "left").select("item_id", F.coalesce(F.expr("contains(body, text)"), F.lit(False)).alias("held"))
    return held.groupBy("item_id").agg(F.max("held").alias("found"))
