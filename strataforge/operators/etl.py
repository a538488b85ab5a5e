"""Document structure: lines, noise lines, headings, sections, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import clean_line, word_count
from .keywords import count_of

# Chunk sizes in words.
TARGET, MOST, OVERLAP, LEAST = 320, 480, 40, 40


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text", *carried: str) -> DataFrame:
    """key, carried columns, line_no (from 0), line: every line of every document, cleaned."""
    cleaned = F.transform(F.split(text, "\n"), clean_line)  # before they are rows, so that no filter on a line cleans it again
    return docs.select(key, *carried, F.posexplode(cleaned).alias("line_no", "line"))


def line_pattern(line: Column) -> Column:
    """A line as it repeats from page to page: lower case, digits as #."""
    return F.regexp_replace(F.lower(line), "[0-9]", "#")


def repeated_lines(pages: DataFrame, doc: str, page: str, least_share: float = 0.6, least: int = 3) -> DataFrame:
    """doc, pattern of lines that stand on max(least, share of pages) pages; documents of fewer pages have none.

    ``pages`` has (doc, page, line). A pattern counts once a page; patterns are counted before anything is joined.
    """
    rows = pages.select(doc, page, line_pattern(F.col("line")).alias("pattern")).filter(F.length("pattern") > 3).distinct()
    counts = rows.groupBy(doc, "pattern").agg(F.count(F.lit(1)).alias("n"))
    totals = pages.select(doc, page).distinct().groupBy(doc).agg(F.count(F.lit(1)).alias("pages"))
    wanted = F.greatest(F.lit(least), F.floor(F.col("pages") * least_share))
    return counts.join(totals, doc).filter((F.col("pages") >= least) & (F.col("n") >= wanted)).select(doc, "pattern")


def is_heading(line: Column) -> Column:
    """3 to 140 characters, no closing punctuation, and a question, or at most 12 words nearly all in capitals or title case."""
    letters = F.length(F.regexp_replace(line, r"[^\p{L}]", ""))
    upper = F.length(F.regexp_replace(line, r"[^\p{Lu}]", ""))
    shouted = (letters > 0) & (upper / letters > 0.9) & (word_count(line) <= 12)
    short = (word_count(line) <= 4) & line.rlike(r"^\p{Lu}")
    return (F.length(line) >= 3) & (F.length(line) <= 140) & ~line.rlike("[.,;:]$") & (line.endswith("?") | shouted | short)


def sections(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """rows (key, line_no, line) with section: a heading starts one, headings in a row are one start."""
    by = Window.partitionBy(key).orderBy("line_no")
    marked = rows.withColumn("heading", is_heading(F.col("line")))
    start = F.col("heading") & ~F.coalesce(F.lag("heading").over(by), F.lit(False))
    return marked.withColumn("start", start).withColumn("section", F.sum(F.col("start").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("start")


def sentences(text: Column) -> Column:
    """A text's sentences: split after closing punctuation before white space."""
    return F.filter(F.split(text, r"(?<=[.?!])\s+"), lambda s: s != "")


def windows(words: Column, size: int = TARGET) -> Column:
    """Consecutive runs of ``size`` words."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(words) / size) - 1, F.lit(0)).cast("int")), lambda i: F.slice(words, i * size + 1, size))


def pack(text: Column, target: int = TARGET, most: int = MOST, overlap: int = OVERLAP) -> Column:
    """Chunks of a section: one if it has ``most`` words or fewer, else sentences packed greedily up to ``target`` words.

    A chunk after the first starts with the last ``overlap`` words of the one before. A fold over
    the section's sentences, longer ones cut into windows first; it runs in the JVM, row by row.
    """
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    pieces = F.flatten(F.transform(sentences(text), lambda s: windows(F.filter(F.split(s, r"\s+"), lambda w: w != ""), target)))
    empty = F.array().cast("array<string>")
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), empty.alias("now"), F.lit(0).alias("fresh"))

    def add(a: Column, piece: Column) -> Column:
        full = (a["fresh"] > 0) & (F.size(a["now"]) + F.size(piece) > target)
        tail = F.slice(a["now"], F.greatest(F.size(a["now"]) - overlap + 1, F.lit(1)), overlap)
        return F.struct(
            F.when(full, F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"]).alias("done"),
            F.when(full, F.concat(tail, piece)).otherwise(F.concat(a["now"], piece)).alias("now"),
            F.when(full, F.size(piece)).otherwise(a["fresh"] + F.size(piece)).alias("fresh"),
        )

    packed = F.aggregate(pieces, start, add, lambda a: F.when(a["fresh"] > 0, F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"]))
    return F.when(F.size(words) <= most, F.array(words)).otherwise(packed)


def merge_small(chunks: Column, least: int = LEAST, most: int = MOST) -> Column:
    """Chunks (arrays of words) in which one of fewer than ``least`` words joins the one before if both fit."""
    start = F.array().cast("array<array<string>>")

    def add(a: Column, c: Column) -> Column:
        last = F.element_at(a, -1)
        fits = (F.size(a) > 0) & ((F.size(c) < least) | (F.size(F.when(F.size(a) > 0, last)) < least)) & (F.size(F.when(F.size(a) > 0, last)) + F.size(c) <= most)
        return F.when(fits, F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.concat(F.when(F.size(a) > 0, last), c)))).otherwise(F.concat(a, F.array(c)))

    return F.aggregate(chunks, start, add)


def most_hits(matches: str, labels: list[str]) -> Column:
    """The label with most matches, the first declared on ties, null without any."""
    best = F.array_max(F.array(*[F.struct(count_of(x, matches).alias("n"), F.lit(-i).alias("order"), F.lit(x).alias("label")) for i, x in enumerate(labels)]))
    return F.when(best["n"] > 0, best["label"])
