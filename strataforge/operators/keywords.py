"""Keyword tables compiled to one automaton: all matches with their places in one pass, however many keywords there are.

A keyword starts at a word's start. It matches as a prefix, and its match runs to the end of the word; one that ends in ``$``
matches only if a word ends with it. Words are runs of letters, marks, digits and underscores in any script. Before a keyword
of Arabic letters one of :data:`CLITICS` may be written, in the same word. Of the matches of one label that
overlap, the first counts, of those that start together the longest. Nulls have no matches.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Arabic article and prepositions that are written with the word after them.
CLITICS = ("وال", "فال", "بال", "كال", "لل", "ال", "و", "ب", "ل", "ف", "ك")
IN_WORD, NOT_IN_WORD = r"[\p{L}\p{M}\p{N}_]", r"[^\p{L}\p{M}\p{N}_]"

Row = tuple[str, str]  # label, keyword
Match = tuple[str, int, int]  # label, start, end


def in_word(c: str) -> bool:
    return c.isalnum() or c == "_" or unicodedata.category(c)[0] == "M"


def is_arabic(word: str) -> bool:
    return "؀" <= word[0] <= "ۿ"


class Keywords:
    """A compiled table of (label, keyword), lower case."""

    def __init__(self, rows: tuple[Row, ...]):
        labels: dict[str, list[tuple[str, bool]]] = {}
        for label, keyword in rows:
            word = keyword.removesuffix("$")
            if word.strip():
                labels.setdefault(word, []).append((label, keyword.endswith("$")))
        self.tree = ahocorasick.Automaton() if labels else None
        for word, of in labels.items():
            self.tree.add_word(word, (len(word), is_arabic(word), tuple(of)))
        if labels:
            self.tree.make_automaton()

    @staticmethod
    @lru_cache(16)
    def of(rows: tuple[Row, ...]) -> Keywords:
        return Keywords(rows)

    def starts_word(self, text: str, start: int, arabic: bool) -> bool:
        if start == 0 or not in_word(text[start - 1]):
            return True
        return arabic and any(text.endswith(c, 0, start) and (start == len(c) or not in_word(text[start - len(c) - 1])) for c in CLITICS)

    def matches(self, text: str | None) -> list[Match]:
        """Matches by start, then label."""
        if not text or self.tree is None:
            return []
        found: list[tuple[int, int, str]] = []
        for last, (size, arabic, labels) in self.tree.iter(text):
            start, end = last + 1 - size, last + 1
            if not self.starts_word(text, start, arabic):
                continue
            whole = end
            while whole < len(text) and in_word(text[whole]):
                whole += 1
            found += [(start, -size, label, whole) for label, exact in labels if not exact or whole == end]
        found.sort()
        upto: dict[str, int] = {}
        out = []
        for start, _, label, end in found:
            if start >= upto.get(label, 0):
                upto[label] = end
                out.append((label, start, end))
        return out


MATCHES = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_ARROW = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def as_arrow(rows: list[list[Match]]) -> pa.Array:
    flat = [m for r in rows for m in r]
    values = pa.StructArray.from_arrays([pa.array([m[i] for m in flat], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32()))], fields=list(_ARROW.value_type))
    ends = [0]
    for r in rows:
        ends.append(ends[-1] + len(r))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def with_column(rows: DataFrame, name: str, kind: T.DataType, make) -> DataFrame:
    """``rows`` with a column that ``make`` computes from an Arrow batch; a narrow map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, make(batch)], [*batch.schema.names, name])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, kind)]))


def with_matches(rows: DataFrame, text: str, table: list[Row], name: str = "matches") -> DataFrame:
    """``rows`` with the matches (label, start, end) in a lower-case text column."""
    keywords = tuple(table)

    def make(batch: pa.RecordBatch) -> pa.Array:
        compiled = Keywords.of(keywords)
        return as_arrow([compiled.matches(t) for t in batch.column(text).to_pylist()])

    return with_column(rows, name, MATCHES, make)


def count_of(label: str, matches: str = "matches") -> Column:
    return F.size(F.filter(matches, lambda m: m["label"] == label))


def labels_of(matches: str = "matches") -> Column:
    return F.array_distinct(F.transform(matches, lambda m: m["label"]))


def pattern_of(keywords: list[str], group: str = "?:") -> str:
    """The same matches as a regular expression without look-arounds; it takes the character before the match as well (in a group, if ``group`` is '')."""
    plain = sorted((k.removesuffix("$") for k in keywords if k.removesuffix("$").strip()), key=lambda k: (-len(k), k))
    exact = {k.removesuffix("$") for k in keywords if k.endswith("$")} - {k for k in keywords if not k.endswith("$")}
    if not plain:
        return r"[^\s\S]"
    clitic = f"(?:{'|'.join(CLITICS)})?" if any(is_arabic(k) for k in plain) else ""
    escape = lambda k: "".join("\\" + c if c in r"\.^$*+?()[]{}|" else c for c in k)
    words = "|".join(escape(k) + (rf"(?:{NOT_IN_WORD}|$)" if k in exact else f"{IN_WORD}*") for k in dict.fromkeys(plain))
    return f"({group}^|{NOT_IN_WORD}){clitic}(?:{words})"
