"""Text normalisation as column expressions; everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Precomposed Latin letters and what they fold to; letters of other scripts keep their marks.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāēīōūăęąćčďěłńňőřśšťůűźżžё"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaeiouaeaccdelnnorsstuuzzzе"
# Digits of other scripts and ASCII digits.
OTHER_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹०१२३४५६७८९"
ASCII_DIGITS = "012345678901234567890123456789"
# Words too frequent to search by.
STOP_WORDS = ["the", "and", "for", "with", "was", "that", "this", "der", "die", "und", "das", "les", "des", "que", "est", "los", "las", "una", "por", "con"]

WORD = r"(?U)[a-z\w]+"  # as \w+; most letters are told by the first range


def fold(c: Column) -> Column:
    """Lower case without accents on Latin letters and without joiners; other scripts keep their marks."""
    return F.translate(F.regexp_replace(F.lower(c), "[‌‍]", ""), ACCENTED, PLAIN)


def unify_digits(c: Column) -> Column:
    return F.translate(c, OTHER_DIGITS, ASCII_DIGITS)


def tokens(c: Column) -> Column:
    """Words of letters, marks, digits and underscores, in order."""
    return F.regexp_extract_all(c, F.lit(WORD), 0)


def search_terms(c: Column) -> Column:
    """Distinct folded words of three letters or more that are not stop words, in order."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.array_distinct(F.filter(tokens(fold(c)), lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w)))


def clean_line(c: Column) -> Column:
    """Ligatures spelled out, joiners and soft hyphens dropped, controls to spaces, spaces collapsed, trimmed."""
    spelled = F.regexp_replace(F.regexp_replace(c, "ﬁ", "fi"), "ﬂ", "fl")
    plain = F.regexp_replace(spelled, "[​‌‍­]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[\x00-\x1f\x7f ]", " "), " +", " "))


def dehyphenate(c: Column) -> Column:
    """Words split by a hyphen at a line's end become one word."""
    return F.regexp_replace(c, r"(\w)-\s*\n\s*(\w)", "$1$2")


def slug(c: Column, most: int = 40) -> Column:
    """Folded, everything but letters and digits to underscores, cut; ``s`` if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(fold(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    cut = F.regexp_replace(F.substring(s, 1, most), "_+$", "")
    return F.when(cut == "", "s").otherwise(cut)


def visible_text(html: Column) -> Column:
    """Text of a page: script and style with their content dropped, tags to spaces, spaces collapsed."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<script\b.*?</script>", " "), r"(?is)<style\b.*?</style>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "(?s)<[^>]*>", " "), r"\s+", " "))


def word_count(c: Column) -> Column:
    """Number of runs of characters other than white space."""
    return F.coalesce(F.regexp_count(c, F.lit(r"\S+")), F.lit(0)).cast("long")


def share(c: Column, pattern: str) -> Column:
    """Part of the letters that match a character class."""
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    return F.when(letters > 0, F.length(F.regexp_replace(c, f"[^{pattern}]", "")) / letters).otherwise(0.0)
