"""Cited addresses against the addresses that answer for them now."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of a path that tell nothing about its topic.
FILLERS = ("www", "html", "htm", "php", "index", "page", "home", "archive", "the", "and", "ref")
RETIRED = r"(?i)/(?:404|gone|not-found|removed|retired)(?:[/?#.]|$)"


def path_words(url: Column) -> Column:
    """The distinct words of three letters or digits and more after the site, fillers left out. The site is in both addresses of most moves, so it never counts."""
    path = F.lower(F.regexp_replace(url, "^https?://[^/]+", ""))
    return F.array_distinct(F.filter(F.split(path, "[^a-z0-9]+"), lambda w: (F.length(w) > 2) & ~w.isin(*FILLERS)))


def _plain(url: Column) -> Column:
    """Percent signs decoded (a plus stays one; what can't be decoded stays as it is), no slash at the end."""
    return F.regexp_replace(F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url), "/+$", "")


def link_class(before: Column, after: Column, answers: Column) -> Column:
    """``broken``, ``retired``, ``same``, ``topic`` (no word of the path is left) or ``moved``; null only for a null ``before``.

    An address without words of its own can't change its topic. No ``after`` is broken.
    """
    own = path_words(before)
    changed = (F.size(own) > 0) & ~F.arrays_overlap(own, path_words(after))
    gone = after.isNull() | ~F.coalesce(answers, F.lit(False))
    return F.when(before.isNull(), None).when(gone, "broken").when(after.rlike(RETIRED), "retired").when(_plain(before) == _plain(after), "same").when(changed, "topic").otherwise("moved")
