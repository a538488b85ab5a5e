"""URL filters with redirect equivalence, as DataFrame operations only.

Rules name an action, a host and a path; a rule fits its host and all
subdomains where the url's path starts with the rule's, and the longest fitting
rule (host and path together, ties to allow) decides. A url without a fitting
rule takes the decision of its aliases: redirects and canonical links join urls
into components, and a component with an explicitly allowed member is allowed,
otherwise one with a blocked member is blocked. Without either, a url is allowed.

Edge cases: a null url, or one without ``://``, has empty host and path, no rule
and no alias, so it is allowed. Urls that differ only in scheme or fragment are
one node. Relative links are resolved against the page; links to other schemes
(``mailto:``) are ignored. Repeated rows are judged each; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import written

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"
_CANONICAL = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
_REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
_HREF = r"(?is)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)"
_TARGET = r"(?is)\burl\s*=\s*[\"']?\s*([^\"'\s>]+)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of the registered query.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def node_of(url: Column) -> Column:
    """The url without scheme and fragment; null if it has no ``://``."""
    return F.when(url.contains("://"), F.concat(host_of(url), path_of(url), F.regexp_extract(url, _PARTS, 3)))


def absolute(link: Column, base: Column) -> Column:
    """A link of the page at ``base`` as an absolute url; null for other schemes."""
    site = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(path_of(base), r"(?s)^(.*/)", 1)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(link.startswith("/"), F.concat(site, link))
        .when(link.startswith("#") | (link == ""), base)
        .when(link.startswith("?"), F.concat(site, path_of(base), link))
        .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), link))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """(from_url, to_url): each page's canonical link and its refresh redirect."""
    canonical = F.regexp_extract(F.regexp_extract("html", _CANONICAL, 0), _HREF, 1)
    refresh = F.regexp_extract(F.regexp_extract("html", _REFRESH, 0), _TARGET, 1)
    found = pages.filter(F.col("url").contains("://")).select("url", F.explode(F.array(canonical, refresh)).alias("link"))
    link = F.regexp_replace("link", "&amp;", "&")
    return found.filter(F.col("link") != "").select(F.col("url").alias("from_url"), absolute(link, F.col("url")).alias("to_url")).filter(F.col("to_url").isNotNull())


def judge_by_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """places (host, path, ...) distinct by host and path -> host, path, rule, action of those that a rule fits."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = places.select("host", "path", F.explode(suffixes).alias("rule_host"))
    fits = each.join(rules.select("action", F.col("host").alias("rule_host"), F.col("path").alias("rule_path")), "rule_host").filter(F.col("path").startswith(F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    best = F.max(F.struct(F.length(rule).alias("size"), F.when(F.col("action") == "allow", 1).otherwise(0).alias("allow"), rule.alias("rule"), F.col("action").alias("action"))).alias("best")
    return fits.groupBy("host", "path").agg(best).select("host", "path", F.col("best.rule").alias("rule"), F.col("best.action").alias("action"))


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of each page; ``redirects`` may add (from_url, to_url) rows."""
    url = F.col("url")
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select("from_url", "to_url"))
    links = written(links.distinct(), "links")
    ends = links.select(F.explode(F.array("from_url", "to_url")).alias("url"))
    places = pages.select("url").unionByName(ends).select(host_of(url).alias("host"), path_of(url).alias("path")).filter("host != ''").distinct()
    judged = written(judge_by_rules(places, rules), "judged")
    component = connected_components(links.select(node_of(F.col("from_url")).alias("a"), node_of(F.col("to_url")).alias("b")), "a", "b")
    members = ends.select(node_of(url).alias("node"), host_of(url).alias("host"), path_of(url).alias("path")).distinct()
    decided = (
        members.join(judged, ["host", "path"])
        .join(component, "node")
        .groupBy("component")
        .agg(F.when(F.max((F.col("action") == "allow").cast("int")) == 1, "allow").otherwise("block").alias("alias_action"))
    )
    by_alias = written(component.join(decided, "component").select("node", "alias_action"), "aliases")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    return (
        rows.join(judged, ["host", "path"], "left")
        .join(by_alias, "node", "left")
        .select("page_id", "host", "path", "rule", F.coalesce("action", "alias_action", F.lit("allow")).alias("verdict"), "alias_action")
    )
