"""URL aliases on generated link graphs against union-find; the pipeline's stages on unusual tables."""

import random
import sys

from conftest import ROOT

sys.path.insert(0, ROOT)

import corpus_pipeline  # noqa: E402
from strataforge.llm import url_filters  # noqa: E402


def _rule(host, path):
    fits = [(len(h + p), a == "allow", a) for a, h, p in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2] if fits else None


def test_aliases_of_generated_links(spark):
    """A chain, a cycle, a hub and random components, with allowed and blocked members in them."""
    r, edges, places, serial = random.Random(8), [], {}, iter(range(10**6))

    def node(kind):
        n = next(serial)
        host, path = {"free": (f"s{n}.test", f"/p/{n}"), "block": (f"s{n}.com", f"/en/{n}"), "allow": (f"s{n}.net", f"/de/{n}")}[kind]
        places[n] = (host, path)
        return n

    def chain(kinds, closed=False):
        own = [node(k) for k in kinds]
        edges.extend(zip(own, own[1:] + own[:1] if closed else own[1:]))

    chain(["free"] * 250 + ["block"])
    chain(["block"] + ["free"] * 120 + ["allow"])
    chain(["free"] * 40 + ["block"], closed=True)
    for end in ("block", "free"):
        hub = node("free")
        edges.extend((node("free"), hub) for _ in range(1000))
        edges.append((hub, node(end)))
    for _ in range(150):
        own = [node(r.choices(["free", "block", "allow"], [8, 1, 1])[0]) for _ in range(r.randint(1, 6))]
        edges.extend((r.choice(own), r.choice(own)) for _ in range(r.randint(0, 7)))

    parent = {n: n for n in places}

    def root(n):
        while parent[n] != n:
            parent[n] = n = parent[parent[n]]
        return n

    for a, b in edges:
        parent[root(a)] = root(b)
    met = {}
    for n, place in places.items():
        met.setdefault(root(n), set()).add(_rule(*place))
    alias = {c: "allow" if "allow" in found else "block" if "block" in found else "allow" for c, found in met.items()}
    want = {n: _rule(*place) or alias[root(n)] for n, place in places.items()}
    assert list(want.values()).count("block") > 1200

    url = lambda n: "https://" + "".join(places[n])
    first, others = {}, []
    for a, b in edges:  # a page holds one canonical link; further links come as redirects
        if a in first:
            others.append((url(a), url(b)))
        else:
            first[a] = f'<link rel="canonical" href="{url(b)}">'
    pages = spark.createDataFrame([(n, url(n), first.get(n, "")) for n in places], "page_id long, url string, html string")
    rules = spark.createDataFrame(url_filters.RULES, "action string, host string, path string")
    redirects = spark.createDataFrame(others, "from_url string, to_url string")
    got = {x["page_id"]: x["verdict"] for x in url_filters.judge(pages, rules, redirects).collect()}
    assert got == want


_COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, __id long, id string, node string, place int, row string, h long, component long, bucket string, size int"


def _through(spark, rows):
    at = spark.createDataFrame(rows, _COLUMNS)
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, at, "")
        assert kept.columns == at.columns, name
        at = spark.createDataFrame(kept.collect(), at.schema)
        counts.append(at.count())
    return counts, corpus_pipeline.STAGES[-1][1](spark, at, "").collect()


def test_stages_on_an_empty_table(spark):
    assert _through(spark, []) == ([0, 0, 0, 0], [])


def test_stages_with_clashing_names_and_no_language(spark):
    """Nothing is labelled, so no language can be told apart; copies still go, and other columns come through unchanged."""
    r = random.Random(6)
    text = lambda seed: " ".join(random.Random(seed).choices(["".join(r.choices("abcdefghij", k=6)) for _ in range(500)], k=120))
    texts = [text(k) for k in range(12)]
    texts += [texts[0], None, "", texts[1]]
    rows = [(k, t, None, None if k % 3 == 0 else f"s{k % 2}", len(t or ""), 7, "id", "node", 1, None, 3, k, "b", 0) for k, t in enumerate(texts)]
    counts, last = _through(spark, rows + [rows[2]])
    left = {x["doc_id"] for x in last}
    assert counts[1] < counts[0] <= len(rows) + 1
    assert not left & {12, 15} and left <= set(range(12)) | {13, 14}
    assert len(last) == counts[3]
