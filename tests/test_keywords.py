"""The automaton against one pattern a keyword."""

import random

import regex

from strataforge.operators import keywords as K


def brute(text, rows):
    """Matches by a pattern for each keyword, then the longest first match of each label."""
    clitics = "|".join(K.CLITICS)
    found = []
    for label, keyword in set(rows):
        word = keyword.removesuffix("$")
        front = rf"(?<!{K.IN_WORD})" if not K.is_arabic(word) else rf"(?:(?<!{K.IN_WORD})|(?<=(?<!{K.IN_WORD})(?:{clitics})))"
        end = f"(?!{K.IN_WORD})" if keyword.endswith("$") else f"{K.IN_WORD}*"
        for m in regex.finditer(f"{front}{regex.escape(word)}{end}", text, overlapped=True):
            found.append((m.start(), -len(word), label, m.end()))
    out, upto = [], {}
    for start, _, label, end in sorted(found):
        if start >= upto.get(label, 0):
            upto[label] = end
            out.append((label, start, end))
    return out


def test_a_thousand_keywords():
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 5)))
    rows = [(f"l{i % 40}", " ".join(word() for _ in range(r.choice([1, 1, 1, 2]))) + r.choice(["", "", "$"])) for i in range(1000)]
    compiled = K.Keywords(tuple(rows))
    for _ in range(25):
        text = "".join(r.choice([word(), word(), " ", " ", ", ", "_", "9", "́", "\n"]) for _ in range(300))
        assert compiled.matches(text) == brute(text, rows)


def test_boundaries_and_clitics():
    rows = (("ear", "ear$"), ("ear", "earache"), ("throat", "sore throat"), ("typhoid", "تيفوئيد"), ("none", ""), ("none", " "), ("none", "$"), ("vomit", "vomit"), ("hindi", "बुखार"))
    got = K.Keywords(rows).matches
    assert got("early ear, earaches ear") == [("ear", 6, 9), ("ear", 11, 19), ("ear", 20, 23)]
    assert got("بالتيفوئيد و تيفوئيد سلتيفوئيد") == [("typhoid", 3, 10), ("typhoid", 13, 20)]
    assert got("vomiting, not_vomit sore throats") == [("vomit", 0, 8), ("throat", 20, 32)]
    assert got("बुखार") == [("hindi", 0, 5)]
    assert got("") == got(None) == K.Keywords(()).matches("x") == []


def test_column(spark):
    rows = spark.createDataFrame([(1, "a sore throat and ears"), (2, None), (3, "nothing")], "i int, t string")
    got = K.with_matches(rows, "t", [("ear", "ear"), ("throat", "sore throat")])
    assert got.columns == ["i", "t", "matches"]
    found = {r["i"]: [tuple(m) for m in r["matches"]] for r in got.collect()}
    assert found == {1: [("throat", 2, 13), ("ear", 18, 22)], 2: [], 3: []}
    assert got.select(K.count_of("ear").alias("n")).agg({"n": "sum"}).first()[0] == 1


def test_pattern_of_a_table():
    """The pattern for SQL finds as many matches as the automaton, in words that don't touch."""
    r = random.Random(3)
    own = ["ab", "abc", "b$", "c d", "é"]
    compiled = K.Keywords(tuple(("l", k) for k in own))
    for _ in range(300):
        text = "  ".join(r.choice(["c d", "".join(r.choice("abcdé") for _ in range(r.randint(1, 4)))]) for _ in range(8))
        assert len(regex.findall(K.pattern_of(own), text)) == len(compiled.matches(text))
