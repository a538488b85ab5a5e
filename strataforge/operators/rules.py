"""Rule tables over keyword matches, and the guards that need places in the text.

A rule's keywords are matched by one automaton (:mod:`.keywords`). A match counts unless a guard reaches its start:
a sentence that is hypothetical (a condition, something long past, a question for a cause or to the assistant), a clause after
words of prevention or information, or a negation up to LOOK_BACK characters before. A keyword whose own words
are negations ("not breathing") is the signal itself: no negation reaches it, it negates nothing after it, and
keywords inside it don't count.

The guards exist twice: as intervals around matches (:func:`with_hits`, which looks only at sentences that hold a match), and as
replacements in the whole text (:func:`left_of`, for columns and SQL). Tests hold them against each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .keywords import IN_WORD, MATCHES, Keywords, Match, as_arrow, pattern_of

LEVELS = ("routine", "mental_health", "urgent", "emergency")


@dataclass(frozen=True)
class Rule:
    """A row of a rule table. It holds if all flags in ``requires`` hold, or a keyword matches where no guard reaches it.

    A match is excused by ``mild_if`` unless ``serious_if`` matches or the flag ``young`` holds, and by ``contradicted_if`` in any case; these match anywhere.
    """

    name: str
    level: str
    keywords: list[str]
    requires: list[str] = field(default_factory=list)
    mild_if: list[str] = field(default_factory=list)
    serious_if: list[str] = field(default_factory=list)
    contradicted_if: list[str] = field(default_factory=list)


# Fixed values of the guards, by language: words of negation, of contrast, of enumeration.
NEGATIONS = {
    "en": ["no", "not", "without", "never", "cannot", "can't", "won't", "doesn't", "isn't", "hasn't"],
    "de": ["nicht", "kein", "keine", "keinen", "keiner", "ohne", "nie"],
    "fr": ["sans", "pas", "jamais", "aucun", "aucune"],
    "es": ["no", "sin", "nunca", "ni"],
    "pt": ["não", "nao", "sem", "nunca", "nem"],
}
CONTRASTS = "but|however|though|aber|jedoch|doch|mais|pero|aunque|mas|porém"
LINKS = "and|or|nor|und|oder|noch|et|ou|ni|y|o|e|nem"
LOOK_BACK = 26
# What marks a sentence, or the rest of a clause, as no report of something that happens now.
CLAUSE_GUARDS = {
    "en": ["how (?:to|do i|can i) (?:avoid|prevent|protect)", "prevention of", "vaccine against", "what (?:is|are|does)", "tell me about", "difference between", "i (?:was told|have read)"],
    "de": ["vorbeugung (?:von|gegen)", "impfung gegen", "was (?:ist|sind|bedeutet)", "unterschied zwischen", "ich habe gelesen"],
    "fr": ["comment (?:éviter|prévenir)", "prévention d", "vaccin contre", "qu.est-ce", "différence entre", "j.ai lu"],
    "es": ["cómo (?:evitar|prevenir)", "prevención d", "vacuna contra", "qué (?:es|son|significa)", "diferencia entre", "he leído"],
    "pt": ["como (?:evitar|prevenir)", "prevenção d", "vacina contra", "o que (?:é|são|significa)", "diferença entre", "eu li"],
}
SENTENCE_GUARDS = {
    "en": ["^ *if ", ", *if ", "what (?:should|do|would|happens)[^,]* if ", "in case (?:of|he|she)", "(?:years?|months?) ago", "last (?:year|month)", "when (?:i|he|she) was", "(?:can|could) you (?:explain|tell|help|show)"],
    "de": ["^ *(?:falls|wenn) ", ", *(?:falls|wenn) ", "wie .*(?:vorbeug|verhinder|vermeid)", r"vor [^,]*(?:jahren|monaten)", "letztes jahr", "kannst du", "können sie"],
    "fr": ["^ *si ", ", *si ", "s.il ", "au cas où", "il y a [^,]*(?:ans|mois)", "l.an dernier", "(?:peux|pouvez).(?:tu|vous)"],
    "es": ["^ *si ", ", *si ", "en caso de", "hace [^,]*(?:años|meses)", "el año pasado", "puedes (?:explicar|decir)"],
    "pt": ["^ *se ", ", *se ", "em caso de", "há [^,]*(?:anos|meses)", "no ano passado", "podes? (?:explicar|dizer)"],
}
QUESTION_GUARDS = {
    "en": ["why (?:do|does|did|is)", "(?:can|could|may) .*(?:cause|lead to)"],
    "de": ["warum ", "^ *kann .*(?:verursachen|auslösen)"],
    "fr": ["pourquoi", "peut.* (?:provoquer|causer)"],
    "es": ["por qué", "puede (?:causar|provocar|dar)"],
    "pt": ["por que", "pode (?:causar|provocar|dar)"],
}
LANGUAGES = (*NEGATIONS, None)  # None: unknown, guards of all languages but those that are common words elsewhere
_COMMON_ELSEWHERE = {"^ *si ", ", *si ", "^ *se ", ", *se ", "mas", "^ *(?:falls|wenn) ", ", *(?:falls|wenn) ", "eu li"}

_BEFORE = r"(^|[^\p{L}])"
_MARK, _ASKED = 0xE000, "\x02"  # private characters: a negative keyword of rule k; a sentence that is a question
_MARKS = "\ue000-\ue0ff"


def joined(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def any_of(text: Column, patterns: list[str]) -> Column:
    """Whether one of the literal patterns matches; each is compiled once for the plan."""
    return text.rlike(joined(patterns)) if patterns else F.lit(False)


def _for(table: dict[str, list[str]], lang: str | None) -> list[str]:
    return table[lang] if lang else [p for ps in table.values() for p in dict.fromkeys(ps) if p not in _COMMON_ELSEWHERE]


@dataclass(frozen=True)
class Guards:
    """A language's guards as patterns that Java, RE2 and Python read alike."""

    sentence: str
    question: str
    clause: str
    contrast: str
    negated: str

    @staticmethod
    @lru_cache(16)
    def of(lang: str | None) -> Guards:
        words = joined(_for(NEGATIONS, lang))
        return Guards(
            sentence=joined([p if p.startswith(("^", ",")) else f"{_BEFORE}{p}" for p in _for(SENTENCE_GUARDS, lang)]),
            question=joined([p if p.startswith("^") else f"{_BEFORE}{p}" for p in _for(QUESTION_GUARDS, lang)]),
            clause=rf"{_BEFORE}(?:{joined(_for(CLAUSE_GUARDS, lang))})[^.!?;,\n]*",
            contrast=rf"{_BEFORE}(?:{CONTRASTS})([^\p{{L}}]|$)",
            negated=rf"{_BEFORE}(?:{words})[^\p{{L}}.!?;,\n{_MARKS}](?:[^.!?;,\n{_MARKS}]|, *(?:{LINKS})[^\p{{L}}{_MARKS}]){{0,{LOOK_BACK - 1}}}{IN_WORD}*",
        )

    @staticmethod
    @lru_cache(16)
    def compiled(lang: str | None) -> Guards:
        g = Guards.of(lang)
        return Guards(*(regex.compile(p) for p in (g.sentence, g.question, g.clause, g.contrast, g.negated)))


def is_negative(keyword: str) -> bool:
    """Whether a word of the keyword is a negation in some language."""
    return any(w in ws for w in keyword.removesuffix("$").split() for ws in NEGATIONS.values())


# ---------------------------------------------------------------- guards around matches


_SENTENCE = regex.compile(r"[^.!?\n]*[.!?\n]?")


def unguarded(text: str, found: list[Match], negative: list[bool], lang: str | None) -> list[Match]:
    """The matches that no guard reaches; ``negative`` tells whose keyword is a negation itself."""
    shields = [m for m, n in zip(found, negative) if n]
    found = [(m, n) for m, n in zip(found, negative) if n or not any(s <= m[1] < e for _, s, e in shields)]
    guards = Guards.compiled(lang if lang in NEGATIONS else None)
    out, k = [], 0
    for part in _SENTENCE.finditer(text):
        own = []
        while k < len(found) and found[k][0][1] < part.end():
            own.append(found[k])
            k += 1
        if not own:
            if k == len(found):
                break
            continue
        a = part.start()
        body = part.group()
        asked = body.endswith("?")
        body = body[:-1] if body[-1:] in ".!?\n" else body
        for _, s, e in shields:
            if a <= s < a + len(body):
                body = body[: s - a] + chr(_MARK) * (min(e, a + len(body)) - s) + body[min(e - a, len(body)) :]
        if guards.sentence.search(body) or (asked and guards.question.search(body)):
            continue
        reached: list[tuple[int, int]] = []

        def blank(m: regex.Match) -> str:
            begin = m.end(1)
            reached.append((begin, m.end()))
            return m[1] + ";" * (m.end() - begin)

        body = guards.clause.sub(blank, body)
        body = guards.contrast.sub(lambda m: m[1] + ";" * (len(m[0]) - len(m[1]) - len(m[2])) + m[2], body)
        denied = [(m.end(1), m.end()) for m in guards.negated.finditer(body)]
        for (label, s, e), shield in own:
            inside = lambda spans: any(x <= s - a < y for x, y in spans)  # noqa: B023, E731
            if not inside(reached) and (shield or not inside(denied)):
                out.append((label, s, e))
    return out


HITS = T.StructType([T.StructField("hits", MATCHES), T.StructField("said", T.ArrayType(T.StringType()))])


def with_hits(rows: DataFrame, text: str, lang: str | None, rules: list[Rule], name: str = "found") -> DataFrame:
    """``rows`` with hits (rule, start, end) that no guard reaches, and said, the excusing conditions that match anywhere.

    ``text`` is a lower-case column, ``lang`` one of language codes (null: unknown) or None. One pass of one automaton a text.
    """
    table = tuple((f"{i}{'!' if is_negative(k) else '.'}", k) for i, r in enumerate(rules) for k in r.keywords)
    table += tuple((f"{i}{kind}", k) for i, r in enumerate(rules) for kind in ("mild_if", "serious_if", "contradicted_if") for k in getattr(r, kind))
    names = [r.name for r in rules]
    struct = pa.struct([("hits", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))), ("said", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = Keywords.of(table)
        for batch in batches:
            hits, said = [], []
            langs = batch.column(lang).to_pylist() if lang else [None] * batch.num_rows
            for t, of in zip(batch.column(text).to_pylist(), langs):
                found = keywords.matches(t)
                said.append(sorted({m[0] for m in found if m[0][-1] not in ".!"}))
                mine = [m for m in found if m[0][-1] in ".!"]
                kept = unguarded(t, mine, [m[0][-1] == "!" for m in mine], of) if mine else []
                hits.append([(names[int(label[:-1])], s, e) for label, s, e in kept])
            both = pa.StructArray.from_arrays([as_arrow(hits), pa.array(said, pa.list_(pa.string()))], fields=list(struct))
            yield pa.RecordBatch.from_arrays([*batch.columns, both], [*batch.schema.names, name])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, HITS)]))


def matched(found: Column, flags: dict[str, Column], rules: list[Rule]) -> Column:
    """Names of the rules that hold, most severe first, then in table order."""
    hit = F.transform(found["hits"], lambda m: m["label"])
    said = lambda i, kind: F.array_contains(found["said"], f"{i}{kind}")
    holds = []
    for i, r in sorted(enumerate(rules), key=lambda x: -LEVELS.index(x[1].level)):
        h = F.array_contains(hit, r.name)
        if r.mild_if:
            h = h & ~(said(i, "mild_if") & ~said(i, "serious_if") & ~flags["young"])
        if r.contradicted_if:
            h = h & ~said(i, "contradicted_if")
        if r.requires:
            every = flags[r.requires[0]]
            for f in r.requires[1:]:
                every = every & flags[f]
            h = every | h if r.keywords else every
        holds.append(F.when(h, F.lit(r.name)))
    return F.array_compact(F.array(*holds))


# ---------------------------------------------------------------- guards as replacements


def replacements(rules: list[Rule], lang: str | None) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(pattern, replacement) before sentences are filtered and after; \\1 stands for the first group."""
    g = Guards.of(lang)
    shields = [(pattern_of(own, ""), rf"\1{chr(_MARK + i)}") for i, r in enumerate(rules) if (own := [k for k in r.keywords if is_negative(k)])]
    return shields, [(g.clause, r"\1;"), (g.contrast, r"\1;\2"), (g.negated, r"\1;")]


def sentences(lowered: Column) -> Column:
    """Sentences without their ends; a question ends in a mark of its own."""
    return F.split(F.regexp_replace(lowered, r"\?", _ASKED + "?"), "[.!?\n]")


def hypothetical(sentence: Column, lang: str | None) -> Column:
    g = Guards.of(lang)
    return sentence.rlike(g.sentence) | (sentence.endswith(_ASKED) & sentence.rlike(g.question))


def left_of(lowered: Column, rules: list[Rule], lang: str | None = None) -> Column:
    """What guards leave of a text: keywords that are still there count; a negative keyword has become its rule's mark."""
    first, then = replacements(rules, lang)
    change = lambda c, steps: c if not steps else change(F.regexp_replace(c, steps[0][0], steps[0][1].replace("\\", "$")), steps[1:])
    return change(F.array_join(F.filter(sentences(change(lowered, first)), lambda s: ~hypothetical(s, lang)), ". "), then)


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sentences_sql(lowered: str) -> str:
    return f"string_split_regex(replace({lowered}, '?', '{_ASKED}?'), '[.!?\n]')"


def hypothetical_sql(sentence: str, lang: str | None) -> str:
    g = Guards.of(lang)
    return f"(regexp_matches({sentence}, {_text(g.sentence)}) OR (suffix({sentence}, '{_ASKED}') AND regexp_matches({sentence}, {_text(g.question)})))"


def left_of_sql(lowered: str, rules: list[Rule], lang: str | None = None) -> str:
    """:func:`left_of` in DuckDB's SQL."""
    first, then = replacements(rules, lang)
    change = lambda c, steps: c if not steps else change(f"regexp_replace({c}, {_text(steps[0][0])}, {_text(steps[0][1])}, 'g')", steps[1:])
    return change(f"array_to_string(list_filter({sentences_sql(change(lowered, first))}, lambda s: NOT {hypothetical_sql('s', lang)}), '. ')", then)


def left_by_lang_sql(lowered: str, rules: list[Rule], lang: str | None) -> str:
    """:func:`left_of_sql` by the language in a column; texts that no rule matches at all are not looked at again."""
    any_rule = pattern_of([k for r in rules for k in r.keywords])
    branches = " ".join(f"WHEN {lang} = '{x}' THEN {left_of_sql(lowered, rules, x)}" for x in NEGATIONS) if lang else ""
    return f"CASE WHEN NOT regexp_matches({lowered}, {_text(any_rule)}) THEN '' {branches} ELSE {left_of_sql(lowered, rules)} END"


def rule_pattern(rules: list[Rule], i: int) -> str:
    """Matches of a rule in what :func:`left_of` leaves."""
    plain = [k for k in rules[i].keywords if not is_negative(k)]
    return joined([pattern_of(plain)] * bool(plain) + [chr(_MARK + i)] * (len(plain) < len(rules[i].keywords)))


def matched_sql(text: str, left: str, flags: dict[str, str], rules: list[Rule]) -> str:
    """:func:`matched` as a DuckDB list."""
    test = lambda of, pattern: f"regexp_matches({of}, {_text(pattern)})"
    hits = []
    for i, r in sorted(enumerate(rules), key=lambda x: -LEVELS.index(x[1].level)):
        holds = test(left, rule_pattern(rules, i)) if r.keywords else "false"
        if r.mild_if:
            serious = test(text, pattern_of(r.serious_if)) if r.serious_if else "false"
            holds += f" AND NOT ({test(text, pattern_of(r.mild_if))} AND NOT {serious} AND NOT {flags['young']})"
        if r.contradicted_if:
            holds += f" AND NOT {test(text, pattern_of(r.contradicted_if))}"
        if r.requires:
            holds = f"({' AND '.join(flags[f] for f in r.requires)}) OR ({holds})"
        hits.append(f"CASE WHEN {holds} THEN '{r.name}' END")
    return "list_filter([" + ", ".join(hits) + "], lambda x: x IS NOT NULL)"


def level_of(names: Column, rules: list[Rule]) -> Column:
    """The highest level among matched rules; the array is ordered, so its first decides."""
    levels = F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.level)])
    return F.when(F.size(names) == 0, LEVELS[0]).otherwise(levels[F.element_at(names, 1)])


_UNIT = r"[0-9]{2,3}(?:\.[0-9])? ?(?:°?F|lbs?|pounds?)\b"


def with_converted_units(text: Column) -> Column:
    """A text in which each temperature in Fahrenheit (of a body: 30 to 45 C) and each weight in pounds (2 to 300) is followed by its metric value.

    The text is cut at the matches; each piece gets its match and what that converts to, and all are joined again.
    """

    def said(match: Column) -> Column:
        n = F.regexp_extract(match, "^[0-9.]+", 0).cast("double")
        celsius = (n - 32) * 5 / 9
        converted = F.when(match.endswith("F"), F.when(celsius.between(30, 45), F.format_string(" (%.1f C)", celsius))).when(n.between(2, 300), F.format_string(" (%.1f kg)", n * 0.45359237))
        return F.concat(match, F.coalesce(converted, F.lit("")))

    found = F.transform(F.regexp_extract_all(text, F.lit(_UNIT), 0), said)
    return F.array_join(F.zip_with(F.split(text, _UNIT), found, lambda piece, match: F.concat(piece, F.coalesce(match, F.lit("")))), "")


def with_converted_units_sql(text: str) -> str:
    """:func:`with_converted_units` in DuckDB's SQL."""
    n = "regexp_extract(x, '^[0-9.]+', 0)::DOUBLE"
    said = f"list_transform(regexp_extract_all({text}, '{_UNIT}'), lambda x: x || CASE WHEN x LIKE '%F' THEN CASE WHEN ({n} - 32) * 5 / 9 BETWEEN 30 AND 45 THEN format(' ({{:.1f}} C)', ({n} - 32) * 5 / 9) ELSE '' END WHEN {n} BETWEEN 2 AND 300 THEN format(' ({{:.1f}} kg)', {n} * 0.45359237) ELSE '' END)"
    rest = f"string_split_regex({text}, '{_UNIT}')"
    return f"array_to_string(list_transform(range(1, len({rest}) + 1), lambda i: {rest}[i] || coalesce({said}[i], '')), '')"
