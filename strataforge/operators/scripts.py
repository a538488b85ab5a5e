"""Scripts written in other scripts: Devanagari as Latin letters, and folds for Hindi and Arabic typed on a Latin keyboard.

Devanagari is read by a transducer: of the letter groups that a table holds, the longest at each place is taken, and
what it gives depends on what follows. A consonant carries a vowel of its own unless a vowel sign
or a stop (virama) follows or the word ends; a dot below (nukta) makes it another sound.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .keywords import with_column

# Devanagari letters in the order of the alphabet and what they sound like.
CONSONANTS = dict(zip("क ख ग घ ङ च छ ज झ ञ ट ठ ड ढ ण त थ द ध न प फ ब भ म य र ल ळ व श ष स ह".split(), "k kh g gh ng ch chh j jh ny t th d dh n t th d dh n p ph b bh m y r l l v sh sh s h".split()))
DOTTED = dict(zip("क ख ग ज ड ढ फ".split(), "q kh gh z r rh f".split()))
VOWELS = dict(zip("अ आ इ ई उ ऊ ऋ ए ऐ ओ औ ऍ ऑ".split(), "a aa i ee u oo ri e ai o au e o".split()))
SIGNS = dict(zip("ा ि ी ु ू ृ े ै ो ौ ॅ ॉ".split(), "aa i ee u oo ri e ai o au e o".split()))
MARKS = {"ं": "n", "ँ": "n", "ः": "h", "ऽ": "", "़": ""}
DIGITS = dict(zip("०१२३४५६७८९", "0123456789"))
VIRAMA, NUKTA = "्", "़"
_DOTTED_LETTERS = dict(zip(map(chr, range(0x958, 0x95F)), DOTTED.values()))  # with their dot, as one character
_BLOCK = ("ऀ", "ॿ")


def _table() -> dict[str, str]:
    """What each group of characters gives by itself: letters, consonants with dot, sign or stop."""
    out = dict(VOWELS) | SIGNS | MARKS | DIGITS
    letters = CONSONANTS | _DOTTED_LETTERS | {c + NUKTA: DOTTED.get(c, s) for c, s in CONSONANTS.items()}
    for letter, sound in letters.items():
        out[letter] = sound
        out[letter + VIRAMA] = sound
        for sign, vowel in SIGNS.items():
            out[letter + sign] = sound + vowel
    return out


TABLE = _table()


_FIRST, _OUTSIDE, _NOTHING = ord(_BLOCK[0]), 128, 0xFFFFFFFF  # the block's first place; all other characters are one class
_SOME = re.compile(f"[{_BLOCK[0]}-{_BLOCK[1]}]")
_PIECE = 1 << 16  # characters read at once


def _places(letters) -> np.ndarray:
    """Which of the block's places are among ``letters``."""
    found = np.zeros(_OUTSIDE + 1, bool)
    found[[ord(c) - _FIRST for c in letters]] = True
    return found


def _outputs(table: dict[str, str]) -> np.ndarray:
    """Up to three letters for each place of the block, and room for a vowel; what the table lacks stands for itself."""
    out = np.full((_OUTSIDE + 1, 4), _NOTHING, np.uint32)
    for k in range(_OUTSIDE):
        own = table.get(chr(_FIRST + k), chr(_FIRST + k))
        out[k, : len(own)] = [ord(c) for c in own]
    return out


_PLAIN, _WITH_DOT = _places(CONSONANTS), _places(_DOTTED_LETTERS)
_SIGN, _V, _N = _places(SIGNS), ord(VIRAMA) - _FIRST, ord(NUKTA) - _FIRST
_OUT, _OUT_DOTTED = _outputs(TABLE), _outputs({c: TABLE[c + NUKTA] for c in CONSONANTS})


def _piece(text: str) -> str:
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    o = np.minimum(x - np.uint32(_FIRST), _OUTSIDE)  # smaller characters wrap around
    ahead = np.concatenate([o, [_OUTSIDE, _OUTSIDE]])
    dotted = _PLAIN[o] & (ahead[1:-1] == _N)
    bare, after = _PLAIN[o] | _WITH_DOT[o], np.where(dotted, ahead[2:], ahead[1:-1])
    out = _OUT[o]
    outside = o == _OUTSIDE
    out[outside, 0] = x[outside]
    out[dotted] = _OUT_DOTTED[o[dotted]]
    stop = np.flatnonzero(bare & (after == _V))  # a stop after a consonant is not heard
    out[stop + 1 + dotted[stop]] = _NOTHING
    out[bare & (after != _OUTSIDE) & (after != _V) & ~_SIGN[after], 3] = ord("a")  # inside a word the vowel of its own is heard
    return out[out != _NOTHING].tobytes().decode("utf-32-le", "surrogatepass")


def romanised(text: str | None) -> str | None:
    """The text with Devanagari as Latin letters; other characters stay. All places of a piece are read at once; pieces end before a character of another block."""
    if text is None or not _SOME.search(text):
        return text
    out, at = [], 0
    while at < len(text):
        end = at + _PIECE
        while end < len(text) and _BLOCK[0] <= text[end] <= _BLOCK[1]:
            end += 1
        out.append(_piece(text[at:end]))
        at = end
    return "".join(out)


def with_romanised(rows: DataFrame, text: str, name: str) -> DataFrame:
    """``rows`` with their text romanised; a narrow map."""
    return with_column(rows, name, T.StringType(), lambda batch: pa.array(list(_each(batch.column(text).to_pylist())), pa.string()))


def _each(texts: list[str | None]) -> Iterator[str | None]:
    for t in texts:
        yield romanised(t)


# Arabic letters that are typed one for another; digits that stand for Arabic sounds on a Latin keyboard.
ARABIC_FROM, ARABIC_TO = "أإآٱةىؤئ", "اااا" + "هيوي"
ARABIC_MARKS = "[ً-ْـ]"
SILENT, SOUNDS = "23'`", {"7": "h", "5": "kh", "8": "gh", "9": "s", "6": "t", "4": "th"}


def fold_hindi(c: Column) -> Column:
    """Lower case, doubled vowels as one: how long a vowel is differs from hand to hand."""
    return F.regexp_replace(F.lower(c), r"([aeiou])\1+", "$1")


def fold_arabic(c: Column) -> Column:
    """Arabic letters unified; or, where there is none, digits as the sounds they stand for, o and e as u and i, repeated letters as one."""
    native = F.regexp_replace(F.translate(c, ARABIC_FROM, ARABIC_TO), ARABIC_MARKS, "")
    typed = F.translate(F.lower(c), SILENT, "")
    for digit, sound in SOUNDS.items():
        typed = F.replace(typed, F.lit(digit), F.lit(sound))
    typed = F.regexp_replace(F.translate(typed, "oe", "ui"), r"([a-z])\1+", "$1")
    return F.when(c.rlike("[؀-ۿ]"), native).otherwise(typed)


def fold_hindi_sql(c: str) -> str:
    out = f"lower({c})"
    for v in "aeiou":
        out = f"regexp_replace({out}, '{v}{{2,}}', '{v}', 'g')"
    return out


def fold_arabic_sql(c: str) -> str:
    native = f"regexp_replace(translate({c}, '{ARABIC_FROM}', '{ARABIC_TO}'), '{ARABIC_MARKS}', '', 'g')"
    typed = f"regexp_replace(lower({c}), '[{SILENT.replace(chr(39), chr(39) * 2)}]', '', 'g')"
    for digit, sound in SOUNDS.items():
        typed = f"replace({typed}, '{digit}', '{sound}')"
    typed = f"translate({typed}, 'oe', 'ui')"
    for letter in "abcdefghijklmnopqrstuvwxyz":
        typed = f"regexp_replace({typed}, '{letter}{{2,}}', '{letter}', 'g')"
    return f"CASE WHEN regexp_matches({c}, '[؀-ۿ]') THEN {native} ELSE {typed} END"
