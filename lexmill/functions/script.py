"""Stress marks and transliteration of Latin-script words as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.text import ColumnLike, _c, strip, syllables

# Words without stress, and the letters of the scripts.
UNSTRESSED = "ji or nor kam mas kwas he ki fe le na xa ger no el de tas tem kom".split()
PLAIN_VOWELS, ACUTE_VOWELS = "aeiouAEIOU", "áéíóúÁÉÍÓÚ"
LATIN = "aeioupbcjtdkgfsxhvzrlmnyw"
CYRILLIC = "аеиоупбчжтдкгфсшхвзрлмнйў"
# The private-use letters of the featural script, for the letters of LATIN; stressed vowels for aeiou.
FEATURAL = "\ue0ec\ue0c4\ue0dc\ue0bc\ue0ac\ue216\ue192\ue210\ue18c\ue208\ue184\ue20e\ue18a\ue298\ue299\ue294\ue292\ue1bc\ue1bd\ue2ce\ue142\ue124\ue116\ue111\ue10b"
FEATURAL_STRESSED = "\ue0e8\ue0c0\ue0d8\ue0b8\ue0a8"
ENGMA, TRILL, BREAK = "\ue11c", "\ue2db", "\ue100"

_V, _C = f"[{PLAIN_VOWELS}]", f"[^{PLAIN_VOWELS}]"
_LAST = f"(?s)^(.*)({_V})({_C}*)$"
_LAST_BUT_ONE = f"(?s)^(.*)({_V})({_C}*{_V}{_C}*)$"


def _at_stress(word: Column, change: Callable[[Column], Column]) -> Column:
    """The word with its stressed vowel changed: the last but one if the word ends in a vowel and has several, else the last."""
    vowels = F.length(F.regexp_replace(word, _C, ""))

    def put(p: str) -> Column:
        return F.concat(F.regexp_extract(word, p, 1), change(F.regexp_extract(word, p, 2)), F.regexp_extract(word, p, 3))

    ends = F.lower(word).rlike("[aeiou]$")
    return F.when(vowels == 0, word).when(ends & (vowels > 1), put(_LAST_BUT_ONE)).otherwise(put(_LAST))


def _acute(vowel: Column) -> Column:
    return F.translate(vowel, PLAIN_VOWELS, ACUTE_VOWELS)


def stress_word(word: ColumnLike) -> Column:
    """Acute on the stressed vowel, also of words of one syllable; unstressed function words stay."""
    w = _c(word)
    return F.when(w.isin(*UNSTRESSED), w).otherwise(_at_stress(w, _acute))


def stress_sentence(text: ColumnLike) -> Column:
    """Each blank-separated token that begins with a letter stressed; texts of one syllable stay."""
    c = _c(text)
    words = F.transform(F.split(strip(c), r"(?U)\s+"), lambda w: F.when(w.rlike(r"^\p{L}"), stress_word(w)).otherwise(w))
    return F.when(syllables(c) == 1, c).otherwise(F.array_join(words, " "))


def _shown_stress(word: Column, change: Callable[[Column], Column]) -> Column:
    """Stress as the written scripts show it: none on words of one syllable and function words."""
    vowels = F.length(F.regexp_replace(word, _C, ""))
    return F.when(F.lower(word).isin(*UNSTRESSED) | (vowels < 2), word).otherwise(_at_stress(word, change))


def latin_stressed(word: ColumnLike) -> Column:
    return _shown_stress(_c(word), _acute)


def cyrillic(word: ColumnLike) -> Column:
    """Cyrillic letters, the stressed vowel with a combining acute.

    ``y`` and a vowel make the iotated letter where there is one. A capital ``Y`` before a
    small vowel leaves that vowel alone.
    """
    w = _shown_stress(_c(word), lambda v: F.concat(v, F.lit("́")))
    w = F.regexp_replace(w, "Y(?=[aeiou])", "")
    for latin, letter in (("y[aA]", "я"), ("y[uU]", "ю"), ("YA", "Я"), ("YU", "Ю"), ("y[eE]", "йе"), ("y[iI]", "йи"), ("y[oO]", "йо"), ("YE", "Йе"), ("YI", "Йи"), ("YO", "Йо")):
        w = F.regexp_replace(w, latin, letter)
    return F.translate(w, LATIN + LATIN.upper(), CYRILLIC + CYRILLIC.upper())


def featural(word: ColumnLike) -> Column:
    """The featural script: one letter a sound, a break between vowels, ``ng``/``nk`` and ``rr`` with letters of their own."""
    w = _shown_stress(F.lower(_c(word)), F.upper)
    w = F.regexp_replace(w, f"(?<={_V})(?={_V})", BREAK)
    w = F.regexp_replace(w, "n(?=[gk])", ENGMA)
    w = F.reverse(F.replace(F.reverse(w), F.lit("rr"), F.lit(TRILL)))  # pairs count from the end
    return F.translate(w, LATIN + "AEIOU", FEATURAL + FEATURAL_STRESSED)


SCRIPTS: dict[str, Callable[[ColumnLike], Column]] = {"Latin": _c, "Latin (stressed)": latin_stressed, "Cyrillic": cyrillic, "Musa": featural}


def convert_sentence(text: ColumnLike, script: str) -> Column:
    """Every run of ASCII letters converted, everything between as it is."""
    if script == "Latin":
        return _c(text)
    runs = F.regexp_extract_all(_c(text), F.lit("[a-zA-Z]+|[^a-zA-Z]+"), 0)
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[a-zA-Z]"), SCRIPTS[script](r)).otherwise(r)), "")
