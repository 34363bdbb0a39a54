"""Suffix stripping after Porter's published algorithm, for the optional stemmer."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes and what they become where the measure before them is over 0.
_STEP_2 = (
    "ational ate, tional tion, enci ence, anci ance, izer ize, abli able, alli al, entli ent, eli e, ousli ous, ization ize, ation ate, ator ate,"
    " alism al, iveness ive, fulness ful, ousness ous, aliti al, iviti ive, biliti ble"
)
_STEP_3 = "icate ic, ative , alize al, iciti ic, ical ic, ful , ness "
#: Suffixes that go where the measure before them is over 1.
_STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _table(text: str) -> list[tuple[str, str]]:
    pairs = [entry.strip(" ").split(" ") if " " in entry.strip(" ") else [entry.strip(" "), ""] for entry in text.split(",")]
    return sorted(((a, b) for a, b in pairs), key=lambda p: -len(p[0]))


_TABLE_2, _TABLE_3 = _table(_STEP_2), _table(_STEP_3)


def _shape(word: str) -> str:
    """v for vowels, c for others; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("vc", re.sub(r"(.)\1+", r"\1", _shape(stem))))


def _short(stem: str) -> bool:
    return len(stem) >= 3 and _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _replaced(word: str, table: list[tuple[str, str]]) -> str:
    for suffix, new in table:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + new if _measure(stem) > 0 else word
    return word


@lru_cache(100_000)
def porter(word: str) -> str:
    if len(word) <= 2:
        return word
    for suffix, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            word = word[: len(word) - len(suffix)] + new
            break
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        suffix = next((s for s in ("ed", "ing") if word.endswith(s) and "v" in _shape(word[: -len(s)])), "")
        if suffix:
            word = word[: -len(suffix)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, _TABLE_2), _TABLE_3)
    for suffix in sorted(_STEP_4, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def stemmer(name: str) -> Callable[[str], str]:
    if name != "porter":
        raise ValueError(f"unknown stemmer: {name}")
    return porter


def stem_words(words: Column, name: str) -> Column:
    """Stems of an array of words, batch by batch."""
    stem = stemmer(name)

    @F.pandas_udf("array<string>")
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda ws: None if ws is None else [stem(w) for w in ws])

    return run(words)
