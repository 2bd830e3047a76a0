"""The English (Porter2) stemmer, from its published description, as a pandas UDF."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Fixed values of the published algorithm.
_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"),
    ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"),
    ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"),
    ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]
_VOWEL = "aeiouy"
_REGION = re.compile(r"[aeiouy][^aeiouy]")
_SHORT_END = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")


def _region(word: str, start: int) -> int:
    m = _REGION.search(word, start)
    return m.end() if m else len(word)


@lru_cache(maxsize=1 << 18)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in _WHOLE:
        return _WHOLE[word]
    word = word.lstrip("'")
    word = re.sub(r"(?<=[aeiouy])y", "Y", re.sub(r"^y", "Y", word))
    special = re.match(r"gener|commun|arsen", word)
    r1 = special.end() if special else _region(word, 0)
    r2 = _region(word, r1)
    word = re.sub(r"'s'$|'s$|'$", "", word)
    # 1a: plurals
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(r"[aeiouy].", word[:-1]):
        word = word[:-1]
    if word in _AFTER_1A:
        return word
    # 1b: past forms
    if word.endswith(("eedly", "eed")):
        n = 5 if word.endswith("eedly") else 3
        if len(word) - n >= r1:
            word = word[:-n] + "ee"
    else:
        m = re.search(r"(?:ingly|edly|ing|ed)$", word)
        if m and re.search(r"[aeiouy]", word[: m.start()]):
            word = word[: m.start()]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", word):
                word = word[:-1]
            elif r1 >= len(word) and _SHORT_END.search(word):
                word += "e"
    # 1c: final y
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWEL:
        word = word[:-1] + "i"
    for suffix, to in _STEP2:
        if word.endswith(suffix):
            stand = word[: -len(suffix)]
            if len(stand) >= r1 and (suffix != "ogi" or stand.endswith("l")) and (suffix != "li" or stand[-1:] in tuple("cdeghkmnrt")):
                word = stand + to
            break
    for suffix, to in _STEP3:
        if word.endswith(suffix):
            stand = word[: -len(suffix)]
            if len(stand) >= (r2 if suffix == "ative" else r1):
                word = stand + to
            break
    for suffix in _STEP4:
        if word.endswith(suffix):
            stand = word[: -len(suffix)]
            if len(stand) >= r2 and (suffix != "ion" or stand[-1:] in ("s", "t")):
                word = stand
            break
    # 5: final e and ll
    if word.endswith("e"):
        if len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _SHORT_END.search(word[:-1])):
            word = word[:-1]
    elif word.endswith("l") and len(word) - 1 >= r2 and word[-2:-1] == "l":
        word = word[:-1]
    return word.replace("Y", "y")


@F.pandas_udf(ArrayType(StringType()))
def stemmed(terms: pd.Series) -> pd.Series:
    """Terms of letters as their stems; others as they are."""
    return terms.map(lambda ts: None if ts is None else [stem(t) if t.isalpha() else t for t in ts])
