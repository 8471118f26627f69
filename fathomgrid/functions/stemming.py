"""The English stemmer of five suffix steps and two regions, over columns of words.

R1 begins behind the first consonant that follows a vowel, R2 likewise inside R1. A step
takes the longest of its endings and changes it only where it lies in the step's region.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed values of the published algorithm: whole words, endings and what replaces them.
WHOLE_WORDS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT_AFTER_PLURALS = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
R1_PREFIXES = ("gener", "commun", "arsen")
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
BEFORE_LI = "cdeghkmnrt"

_VOWEL, _OTHER = "[aeiouy]", "[^aeiouy]"
_REGION = re.compile(f".*?{_VOWEL}{_OTHER}")
_PREFIX = re.compile("|".join(R1_PREFIXES))
_SHORT = re.compile(f"(?:^|.*{_OTHER})[aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy]")
_ENDINGS_2, _ENDINGS_3, _ENDINGS_4 = (re.compile("(?:" + "|".join(sorted(e, key=len, reverse=True)) + ")$") for e in (STEP_2, STEP_3, STEP_4))
_PAST = re.compile("(?:eedly|ingly|edly|eed|ing|ed)$")


def _behind(word: str, start: int) -> int:
    m = _REGION.match(word, start)
    return m.end() if m else len(word)


def _marked(word: str) -> str:
    """The word with Y for each y that is a consonant: at the beginning, or after a vowel, which Y isn't."""
    out = ""
    for c in word:
        out += "Y" if c == "y" and (not out or out[-1] in "aeiouy") else c
    return out


def _ends_short(word: str) -> bool:
    """Whether the word ends in a short syllable."""
    return bool(_SHORT.fullmatch(word))


def _past(word: str, r1: int) -> str:
    m = _PAST.search(word)
    if not m:
        return word
    body = word[: m.start()]
    if m[0].startswith("ee"):
        return body + "ee" if m.start() >= r1 else word
    if not re.search(_VOWEL, body):
        return word
    if body.endswith(("at", "bl", "iz")):
        return body + "e"
    if re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", body):
        return body[:-1]
    return body + "e" if r1 >= len(body) and _ends_short(body) else body


def stem_word(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters are their own."""
    if len(word) < 3:
        return word
    if word in WHOLE_WORDS:
        return WHOLE_WORDS[word]
    word = _marked(word)
    prefix = _PREFIX.match(word)
    r1 = prefix.end() if prefix else _behind(word, 0)
    r2 = _behind(word, r1)

    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(_VOWEL, word[:-2]):
        word = word[:-1]
    if word in KEPT_AFTER_PLURALS:
        return word.replace("Y", "y")
    word = _past(word, r1)
    if len(word) > 2 and word[-1] in "yY" and not re.match(_VOWEL, word[-2]):
        word = word[:-1] + "i"

    m = _ENDINGS_2.search(word)
    if m and m.start() >= r1:
        before = word[m.start() - 1 : m.start()]
        if not (m[0] == "ogi" and before != "l" or m[0] == "li" and (before not in BEFORE_LI or not before)):
            word = word[: m.start()] + STEP_2[m[0]]
    m = _ENDINGS_3.search(word)
    if m and m.start() >= (r2 if m[0] == "ative" else r1):
        word = word[: m.start()] + STEP_3[m[0]]
    m = _ENDINGS_4.search(word)
    if m and m.start() >= r2 and (m[0] != "ion" or word[m.start() - 1] in "st"):
        word = word[: m.start()]
    end = len(word) - 1
    if word.endswith("e") and (end >= r2 or end >= r1 and not _ends_short(word[:-1])) or word.endswith("ll") and end >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


@F.pandas_udf(StringType())
def stems(words: pd.Series) -> pd.Series:
    """The stems of lower-case words; null stays null. A batch stems each distinct word once."""
    known = {w: stem_word(w) for w in words.dropna().unique()}
    return pd.Series([known.get(w) for w in words], dtype=object)
