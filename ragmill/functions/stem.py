"""English lexemes: stop words and the Porter2 stemmer, after its published description (snowballstem.org)."""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Common English stop words.
STOP_WORDS = frozenset(
    """a about above after again against all am an and any are as at be because been before being below between both but by can did do does
    doing don down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its
    itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own s same she should so some
    such t than that the their theirs them themselves then there these they this those through to too under until up very was we were what
    when where which while who whom why will with you your yours yourself yourselves""".split()
)
# Words with stems of their own, words that stay, and words that stay after the first step.
_OWN = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl",
}
_STAY = frozenset("sky news howe atlas cosmos bias andes".split())
_DONE = frozenset("inning outing canning herring earring proceed exceed succeed".split())
# Endings of steps 2, 3 and 4 with what takes their place.
_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate",
    "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
    "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()

_V = "[aeiouy]"
_REGION = re.compile(f"{_V}[^aeiouy]")
_SHORT_END = re.compile(f"(?:^{_V}[^aeiouy]|[^aeiouy]{_V}[^aeiouywxY])$")


def _ending(word: str, endings: object) -> str | None:
    """The longest of the endings that the word has."""
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _regions(word: str) -> tuple[int, int]:
    """Where R1 and R2 begin: after the first consonant that follows a vowel, and again after that."""
    head = re.match("gener|commun|arsen", word)
    first = head.end() if head else (m.end() if (m := _REGION.search(word)) else len(word))
    return first, m.end() if (m := _REGION.search(word, first)) else len(word)


@functools.lru_cache(100_000)
def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in _OWN:
        return _OWN[word]
    if word in _STAY:
        return word
    word = re.sub(r"^y|(?<=[aeiouy])y", "Y", word.removeprefix("'"))
    r1, r2 = _regions(word)
    word = re.sub("('s'|'s|')$", "", word)
    # 1a
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[: -2 if len(word) > 4 else -1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(_V, word[:-2]):
        word = word[:-1]
    if word in _DONE:
        return word
    # 1b
    end = _ending(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(word) - len(end) >= r1:
            word = word[: -len(end)] + "ee"
    elif end and re.search(_V, word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", word):
            word = word[:-1]
        elif r1 >= len(word) and _SHORT_END.search(word):
            word += "e"
    # 1c
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    # 2 and 3
    end = _ending(word, _STEP2)
    if end and len(word) - len(end) >= r1 and (end != "ogi" or word[-4:-3] == "l") and (end != "li" or word[-3:-2] in tuple("cdeghkmnrt")):
        word = word[: -len(end)] + _STEP2[end]
    end = _ending(word, _STEP3)
    if end and len(word) - len(end) >= (r2 if end == "ative" else r1):
        word = word[: -len(end)] + _STEP3[end]
    # 4
    end = _ending(word, _STEP4)
    if end and len(word) - len(end) >= r2 and (end != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(end)]
    # 5
    if word.endswith("e") and (len(word) - 1 >= r2 or len(word) - 1 >= r1 and not _SHORT_END.search(word[:-1])):
        word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


def english_lexeme(token: Column) -> Column:
    """The stem of a lower-case token, null for a stop word; for `search.postings(chunks, english_lexeme)`."""

    @F.pandas_udf("string")
    def of(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda t: None if t is None or t in STOP_WORDS else stem(t))

    return of(token)


def query_lexemes(question: str) -> list[str]:
    """Lexemes of a question, in order, without repeats; none for one of stop words only."""
    words = re.findall(r"[^\W_]+", question.lower())
    return list(dict.fromkeys(stem(w) for w in words if w not in STOP_WORDS))
