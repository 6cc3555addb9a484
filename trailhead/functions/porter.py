"""Porter's stemming algorithm (1980), for ASCII words; other words stay as they are."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
#: Conditions on what stands before an ending: a measure above 0, of 1, above 1, a vowel, consonant-vowel-consonant.
PATTERNS = {"m0": f"^({_C})?{_V}{_C}", "m1": f"^({_C})?{_V}{_C}({_V})?$", "more": f"^({_C})?{_V}{_C}{_V}{_C}", "vowel": f"^({_C})?[aeiouy]", "cvc": f"^{_C}[aeiouy][^aeiouwxy]$"}
_M0, _M1, _MORE, _VOWEL, _CVC = (re.compile(PATTERNS[n]) for n in ("m0", "m1", "more", "vowel", "cvc"))
# The suffix tables of steps 2, 3 and 4.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _swap(w: str, table: dict[str, str]) -> str:
    for tail in sorted(table, key=len, reverse=True):
        if w.endswith(tail):
            stem = w[: -len(tail)]
            return stem + table[tail] if _M0.match(stem) else w
    return w


def stem(w: str) -> str:
    if len(w) < 3 or not re.fullmatch("[a-z]+", w):
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _M0.match(w[:-3]):
            w = w[:-1]
    else:
        for tail in ("ed", "ing"):
            if w.endswith(tail):
                base = w[: -len(tail)]
                if _VOWEL.match(base):
                    w = base
                    if w.endswith(("at", "bl", "iz")) or _CVC.match(w):
                        w += "e"
                    elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeioulsz":
                        w = w[:-1]
                break
    if w.endswith("y") and _VOWEL.match(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, STEP2), STEP3)
    for tail in sorted(STEP4, key=len, reverse=True):
        if w.endswith(tail):
            if _MORE.match(w[: -len(tail)]):
                w = w[: -len(tail)]
            break
    else:
        if w.endswith(("sion", "tion")) and _MORE.match(w[:-3]):
            w = w[:-3]
    if w.endswith("e"):
        base = w[:-1]
        if _MORE.match(base) or _M1.match(base) and not _CVC.match(base):
            w = base
    if w.endswith("ll") and _MORE.match(w):
        w = w[:-1]
    return w


def porter(terms: Column) -> Column:
    """Stems of a term column. Apply it to distinct terms: it is the one function here that leaves the JVM."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else stem(x))

    return run(terms)
