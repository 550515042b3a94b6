"""The Porter stemmer (Porter 1980), written from its published rules."""

from __future__ import annotations

import re

_V = "[aeiou]|(?<![aeiou])y"
_STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("ement", "ment", "able", "ible", "ance", "ence", "ant", "ent", "ion", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou")

#: Longest endings first, and all endings of a step: most words have none.
_STEPS23 = tuple((sorted(t, key=lambda r: -len(r[0])), tuple(end for end, _ in t)) for t in (_STEP2, _STEP3))
_LONGEST4 = sorted(_STEP4, key=len, reverse=True)
_PLAIN = re.compile("[a-z]+").fullmatch
_VOWELS = str.maketrans({c: "v" if c in "aeiou" else "c" for c in "abcdefghijklmnopqrstuvwxz"})


def _shape(w: str) -> str:
    out = w.translate(_VOWELS)
    while (i := out.find("y")) >= 0:
        out = out[:i] + ("v" if i and out[i - 1] == "c" else "c") + out[i + 1 :]
    return out


def _m(w: str) -> int:
    return _shape(w).count("vc")  # runs of a kind don't change how often a vowel stands before a consonant


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c"


def _cvc(w: str) -> bool:
    return _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


def stem(w: str) -> str:
    if len(w) < 3 or not _PLAIN(w):
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _m(w[:-3]) else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in _shape(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _m(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table, ends in _STEPS23:
        for end, new in table if w.endswith(ends) else ():
            if w.endswith(end):
                if _m(w[: -len(end)]):
                    w = w[: -len(end)] + new
                break
    for end in _LONGEST4 if w.endswith(_STEP4) else ():
        if w.endswith(end):
            rest = w[: -len(end)]
            if _m(rest) > 1 and (end != "ion" or rest[-1:] in ("s", "t")):
                w = rest
            break
    if w.endswith("e") and (_m(w[:-1]) > 1 or (_m(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _m(w) > 1:
        w = w[:-1]
    return w
