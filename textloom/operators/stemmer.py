"""The published Porter2 (Snowball English) stemmer, written from its description."""

from __future__ import annotations

import re

_V = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
#: Fixed exceptions of the algorithm.
EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
_AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = [("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", "")]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = sorted("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split(), key=len, reverse=True)


def _region(w: str, start: int = 0) -> int:
    m = re.search(r"[aeiouy][^aeiouy]", w[start:])
    return start + m.end() if m else len(w)


def _regions(w: str) -> tuple[int, int]:
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = _region(w) if r1 is None else r1
    return r1, _region(w, r1)


def _short(w: str) -> bool:
    return bool(re.search(r"(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$", w))


def stem(word: str) -> str:
    w = word.lower()
    if len(w) < 3:
        return w
    w = w.removeprefix("'")
    if w in EXCEPTIONS:
        return EXCEPTIONS[w]
    w = re.sub(r"(?:^y|(?<=[aeiouy])y)", "Y", w)
    r1, r2 = _regions(w)
    w = re.sub(r"(?:'s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(r"[aeiouy].+s$", w):
        w = w[:-1]
    if w.lower() in _AFTER_1A:
        return w.lower()
    m = re.search(r"(?:eedly|ingly|edly|eed|ing|ed)$", w)
    if m:
        if m[0] in ("eed", "eedly"):
            if m.start() >= r1:
                w = w[: m.start()] + "ee"
        elif re.search("[aeiouy]", w[: m.start()]):
            w = w[: m.start()]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(_DOUBLES):
                w = w[:-1]
            elif len(w) <= r1 and _short(w):
                w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    for suffix, to in _STEP2:
        if w.endswith(suffix):
            if len(w) - len(suffix) >= r1 and (suffix != "ogi" or w[-4:-3] == "l") and (suffix != "li" or w[-3:-2] in "cdeghkmnrt"):
                w = w[: len(w) - len(suffix)] + to
            break
    for suffix, to in _STEP3:
        if w.endswith(suffix):
            if len(w) - len(suffix) >= (r2 if suffix == "ative" else r1):
                w = w[: len(w) - len(suffix)] + to
            break
    for suffix in _STEP4:
        if w.endswith(suffix):
            if len(w) - len(suffix) >= r2 and (suffix != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: len(w) - len(suffix)]
            break
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()
