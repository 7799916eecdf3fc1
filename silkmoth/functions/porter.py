"""Porter's stemming algorithm, with the departures *bli -> ble* and *logi -> log*."""

from __future__ import annotations

from functools import lru_cache

#: Suffixes of steps 2 to 4 (fixed values of the published algorithm).
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def shape(word: str) -> str:
    """``word`` with v for vowels and c for consonants; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out[-1:] == "c") else "c"
    return out


def measure(stem: str) -> int:
    """Number of vowel-consonant sequences."""
    return shape(stem).replace("c", " c").replace("v", " v").replace("c c", "cc").count("v c")


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and shape(word)[-1] == "c"


def _short(word: str) -> bool:
    return len(word) > 2 and shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """Stem of a lower-case word; words of one or two letters are kept."""
    if len(word) < 3:
        return word
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        ending = next((e for e in ("ed", "ing") if w.endswith(e) and "v" in shape(w[: -len(e)])), None)
        if ending:
            w = w[: -len(ending)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w):
                w = w if w[-1] in "lsz" else w[:-1]
            elif measure(w) == 1 and _short(w):
                w += "e"
    if w.endswith("y") and "v" in shape(w[:-1]):
        w = w[:-1] + "i"
    for rules in (STEP_2, STEP_3):
        s = _longest(w, rules)
        if s and measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + rules[s]
    s = _longest(w, STEP_4)
    if s and measure(w[: -len(s)]) > 1 and (s != "ion" or w[: -len(s)].endswith(("s", "t"))):
        w = w[: -len(s)]
    if w.endswith("e"):
        m = measure(w[:-1])
        if m > 1 or (m == 1 and not _short(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and measure(w) > 1:
        w = w[:-1]
    return w
