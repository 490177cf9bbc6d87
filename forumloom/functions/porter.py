"""Porter's stemmer (M. F. Porter, "An algorithm for suffix stripping", 1980) for single tokens.

Includes the widely used amendments: an exception list, words of one or two letters left alone,
"ies"/"ied" in four-letter words, and a two-letter vowel-consonant stem counting as *o.
"""

from __future__ import annotations

import re

# Words with irregular stems.
IRREGULAR = {
    "sky": "sky",
    "skies": "sky",
    "dying": "die",
    "lying": "lie",
    "tying": "tie",
    "news": "news",
    "innings": "inning",
    "inning": "inning",
    "outings": "outing",
    "outing": "outing",
    "cannings": "canning",
    "canning": "canning",
    "howe": "howe",
    "proceed": "proceed",
    "exceed": "exceed",
    "succeed": "succeed",
}

# Suffix tables of steps 2, 3 and 4.
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
    ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
)
STEP3 = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""),
)
STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate",
    "iti", "ous", "ive", "ize",
)

# A word's shape has one letter per character: v for vowels, c for consonants.
_VOWEL_GROUPS = re.compile("v+c")


def _shape(word: str) -> str:
    shape = []
    for position, letter in enumerate(word):
        vowel = letter in "aeiou" or (letter == "y" and position > 0 and shape[-1] == "c")
        shape.append("v" if vowel else "c")
    return "".join(shape)


def _measure(stem: str) -> int:
    return len(_VOWEL_GROUPS.findall(_shape(stem)))


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _double_consonant(word: str) -> bool:
    return len(word) >= 2 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short_end(word: str) -> bool:
    shape = _shape(word)
    return (shape[-3:] == "cvc" and word[-1] not in "wxy") or shape == "vc"


def _replace_first(word: str, table, condition) -> str:
    """Apply the longest suffix of the table that ends the word, if its stem meets the condition."""
    matching = [(suffix, new) for suffix, new in table if word.endswith(suffix)]
    if not matching:
        return word
    suffix, new = max(matching, key=lambda pair: len(pair[0]))
    stem = word[: len(word) - len(suffix)]
    return stem + new if condition(stem, suffix) else word


def _plural(word: str) -> str:
    if word.endswith("ies"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith("s") and not word.endswith("ss"):
        return word[:-1]
    return word


def _participle(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        if word.endswith(suffix) and _has_vowel(word[: -len(suffix)]):
            stem = word[: -len(suffix)]
            break
    else:
        return word
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if _double_consonant(stem):
        return stem if stem[-1] in "lsz" else stem[:-1]
    if _measure(stem) == 1 and _short_end(stem):
        return stem + "e"
    return stem


def _final_y(word: str) -> str:
    if word.endswith("y") and len(word) > 2 and _shape(word)[-2] == "c":
        return word[:-1] + "i"
    return word


def _double_suffix(word: str) -> str:
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        return _double_suffix(word[:-4] + "al")
    if word.endswith("logi"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    return _replace_first(word, STEP2, lambda stem, _: _measure(stem) > 0)


def _drop_suffix(word: str) -> str:
    table = tuple((suffix, "") for suffix in STEP4)
    return _replace_first(
        word, table, lambda stem, suffix: _measure(stem) > 1 and (suffix != "ion" or stem[-1:] in ("s", "t"))
    )


def _final_e_and_l(word: str) -> str:
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _short_end(stem)):
            word = stem
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def stem(token: str) -> str:
    word = token.lower()
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    word = _double_suffix(_final_y(_participle(_plural(word))))
    word = _replace_first(word, STEP3, lambda s, _: _measure(s) > 0)
    return _final_e_and_l(_drop_suffix(word))
