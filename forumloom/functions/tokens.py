"""Token-level Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from forumloom.functions import charsets as cs
from forumloom.functions.normalize import by_alphabet, remove_accents

# Two or more word characters: the default token pattern of the count-based extractors.
DEFAULT_TOKEN_PATTERN = rf"[{cs.WORD}]{{2,}}"


def whitespace_tokens(text: Column) -> Column:
    """Split at Unicode white space; empty text has no tokens."""
    in_ascii = F.split(text, cs.ascii_class(str.isspace) + "+")
    pieces = by_alphabet(text, in_ascii, F.split(text, rf"[{cs.SPACE}]+"))
    return F.filter(pieces, lambda t: t != "")


def join_tokens(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def without_words(tokens: Column, words: list[str]) -> Column:
    """Drop tokens found, ignoring case, in a bounded word list (a hash set in the plan)."""
    lowered = sorted({w.lower() for w in words})
    if not lowered:
        return tokens
    return F.filter(tokens, lambda t: ~F.lower(t).isin(lowered))


def regex_stem(tokens: Column, pattern: str, min_length: int = 0) -> Column:
    """Delete ``pattern`` from tokens that have at least ``min_length`` characters."""
    return F.transform(
        tokens, lambda t: F.when(F.length(t) >= min_length, F.regexp_replace(t, pattern, "")).otherwise(t)
    )


def word_tokens(
    text: Column,
    token_pattern: str = DEFAULT_TOKEN_PATTERN,
    lowercase: bool = True,
    strip_accents: bool = False,
    stop_words: list[str] | None = None,
) -> Column:
    """All matches of the token pattern in (optionally folded) text."""
    source = F.lower(text) if lowercase else text
    source = remove_accents(source) if strip_accents else source
    tokens = F.regexp_extract_all(source, F.lit(token_pattern), F.lit(0))
    if token_pattern == DEFAULT_TOKEN_PATTERN:
        in_ascii = F.regexp_extract_all(source, F.lit(cs.ascii_class(cs.is_word) + "{2,}"), F.lit(0))
        tokens = by_alphabet(source, in_ascii, tokens)
    if stop_words:
        tokens = F.filter(tokens, lambda t: ~t.isin(sorted(set(stop_words))))
    return tokens


def _runs(items: Column, n: int, separator: str) -> Column:
    """All runs of ``n`` neighbouring items, joined. Items are fetched one by one: ``slice`` and ``substring``
    would walk the whole text again for each run."""
    runs = F.transform(
        F.sequence(F.lit(0), F.size(items) - n),
        lambda i: F.concat_ws(separator, *[F.get(items, i + offset) for offset in range(n)]),
    )
    return F.when(F.size(items) >= n, runs).otherwise(F.array().cast("array<string>"))


def word_ngrams(tokens: Column, low: int, high: int) -> Column:
    """Word n-grams of every length from ``low`` to ``high``, joined by one blank; ``tokens`` is a plain column."""
    if (low, high) == (1, 1):
        return tokens
    return F.concat(*[_runs(tokens, n, " ") if n > 1 else tokens for n in range(low, high + 1)])


def _folded(text: Column, lowercase: bool, strip_accents: bool) -> Column:
    source = F.lower(text) if lowercase else text
    return remove_accents(source) if strip_accents else source


def char_ngrams(text: Column, low: int, high: int, lowercase: bool = True, strip_accents: bool = False) -> Column:
    """Character n-grams over the text with runs of two or more blanks collapsed to one."""
    source = F.regexp_replace(_folded(text, lowercase, strip_accents), rf"[{cs.SPACE}]{{2,}}", " ")
    grams = F.transform(
        F.array(F.split(source, "")), lambda chars: F.concat(*[_runs(chars, n, "") for n in range(low, high + 1)])
    )
    return F.flatten(grams)


def word_bounded_char_ngrams(
    text: Column, low: int, high: int, lowercase: bool = True, strip_accents: bool = False
) -> Column:
    """Character n-grams inside words padded with one blank on each side.

    A padded word shorter than the smallest ``n`` is emitted whole, once.
    """
    words = whitespace_tokens(_folded(text, lowercase, strip_accents))

    def grams(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        bound = F.transform(
            F.array(F.split(padded, "")),
            lambda chars: F.when(F.size(chars) < low, F.array(F.array_join(chars, ""))).otherwise(
                F.concat(*[_runs(chars, n, "") for n in range(low, high + 1)])
            ),
        )
        return F.flatten(bound)

    return F.flatten(F.transform(words, grams))


__all__ = [
    "DEFAULT_TOKEN_PATTERN",
    "char_ngrams",
    "join_tokens",
    "regex_stem",
    "whitespace_tokens",
    "without_words",
    "word_bounded_char_ngrams",
    "word_ngrams",
    "word_tokens",
]
