"""Text normalisation as Column expressions: row-local, JVM-side, no Python worker.

Patterns are Java regular expressions. ``(?d)`` makes ``.`` and ``$`` treat only ``\\n`` as a line end.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from forumloom.functions import charsets as cs



class Rule(NamedTuple):
    """A pattern and its replacement. ``needs`` lists texts of which every match contains at least one:
    rows without any of them skip the regex after a plain byte search."""

    pattern: str
    replacement: str
    needs: tuple[str, ...] = ()


CODE_BLOCK = Rule(r"(?dm)(^|\n)(\t| {4,})+.+?$", "", ("\t", "    "))
HYPERLINK = Rule(rf"(http|www)[^{cs.SPACE}]+", "", ("http", "www"))
INLINE_CODE = Rule(r"(?d)`+.+?`+", "", ("`",))
QUOTED_LINE = Rule(r"(?d)(^|\n) {0,3}(&gt;|>).*?\n", "", (">", "&gt;"))
HYPHEN_RUN = Rule(rf"[{cs.HYPHENS}]+", "-", tuple(cs.HYPHENS))
PUNCTUATION = Rule(rf"[^{cs.WORD}{cs.SPACE}'\-/]", " ")
WHITESPACE_RUN = Rule(rf"[{cs.COLLAPSIBLE}]+", " ")

# The same two classes for ASCII rows.
ASCII_PUNCTUATION_TO_BLANK = Rule(
    cs.ascii_class(lambda c: not (cs.is_word(c) or c.isspace() or c in "'-/")), PUNCTUATION.replacement
)
ASCII_WHITESPACE_RUN = Rule(cs.ascii_class(lambda c: c in "\n\t\v\b\r\f\a ") + "+", WHITESPACE_RUN.replacement)


def is_ascii(text: Column) -> Column:
    """True when the UTF-8 form has as many bytes as characters; far cheaper than a regex."""
    return F.octet_length(text) == F.char_length(text)


def may_match(text: Column, rule: Rule) -> Column | None:
    """A cheap condition that holds for every row the rule can change; ``None`` when there is none."""
    if not rule.needs:
        return None
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(need)) for need in rule.needs])


def replace_pattern(text: Column, rule: Rule) -> Column:
    replaced = F.regexp_replace(text, rule.pattern, rule.replacement)
    gate = may_match(text, rule)
    return replaced if gate is None else F.when(gate, replaced).otherwise(text)


def map_characters(text: Column, sources: str, target: str) -> Column:
    """Replace each character of ``sources`` by the one-character ``target`` (or delete it when empty)."""
    return F.translate(text, sources, target * len(sources))


def strip(text: Column) -> Column:
    """Remove Unicode white space from both ends (``trim`` only knows the blank)."""
    return F.trim(text, F.lit(cs.space_characters()))


def lower_case(text: Column) -> Column:
    return F.lower(text)


def passthrough(text: Column) -> Column:
    return text


def remove_accents(text: Column) -> Column:
    """Decompose (NFKD) and drop whatever is not ASCII afterwards.

    ASCII rows are returned untouched. Otherwise one ``translate`` covers the characters that fold to a
    single ASCII character; the few that fold to several are looked up only in rows that contain one.
    """
    single, several = cs.ascii_foldings()
    sources = "".join(single)
    folded = F.translate(text, sources, "".join(single.values()))
    # one string literal, folded to a map once per plan
    expansions = F.str_to_map(F.lit("\n".join(f"{c}\t{kept}" for c, kept in several.items())), F.lit("\n"), F.lit("\t"))

    def expand(char: Column) -> Column:
        return F.when(char < "\u0080", char).otherwise(F.coalesce(F.try_element_at(expansions, char), F.lit("")))

    def finish(once: Column) -> Column:
        # deleting the characters tells whether there were any; a class of hundreds of characters is slow
        has_expansion = F.translate(once, "".join(several), "") != once
        expanded = F.array_join(F.transform(F.split(once, ""), expand), "")
        return F.when(is_ascii(once), once).otherwise(
            F.when(has_expansion, expanded).otherwise(F.regexp_replace(once, r"[^\x00-\x7F]+", ""))
        )

    # the one-element array binds ``folded`` once instead of repeating it in every branch
    bound = F.get(F.transform(F.array(folded), finish), F.lit(0))
    return F.when(is_ascii(text), text).otherwise(bound)


def normalize_apostrophes(text: Column) -> Column:
    """In ASCII rows only a backtick can change."""
    unchanged = is_ascii(text) & ~F.contains(text, F.lit("`"))
    return F.when(unchanged, text).otherwise(map_characters(text, cs.APOSTROPHES, "'"))


def normalize_quotation_marks(text: Column) -> Column:
    """ASCII rows are as they should be already."""
    return F.when(is_ascii(text), text).otherwise(map_characters(text, cs.QUOTATION_MARKS, '"'))


def normalize_hyphens(text: Column) -> Column:
    return replace_pattern(text, HYPHEN_RUN)


def remove_code_blocks(text: Column) -> Column:
    return replace_pattern(text, CODE_BLOCK)


def remove_hyperlinks(text: Column) -> Column:
    return replace_pattern(text, HYPERLINK)


def remove_inline_code(text: Column) -> Column:
    return replace_pattern(text, INLINE_CODE)


def remove_quoted_lines(text: Column) -> Column:
    return replace_pattern(text, QUOTED_LINE)


def by_alphabet(text: Column, in_ascii: Column, otherwise: Column) -> Column:
    """Choose between two forms of the same operation by whether the row is ASCII."""
    return F.when(is_ascii(text), in_ascii).otherwise(otherwise)


def blank_punctuation(text: Column) -> Column:
    return by_alphabet(
        text, replace_pattern(text, ASCII_PUNCTUATION_TO_BLANK), replace_pattern(text, PUNCTUATION)
    )


def collapse_whitespace(text: Column) -> Column:
    return by_alphabet(
        text, replace_pattern(text, ASCII_WHITESPACE_RUN), replace_pattern(text, WHITESPACE_RUN)
    )


def convert_entities(text: Column) -> Column:
    """Turn character references into literals, each only in rows whose *original* text had that code.

    ``text`` should be a plain column: it is consulted once per code. The search string is emptied where
    the original lacks the code, and ``replace`` with an empty search string changes nothing, so the
    chain mentions its running value once per step and stays linear in size.
    """

    def step(current: Column, pair: tuple[str, str]) -> Column:
        code, literal = pair
        search = F.when(F.contains(text, F.lit(code)), F.lit(code)).otherwise(F.lit(""))
        return F.replace(current, search, F.lit(literal))

    return F.when(F.contains(text, F.lit("&")), reduce(step, cs.entity_codes(), text)).otherwise(text)


def original_matches(text: Column, rule: Rule) -> Column:
    gate = may_match(text, rule)
    matches = text.rlike(rule.pattern)
    return matches if gate is None else gate & matches


def rewrite(text: Column, rules: list[Rule]) -> Column:
    """Apply several rules in order, each only where the *original* text matches its pattern."""

    def step(current: Column, rule: Rule) -> Column:
        matched = original_matches(text, rule)
        # the one-element array binds the running value once
        return F.get(
            F.transform(F.array(current), lambda x: F.when(matched, replace_pattern(x, rule)).otherwise(x)), F.lit(0)
        )

    if not rules:
        return text
    first, *rest = rules
    return reduce(step, rest, replace_pattern(text, first))


# Variants timed against each other -----------------------------------------------------------------

SPAN_BETWEEN_BACKTICKS = Rule(r"(?d)`.+?`", "", ("`",))
ASCII_PUNCTUATION = Rule(r"""[!"#$%&'()*+,\-./:;<=>?@\[\]^_`{|}~]""", "")


def remove_backtick_spans(text: Column) -> Column:
    return replace_pattern(text, SPAN_BETWEEN_BACKTICKS)


def remove_ascii_punctuation(text: Column) -> Column:
    """Delete ASCII punctuation; the backslash is not in the class and stays."""
    return replace_pattern(text, ASCII_PUNCTUATION)


def upper_one_by_one(text: Column, letters: str = "abcde") -> Column:
    """One ``regexp_replace`` per letter."""
    return reduce(lambda current, c: F.regexp_replace(current, c, c.upper()), letters, text)


def upper_at_once(text: Column, letters: str = "abcde") -> Column:
    """The same mapping as a single ``translate``."""
    return F.translate(text, letters, letters.upper())


# Raw comment cleaning --------------------------------------------------------------------------------


def is_deletion_marker(text: Column) -> Column:
    """True for the markers; null text counts as not deleted."""
    return F.coalesce(text.isin(*cs.DELETION_MARKERS), F.lit(False))


def drop_quote_characters(text: Column) -> Column:
    return F.translate(text, cs.CLEANED_QUOTES, "")


def has_more_than_quotes(text: Column) -> Column:
    """Whether anything is left once the quote characters are gone; stops at the first such character."""
    return text.rlike(f"[^{cs.CLEANED_QUOTES}]")
