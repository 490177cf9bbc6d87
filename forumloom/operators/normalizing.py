"""Normalisation steps on DataFrames and their composition.

A step takes a DataFrame and the name of its text column and returns a DataFrame with the same columns.
All steps are row-local projections: a whole sequence of them runs in the scan's own tasks, on streams too.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumloom.functions import normalize as N
from forumloom.functions.normalize import Rule
from forumloom.schema import TEXT

Step = Callable[[DataFrame, str], DataFrame]


def column_step(function: Callable[[Column], Column]) -> Step:
    """Turn a Column function into a step."""
    return lambda df, text=TEXT: df.withColumn(text, function(F.col(text)))


lower_case: Step = column_step(N.lower_case)
remove_accents: Step = column_step(N.remove_accents)
passthrough: Step = column_step(N.passthrough)


def check_rules(rules: Sequence[tuple]) -> list[Rule]:
    """Reject rules that are not pairs of strings."""
    checked = []
    for rule in rules:
        if not (isinstance(rule, tuple) and len(rule) >= 2 and all(isinstance(part, str) for part in rule[:2])):
            raise TypeError("a rewriting rule must be a (pattern, replacement) pair of strings")
        checked.append(Rule(*rule))
    return checked


def rewrite_group(*rules: tuple) -> Step:
    """Apply rules one after another, each only to rows whose text *before the group* matches it; then strip.

    Each rule is its own projection that reads the original text and the running text, so no expression
    is repeated and the whole group stays in generated code.
    """
    checked = check_rules(rules)

    def step(df: DataFrame, text: str = TEXT) -> DataFrame:
        columns = df.columns
        current = df.withColumn("_now", F.col(text))
        for position, rule in enumerate(checked):
            rewritten = N.replace_pattern(F.col("_now"), rule)
            if position:  # before the first rule the running text is the original
                matched = N.original_matches(F.col(text), rule)
                rewritten = F.when(matched, rewritten).otherwise(F.col("_now"))
            current = current.withColumn("_now", rewritten)
        return current.withColumn(text, N.strip(F.col("_now"))).select(*columns)

    return step


def character_group(*functions: Callable[[Column], Column]) -> Step:
    """Like ``rewrite_group`` for functions whose results cannot create new matches for each other."""

    def step(df: DataFrame, text: str = TEXT) -> DataFrame:
        for function in functions:
            df = df.withColumn(text, function(F.col(text)))
        return df.withColumn(text, N.strip(F.col(text)))

    return step


def in_order(*steps: Step) -> Step:
    """The composition of several steps."""

    def step(df: DataFrame, text: str = TEXT) -> DataFrame:
        for one in steps:
            df = one(df, text)
        return df

    return step


convert_entities: Step = character_group(N.convert_entities)
unify_hyphens_and_quotes: Step = character_group(N.normalize_hyphens, N.normalize_quotation_marks)
remove_markup: Step = rewrite_group(N.CODE_BLOCK, N.HYPERLINK, N.INLINE_CODE, N.QUOTED_LINE)
unify_apostrophes: Step = character_group(N.normalize_apostrophes)
blank_punctuation: Step = character_group(N.blank_punctuation)
collapse_whitespace: Step = character_group(N.collapse_whitespace)

TEXT_STEPS: tuple[Step, ...] = (
    lower_case,
    remove_accents,
    convert_entities,
    unify_hyphens_and_quotes,
    remove_markup,
    unify_apostrophes,
    blank_punctuation,
    collapse_whitespace,
)
"""The fixed order of the full normalisation, up to but without stop words and lemmas."""

normalize_text: Step = in_order(*TEXT_STEPS)
