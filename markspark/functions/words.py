"""Tokens and white space, with Unicode classes (Java's `\\w` and `\\s` are ASCII by default)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from markspark.language import LETTER_RUN, LINE_BREAK, REPORT_PUNCTUATION, WHITESPACE, WORD_RUN


def tokenize_w(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD_RUN})"), F.lit(1))


def tokenize_letters(text: Column) -> Column:
    """Runs of letters, without digits and underscores."""
    return F.regexp_extract_all(text, F.lit(f"({LETTER_RUN})"), F.lit(1))


def gaps_between_letters(text: Column) -> Column:
    """What stands before, between and after the letter runs: one more than there are runs."""
    return F.split(text, LETTER_RUN, -1)


def split_ws(text: Column) -> Column:
    """Words between Unicode white space, without empty ones."""
    return F.filter(F.split(text, f"(?U){WHITESPACE}+"), lambda w: w != "")


def strip_ws(text: Column) -> Column:
    """The text without leading and trailing Unicode white space."""
    leading = F.regexp_replace(text, f"(?U)^{WHITESPACE}+", "")
    return F.regexp_replace(leading, f"(?U)(?<!{WHITESPACE}){WHITESPACE}+\\z", "")


def strip_punct(word: Column, punctuation: str = REPORT_PUNCTUATION) -> Column:
    """The word without the punctuation around it."""
    return F.btrim(word, F.lit(punctuation))


def split_lines(text: Column) -> Column:
    """Lines of a whole text, broken wherever Unicode breaks lines."""
    return F.split(text, LINE_BREAK, -1)
