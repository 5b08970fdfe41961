"""Marks, labels and candidate letters. Every text function keeps the text's length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from markspark.language import LABEL_NAMES, MAX_CHARS, ROMANIAN, MarkProfile


def fix_cedilla(text: Column, profile: MarkProfile = ROMANIAN) -> Column:
    """Replace legacy cedilla letters by comma-below ones.

    Most texts hold none; searching for four letters then costs a fraction of a `translate`.
    """
    for old, new in zip(profile.legacy, profile.legacy_fixed, strict=True):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def strip_marks(text: Column, profile: MarkProfile = ROMANIAN) -> Column:
    """Remove the profile's marks, keeping length and case."""
    return F.translate(text, profile.marked, profile.marked_base)


def fix_and_strip(text: Column, profile: MarkProfile = ROMANIAN) -> Column:
    """`strip_marks(fix_cedilla(text))` in one pass over the text."""
    legacy_base = "".join(profile.base_of[c] for c in profile.legacy_fixed)
    return F.translate(text, profile.marked + profile.legacy, profile.marked_base + legacy_base)


def clean_text(text: Column, profile: MarkProfile = ROMANIAN) -> Column:
    """Composes characters (NFC) and fixes cedillas.

    Spark has no NFC function, but the ICU library it ships for collations does; calling it
    with `reflect` keeps the text inside the JVM. ICU checks first whether anything has to be
    composed, so text that is NFC already costs one quick scan.
    """
    nfc = F.reflect(
        F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False)
    )
    return fix_cedilla(F.when(text.isNotNull(), nfc), profile)


def chars(text: Column) -> Column:
    """The text's code points as an array; an empty text gives an empty array."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def count_letters(text: Column, letters: str) -> Column:
    """How many of these letters a text holds, by the bytes that go when they are deleted."""
    total = F.lit(0)
    for letter in letters:
        gone = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(letter), F.lit("")))
        width = len(letter.encode())
        total = total + (gone if width == 1 else F.floor(gone / width).cast("int"))
    return total


def by_code_point(values: dict[str, int], default: int) -> Column:
    """A constant array with a small number per code point, up to the last one with a value.

    Spark folds it to one literal; `F.get(table, F.ascii(ch))` looks a character up.
    """
    last = max((ord(c) for c in values), default=0)
    numbers = ",".join(str(values.get(chr(cp), default)) for cp in range(last + 1))
    return F.split(F.lit(numbers), ",").cast("array<smallint>")


def is_candidate(ch: Column, profile: MarkProfile = ROMANIAN) -> Column:
    """Whether a mark-free character could carry a mark."""
    return ch.isin(*profile.candidates)


def label_of(ch: Column, profile: MarkProfile = ROMANIAN) -> Column:
    """The label of one character of correct text: 0 none, 1 breve or comma, 2 circumflex."""
    return (
        F.when(ch.isin(*profile.breve_comma), F.lit(1))
        .when(ch.isin(*profile.circumflex), F.lit(2))
        .otherwise(F.lit(0))
        .cast("tinyint")
    )


def labels_of(text: Column, profile: MarkProfile = ROMANIAN) -> Column:
    """Per-character labels; cedilla letters count as comma-below ones."""
    values = {**dict.fromkeys(profile.breve_comma, 1), **dict.fromkeys(profile.circumflex, 2)}
    old = zip(profile.legacy, profile.legacy_fixed, strict=True)
    table = by_code_point(values | {c: values[fixed] for c, fixed in old}, 0)
    return F.transform(
        chars(text), lambda c: F.coalesce(F.get(table, F.ascii(c)), F.lit(0)).cast("tinyint")
    )


def candidates_of(stripped: Column, profile: MarkProfile = ROMANIAN) -> Column:
    """Per-character candidate mask of mark-free text."""
    return F.transform(chars(stripped), lambda c: is_candidate(c, profile))


def label_name(label: Column) -> Column:
    name = F.lit(None).cast("string")
    for i, value in reversed(list(enumerate(LABEL_NAMES))):
        name = F.when(label == i, F.lit(value)).otherwise(name)
    return name


def within_limit(text: Column, max_chars: int = MAX_CHARS) -> Column:
    """Whether one request may carry this text; longer ones go to `split_long_text`."""
    return F.length(text) <= max_chars


def has_candidates(text: Column, profile: MarkProfile = ROMANIAN) -> Column:
    """Whether the text has a letter that a restorer could change."""
    return text.rlike(f"[{profile.candidates}]")
