"""From text to ids and labels, and from predictions back to text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from markspark.functions import marks
from markspark.functions.marks import chars, fix_cedilla
from markspark.language import FIRST_CHAR_ID, ROMANIAN, UNK_ID, MarkProfile


TABLE_LIMIT = 0x3000  # code points below are looked up in a table, the others searched for


def encode_chars(text: Column, alphabet: str, profile: MarkProfile | None = None) -> Column:
    """Character ids: 2 + place in the sorted alphabet, 1 for characters outside it.

    Common characters find their id in a table by code point. With a `profile`, marked and
    legacy letters get the ids of their base letters, as if the text had been stripped first.
    """
    ids = {c: i + FIRST_CHAR_ID for i, c in enumerate(alphabet)}
    near = {c: i for c, i in ids.items() if ord(c) < TABLE_LIMIT}
    if profile is not None:
        fixed = dict(zip(profile.legacy, profile.legacy_fixed, strict=True))
        for c in profile.marked + profile.legacy:
            near[c] = ids.get(profile.base_of[fixed.get(c, c)], UNK_ID)
    table = marks.by_code_point(near, UNK_ID)
    far = "".join(c for c in alphabet if ord(c) >= TABLE_LIMIT)
    before = len(alphabet) - len(far)  # sorted: the far characters stand last

    def searched(c: Column) -> Column:
        if not far:
            return F.lit(UNK_ID).cast("smallint")
        place = F.instr(F.lit(far), c)
        return F.when(place > 0, place + F.lit(1 + before)).otherwise(UNK_ID).cast("smallint")

    return F.transform(
        marks.chars(text), lambda c: F.coalesce(F.get(table, F.ascii(c)), searched(c))
    )


def encode_example(text: Column, alphabet: str, profile: MarkProfile = ROMANIAN) -> Column:
    """`struct(input_ids, labels, candidates)` of correct text, three arrays of equal length."""
    stripped = marks.fix_and_strip(text, profile)
    return F.struct(
        encode_chars(text, alphabet, profile).alias("input_ids"),
        marks.labels_of(text, profile).alias("labels"),
        marks.candidates_of(stripped, profile).alias("candidates"),
    )


def mark_letter(ch: Column, label: Column, profile: MarkProfile = ROMANIAN) -> Column:
    """The letter with the label's mark; unchanged where letter and label do not fit."""
    return (
        F.when(
            (label == 1) & ch.isin(*profile.breve_comma_base),
            F.translate(ch, profile.breve_comma_base, profile.breve_comma),
        )
        .when(
            (label == 2) & ch.isin(*profile.circumflex_base),
            F.translate(ch, profile.circumflex_base, profile.circumflex),
        )
        .otherwise(ch)
    )


def decode_restore(
    text: Column,
    predictions: Column,
    threshold: float | Column = 0.5,
    profile: MarkProfile = ROMANIAN,
) -> Column:
    """Apply per-character `struct(label, confidence)` predictions to mark-free text.

    Only predictions of at least `threshold` count; a length mismatch is an error.
    """
    threshold = F.lit(float(threshold)) if not isinstance(threshold, Column) else threshold
    letters = chars(text)
    restored = F.array_join(
        F.zip_with(
            letters,
            predictions,
            lambda c, p: F.when(
                p.confidence >= threshold, mark_letter(c, p.label, profile)
            ).otherwise(c),
        ),
        "",
    )
    message = F.format_string(
        "a text of length %d got %d predictions", F.size(letters), F.size(predictions)
    )
    return F.when(F.size(letters) == F.size(predictions), restored).otherwise(
        F.raise_error(message).cast("string")
    )


def case_transfer(original: Column, form: Column) -> Column:
    """`form` with the original's upper case, letter by letter.

    Where a letter's upper case is longer than one character the original letter stays, so
    the length never changes.
    """

    def recase(o: Column, f: Column) -> Column:
        up = F.upper(f)
        return (
            F.when(~o.rlike(r"^\p{IsUppercase}$"), f).when(F.length(up) == 1, up).otherwise(o)
        )

    joined = F.array_join(F.zip_with(chars(original), chars(form), recase), "")
    return F.when(F.length(original) == F.length(form), joined).otherwise(original)


def merge_keep_marked(
    original: Column, restored: Column, profile: MarkProfile = ROMANIAN
) -> Column:
    """Letters the writer marked stay (cedillas fixed), all others come from `restored`."""
    kept = profile.marked + profile.legacy
    merged = F.array_join(
        F.zip_with(
            chars(original),
            chars(restored),
            lambda o, r: F.when(o.isin(*kept), fix_cedilla(o, profile)).otherwise(r),
        ),
        "",
    )
    return F.when(F.length(original) == F.length(restored), merged).otherwise(restored)


def count_changed(before: Column, after: Column) -> Column:
    """Number of positions where two texts of equal length differ."""
    pairs = F.zip_with(chars(before), chars(after), lambda a, b: ~a.eqNullSafe(b))
    return F.size(F.filter(pairs, lambda d: d))
