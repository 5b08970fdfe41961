"""Text-quality predicates, without exploding any text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from markspark.functions.marks import count_letters
from markspark.functions.words import tokenize_w
from markspark.language import ROMANIAN, MarkProfile


def _with_counts(
    text: Column, profile: MarkProfile, use: Callable[[Callable[[str], Column]], Column]
) -> Column:
    """`use(count)`, where `count(letters)` says how many of these letters the text holds.

    A filter evaluates an expression as often as it is written. Here each letter is counted
    once per text, in the only element of an array that `use` is then applied to.
    """
    letters = dict.fromkeys(profile.marked + profile.legacy + profile.candidates)
    letters |= dict.fromkeys(
        c for plain, marked, _ in profile.min_marked for p in (plain, marked) for c in p + p.upper()
    )
    names = {c: f"u{ord(c):x}" for c in letters}
    counts = F.struct(*[count_letters(text, c).alias(n) for c, n in names.items()])

    def apply(found: Column) -> Column:
        def count(wanted: str) -> Column:
            total = F.lit(0)
            for c in wanted:
                total = total + found[names[c]]
            return total.cast("double")

        return use(count)

    return F.transform(F.array(counts), apply)[0]


def _ratio(count: Callable[[str], Column], profile: MarkProfile) -> Column:
    with_marks = profile.marked + profile.legacy
    share = F.try_divide(count(with_marks), count(with_marks + profile.candidates))
    return F.coalesce(share, F.lit(0.0))


def _every_letter(count: Callable[[str], Column], profile: MarkProfile) -> Column:
    passes = F.lit(True)
    for plain, marked, least in profile.min_marked:
        with_mark = marked + marked.upper()
        both = with_mark + plain + plain.upper()
        passes = passes & (count(with_mark) >= F.lit(float(least)) * count(both))
    return passes


def mark_ratio(text: Column, profile: MarkProfile = ROMANIAN) -> Column:
    """Share of candidate letters that carry a mark; 0 when there are none."""
    return _with_counts(text, profile, lambda count: _ratio(count, profile))


def marks_every_letter(text: Column, profile: MarkProfile = ROMANIAN) -> Column:
    """Whether each marked letter, in either case, reaches its least share; an absent letter
    passes."""
    return _with_counts(text, profile, lambda count: _every_letter(count, profile))


def drops_marks(text: Column, profile: MarkProfile = ROMANIAN) -> Column:
    """Whether too many words that always carry marks are written without them."""
    bare_words, marked_words = profile.bare_words, profile.always_marked
    listed = F.filter(tokenize_w(text), lambda w: w.isin(*{*bare_words, *marked_words}))
    # A word that stands in both lists counts once on each side: 1 bare, 2 in the sum.
    tally = F.aggregate(
        listed,
        F.struct(F.lit(0.0).alias("bare"), F.lit(0.0).alias("both")),
        lambda acc, w: F.struct(
            (acc.bare + w.isin(*bare_words).cast("double")).alias("bare"),
            (
                acc.both + w.isin(*bare_words).cast("double") + w.isin(*marked_words).cast("double")
            ).alias("both"),
        ),
        lambda acc: acc.bare > F.lit(float(profile.max_bare_share)) * acc.both,
    )
    return tally


def keep_document(
    text: Column,
    min_chars: int = 200,
    min_ratio: float = 0.05,
    profile: MarkProfile = ROMANIAN,
) -> Column:
    """All quality rules on cleaned text, cheapest first so that most texts stop early."""
    well_marked = _with_counts(
        text,
        profile,
        lambda count: (_ratio(count, profile) >= F.lit(float(min_ratio)))
        & _every_letter(count, profile),
    )
    long_enough = F.length(text) >= min_chars
    if min_ratio > 0:  # without any mark the ratio is 0; that is seen without counting letters
        long_enough = long_enough & _has_marks(text, profile)
    return long_enough & well_marked & ~drops_marks(text, profile)


def _has_marks(text: Column, profile: MarkProfile) -> Column:
    found = F.lit(False)
    for letter in profile.marked + profile.legacy:
        found = found | text.contains(letter)
    return found


def hash_bucket(doc_id: Column, every: int) -> Column:
    """CRC32 of the id's UTF-8 bytes modulo `every`: the same on every run."""
    return F.crc32(doc_id.cast("string")) % F.lit(every)


def in_sample(doc_id: Column, every: int) -> Column:
    """Keeps one document in `every`; 1 keeps all."""
    return F.lit(True) if every == 1 else hash_bucket(doc_id, every) == 0


def is_validation(doc_id: Column, valid_every: int) -> Column:
    return hash_bucket(doc_id, valid_every) == 0


def split_name(doc_id: Column, valid_every: int) -> Column:
    return F.when(is_validation(doc_id, valid_every), F.lit("valid")).otherwise(F.lit("train"))
