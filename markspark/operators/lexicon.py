"""The most-frequent-form model: count forms, keep the best per key, restore by dictionary."""

from __future__ import annotations

import sys
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markspark.functions import codec, marks, words
from markspark.operators import lookup as lookups
from markspark.operators.faraway import lookup_in_place
from markspark.operators.ordering import arrival
from markspark.language import ROMANIAN, MarkProfile
from markspark.storage import materialize


def form_counts(documents: DataFrame, profile: MarkProfile = ROMANIAN) -> DataFrame:
    """`(key, form, n, first_seen)`: how often each lower-cased word form occurs.

    The key is the form without marks, hence a function of the form: grouping by the form
    alone is enough, and counts are reduced inside each task before the shuffle.
    """
    text = marks.fix_cedilla(F.col("text"), profile)
    tokens = documents.select(arrival().alias("arrival"), words.tokenize_letters(text).alias("all"))
    tokens = tokens.select("arrival", F.posexplode("all").alias("pos", "word"))
    counts = (
        tokens.withColumn("form", F.lower("word"))
        .groupBy("form")
        .agg(
            F.count("*").alias("n"),
            F.min((F.col("arrival") + F.col("pos")).cast("decimal(38,0)")).alias("first_seen"),
        )
    )
    key = marks.strip_marks(F.col("form"), profile)
    return counts.select(key.alias("key"), "form", "n", "first_seen")


def fit_dictionary(counts: DataFrame) -> DataFrame:
    """`(key, form)`: the most frequent form of each key; the first seen one among equals."""
    rank = F.struct(F.col("n"), -F.col("first_seen"))
    return counts.groupBy("key").agg(F.max_by("form", rank).alias("form"))


@cache
def _letters_recased_by_lookup() -> str:
    """Lower-case letters whose upper-case partner is not unique: the look-up rewrites a Kelvin
    sign to a plain K, for instance, even if the form is the key itself."""
    found = set()
    for c in map(chr, range(sys.maxunicode + 1)):
        low = c.lower()
        back = low.upper() if c.isupper() else low
        if len(low) == 1 and len(back) == 1 and back != c:
            found.add(low)
    return "".join(sorted(found))


def prune_dictionary(dictionary: DataFrame) -> DataFrame:
    """Only the entries that can change a word. Looking up the others gives the word back."""
    recased = F.col("key").rlike(f"[{_letters_recased_by_lookup()}]")
    return dictionary.filter((F.col("form") != F.col("key")) | recased)


def apply_form(stripped: Column, form: Column) -> Column:
    """The word with its dictionary form in the word's case; no form or another length: as is."""
    same_length = F.length(form) == F.length(stripped)
    lower_case = stripped == F.lower(stripped)
    return (
        F.when(form.isNull() | ~same_length, stripped)
        .when(lower_case, form)
        .otherwise(codec.case_transfer(stripped, form))
    )


def restore_frequent(
    documents: DataFrame,
    dictionary: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    output: str = "restored",
    profile: MarkProfile = ROMANIAN,
    max_rows: int = lookups.BROADCAST_ROWS,
    max_bytes: int = lookups.BROADCAST_BYTES,
    known: lookups.InMemory | None = None,
) -> DataFrame:
    """Adds `output`: the text stripped, every word then in its most frequent form.

    Every text is restored where it lies. A dictionary that can be broadcast goes there; of a larger
    one, only the forms of words that it may know (`faraway`).
    Either way there is one row out for every row in; `key` is not needed for that and may
    repeat. A missing text stays missing. `known` is the dictionary as `loaded` gave it.
    """
    columns = documents.columns
    forms = dictionary.select("key", "form")
    stripped = F.transform(
        words.tokenize_letters(F.col(text)), lambda w: marks.fix_and_strip(w, profile)
    )
    keys = F.transform(stripped, lambda w: F.lower(w))
    known = known or loaded(forms, max_rows, max_bytes)
    if known is not None:
        found = lookups.lookup_in_rows(documents, [keys], known, "_forms")
    else:
        found = lookup_in_place(documents, [keys], forms, "_forms", F.octet_length(text))
    placed = F.zip_with(
        stripped, F.col("_forms"), lambda w, f: F.coalesce(apply_form(w, f["form"]), w)
    )
    restored = woven(words.gaps_between_letters(F.col(text)), placed)
    return found.select(*columns, restored.alias(output))


def loaded(
    dictionary: DataFrame,
    max_rows: int = lookups.BROADCAST_ROWS,
    max_bytes: int = lookups.BROADCAST_BYTES,
) -> lookups.InMemory | None:
    """The dictionary on every executor, or None if it is too large for that. Streams measure
    and send it once, not with every batch."""
    if max_rows <= 0:
        return None
    forms = dictionary.select("key", "form")
    fits = lookups.fits_broadcast(forms, max_rows, max_bytes)
    return lookups.in_memory(forms) if fits else None


def woven(gaps: Column, parts: Column) -> Column:
    """A text from what stands between its parts (one more than there are) and the parts."""
    ends = F.concat(parts, F.array(F.lit("")))
    return F.array_join(F.zip_with(gaps, ends, lambda g, p: F.concat(g, p)), "")


def fit(
    documents: DataFrame, profile: MarkProfile = ROMANIAN, prune: bool = True
) -> DataFrame:
    """Count, take the best forms, and write the dictionary once as a table."""
    dictionary = fit_dictionary(form_counts(documents, profile))
    return materialize(prune_dictionary(dictionary) if prune else dictionary, "dictionary")
