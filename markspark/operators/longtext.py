"""Long and grouped texts: cutting, guarding, joining for context, and differences."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markspark.functions import codec, marks
from markspark.operators.halo import with_neighbours
from markspark.operators.lookup import with_row_id
from markspark.language import MAX_CHARS, ROMANIAN, MarkProfile

RUN = 128
"""Pieces that are summed up together for the offsets of those that follow."""


def long_text_pieces(text: Column, max_chars: int = MAX_CHARS) -> Column:
    """`array<struct<no, start, piece>>`: pieces of at most `max_chars`, joined they are the text.

    A piece ends before the last line break in its second half, else before the last space
    there, else it is cut hard. One regular expression says just that, in this order.
    """
    half = -(-max_chars // 2)
    rule = (
        rf"(?s)(.{{1,{max_chars}}}\z"
        rf"|.{{{half},{max_chars}}}(?=\n)"
        rf"|.{{{half},{max_chars}}}(?= )"
        rf"|.{{{max_chars}}})"
    )
    cut = F.regexp_extract_all(text, F.lit(rule), F.lit(1))
    pieces = F.when(text == "", F.array(F.lit(""))).otherwise(cut)

    def total(lengths: Column, first: Column, n: Column) -> Column:
        return F.aggregate(F.slice(lengths, first + 1, n), F.lit(0), lambda s, x: s + x)

    def numbered(found: Column) -> Column:
        # a start is the sum of whole runs of pieces and of the pieces before it in its run
        return F.transform(
            found.pieces,
            lambda p, i: F.struct(
                i.alias("no"),
                (
                    total(found.runs, F.lit(0), F.floor(i / RUN).cast("int"))
                    + total(found.lengths, F.floor(i / RUN).cast("int") * RUN, i % RUN)
                ).alias("start"),
                p.alias("piece"),
            ),
        )

    def with_runs(found: Column) -> Column:
        places = F.sequence(F.lit(0), F.floor(F.size(found.pieces) / RUN).cast("int"))
        runs = F.transform(places, lambda r: total(found.lengths, r * RUN, F.lit(RUN)))
        return F.struct(
            found.pieces.alias("pieces"), found.lengths.alias("lengths"), runs.alias("runs")
        )

    # Bound to variables step by step, so that the text is cut once and measured once.
    measured = F.transform(
        F.array(pieces),
        lambda ps: F.struct(
            ps.alias("pieces"), F.transform(ps, lambda p: F.length(p)).alias("lengths")
        ),
    )
    whole = F.transform(F.transform(measured, with_runs), numbered)[0]
    return F.when(text.isNotNull(), whole)


def split_long_text(
    documents: DataFrame, max_chars: int = MAX_CHARS, text: str = "text"
) -> DataFrame:
    """One row per piece: the other columns, `no`, `start`, `piece`. A missing text is one row
    without a piece."""
    others = [c for c in documents.columns if c != text]
    return documents.select(*others, F.inline_outer(long_text_pieces(F.col(text), max_chars)))


def max_chars_guard(
    documents: DataFrame, max_chars: int = MAX_CHARS, text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) documents; the refused ones hold more than `max_chars` characters.
    A missing text holds none."""
    ok = F.coalesce(marks.within_limit(F.col(text), max_chars), F.lit(True))
    return documents.filter(ok), documents.filter(~ok)


def restore_where_needed(
    documents: DataFrame,
    restore: Callable[[DataFrame], DataFrame],
    text: str = "text",
    output: str = "restored",
    profile: MarkProfile = ROMANIAN,
) -> DataFrame:
    """`restore` only texts with a plain candidate letter; all others, missing ones too, pass
    through unchanged."""
    needed = F.coalesce(marks.has_candidates(F.col(text), profile), F.lit(False))
    done = restore(documents.filter(needed))
    rest = documents.filter(~needed).withColumn(output, F.col(text))
    return done.unionByName(rest.select(done.columns))


def restore_written(
    documents: DataFrame,
    restore: Callable[[DataFrame], DataFrame],
    max_chars: int = MAX_CHARS,
    text: str = "text",
    output: str = "restored",
    profile: MarkProfile = ROMANIAN,
) -> DataFrame:
    """What a writer's text goes through: adds `output` and `changed`, the number of letters that
    differ.

    Texts without a plain candidate letter are left alone. All others are cut into pieces of at
    most `max_chars`, `restore` adds `output` to each piece, the pieces are joined, and letters
    that the writer marked stay as they were. One row comes out for every row that goes in;
    missing texts stay missing, with nothing changed.
    """
    columns = documents.columns
    rows = with_row_id(documents, "_row")
    needed = F.coalesce(marks.has_candidates(F.col(text), profile), F.lit(False))
    pieces = split_long_text(rows.filter(needed).select("_row", text), max_chars, text)
    done = restore(pieces.select("_row", "no", F.col("piece").alias(text)))
    parts = F.sort_array(F.collect_list(F.struct("no", output)))[output]
    joined = done.groupBy("_row").agg(F.array_join(parts, "").alias("_joined"))
    merged = codec.merge_keep_marked(F.col(text), F.col("_joined"), profile)
    whole = rows.join(joined, "_row", "left").withColumn(output, F.coalesce(merged, F.col(text)))
    changed = F.coalesce(codec.count_changed(F.col(text), F.col(output)), F.lit(0))
    return whole.select(*columns, output, F.greatest(changed, F.lit(0)).alias("changed"))


def diff_chars(texts: DataFrame, before: str, after: str) -> DataFrame:
    """One row per position where two texts of equal length differ: the other columns,
    `pos`, `from_ch`, `to_ch`. Only differing positions are exploded."""
    others = [c for c in texts.columns if c not in (before, after)]
    found = F.arrow_udf(_differences, "array<struct<pos:int,from_ch:string,to_ch:string>>")
    found = found.asNondeterministic()  # or Spark works it out a second time, to leave out empty arrays
    return texts.select(*others, found(before, after).alias("_found")).select(*others, F.inline("_found"))


def _differences(before: pa.Array, after: pa.Array) -> pa.Array:
    """Text by text the positions that differ, compared as arrays of code points. Where one text is
    longer, its other characters differ from nothing (null)."""
    none = 0xFFFFFFFF
    places, old, new = [np.empty(0, np.int32)], [np.empty(0, np.uint32)], [np.empty(0, np.uint32)]
    counts = np.zeros(len(before), np.int32)
    for i, texts in enumerate(zip(before.to_pylist(), after.to_pylist())):
        if None in texts or texts[0] == texts[1]:
            continue
        a, b = (np.frombuffer(t.encode("utf-32-le"), "<u4") for t in texts)
        n = max(len(a), len(b))
        a, b = (np.pad(x, (0, n - len(x)), constant_values=none) for x in (a, b))
        at = np.flatnonzero(a != b)
        counts[i] = len(at)
        places.append(at.astype(np.int32))
        old.append(a[at])
        new.append(b[at])

    def characters(points: np.ndarray) -> pa.Array:
        known, which = np.unique(points, return_inverse=True)
        names = pa.array([None if c == none else chr(c) for c in known], pa.string())
        return names.take(pa.array(which))

    columns = [pa.array(np.concatenate(places)), *(characters(np.concatenate(x)) for x in (old, new))]
    ends = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(columns, ["pos", "from_ch", "to_ch"]))


def restore_grouped(
    pieces: DataFrame,
    group: str,
    order: str,
    restore: Callable[[DataFrame], DataFrame],
    reach: int,
    text: str = "text",
    output: str = "restored",
) -> DataFrame:
    """Restore every piece as if its group's pieces were one text, joined by line breaks.

    The whole group is never put together, however many pieces it has: a restorer that looks at
    most `reach` characters to either side needs only that much of its neighbours. A word
    restorer needs none at all (`reach=0`), since a line break ends every word. A context model
    reaches as far as its longest context, a window model as far as its window. `restore` gets the
    pieces' columns and `piece_no`, keeps them, adds `output` and changes no length. The texts are
    sorted once and never joined to anything (`halo`).
    """
    if reach == 0:
        keyed = pieces.withColumn("piece_no", F.struct(group, order))
        return restore(keyed).select(*pieces.columns, output)

    framed = with_neighbours(pieces, group, order, text, reach, "_left", "_right")
    joined = framed.select(
        *[c for c in pieces.columns if c != text],
        F.struct(group, order).alias("piece_no"),
        F.length("_left").alias("_skip"),
        F.col(text).alias("_own"),
        F.concat("_left", text, "_right").alias(text),
    )
    own = F.substring(F.col(output), F.col("_skip") + 1, F.length("_own"))
    restored = restore(joined).withColumn(output, own).drop(text)
    return restored.withColumnRenamed("_own", text).select(*pieces.columns, output)


def fresh_changes(texts: DataFrame, before: str, previous: str, after: str) -> DataFrame:
    """`diff_chars` plus `fresh`: whether the letter also differs from the previous output."""
    others = [c for c in texts.columns if c not in (before, previous, after)]
    triples = F.transform(
        F.arrays_zip(
            marks.chars(F.col(before)).alias("a"),
            marks.chars(F.col(previous)).alias("p"),
            marks.chars(F.col(after)).alias("b"),
        ),
        lambda t, i: F.struct(
            i.alias("pos"),
            t.a.alias("from_ch"),
            t.b.alias("to_ch"),
            (~t.p.eqNullSafe(t.b)).alias("fresh"),
        ),
    )
    changed = F.filter(triples, lambda t: ~t.from_ch.eqNullSafe(t.to_ch))
    return texts.select(*others, F.inline(changed))
