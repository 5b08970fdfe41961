"""A count model over letter contexts, with back-off: a label and a confidence per letter.

The context of a candidate letter is the `k` characters on either side of it, lower-cased and
without marks. Training counts labels per context; scoring takes the longest context with
enough support.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markspark.functions import codec, marks
from markspark.operators import lookup as lookups
from markspark.operators.faraway import SOURCE, lookup_in_place
from markspark.operators.evaluation import metrics_summary
from markspark.operators.lexicon import woven
from markspark.language import ROMANIAN, MarkProfile
from markspark.storage import materialize

SIZES = (6, 4, 2, 0)
EDGE = "\x02"  # stands before and after the text


def _lower_per_letter(text: Column) -> Column:
    """Lower case that never changes the length, depends on no neighbour, and makes no
    candidate of a letter that is none."""
    return F.lower(F.translate(text, "İΣ", "ıσ"))


def _letter_class(profile: MarkProfile) -> str:
    return f"[{profile.candidates}{profile.marked}]"


def _letters(fixed: Column, profile: MarkProfile) -> Column:
    """All candidate letters of a text in order, with their marks."""
    return F.regexp_extract_all(fixed, F.lit(f"({_letter_class(profile)})"), F.lit(1))


def _contexts(fixed: Column, size: int, profile: MarkProfile) -> Column:
    """The contexts of the same letters, in the same order.

    One regular expression steps through the text; from every character it looks ahead over a
    whole context with a candidate in the middle. The time is linear in the text's length.
    """
    lower = _lower_per_letter(marks.strip_marks(fixed, profile))
    padded = F.concat(F.lit(EDGE * (size + 1)), lower, F.lit(EDGE * size))
    middle = "".join(sorted(set(profile.candidates.lower())))
    rule = f"(?s).(?=(.{{{size}}}[{middle}].{{{size}}}))"
    return F.regexp_extract_all(padded, F.lit(rule), F.lit(1))


def context_rows(
    documents: DataFrame,
    size: int = SIZES[0],
    text: str = "text",
    profile: MarkProfile = ROMANIAN,
) -> DataFrame:
    """One row per candidate letter: the other columns, `nth` (its place among the text's
    candidates), `letter`, `label`, `ctx`."""
    others = [c for c in documents.columns if c != text]
    fixed = marks.fix_cedilla(F.col(text), profile)
    zipped = F.arrays_zip(
        _letters(fixed, profile).alias("marked"), _contexts(fixed, size, profile).alias("ctx")
    )
    exploded = documents.select(*others, F.posexplode(zipped).alias("nth", "l"))
    return exploded.select(
        *others,
        "nth",
        marks.strip_marks(F.col("l.marked"), profile).alias("letter"),
        marks.label_of(F.col("l.marked"), profile).alias("label"),
        F.col("l.ctx").alias("ctx"),
    )


def counted_rows(rows: DataFrame, by: Sequence[str] = (), name: str = "n") -> DataFrame:
    """`by..., letter, label, ctx, name`: equal letters of `context_rows` counted, in each task before
    the shuffle, and written once. What is worked out for a letter then is worked out once for all
    its equals, and the texts are taken apart once, however often the rows are read."""
    counts = rows.groupBy(*by, "letter", "label", "ctx").agg(F.count("*").alias(name))
    return materialize(counts, "counted-letters")


def _shorter(ctx: Column, size: int, k: int) -> Column:
    return F.substring(ctx, size - k + 1, 2 * k + 1)


def _all_shorter(contexts: Column, size: int, k: int) -> Column:
    return F.transform(contexts, lambda c: _shorter(c, size, k))


def train(
    rows: DataFrame, sizes: Sequence[int] = SIZES, min_support: int = 2, weight: str | None = None
) -> DataFrame:
    """`(k, ctx, n0, n1, n2)`: label counts of every context with enough support.

    Only the longest contexts are counted from the letters; the shorter ones are summed up
    from those counts, so the letters are shuffled once, after a partial count in each task.
    `weight` names a column by which a row counts more than once.
    """
    size = sizes[0]
    unit = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    sums = [
        F.sum(F.when(F.col("label") == i, unit).otherwise(F.lit(0))).alias(f"n{i}")
        for i in range(3)
    ]
    longest = rows.groupBy("ctx").agg(*sums)
    levels = F.array(
        *[
            F.struct(F.lit(k).alias("k"), _shorter(F.col("ctx"), size, k).alias("ctx"))
            for k in sizes
        ]
    )
    counts = (
        longest.select(F.explode(levels).alias("level"), "n0", "n1", "n2")
        .groupBy(F.col("level.k").alias("k"), F.col("level.ctx").alias("ctx"))
        .agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(3)])
    )
    return counts.filter(F.col("n0") + F.col("n1") + F.col("n2") >= min_support)


def score(
    rows: DataFrame,
    model: DataFrame,
    sizes: Sequence[int] = SIZES,
    max_rows: int = lookups.BROADCAST_ROWS,
    max_bytes: int = lookups.BROADCAST_BYTES,
    fits: bool | None = None,
) -> DataFrame:
    """Adds `k`, `pred`, `confidence` and the label counts `n0..n2` of the context used.

    A letter whose contexts are all unknown gets label 0 with confidence 0. Ties between
    labels go to the lowest one.
    """
    size = sizes[0]
    table = model.select("k", "ctx", F.struct("k", "n0", "n1", "n2").alias("hit"))
    fits = lookups.fits_broadcast(table, max_rows, max_bytes) if fits is None else fits
    found = _found_in_broadcast if fits else _found_by_shuffle
    return _with_prediction(found(rows, table, size, sizes)).select(
        *rows.columns, "k", "pred", "confidence", "n0", "n1", "n2"
    )


def _found_in_broadcast(
    rows: DataFrame, table: DataFrame, size: int, sizes: Sequence[int]
) -> DataFrame:
    for k in sizes:
        level = table.filter(F.col("k") == k).select(
            F.col("ctx").alias("_ctx"), F.col("hit").alias(f"_hit{k}")
        )
        rows = rows.withColumn("_ctx", _shorter(F.col("ctx"), size, k))
        rows = lookups.lookup(rows, level, ["_ctx"], fits=True).drop("_ctx")  # a part of what fits
    hits = [f"_hit{k}" for k in sizes]
    return rows.withColumn("_hit", F.coalesce(*hits)).drop(*hits)


def _found_by_shuffle(
    rows: DataFrame, table: DataFrame, size: int, sizes: Sequence[int]
) -> DataFrame:
    """The model is joined to the distinct contexts, all lengths at once, and what it says about
    each of them to the letters. Both joins take hot contexts apart."""
    counts = lookups.key_counts(rows, ["ctx"])
    levels = F.array(
        *[
            F.struct(F.lit(k).alias("k"), _shorter(F.col("ctx"), size, k).alias("_ctx"))
            for k in sizes
        ]
    )
    asked = counts.select("ctx", F.inline(levels))
    answers = lookups.lookup(
        asked, table.withColumnRenamed("ctx", "_ctx"), ["k", "_ctx"], fits=False
    )
    # numbers per length instead of the greatest struct, which would make Spark sort all answers
    known = [
        F.max(F.when(F.col("k") == k, F.col(f"hit.n{i}"))).alias(f"n{i}_{k}") for k in sizes for i in range(3)
    ]
    best = answers.filter(F.col("hit").isNotNull()).groupBy("ctx").agg(*known)
    kind = table.schema["k"].dataType
    of_length = [
        F.when(
            F.col(f"n0_{k}").isNotNull(),
            F.struct(F.lit(k).cast(kind).alias("k"), *[F.col(f"n{i}_{k}").alias(f"n{i}") for i in range(3)]),
        )
        for k in sorted(sizes, reverse=True)
    ]
    best = best.select("ctx", F.coalesce(*of_length).alias("_hit"))
    return lookups.lookup(rows, materialize(best, "contexts"), ["ctx"], counts=counts)


def _with_prediction(df: DataFrame) -> DataFrame:
    n0, n1, n2 = (F.coalesce(F.col(f"_hit.n{i}"), F.lit(0)) for i in range(3))
    pred = F.when((n0 >= n1) & (n0 >= n2), 0).when(n1 >= n2, 1).otherwise(2)
    share = F.try_divide(F.greatest(n0, n1, n2).cast("double"), (n0 + n1 + n2).cast("double"))
    return df.select(
        "*",
        F.col("_hit.k").alias("k"),
        pred.cast("tinyint").alias("pred"),
        F.coalesce(share, F.lit(0.0)).alias("confidence"),
        n0.alias("n0"),
        n1.alias("n1"),
        n2.alias("n2"),
    ).drop("_hit")


def label_probability(label: Column) -> Column:
    """Probability the model gives `label`, smoothed by one count per label."""
    n = [F.col(f"n{i}") for i in range(3)]
    own = F.when(label == 0, n[0]).when(label == 1, n[1]).otherwise(n[2])
    return (own + 1).cast("double") / (n[0] + n[1] + n[2] + 3).cast("double")


def restore_context(
    documents: DataFrame,
    model: DataFrame,
    threshold: float = 0.5,
    sizes: Sequence[int] = SIZES,
    key: str = "doc_id",
    text: str = "text",
    output: str = "restored",
    profile: MarkProfile = ROMANIAN,
    max_rows: int = lookups.BROADCAST_ROWS,
    max_bytes: int = lookups.BROADCAST_BYTES,
    known: lookups.InMemory | None = None,
) -> DataFrame:
    """Adds `output`: the stripped text with every sufficiently confident label applied.

    Every text is restored where it lies. A model that can be broadcast goes there; of a larger one,
    only what it may know about the text's contexts (`faraway`). Either way there is one row out for
    every row in; `key` is not needed for that and may repeat. A missing text stays missing. `known`
    is the model as `loaded` gave it.
    """
    size = sizes[0]
    columns = documents.columns
    fixed = marks.fix_cedilla(F.col(text), profile)
    contexts = _contexts(fixed, size, profile)
    table = model.select("k", "ctx", "n0", "n1", "n2")
    # a context's length tells its level
    keys = [_all_shorter(F.col(SOURCE), size, k) for k in sizes]
    levels = table.filter(F.col("k").isin(*sizes))
    levels = levels.select(F.col("ctx").alias("key"), "n0", "n1", "n2")
    known = known or loaded(model, sizes, max_rows, max_bytes)
    if known is not None:
        found = lookups.lookup_in_rows(documents.withColumn(SOURCE, contexts), keys, known, "_hits")
    else:
        found = lookup_in_place(documents, keys, levels, "_hits", F.octet_length(text), source=contexts)
    letters = F.transform(_letters(fixed, profile), lambda c: marks.strip_marks(c, profile))
    decoded = F.zip_with(letters, F.col("_hits"), lambda c, h: _decoded(c, h, threshold, profile))
    restored = woven(F.split(fixed, _letter_class(profile), -1), decoded)
    return found.select(*columns, restored.alias(output))


def loaded(
    model: DataFrame,
    sizes: Sequence[int] = SIZES,
    max_rows: int = lookups.BROADCAST_ROWS,
    max_bytes: int = lookups.BROADCAST_BYTES,
) -> lookups.InMemory | None:
    """The model on every executor, or None if it is too large for that. Streams measure and send it
    once, not with every batch."""
    if max_rows <= 0:
        return None
    table = model.select("k", "ctx", "n0", "n1", "n2")
    if not lookups.fits_broadcast(table, max_rows, max_bytes):
        return None
    levels = table.filter(F.col("k").isin(*sizes))
    return lookups.in_memory(levels.select(F.col("ctx").alias("key"), "n0", "n1", "n2"))


def _decoded(letter: Column, hit: Column, threshold: float, profile: MarkProfile) -> Column:
    """The letter with the most frequent label of its context, if that is confident enough."""
    n0, n1, n2 = (F.coalesce(hit[f"n{i}"], F.lit(0)) for i in range(3))
    label = F.when((n0 >= n1) & (n0 >= n2), 0).when(n1 >= n2, 1).otherwise(2)
    share = F.try_divide(F.greatest(n0, n1, n2).cast("double"), (n0 + n1 + n2).cast("double"))
    sure = F.coalesce(share, F.lit(0.0)) >= threshold
    return F.when(sure, codec.mark_letter(letter, label, profile)).otherwise(letter)


def threshold_sweep(
    scored: DataFrame,
    steps: int = 10,
    by: Sequence[str] = (),
    profile: MarkProfile = ROMANIAN,
    weight: str | None = None,
) -> DataFrame:
    """Metrics for every threshold 0, 1/steps, ... 1 from rows with `letter`, `label`, `pred`
    and `confidence`.

    Letters are first counted by how many thresholds they pass; only those few counts are
    multiplied by the thresholds. `weight` names a column by which a row counts more than once.
    """
    unit = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    thresholds = F.array(*[F.lit(i / steps) for i in range(steps + 1)])
    passed = F.size(F.filter(thresholds, lambda t: t <= F.col("confidence")))
    fits = codec.mark_letter(F.col("letter"), F.col("pred"), profile) != F.col("letter")
    pred = F.when(fits, F.col("pred")).otherwise(F.lit(0).cast("tinyint"))
    counts = scored.groupBy(
        *by, "label", pred.alias("pred"), passed.alias("passed")
    ).agg(F.sum(unit).alias("n"))
    per_threshold = counts.select(
        *by, "label", "pred", "passed", "n", F.posexplode(thresholds).alias("i", "threshold")
    )
    effective = F.when(F.col("i") < F.col("passed"), F.col("pred")).otherwise(F.lit(0))
    codes = per_threshold.withColumn("code", F.col("label") * 3 + effective)
    return metrics_summary(codes, [*by, "threshold"]).drop("word_accuracy")
