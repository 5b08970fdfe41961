"""Letter and word quality as mergeable counts.

Everything starts from `tallies`: one long-form table of counts per group that can be summed
over documents, batches or days, and from which all ratios follow.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markspark.functions import marks, words
from markspark.language import LABEL_NAMES, ROMANIAN, MarkProfile

N_LABELS = len(LABEL_NAMES)
WORD_WRONG, WORD_RIGHT = N_LABELS * N_LABELS, N_LABELS * N_LABELS + 1


def zip_words(reference: Column, restored: Column) -> Column:
    """`array<struct<r, o>>` of the words at equal places; other numbers of words are an error."""
    wanted, got = words.split_ws(reference), words.split_ws(restored)
    pairs = F.zip_with(wanted, got, lambda r, o: F.struct(r.alias("r"), o.alias("o")))
    message = F.format_string(
        "texts of %d and %d words cannot be compared", F.size(wanted), F.size(got)
    )
    failure = F.raise_error(message).cast("array<struct<r:string,o:string>>")
    missing = reference.isNull() | restored.isNull()
    return F.when(missing | (F.size(wanted) == F.size(got)), pairs).otherwise(failure)


def _aligned(
    texts: DataFrame,
    reference: Column,
    restored: Column,
    keep: Sequence[Column | str],
    profile: MarkProfile,
) -> DataFrame:
    """Per text: `alike`, its equal words in one string, the number of `right` and `wrong`
    words, and `pairs`, the candidate letters that have to be compared one by one.

    When the texts differ in marks only, their words stand at the same places, and only letters
    of unequal words are compared. Any other two texts are compared letter by letter.
    """
    same_base = marks.strip_marks(reference, profile) == marks.strip_marks(restored, profile)
    by_word = zip_words(reference, restored)
    failure = F.raise_error(F.lit("texts of different lengths cannot be compared"))
    by_letter = F.arrays_zip(marks.chars(reference).alias("r"), marks.chars(restored).alias("o"))
    split = texts.select(
        *keep,
        F.when(F.length(reference) == F.length(restored), by_word)
        .otherwise(failure.cast("array<struct<r:string,o:string>>"))
        .alias("words"),
        F.when(~same_base, by_letter).alias("letters"),
    )
    kept = split.columns[: len(keep)]
    sorted_out = split.select(
        *kept,
        "letters",
        F.filter("words", lambda w: w.r.eqNullSafe(w.o))["r"].alias("equal"),
        F.filter("words", lambda w: ~w.r.eqNullSafe(w.o)).alias("unequal"),
    )
    letters_of_words = F.flatten(
        F.transform(
            "unequal",
            lambda w: F.arrays_zip(marks.chars(w.r).alias("r"), marks.chars(w.o).alias("o")),
        )
    )
    return sorted_out.select(
        *kept,
        F.when(F.col("letters").isNull(), F.array_join("equal", "")).otherwise("").alias("alike"),
        F.size("equal").alias("right"),
        F.size("unequal").alias("wrong"),
        F.filter(
            F.coalesce("letters", letters_of_words),
            lambda p: p.r.isin(*profile.candidates, *profile.marked),
        ).alias("pairs"),
    )


def _item(code: Column | int, n: Column | int) -> Column:
    code = F.lit(code) if isinstance(code, int) else code
    n = F.lit(n) if isinstance(n, int) else n
    return F.struct(code.cast("int").alias("code"), n.cast("long").alias("n"))


def _items(profile: MarkProfile) -> Column:
    """`array<struct<code, n>>` from the columns of `_aligned`."""

    def compared(pair: Column) -> Column:
        true = marks.label_of(pair.r, profile)
        pred = marks.label_of(marks.fix_cedilla(pair.o, profile), profile)
        return _item(true * F.lit(N_LABELS) + pred, 1)

    # Letters of equal words are counted in bulk, label by label.
    alike = F.col("alike")
    bulk = [
        _item(i * (N_LABELS + 1), marks.count_letters(alike, letters))
        for i, letters in enumerate((profile.candidates, profile.breve_comma, profile.circumflex))
    ]
    by_word = [_item(WORD_RIGHT, F.col("right")), _item(WORD_WRONG, F.col("wrong"))]
    return F.concat(F.array(*bulk, *by_word), F.transform("pairs", compared))


def tallies(
    texts: DataFrame,
    reference: str = "text",
    restored: str = "restored",
    by: Sequence[str] = (),
    profile: MarkProfile = ROMANIAN,
    flags: Mapping[int, Column] | None = None,
) -> DataFrame:
    """`(by..., code, n)`: at most 11 rows per group leave each task.

    `flags` counts texts for which a condition holds under further codes.
    """
    flagged = [_item(code, condition.cast("long")) for code, condition in (flags or {}).items()]
    keep = [*by, F.array(*flagged).alias("flags")] if flagged else [*by]
    aligned = _aligned(texts, F.col(reference), F.col(restored), keep, profile)
    items = F.concat(_items(profile), "flags") if flagged else _items(profile)
    exploded = aligned.select(*by, F.inline(items))
    return exploded.groupBy(*by, "code").agg(F.sum("n").alias("n"))


def pair_tallies(
    rows: DataFrame, true: str, pred: str, by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """`tallies` from rows that hold one true and one predicted label each. `weight` names a column
    by which a row counts more than once."""
    code = (F.col(true) * N_LABELS + F.col(pred)).cast("int")
    unit = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    return rows.groupBy(*by, code.alias("code")).agg(F.sum(unit).alias("n"))


def _cell(true: int, pred: int) -> Column:
    return F.sum(F.when(F.col("code") == true * N_LABELS + pred, F.col("n")).otherwise(F.lit(0)))


def confusion(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The dense table `(by..., true, pred, n)`: nine rows per group, zeros included."""
    cells = [
        F.struct(F.lit(t).alias("true"), F.lit(p).alias("pred"), _cell(t, p).alias("n"))
        for t in range(N_LABELS)
        for p in range(N_LABELS)
    ]
    wide = counts.groupBy(*by).agg(F.array(*cells).alias("cells"))
    return wide.select(*by, F.inline("cells"))


def metrics_summary(
    counts: DataFrame,
    by: Sequence[str] = (),
    rollup: bool = False,
    extra: Mapping[str, int] | None = None,
) -> DataFrame:
    """One row per group: letter accuracy, precision and recall per label, word accuracy.

    Ratios without a denominator are 0; word accuracy is NULL when there were no words. With
    `rollup` the totals come as further rows from the same job. `extra` names further codes
    whose counts are shown as they are.
    """
    extra = extra or {}
    cells = {
        f"c{t}{p}": _cell(t, p).alias(f"c{t}{p}") for t in range(N_LABELS) for p in range(N_LABELS)
    }
    right = F.sum(F.when(F.col("code") == WORD_RIGHT, F.col("n")).otherwise(F.lit(0)))
    all_words = F.sum(F.when(F.col("code").isin(WORD_WRONG, WORD_RIGHT), F.col("n")).otherwise(F.lit(0)))
    grouped = counts.rollup(*by) if rollup else counts.groupBy(*by)
    shown = [
        F.sum(F.when(F.col("code") == code, F.col("n")).otherwise(F.lit(0))).alias(name)
        for name, code in extra.items()
    ]
    wide = grouped.agg(
        *cells.values(), right.alias("words_correct"), all_words.alias("words"), *shown
    )

    def ratio(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))

    def total(names: list[str]) -> Column:
        out = F.col(names[0])
        for name in names[1:]:
            out = out + F.col(name)
        return out

    labels = range(N_LABELS)
    out = [
        ratio(total([f"c{i}{i}" for i in labels]), total(list(cells))).alias("candidate_accuracy")
    ]
    for i, name in enumerate(LABEL_NAMES):
        hit = F.col(f"c{i}{i}")
        out.append(ratio(hit, total([f"c{t}{i}" for t in labels])).alias(f"precision_{name}"))
        out.append(ratio(hit, total([f"c{i}{p}" for p in labels])).alias(f"recall_{name}"))
    words_ratio = F.try_divide(F.col("words_correct").cast("double"), F.col("words").cast("double"))
    return wide.select(*by, *extra, *out, words_ratio.alias("word_accuracy"))


def summary_of(
    texts: DataFrame,
    reference: str = "text",
    restored: str = "restored",
    by: Sequence[str] = (),
    rollup: bool = False,
    profile: MarkProfile = ROMANIAN,
) -> DataFrame:
    return metrics_summary(tallies(texts, reference, restored, by, profile), by, rollup)


def still_wrong(
    texts: DataFrame, key: str = "doc_id", reference: str = "text", restored: str = "restored"
) -> DataFrame:
    """Per text that is not restored exactly: the words written and the words wanted."""
    pairs = F.filter(
        zip_words(F.col(reference), F.col(restored)), lambda p: ~p.r.eqNullSafe(p.o)
    )
    wrong = texts.filter(F.col(reference) != F.col(restored)).select(key, pairs.alias("misses"))

    def joined(side: str) -> Column:
        return F.array_join(F.transform("misses", lambda p: words.strip_punct(p[side])), " ")

    return wrong.select(key, joined("o").alias("wrote"), joined("r").alias("want"))


def corrections_summary(
    texts: DataFrame,
    reference: str = "text",
    restored: str = "restored",
    profile: MarkProfile = ROMANIAN,
) -> DataFrame:
    """One row: sentences, how many are still wrong, and the metrics over all of them.

    The two counts ride along as further codes, so the texts are read and restored once.
    """
    sentence, miss = WORD_RIGHT + 1, WORD_RIGHT + 2
    flags = {sentence: F.lit(True), miss: F.col(reference) != F.col(restored)}
    counts = tallies(texts, reference, restored, (), profile, flags)
    return metrics_summary(counts, extra={"sentences": sentence, "still_wrong": miss})


def candidate_log_loss(
    rows: DataFrame, p_true: str = "p_true", by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """Mean cross-entropy over candidate rows; 0 when there are none. `weight` names a column by which
    a row counts more than once."""
    lost = -F.log(F.col(p_true))
    mean = F.avg(lost)
    if weight:
        given = F.sum(F.when(lost.isNotNull(), F.col(weight)))
        mean = F.try_divide(F.sum(lost * F.col(weight)), given.cast("double"))
    loss = F.coalesce(mean, F.lit(0.0))
    return rows.groupBy(*by).agg(loss.alias("log_loss"))


def best_on_validation(evaluations: DataFrame, metric: str = "candidate_accuracy") -> DataFrame:
    """The model with the highest validation metric; the earliest step among equals."""
    valid = evaluations.filter(F.col("split") == "valid")
    rank = F.struct(F.col(metric), -F.col("step"))
    return valid.agg(
        F.max_by("model_id", rank).alias("model_id"), F.max(metric).alias(metric)
    )
