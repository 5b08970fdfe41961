"""A threshold for confidences that keeps a promised precision, from the exact curve."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markspark.functions import codec
from markspark.language import ROMANIAN, MarkProfile
from markspark.storage import materialize

Z = 1.6448536269514722
"""95 % on one side."""


def lower_bound(hits: Column, n: Column, z: float = Z) -> Column:
    """Wilson's lower bound of a share of `hits` in `n`."""
    share = hits.cast("double") / n
    spread = F.sqrt(share * (1 - share) / n + F.lit(z * z) / (4.0 * n * n)) * z
    return (share + F.lit(z * z) / (2.0 * n) - spread) / (1 + F.lit(z * z) / n)


def precision_curve(
    scored: DataFrame,
    by: Sequence[str] = (),
    profile: MarkProfile = ROMANIAN,
    weight: str | None = None,
) -> DataFrame:
    """`by..., confidence, placed, correct`: the marks that would be set, and rightly set, if each
    confidence that occurs were the threshold.

    From rows with `letter`, `label`, `pred` and `confidence`. Rows are counted by confidence first;
    the sums from the top down are taken by ranges of confidences, with one row of totals for each
    range and group, so that a group with any number of confidences is no single task's. `weight`
    names a column by which a row counts more than once.
    """
    by = list(by)
    unit = F.col(weight) if weight else F.lit(1)
    sets = codec.mark_letter(F.col("letter"), F.col("pred"), profile) != F.col("letter")
    right = F.col("pred") == F.col("label")
    counts = scored.filter(sets).groupBy(*by, "confidence").agg(
        F.sum(unit.cast("long")).alias("n"), F.sum(right.cast("long") * unit).alias("hits")
    )
    ranges = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = counts.repartitionByRange(ranges, F.desc("confidence"))
    counts = materialize(counts.withColumn("_part", F.spark_partition_id()), "confidences")
    totals = counts.groupBy(*by, "_part").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    above = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(c).alias(f"_{c}") for c in by],
        F.col("_part").alias("_of"),
        F.coalesce(F.sum("n").over(above), F.lit(0)).alias("_n"),
        F.coalesce(F.sum("hits").over(above), F.lit(0)).alias("_hits"),
    )
    same = F.col("_part") == F.col("_of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    down = Window.partitionBy(*by, "_part").orderBy(F.desc("confidence"))
    return counts.join(offsets, same).select(
        *by,
        "confidence",
        (F.col("_n") + F.sum("n").over(down)).alias("placed"),
        (F.col("_hits") + F.sum("hits").over(down)).alias("correct"),
    )


def choose_threshold(
    scored: DataFrame,
    precision: float,
    by: Sequence[str] = (),
    z: float = Z,
    profile: MarkProfile = ROMANIAN,
    weight: str | None = None,
) -> DataFrame:
    """One row per group: `threshold`, the smallest confidence with which the precision is `precision`
    or more even at the lower end of its confidence interval, `placed`, `correct`, `lower` and
    `marked`, the letters that carry a mark. Where no threshold is good enough, the first four are null.

    Rows are counted once, by all that matters here; `weight` names a column by which a row counts
    more than once.
    """
    by = list(by)
    unit = F.col(weight) if weight else F.lit(1)
    counted = scored.groupBy(*by, "letter", "label", "pred", "confidence").agg(
        F.sum(unit.cast("long")).alias("_times")
    )
    counted = materialize(counted, "scored-letters")
    curve = precision_curve(counted, by, profile, "_times")
    curve = curve.withColumn("lower", lower_bound(F.col("correct"), F.col("placed"), z))
    good = F.struct("confidence", "placed", "correct", "lower")
    best = curve.filter(F.col("lower") >= precision).groupBy(*by).agg(F.min(good).alias("best"))
    has_mark = (F.col("label") != 0).cast("long")
    marked = counted.groupBy(*by).agg(F.sum(has_mark * F.col("_times")).alias("marked"))
    best = best.select(*[F.col(c).alias(f"_{c}") for c in by], "best")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return marked.join(best, same, "left").select(
        *by,
        F.col("best.confidence").alias("threshold"),
        "best.placed",
        "best.correct",
        "best.lower",
        "marked",
    )
