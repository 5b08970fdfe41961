"""Fit the most-frequent-form model on the training split, judge it on the validation split."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markspark.operators import corpus, evaluation, lexicon
from markspark.operators.ordering import first_rows
from markspark.language import EVAL_DOCUMENTS, ROMANIAN, MarkProfile
from markspark.settings import Settings
from markspark.sources import sinks

Restore = Callable[[DataFrame], DataFrame]
"""Takes documents with `doc_id` and `text`, adds `restored`."""


def fit_and_restore(
    usable: DataFrame,
    valid_every: int,
    sample: int = 0,
    profile: MarkProfile = ROMANIAN,
) -> DataFrame:
    """Validation documents (the first `sample` when > 0) restored by forms of the others."""
    dictionary = lexicon.fit(corpus.training(usable, valid_every), profile)
    valid = first_rows(corpus.validation(usable, valid_every), sample)
    return lexicon.restore_frequent(valid, dictionary, profile=profile)


def baseline(
    spark: SparkSession,
    location: str,
    settings: Settings,
    profile: MarkProfile = ROMANIAN,
) -> dict:
    """Metrics of the most-frequent-form model on the first validation documents of a build.

    The summary is kept with the build, so a rebuild, which has another location, starts anew.
    """
    cached = sinks.read_summary(spark, location, "baseline")
    if cached is not None:
        return cached
    usable = spark.read.parquet(f"{location}/documents")
    restored = fit_and_restore(usable, settings.corpus.valid_every, EVAL_DOCUMENTS, profile)
    row = evaluation.summary_of(restored, profile=profile).first()
    summary = {k: v for k, v in row.asDict().items() if v is not None}
    sinks.write_summary(spark, summary, location, "baseline")
    return summary


def evaluate_restorer(
    usable: DataFrame,
    restore: Restore,
    valid_every: int,
    sample: int = EVAL_DOCUMENTS,
    profile: MarkProfile = ROMANIAN,
) -> DataFrame:
    """Metrics of any restorer on the first `sample` validation documents, as one row."""
    valid = first_rows(corpus.validation(usable, valid_every), sample)
    return evaluation.summary_of(restore(valid), profile=profile)


def corrections_report(
    corrections: DataFrame, restore: Restore, profile: MarkProfile = ROMANIAN
) -> tuple[DataFrame, DataFrame]:
    """(the sentences a restorer still gets wrong, word by word; one row of totals)."""
    restored = restore(corrections.select("doc_id", "text"))
    return (
        evaluation.still_wrong(restored),
        evaluation.corrections_summary(restored, profile=profile),
    )


def split_metrics(
    restored: DataFrame, by: str = "split", profile: MarkProfile = ROMANIAN
) -> DataFrame:
    """Letter accuracy of several splits (validation, corrections) side by side."""
    summary = evaluation.summary_of(restored, by=[by], profile=profile)
    return summary.select(by, F.col("candidate_accuracy"))


def split_report(
    usable: DataFrame,
    corrections: DataFrame,
    restore: Restore,
    valid_every: int,
    profile: MarkProfile = ROMANIAN,
) -> DataFrame:
    """Letter accuracy on the corrections beside that on the validation documents: how well a model
    holds what it was corrected in, and whether it pays for that elsewhere. Both are restored in
    one job. Without corrections there is no row for them."""
    valid = corpus.validation(usable, valid_every).select("doc_id", "text")
    known = corrections.select("doc_id", "text").withColumn("split", F.lit("corrections"))
    texts = valid.withColumn("split", F.lit("valid")).unionByName(known)
    return split_metrics(restore(texts), profile=profile)
