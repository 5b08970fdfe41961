"""Corpus filtering: clean, keep, limit, sample, split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markspark.functions import marks, quality
from markspark.operators.ordering import first_rows
from markspark.language import ROMANIAN, MarkProfile
from markspark.settings import CorpusSettings
from markspark.storage import materialize


def filtered(
    documents: DataFrame,
    min_chars: int = 200,
    min_ratio: float = 0.05,
    limit: int = 0,
    profile: MarkProfile = ROMANIAN,
) -> DataFrame:
    """Cleaned documents that pass the quality rules; the first `limit` of them when > 0.

    With a limit, the documents are cleaned and filtered in one pass that writes those that pass; the
    n-th key is found among the written keys.
    """
    cleaned = documents.withColumn("text", marks.clean_text(F.col("text"), profile))
    kept = cleaned.filter(quality.keep_document(F.col("text"), min_chars, min_ratio, profile))
    return first_rows(materialize(kept, "kept"), limit) if limit > 0 else kept


def usable(
    documents: DataFrame, settings: CorpusSettings, profile: MarkProfile = ROMANIAN
) -> DataFrame:
    """`filtered` with the corpus settings."""
    return filtered(
        documents,
        settings.min_doc_chars,
        settings.min_mark_ratio,
        settings.max_documents,
        profile,
    )


def hash_sample(documents: DataFrame, every: int, id_col: str = "doc_id") -> DataFrame:
    """One document in `every`, chosen by the CRC32 of its id."""
    return documents.filter(quality.in_sample(F.col(id_col), every))


def with_split(documents: DataFrame, valid_every: int, id_col: str = "doc_id") -> DataFrame:
    """Adds `split`: "valid" for one document in `valid_every`, else "train"."""
    return documents.withColumn("split", quality.split_name(F.col(id_col), valid_every))


def training(documents: DataFrame, valid_every: int, id_col: str = "doc_id") -> DataFrame:
    return documents.filter(~quality.is_validation(F.col(id_col), valid_every))


def validation(documents: DataFrame, valid_every: int, id_col: str = "doc_id") -> DataFrame:
    return documents.filter(quality.is_validation(F.col(id_col), valid_every))


def repeat_rows(rows: DataFrame, times: int) -> DataFrame:
    """Every row `times` times, with its copy number in `copy`; nothing for 0."""
    if times <= 0:
        return rows.withColumn("copy", F.lit(0)).limit(0)
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def mix_corrections(train: DataFrame, corrections: DataFrame, repeat: int) -> DataFrame:
    """Training rows plus every correction `repeat` times."""
    return train.unionByName(repeat_rows(corrections, repeat).drop("copy"))
