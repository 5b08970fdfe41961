"""Corpus to dataset: usable documents, alphabet, training windows, corrections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markspark.operators import alphabet as alphabets
from markspark.operators import context, corpus
from markspark.operators.windows import windows_train
from markspark.language import ROMANIAN, MarkProfile
from markspark.settings import Settings
from markspark.sources import sinks
from markspark.sources.documents import chain, parquet_documents
from markspark.sources.lines import line_documents
from markspark.storage import Build, materialize_stamped


def corpus_source(
    spark: SparkSession,
    settings: Settings,
    articles: Sequence[str] = (),
    lines: Sequence[str] = (),
    web: Sequence[str] = (),
) -> DataFrame:
    """The corpus that the settings describe: articles, then one in `lines_every` documents of
    the line dumps, then one in `web_every` web pages. Kinds without paths are left out."""
    c = settings.corpus
    return chain(
        parquet_documents(spark, list(articles)) if articles else None,
        line_documents(spark, list(lines), every=c.lines_every) if lines else None,
        parquet_documents(spark, list(web), every=c.web_every) if web else None,
    )


def fit_context(documents: DataFrame, settings: Settings) -> DataFrame:
    """The context model with the settings' context sizes and support."""
    m = settings.model
    rows = context.context_rows(documents.select("doc_id", "text"), m.context_sizes[0])
    return context.train(rows, m.context_sizes, m.min_support)


def build_dataset(
    spark: SparkSession,
    documents: DataFrame,
    directory: str,
    settings: Settings,
    profile: MarkProfile = ROMANIAN,
    source: str | None = None,
) -> Build:
    """Usable documents, the alphabet of both splits, and windows partitioned by split.

    `source` names the corpus and its state (paths and versions, say); a build is skipped only
    if that and the settings are the same. Without it, one pass over the corpus takes a checksum.
    The corpus is cleaned and filtered once: the usable documents become a table of the
    build, from which everything else is read.
    """
    w = settings.windows

    def build(location: str) -> None:
        usable = corpus.usable(documents, settings.corpus, profile)
        usable.select("doc_id", "text", "source_rank", "ord").write.parquet(
            f"{location}/documents"
        )
        usable = spark.read.parquet(f"{location}/documents")
        table = alphabets.build_alphabet(
            alphabets.char_counts(usable, profile), w.vocab_size
        )
        chars = alphabets.alphabet_string(table)
        sinks.write_alphabet(spark, chars, location)
        split = corpus.with_split(usable, settings.corpus.valid_every)
        windows = windows_train(split, chars, w.window, w.overlap, profile)
        sinks.write_windows(windows, location, w.window)

    return materialize_stamped(
        spark,
        directory,
        settings.stamp(corpus_checksum(documents) if source is None else source)
        + repr(profile),
        build,
        lambda location: sinks.is_complete(spark, location, w.window),
    )


def corpus_checksum(documents: DataFrame) -> str:
    """The same for the same rows, however they are partitioned."""
    row = F.xxhash64("doc_id", "text", "source_rank", "ord")
    halves = [F.sum(F.pmod(row, F.lit(1 << 31))), F.bit_xor(row), F.count("*")]
    return ":".join(map(str, documents.agg(*halves).first()))


def build_corrections(
    spark: SparkSession,
    corrections: DataFrame,
    location: str,
    settings: Settings,
    profile: MarkProfile = ROMANIAN,
) -> int:
    """Windows of the corrections, rebuilt every time. Returns the row count."""
    w = settings.windows
    chars = sinks.read_alphabet(spark, location)
    if chars is None:
        raise ValueError(f"{location} holds no alphabet; build the dataset first")
    documents = corrections.select("doc_id", "text", F.lit("corrections").alias("split"))
    windows = windows_train(documents, chars, w.window, w.overlap, profile)
    sinks.write_windows(windows, location, w.window, "corrections")
    return sinks.split_rows(spark, location, "corrections", "corrections")


def training_windows(spark: SparkSession, location: str, settings: Settings) -> DataFrame:
    """Training windows, with the corrections' windows repeated as often as set."""
    train = sinks.open_split(spark, location, "train")
    known = sinks.open_split(spark, location, "corrections", "corrections")
    return corpus.mix_corrections(train, known, settings.model.corrections_repeat)
