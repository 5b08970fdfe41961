"""Line dumps: exact line numbers over splits and files, and lines grouped into documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markspark.functions import quality, words
from markspark.language import LINES_PER_DOCUMENT
from markspark.operators.lookup import lookup
from markspark.sources.documents import SourceUnavailable, file_key, file_ranks


def text_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Lines of text files as `value`; blank lines are kept, bad bytes become U+FFFD."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    try:
        return spark.read.text(paths)
    except AnalysisException as err:
        raise SourceUnavailable(f"read {', '.join(paths)}: {err.getCondition()}") from err


def _split_key() -> Column:
    return F.xxhash64("_metadata.file_path", "_metadata.file_block_start")


def _numbers(firsts: Broadcast) -> Callable[[Column], Column]:
    """Line numbers from the keys of their splits. A split's lines follow one another in its task."""

    def number(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        keys, numbers = firsts.value
        current, count = None, 0
        for batch in batches:
            found = batch.to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(keys, found), max(len(keys) - 1, 0))
            if len(found) and not (len(keys) and (keys[at] == found).all()):
                raise ValueError("the files, or how they are split, changed while they were read")
            starts = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))[: len(found)]
            place = np.arange(len(found)) - np.repeat(starts, np.diff([*starts, len(found)]))
            if len(found) and found[0] == current:
                same = starts[1] if len(starts) > 1 else len(found)
                place[:same] += count
            if len(found):
                current, count = found[-1], int(place[-1]) + 1
            yield pa.array(numbers[at] + place if len(found) else place, pa.int64())

    number.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    # where it stands in the plan matters: no filter may come before it
    return F.arrow_udf(number, T.LongType()).asNondeterministic()


def numbered_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """`(line_no, value)`: lines numbered from 0 through all files, in path order.

    The files are read twice, in parallel splits (a compressed file is one): first only to count the
    lines of each split, which gives every split its first number, 16 bytes each; then, the lines
    are numbered while they are read. They are not copied, and none leaves its task for it.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    found = text_lines(spark, paths)
    splits = found.groupBy(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        _split_key().alias("key"),
        file_key().alias("_key"),
    ).agg(F.count("*").alias("n"))
    ranked = lookup(splits, file_ranks(spark, paths), ["_key"])
    before = Window.orderBy("rank", "block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = ranked.select("key", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    table = firsts.toArrow()  # one row per split
    keys, numbers = (table.column(c).to_numpy() for c in ("key", "first"))
    order = np.argsort(keys, kind="stable")
    if len(np.unique(keys)) < len(keys):
        raise ValueError("two splits have the same key; read with another split size")
    shared = spark.sparkContext.broadcast((keys[order], numbers[order]))
    return found.select(_numbers(shared)(_split_key()).alias("line_no"), "value")


def line_chunks(
    lines: DataFrame,
    every: int = 1,
    prefix: str = "subtitles",
    size: int = LINES_PER_DOCUMENT,
    rank: int = 0,
) -> DataFrame:
    """Documents of `size` consecutive lines from `(line_no, value)`.

    Lines are trimmed and joined by line breaks; a partial last document is dropped. The
    sample is taken by the document's id *before* the lines are brought together, so only
    sampled lines are shuffled, `size` to a group.
    """
    numbered = lines.withColumn("ord", F.floor(F.col("line_no") / size).cast("long")).withColumn(
        "doc_id", F.concat(F.lit(f"{prefix}:"), F.col("ord"))
    )
    sampled = numbered.filter(quality.in_sample(F.col("doc_id"), every))
    trimmed = sampled.select(
        "doc_id", "ord", F.struct("line_no", words.strip_ws(F.col("value")).alias("line")).alias("l")
    )
    groups = trimmed.groupBy("doc_id", "ord").agg(
        F.sort_array(F.collect_list("l")).alias("lines")
    )
    return groups.filter(F.size("lines") == size).select(
        "doc_id",
        F.array_join(F.col("lines.line"), "\n").alias("text"),
        F.lit(rank).alias("source_rank"),
        "ord",
    )


def line_documents(
    spark: SparkSession, paths: str | Sequence[str], every: int = 4, rank: int = 0
) -> DataFrame:
    """Documents of a (compressed) line dump."""
    return line_chunks(numbered_lines(spark, paths), every, rank=rank)
