"""Character vocabulary: counts, the kept characters, and their ids."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from markspark.functions import marks
from markspark.storage import materialize
from markspark.language import FIRST_CHAR_ID, PAD_ID, ROMANIAN, UNK_ID, MarkProfile


BATCH_CHARS = 1 << 20


def char_counts(documents: DataFrame, profile: MarkProfile = ROMANIAN) -> DataFrame:
    """`(ch, n, first_seen)` over the mark-free texts; `first_seen` orders ties by arrival.

    Characters are counted batch by batch as arrays of code points, so that one row per distinct
    character leaves a batch: its number, and its first place in the batch's first document. Marks
    are taken off these code points, not off the texts.
    """
    bases = {ord(c): ord(b) for c, b in zip(profile.marked, profile.marked_base, strict=True)}
    counted = documents.select("source_rank", "ord", "text").mapInArrow(
        lambda batches: _count_batches(batches, bases),
        "ch STRING, n LONG, source_rank INT, ord LONG, nth INT",
    )
    place = F.struct(F.struct("source_rank", "ord").alias("doc"), "nth")
    found = counted.groupBy("ch").agg(F.sum("n").alias("n"), F.min(place).alias("first_seen"))
    return materialize(found, "characters")  # one row per distinct character


def _count_batches(
    batches: Iterator[pa.RecordBatch], bases: dict[int, int]
) -> Iterator[pa.RecordBatch]:
    base_of = np.arange(max(bases, default=0) + 1, dtype=np.uint32)
    base_of[list(bases)] = list(bases.values())
    for batch in batches:
        ranks, ords = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        texts = batch.column(2)
        chosen, size = [], 0
        for i in np.lexsort((ords, ranks)).tolist():
            text = texts[i].as_py()
            if text:
                chosen.append((i, text))
                size += len(text)
            if size > BATCH_CHARS:
                yield _counted(chosen, ranks, ords, base_of)
                chosen, size = [], 0
        if chosen:
            yield _counted(chosen, ranks, ords, base_of)


def _counted(
    chosen: list[tuple[int, str]], ranks: np.ndarray, ords: np.ndarray, base_of: np.ndarray
) -> pa.RecordBatch:
    points = np.frombuffer("".join(t for _, t in chosen).encode("utf-32-le"), "<u4")
    last = np.uint32(len(base_of) - 1)
    points = np.where(points <= last, base_of[np.minimum(points, last)], points)
    counts = np.bincount(points)
    seen = np.flatnonzero(counts)
    first = np.empty(len(counts), np.int64)
    first[points[::-1]] = np.arange(len(points) - 1, -1, -1)
    begins = np.cumsum([0, *(len(t) for _, t in chosen[:-1])])
    doc = np.searchsorted(begins, first[seen], side="right") - 1
    rows = np.array([i for i, _ in chosen])[doc]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([chr(c) for c in seen]),
            pa.array(counts[seen].astype(np.int64)),
            pa.array(ranks[rows].astype(np.int32)),
            pa.array(ords[rows].astype(np.int64)),
            pa.array((first[seen] - begins[doc]).astype(np.int32)),
        ],
        ["ch", "n", "source_rank", "ord", "nth"],
    )


def build_alphabet(counts: DataFrame, max_size: int) -> DataFrame:
    """`(ch, char_id, n)` of the most frequent characters, so that ids stay below `max_size`.

    Ids follow code-point order. Only `max_size - 2` rows are left when they are numbered, so
    that one window needs no partitions.
    """
    if max_size <= FIRST_CHAR_ID:
        raise ValueError(f"an alphabet of {max_size} ids has no room for characters")
    kept = counts.orderBy(F.desc("n"), "first_seen").limit(max_size - FIRST_CHAR_ID)
    place = F.row_number().over(Window.orderBy("ch"))
    return kept.select("ch", (place + FIRST_CHAR_ID - 1).cast("smallint").alias("char_id"), "n")


def alphabet_string(alphabet: DataFrame) -> str:
    """The alphabet's characters in id order as one string of at most 254 characters."""
    chars = alphabet.agg(F.array_join(F.sort_array(F.collect_list("ch")), "")).first()[0]
    if len(set(chars)) != len(chars):
        raise ValueError("a character stands twice in the alphabet")
    return chars


def alphabet_json(chars: str) -> str:
    """The alphabet as JSON: `{"pad_id", "unk_id", "chars"}`."""
    return json.dumps({"pad_id": PAD_ID, "unk_id": UNK_ID, "chars": chars}, ensure_ascii=False)


def alphabet_table(spark: SparkSession, text: str) -> DataFrame:
    """`(ch, char_id)` from the JSON of `alphabet_json`."""
    chars = json.loads(text)["chars"]
    if not isinstance(chars, str):
        raise ValueError("chars is no text")
    if len(set(chars)) != len(chars):
        raise ValueError("a character stands twice in the alphabet")
    one = spark.range(1).select(F.posexplode(marks.chars(F.lit(chars))).alias("pos", "ch"))
    return one.select("ch", (F.col("pos") + FIRST_CHAR_ID).cast("smallint").alias("char_id"))
