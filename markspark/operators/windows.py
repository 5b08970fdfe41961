"""Fixed windows over long texts, cut from stride-sized blocks in time linear in the text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from markspark.language import FIRST_CHAR_ID, LABEL_NONE, PAD_ID, ROMANIAN, UNK_ID, MarkProfile


def _check(window: int, overlap: int) -> None:
    if window <= 0:
        raise ValueError("a window holds at least one character")
    if not 0 <= overlap < window:
        raise ValueError("an overlap is at least 0 and shorter than the window")


def blocks(text: Column, size: int) -> Column:
    """The text in pieces of `size` code points; the last one may be shorter."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{size}}})"), F.lit(1))


def _by_block(documents: DataFrame, text: str, window: int, stride: int) -> DataFrame:
    """One row per block: the other columns, `len` (of the text), `i`, and `around`: the block
    before, the block itself, and as many after it as a window can touch."""
    others = [c for c in documents.columns if c != text]
    cut = documents.select(
        *others, F.length(text).alias("len"), blocks(F.col(text), stride).alias("b")
    )
    touched = -(-window // stride)
    shifted = [F.concat(F.array(F.lit("")), "b").alias("b_before"), F.col("b").alias("b0")] + [
        F.slice("b", j + 1, F.size("b")).alias(f"b{j}") for j in range(1, touched)
    ]
    return cut.select(*others, "len", F.posexplode(F.arrays_zip(*shifted)).alias("i", "around"))


def _following(window: int, stride: int) -> Column:
    touched = -(-window // stride)
    return F.concat(*[F.coalesce(f"around.b{j}", F.lit("")) for j in range(touched)])


def _row_encoder(alphabet: str, window: int, profile: MarkProfile):
    """An Arrow UDF from a window's text to its padded ids and labels.

    A whole batch becomes one array of code points, which NumPy maps at once. Lambdas over
    arrays of characters say the same (`functions.codec`), but are interpreted letter by letter
    and take several times as long. Ids of marked letters are those of their base letters.
    """
    near = 0x3000
    points = np.array([ord(c) for c in alphabet], dtype=np.uint32)  # in ascending order
    ids = np.full(near, UNK_ID, dtype=np.int16)
    labels = np.full(near, LABEL_NONE, dtype=np.int8)
    for i, point in enumerate(points):
        if point < near:
            ids[point] = FIRST_CHAR_ID + i
    for c, old in [(c, c) for c in profile.marked] + list(
        zip(profile.legacy_fixed, profile.legacy, strict=True)
    ):
        ids[ord(old)] = ids[ord(profile.base_of[c])]
        labels[ord(old)] = 1 if c in profile.breve_comma else 2
    unknown, first = UNK_ID, FIRST_CHAR_ID

    def encode(pieces: pa.Array) -> pa.Array:
        lengths = pc.utf8_length(pieces).to_numpy(zero_copy_only=False)
        text = "".join(pieces.to_pylist())
        found = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        common = np.minimum(found, near - 1)
        row_ids, row_labels = ids[common], labels[common]
        far = np.flatnonzero(found >= near - 1)
        if len(far) and len(points):
            place = np.minimum(np.searchsorted(points, found[far]), len(points) - 1)
            row_ids[far] = np.where(points[place] == found[far], place + first, unknown)
        used = np.arange(window) < lengths[:, None]
        columns = []
        for values, filler in ((row_ids, PAD_ID), (row_labels, LABEL_NONE)):
            padded = np.full(used.shape, filler, dtype=values.dtype)
            padded[used] = values
            offsets = pa.array(np.arange(len(lengths) + 1) * window, pa.int32())
            columns.append(pa.ListArray.from_arrays(offsets, pa.array(padded.ravel())))
        return pa.StructArray.from_arrays(columns, ["input_ids", "labels"])

    return F.arrow_udf(encode, "input_ids array<smallint>, labels array<tinyint>")


def windows_train(
    documents: DataFrame,
    alphabet: str,
    window: int = 256,
    overlap: int = 32,
    profile: MarkProfile = ROMANIAN,
) -> DataFrame:
    """One row per training window: the other columns, `win_no`, `start`, `n`, `input_ids`,
    `labels`; both arrays padded to `window`. A narrow operation: nothing is shuffled."""
    _check(window, overlap)
    stride = window - overlap
    others = [c for c in documents.columns if c != "text"]
    # Starts are 0, stride, 2*stride ... up to and including the first window that is not full;
    # after one that is just full, one more with only the overlap follows.
    start = F.col("i") * stride
    reached = (F.col("i") == 0) | (start - stride + window <= F.col("len"))
    cut = _by_block(documents, "text", window, stride).filter(
        F.col("around.b0").isNotNull() & reached
    )
    cut = cut.select(
        *others,
        F.col("i").alias("win_no"),
        start.alias("start"),
        F.left(_following(window, stride), F.lit(window)).alias("piece"),
    )
    encode = _row_encoder(alphabet, window, profile)
    return cut.withColumn("_row", encode("piece")).select(
        *others,
        "win_no",
        "start",
        F.length("piece").alias("n"),
        F.col("_row.input_ids").alias("input_ids"),
        F.col("_row.labels").alias("labels"),
    )


def _bounds(length: Column, i: Column, window: int, overlap: int) -> dict[str, Column]:
    """Number of windows less one, and the bounds of window `i`."""
    stride, half = window - overlap, overlap // 2
    last = F.when(length <= window, 0).otherwise(F.ceil((length - window) / stride)).cast("int")
    end_start = F.greatest(length - window, F.lit(0))

    def start(k: Column) -> Column:
        return F.when(k < last, k * stride).otherwise(end_start)

    return {
        "last": last,
        "start": start(i),
        "end": F.least(start(i) + window, length),
        "keep_from": F.when(i == 0, F.lit(0)).otherwise(start(i) + half),
        "keep_to": F.when(i < last, start(i + 1) + half).otherwise(length),
    }


BOUNDS = ("start", "end", "keep_from", "keep_to")


def plan_windows(length: Column, window: int, overlap: int) -> Column:
    """Inference windows as `array<struct<start, end, keep_from, keep_to>>`.

    They cover 0..length, the last one shifted left to end with the text; each position is
    kept from the window where it lies furthest from an edge.
    """
    _check(window, overlap)

    def plan(n: Column) -> Column:
        def one(i: Column) -> Column:
            found = _bounds(n, i, window, overlap)
            return F.struct(*[found[name].alias(name) for name in BOUNDS])

        zero = F.lit(0)
        places = F.sequence(zero, _bounds(n, zero, window, overlap)["last"])
        return F.transform(F.slice(places, F.lit(1), F.when(n > 0, F.size(places)).otherwise(0)), one)

    return F.transform(F.array(length), plan)[0]  # the length is worked out once


def windows_text(
    documents: DataFrame, window: int, overlap: int, text: str = "text"
) -> DataFrame:
    """One row per inference window: the other columns, `win_no`, the four bounds and `piece`."""
    _check(window, overlap)
    stride = window - overlap
    others = [c for c in documents.columns if c != text]
    found = _bounds(F.col("len"), F.col("i"), window, overlap)
    rows = _by_block(documents, text, window, stride).withColumn("_last", found["last"])
    following = _following(window, stride)
    piece = F.when(F.col("i") < F.col("_last"), F.left(following, F.lit(window))).otherwise(
        F.right(F.concat("around.b_before", following), F.lit(window))
    )
    return rows.filter(F.col("around.b0").isNotNull() & (F.col("i") <= F.col("_last"))).select(
        *others,
        F.col("i").alias("win_no"),
        *[found[name].alias(name) for name in BOUNDS],
        piece.alias("piece"),
    )


def window_stitch(
    scored: DataFrame, key: str, value: str, output: str, rows: DataFrame | None = None
) -> DataFrame:
    """Per `key`, which names a row, the kept part of every window's `value`, in order.

    `scored` holds `win_no`, `start`, `keep_from`, `keep_to` and one value per window: an array, or
    a text, which takes a fraction of an array of its characters when it is shuffled. Values are
    cut before they are grouped, so only kept positions are shuffled. With `rows`, the table the
    windows were made from, rows without a window (of empty or missing texts) are in the result as
    well, with a null.
    """
    is_text = isinstance(scored.schema[value].dataType, StringType)
    cut = F.substring if is_text else F.slice
    kept = cut(
        F.col(value), F.col("keep_from") - F.col("start") + 1, F.col("keep_to") - F.col("keep_from")
    )
    parts = scored.select(key, "win_no", kept.alias("part"))
    whole = stitch_parts(parts.select(key).distinct() if rows is None else rows, parts, key, "part")
    joined = F.array_join("part", "") if is_text else F.flatten("part")
    return whole.withColumn("part", joined).withColumnRenamed("part", output)


def stitch_parts(rows: DataFrame, parts: DataFrame, row_id: str, part: str) -> DataFrame:
    """`rows` with the array of their parts in the order of `win_no`; null where there are none."""
    grouped = parts.groupBy(row_id).agg(
        F.sort_array(F.collect_list(F.struct("win_no", part)))[part].alias(part)
    )
    return rows.join(grouped, row_id, "left")


def split_counts(windows: DataFrame, window: int) -> DataFrame:
    """Rows per split and the window size."""
    return windows.groupBy("split").agg(F.count("*").alias("rows")).withColumn(
        "window", F.lit(window)
    )
