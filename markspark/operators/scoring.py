"""Windows scored in Arrow batches by a function the user supplies."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markspark.functions import marks
from markspark.operators.windows import plan_windows
from markspark.language import ROMANIAN, MarkProfile

BATCH_CHARS = 1 << 20

Predict = Callable[[Sequence[str]], Sequence[np.ndarray]]
"""Texts of at most one window in, one `(len(text), 3)` array of probabilities each out."""


def score_windows(
    windows: DataFrame, load: Callable[[], Predict], batch_size: int = 64
) -> DataFrame:
    """Adds `pred` and `confidence`, two arrays with one value per character of `piece`.

    `load` runs once per Python task. Windows of one batch are ordered by length, so that a
    padding model spends no work on short ones. Equal probabilities give the lowest label.
    """
    schema = T.StructType(
        [
            *windows.schema.fields,
            T.StructField("pred", T.ArrayType(T.ByteType())),
            T.StructField("confidence", T.ArrayType(T.DoubleType())),
        ]
    )
    place = windows.columns.index("piece")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = load()
        for batch in batches:
            pieces = batch.column(place).to_pylist()
            lengths = np.array([len(p) for p in pieces], dtype=np.int64)
            order = np.argsort(lengths, kind="stable")
            answers: list = [None] * len(pieces)
            for at in range(0, len(order), batch_size):
                chosen = order[at : at + batch_size]
                given = predict([pieces[i] for i in chosen])
                for i, answer in zip(chosen, given, strict=True):
                    if len(answer) != lengths[i]:
                        raise ValueError(f"a text of length {lengths[i]} got {len(answer)} predictions")
                    answers[i] = answer
            flat = np.concatenate([np.empty((0, 3)), *answers])
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
            labels = pa.array(flat.argmax(axis=1).astype(np.int8))
            best = pa.array(flat.max(axis=1))
            columns = [
                *batch.columns,
                pa.ListArray.from_arrays(offsets, labels),
                pa.ListArray.from_arrays(offsets, best),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "pred", "confidence"])

    return windows.mapInArrow(score, schema)


def _labelled(
    texts: list[str], plans: list, predict: Predict, batch_size: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each text begins, and per character its label and confidence, from the window that keeps it."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    windows = [(w["end"] - w["start"], i, w) for i, planned in enumerate(plans) for w in planned or ()]
    windows.sort(key=lambda w: w[0])
    labels, best = np.zeros(offsets[-1], np.int8), np.zeros(offsets[-1])
    for at in range(0, len(windows), batch_size):
        chosen = windows[at : at + batch_size]
        given = predict([texts[i][w["start"] : w["end"]] for _, i, w in chosen])
        for (n, i, w), answer in zip(chosen, given, strict=True):
            if len(answer) != n:
                raise ValueError(f"a text of length {n} got {len(answer)} predictions")
            kept = answer[w["keep_from"] - w["start"] : w["keep_to"] - w["start"]]
            to = slice(offsets[i] + w["keep_from"], offsets[i] + w["keep_to"])
            labels[to], best[to] = kept.argmax(axis=1), kept.max(axis=1)
    return offsets, labels, best


def _scored(held: list[pa.RecordBatch], predict: Predict, batch_size: int, text: int, plan: int) -> pa.Table:
    """These rows with `pred` and `confidence` per character."""
    rows = pa.Table.from_batches(held)
    texts = [t or "" for t in rows.column(text).to_pylist()]
    offsets, labels, best = _labelled(texts, rows.column(plan).to_pylist(), predict, batch_size)
    ends = pa.array(offsets, pa.int32())
    scored = rows.append_column("pred", pa.ListArray.from_arrays(ends, pa.array(labels)))
    return scored.append_column("confidence", pa.ListArray.from_arrays(ends, pa.array(best)))


def _gathered(
    batches: Iterator[pa.RecordBatch], text: int, batch_chars: int
) -> Iterator[list[pa.RecordBatch]]:
    """Rows, over several Arrow batches if need be, until they have some `batch_chars` characters."""
    held, size = [], 0
    for batch in batches:
        begin = 0
        chars = pc.fill_null(pc.utf8_length(batch.column(text)), 0).to_pylist()
        for i, n in enumerate(chars):
            size += n
            if size >= batch_chars:
                held.append(batch.slice(begin, i + 1 - begin))
                yield held
                held, size, begin = [], 0, i + 1
        if begin < batch.num_rows:
            held.append(batch.slice(begin))
    if held:
        yield held


def score_texts(
    documents: DataFrame,
    load: Callable[[], Predict],
    window: int = 256,
    overlap: int = 32,
    text: str = "text",
    batch_size: int = 64,
    batch_chars: int = BATCH_CHARS,
) -> DataFrame:
    """Adds `pred` and `confidence`, two arrays with one value per character of `text`.

    A text's windows are cut, scored and put together in one task, so nothing is shuffled. Rows are
    gathered, over several Arrow batches if need be, until they have some `batch_chars` characters;
    their windows are then scored by length, `batch_size` at a time.
    """
    planned = documents.withColumn("_plan", plan_windows(F.length(text), window, overlap))
    schema = T.StructType(
        [
            *planned.schema.fields,
            T.StructField("pred", T.ArrayType(T.ByteType())),
            T.StructField("confidence", T.ArrayType(T.DoubleType())),
        ]
    )
    place, plan = planned.columns.index(text), planned.columns.index("_plan")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = load()
        for held in _gathered(batches, place, batch_chars):
            yield from _scored(held, predict, batch_size, place, plan).to_batches()

    return planned.mapInArrow(score, schema).drop("_plan")


def restore_scored(
    documents: DataFrame,
    load: Callable[[], Predict],
    window: int = 256,
    overlap: int = 32,
    threshold: float = 0.5,
    key: str = "doc_id",
    text: str = "text",
    output: str = "restored",
    profile: MarkProfile = ROMANIAN,
) -> DataFrame:
    """`key, output`: strip, score by windows, decode. Texts stay where they are, and are decoded in the
    task that scores them: labels and confidences, some ten bytes a character, do not leave it.

    One row comes out for every row that goes in; `key` may repeat. An empty text stays empty, a
    missing one missing.
    """
    stripped = documents.select(key, marks.fix_and_strip(F.col(text), profile).alias(text))
    planned = stripped.withColumn("_plan", plan_windows(F.length(text), window, overlap))
    schema = T.StructType([planned.schema[key], T.StructField(output, T.StringType())])

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = load()
        for held in _gathered(batches, 1, BATCH_CHARS):
            rows = pa.Table.from_batches(held).combine_chunks()
            given = rows.column(1).to_pylist()
            found = _labelled([t or "" for t in given], rows.column(2).to_pylist(), predict, 64)
            restored = _decoded(given, *found, threshold, profile)
            out = pa.table([rows.column(0), pa.array(restored, pa.string())], schema.names)
            yield from out.to_batches()

    return planned.select(key, text, "_plan").mapInArrow(restore, schema)


def _decoded(
    texts: list[str | None],
    offsets: np.ndarray,
    labels: np.ndarray,
    best: np.ndarray,
    threshold: float,
    profile: MarkProfile,
) -> list[str | None]:
    """What `codec.decode_restore` does to one text, for many: labels of at least `threshold` set the
    marks that fit their letters."""
    points = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le"), "<u4").copy()
    sure = ~(best < threshold)  # like Spark, which puts NaN above all numbers
    pairs = ((profile.breve_comma_base, profile.breve_comma), (profile.circumflex_base, profile.circumflex))
    for label, (plain, marked) in enumerate(pairs, 1):
        at = np.flatnonzero(sure & (labels == label))
        old = points[at]
        for c, m in zip(plain, marked, strict=True):
            points[at[old == ord(c)]] = ord(m)
    whole = points.tobytes().decode("utf-32-le")
    return [t and whole[offsets[i] : offsets[i + 1]] for i, t in enumerate(texts)]
