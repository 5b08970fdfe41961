"""Packing documents into training sequences with a bounded number of open windows.

Each task keeps a fixed number of windows open. The rest of a document (what is left after whole
windows are cut off) goes where it fits best. When it fits nowhere, the fullest window leaves, its
gap filled with the beginning of the document if the gap is worth a piece. Windows still open at
the end of a task are merged in rounds, a fixed number of tasks at a time, until one group is left;
what that leaves is cut into sequences whose lengths are powers of two. No text is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markspark.llm.bpe import encoder
from markspark.storage import materialize

WINDOW = 4096
OPEN_WINDOWS = 32
MERGED_TASKS = 32
LEAST_PIECE = 16
"""A smaller gap is padded, not filled with a piece."""
END_ID = 2
ROWS = 20_000

PIECE_FIELDS = [
    ("start", pa.int64()),
    ("length", pa.int64()),
    ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()),
    ("offset", pa.int64()),
    ("task", pa.int64()),
    ("ids", pa.binary()),
]
PIECE_SCHEMA = (
    "start LONG, length LONG, ids_crc32 LONG, doc_tokens LONG, sequence_id LONG, offset LONG, "
    "task LONG, ids BINARY"
)


class Packer:
    """Places pieces `(doc, start, ids, doc_tokens)`; `emit` gets every finished sequence."""

    def __init__(self, emit: Callable[[list], None], window: int, open_windows: int) -> None:
        self.emit, self.window, self.most = emit, window, open_windows
        self.open: list[list] = []
        self.free: list[int] = []

    def add(self, doc, start: int, ids: np.ndarray, doc_tokens: int) -> None:
        while len(ids) >= self.window:
            self.emit([(doc, start, ids[: self.window], doc_tokens)])
            start, ids = start + self.window, ids[self.window :]
        while len(ids):
            size = len(ids)
            fitting = [(f, i) for i, f in enumerate(self.free) if f >= size]
            if fitting:
                free, i = min(fitting)
                self.open[i].append((doc, start, ids, doc_tokens))
                self.free[i] -= size
                if free == size:
                    self._leave(i)
                return
            if len(self.open) < self.most:
                self.open.append([(doc, start, ids, doc_tokens)])
                self.free.append(self.window - size)
                return
            i = min(range(len(self.free)), key=self.free.__getitem__)
            if (gap := self.free[i]) >= LEAST_PIECE:
                self.open[i].append((doc, start, ids[:gap], doc_tokens))
                start, ids = start + gap, ids[gap:]
            self._leave(i)

    def _leave(self, i: int) -> None:
        self.emit(self.open[i])
        del self.open[i], self.free[i]

    def finish(self) -> None:
        """Everything still open: whole windows, then lengths that are powers of two."""
        rest = [piece for pieces in self.open for piece in pieces]
        self.open, self.free = [], []
        left = sum(len(p[2]) for p in rest)
        while left:
            size = self.window if left >= self.window else 1 << (left.bit_length() - 1)
            sequence, room = [], size
            while room:
                doc, start, ids, doc_tokens = rest.pop(0)
                if len(ids) > room:
                    rest.insert(0, (doc, start + room, ids[room:], doc_tokens))
                    ids = ids[:room]
                sequence.append((doc, start, ids, doc_tokens))
                room -= len(ids)
            self.emit(sequence)
            left -= size


class _Rows:
    """Collects output rows, and numbers the sequences of one task and round."""

    def __init__(self, round_: int, task: int, doc_type: pa.DataType, keep_ids: bool) -> None:
        self.first = (round_ << 58) | (task << 30)
        self.task, self.keep = task, keep_ids
        self.schema = pa.schema([("doc_id", doc_type), *PIECE_FIELDS])
        self.rows: list[tuple] = []
        self.sequences = 0

    def emit(self, pieces: list) -> None:
        offset = 0
        for doc, start, ids, doc_tokens in pieces:
            raw = ids.astype("<u4").tobytes()
            self.rows.append(
                (doc, start, len(ids), zlib.crc32(raw), doc_tokens, self.first + self.sequences,
                 offset, self.task, raw if self.keep else None)
            )
            offset += len(ids)
        self.sequences += 1

    def left(self, windows: list) -> None:
        for number, pieces in enumerate(windows):
            for doc, start, ids, doc_tokens in pieces:
                raw = ids.astype("<u4").tobytes()
                row = (doc, start, len(ids), None, doc_tokens, None, number, self.task, raw)
                self.rows.append(row)

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * len(self.schema)
        arrays = [pa.array(c, f.type) for c, f in zip(columns, self.schema)]
        self.rows = []
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
    keep_ids: bool = False,
    cached: int | None = None,
) -> DataFrame:
    """One row per piece: `id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset`,
    and `ids` (little-endian, four bytes each) if `keep_ids`.

    A document is its tokenizer's ids and one end id. Every id lies in exactly one piece, pieces
    of a sequence follow each other without gaps, no sequence is longer than `window`. Sequences
    shorter than that either are powers of two long or lack fewer than `LEAST_PIECE` ids.

    Null, empty and blank texts are one end id. Rows that repeat are packed each for itself. Null
    ids of documents stay null. An empty table gives no pieces; other columns are ignored.
    `cached` is the size of the tokenizer's caches, where memory is scarcer than time.
    """
    if window & (window - 1):
        raise ValueError("the window is a power of two")
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = source.schema[0].dataType.simpleString()
    schema = f"doc_id {kind}, {PIECE_SCHEMA}"

    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rows = encoder(tokenizer, cached), None
        for batch in batches:
            if rows is None:
                task = TaskContext.get().partitionId()
                rows = _Rows(0, task, batch.schema.field(0).type, keep_ids)
                packer = Packer(rows.emit, window, open_windows)
            all_ids = known.encode_all(t.as_py() for t in batch.column(1))
            for doc, ids in zip(batch.column(0).to_pylist(), all_ids):
                ids = np.append(ids, np.uint16(END_ID))
                packer.add(doc, 0, ids, len(ids))
                if len(rows.rows) >= ROWS:
                    yield rows.take()
        if rows is not None:
            rows.left(packer.open)
            yield rows.take()

    packed = materialize(source.mapInArrow(first_round, schema), "packed")
    done = [packed.filter("sequence_id IS NOT NULL")]
    left = packed.filter("sequence_id IS NULL")
    top = left.agg(F.max("task").alias("t")).first().t
    tasks, round_ = (0 if top is None else int(top) + 1), 0
    while tasks:
        round_ += 1
        tasks = -(-tasks // MERGED_TASKS)
        last = tasks == 1

        def merge(key, batches, round_=round_, last=last):
            rows = packer = None
            for batch in batches:
                if rows is None:
                    rows = _Rows(round_, key[0].as_py(), batch.schema.field("doc_id").type, keep_ids)
                    packer = Packer(rows.emit, window, open_windows)
                for r in batch.to_pylist():
                    ids = np.frombuffer(r["ids"], "<u4")
                    packer.add(r["doc_id"], r["start"], ids, r["doc_tokens"])
            if last:
                packer.finish()
            else:
                rows.left(packer.open)
            yield rows.take()

        # a group is bounded: so many tasks, each with so many windows
        grouped = left.withColumn("task", F.floor(F.col("task") / MERGED_TASKS).cast("long"))
        merged = grouped.groupBy("task").applyInArrow(_by_key(merge), schema)
        merged = materialize(merged, "packed")
        done.append(merged.filter("sequence_id IS NOT NULL"))
        left = merged.filter("sequence_id IS NULL")
        tasks = 0 if last else tasks
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    columns = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return out.select(
        F.col("doc_id").alias(id_col), *columns, *(["ids"] if keep_ids else [])
    )


def _by_key(function: Callable) -> Callable:
    """A grouped function over the whole group's table, as `applyInArrow` wants it."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(function(key, group.to_batches())))

    return run
