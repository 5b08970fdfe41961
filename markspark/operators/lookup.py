"""Left join of many rows with a table of unique keys, safe against size and skew."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markspark.storage import materialize

BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 64 * 1024 * 1024
HOT_KEYS = 1_000


def _text_bytes(name: str, kind: str) -> Column:
    """Bytes of one value: texts as they are, nested values as they would be written."""
    if kind == "string":
        return F.coalesce(F.octet_length(name), F.lit(0))
    if kind in ("struct", "array", "map"):
        return F.coalesce(F.octet_length(F.to_json(name)), F.lit(0))
    return F.lit(8)


def fits_broadcast(
    table: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """Whether a table is small enough to broadcast, by its real row count and bytes."""
    size = F.lit(8 * len(table.columns)).cast("long")
    for field in table.schema.fields:
        size = size + _text_bytes(field.name, field.dataType.typeName())
    found = table.agg(F.count("*").alias("n"), F.sum(size).alias("b"))
    row = found.first()
    return row.n <= max_rows and (row.b or 0) <= max_bytes


def lookup(
    left: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    max_rows: int = BROADCAST_ROWS,
    max_bytes: int = BROADCAST_BYTES,
    fits: bool | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """`left LEFT JOIN table USING (on)`, where the table has one row per key.

    A table of checked size is broadcast. Above that, fewer than `HOT_KEYS` keys can each hold
    more than one `HOT_KEYS`-th of the rows: their table rows are few enough to broadcast, and
    the rows that carry them stay where they are. Only the rows of all other keys are shuffled.
    Rows without a key match nothing and are not moved either.

    `fits` is the answer of `fits_broadcast`, and `counts` the result of `key_counts`, where
    the caller has them already.
    """
    on = list(on)
    if fits if fits is not None else fits_broadcast(table, max_rows, max_bytes):
        return left.join(F.broadcast(table), on, "left")

    hot = _hot_keys(key_counts(left, on) if counts is None else counts, on)
    hot_rows = table.join(F.broadcast(hot), on, "left_semi")
    hot_table = F.broadcast(hot.join(F.broadcast(hot_rows), on, "left"))
    keyless = F.lit(False)
    for name in on:
        keyless = keyless | F.col(name).isNull()
    values = [c for c in table.columns if c not in on]
    nothing = [F.lit(None).cast(table.schema[v].dataType).alias(v) for v in values]
    parts = (
        left.filter(~keyless).join(hot_table, on, "inner"),
        left.filter(~keyless).join(F.broadcast(hot), on, "left_anti").join(table, on, "left"),
        left.filter(keyless).select("*", *nothing),
    )
    columns = [*left.columns, *values]
    return reduce(DataFrame.unionByName, [part.select(*columns) for part in parts])


def key_counts(left: DataFrame, on: Sequence[str]) -> DataFrame:
    """`(on..., _n)`: rows per key, counted in every task before the shuffle, kept as a table."""
    return materialize(left.groupBy(*on).agg(F.count("*").alias("_n")), "key-counts")


def _hot_keys(counts: DataFrame, on: list[str]) -> DataFrame:
    total = counts.agg(F.sum("_n")).first()[0] or 0
    return materialize(counts.filter(F.col("_n") * HOT_KEYS > total).select(*on), "hot-keys")


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """`df` as a written table with a number for every row: an identity that no two rows share,
    whatever their columns hold."""
    return materialize(df.withColumn(name, F.monotonically_increasing_id()), "rows")


@dataclass(frozen=True)
class InMemory:
    """A small table on every executor: a broadcast of its keys and values as arrays."""

    arrays: Broadcast
    values: T.StructType


def in_memory(table: DataFrame) -> InMemory:
    """Sends a table with a unique column `key` to all executors, once. It has to fit."""
    values = [c for c in table.columns if c != "key"]
    rows = table.select("key", F.struct(*values).alias("value")).toArrow().combine_chunks()
    arrays = []
    for name in ("key", "value"):
        column = rows.column(name)
        arrays.append(pa.concat_arrays(column.chunks or [pa.array([], column.type)]))
    shared = table.sparkSession.sparkContext.broadcast(arrays)
    return InMemory(shared, T.StructType([table.schema[v] for v in values]))


def lookup_in_rows(
    df: DataFrame, keys: Sequence[Column], table: InMemory, output: str
) -> DataFrame:
    """Looks up whole arrays of keys without taking rows apart.

    `keys` are arrays of equal lengths, tried in turn. `output` is an array with a struct of the
    table's values for each place, null where no key is known. Each task maps its batches with
    one look-up per array, so that nothing is shuffled, and rows are neither lost nor merged.
    """
    shared = table.arrays

    def find(*arrays: pa.Array) -> pa.Array:
        names, found = shared.value
        lengths = pc.fill_null(pc.list_value_length(arrays[0]), 0)
        offsets = np.concatenate([[0], np.cumsum(lengths.to_numpy(zero_copy_only=False))])
        place = None
        for array in arrays:
            here = pc.index_in(array.flatten(), value_set=names)
            place = here if place is None else pc.coalesce(place, here)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), found.take(place))

    return df.withColumn(output, F.arrow_udf(find, T.ArrayType(table.values))(*keys))
