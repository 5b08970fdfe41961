"""Looking up whole arrays of keys in a table that is too large to send: the rows stay where they are.

Three things keep the traffic small. A Bloom filter of the table's keys, of bounded size, goes to every
executor: most keys that the table does not know end there. The entries that the rows ask for most are
sent too and answered in place. For the rest, `(part, row, nth, level, key)` travels to the table, and
the answers travel back to the part that asked, where the rows were left: they are written once, in
parts of bounded size, bucketed by part, so that bringing rows and answers together moves answers only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markspark.operators import lookup as lookups
from markspark.storage import materialize, materialize_bucketed

FILTER_BYTES = 32 * 1024 * 1024
BITS_PER_KEY = 10
HASHES = 4
FREQUENT = 100_000
"""Entries that are answered in place."""
PART_BYTES = 1024 * 1024
"""A part is in a Python task's memory as a whole, with some thirty times these bytes: its texts, their keys
of all levels, and the answers."""
MOST_BUCKETS = 10_000
SOURCE = "_source"
"""What keys are made from, where that is not a column."""
_PART_BITS = 24  # parts of one task; the task's number lies above


# --- the filter -------------------------------------------------------------------------------


def _bits(hashes: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The places of each hash in a filter of `size` bits, a power of two."""
    low = hashes & np.uint64(0xFFFFFFFF)
    high = (hashes >> np.uint64(32)) | np.uint64(1)
    for i in range(HASHES):
        yield (low + np.uint64(i) * high) & np.uint64(size - 1)


def key_filter(keys: DataFrame, most_bytes: int = FILTER_BYTES) -> np.ndarray:
    """A Bloom filter of the column `key`, as 64-bit words. Above some `8 / BITS_PER_KEY` keys for each
    of `most_bytes` it lets more wrong keys through, but it never grows and never misses a key."""
    n = keys.count()
    size = 1 << max(6, (BITS_PER_KEY * n - 1).bit_length())
    size = min(size, 1 << ((8 * most_bytes).bit_length() - 1))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(0).to_numpy().view(np.uint64)
            places = np.unique(np.concatenate([*_bits(hashes, size), np.empty(0, np.uint64)]))
            word, first = np.unique(places >> np.uint64(6), return_index=True)
            bits = np.uint64(1) << (places & np.uint64(63))
            bits = np.bitwise_or.reduceat(bits, first) if len(word) else bits
            yield pa.RecordBatch.from_arrays(
                [pa.array(word.view(np.int64)), pa.array(bits.view(np.int64))], ["word", "bits"]
            )

    hashed = keys.filter("key IS NOT NULL").select(F.xxhash64("key").alias("h"))
    found = hashed.mapInArrow(words, "word LONG, bits LONG").groupBy("word")
    found = found.agg(F.bit_or("bits").alias("bits")).toArrow()  # most_bytes / 8 rows at most
    out = np.zeros(size // 64, np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def may_know(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    out = np.ones(len(hashes), bool)
    for place in _bits(hashes, 64 * len(words)):
        out &= (words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0
    return out


# --- rows that stay ---------------------------------------------------------------------------


def in_parts(df: DataFrame, size: Column, part: str, row: str) -> DataFrame:
    """`df` as a written table with `part`, a number for some `PART_BYTES` of one task's rows by
    `size`, and `row`, a number in the part. Reading it grouped by `part` moves nothing."""
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.LongType()) for c in (part, row))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, nth, at, held = TaskContext.get().partitionId() << _PART_BITS, 0, 0, 0
        for batch in batches:
            sizes = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            parts, rows = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
            for i, n in enumerate(sizes.tolist()):
                if held and held + n > PART_BYTES:
                    nth, at, held = nth + 1, 0, 0
                parts[i], rows[i] = task + nth, at
                at, held = at + 1, held + n
            columns = [*batch.columns[:-1], pa.array(parts), pa.array(rows)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], part, row])

    sized = df.select("*", F.coalesce(size, F.lit(0)).cast("long").alias("_size"))
    # with fewer buckets than shuffles have partitions, Spark would rather deal the rows out anew
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least, min(df.rdd.getNumPartitions(), MOST_BUCKETS))
    return materialize_bucketed(sized.mapInArrow(run, schema), part, buckets, "parts")


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks or [pa.array([], column.type)])


# --- the look-up ------------------------------------------------------------------------------


def _asking(frequent: lookups.InMemory, words: Broadcast, levels: int) -> Column:
    """From arrays of keys and arrays of their hashes, one of each per level: what has to be looked up
    elsewhere (`nth, level`), levels before that of a frequent entry only."""
    shared = frequent.arrays
    ask_kind = T.StructType([T.StructField(c, T.IntegerType()) for c in ("nth", "level")])

    def find(*arrays: pa.Array) -> pa.Array:
        names, _ = shared.value
        lengths = pc.fill_null(pc.list_value_length(arrays[0]), 0).to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        row = np.repeat(np.arange(len(lengths)), lengths)
        places, level_of = [], []
        open_ = np.ones(offsets[-1], bool)
        for level in range(levels):
            known = pc.index_in(arrays[level].flatten(), value_set=names).is_valid()
            open_ &= ~known.to_numpy(zero_copy_only=False)
            hashes = arrays[levels + level].flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            places.append(np.flatnonzero(open_ & may_know(words.value, hashes)))
            level_of.append(np.full(len(places[-1]), level, np.int32))
        places, level_of = np.concatenate(places), np.concatenate(level_of)
        order = np.argsort(places, kind="stable")
        places, level_of = places[order], level_of[order]
        nth = (places - offsets[row[places]]).astype(np.int32)
        ends = np.concatenate([[0], np.cumsum(np.bincount(row[places], minlength=len(lengths)))])
        asks = pa.StructArray.from_arrays([pa.array(nth), pa.array(level_of)], ["nth", "level"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), asks)

    return F.arrow_udf(find, T.ArrayType(ask_kind))


def lookup_in_place(
    df: DataFrame,
    keys: Sequence[Column],
    table: DataFrame,
    output: str,
    size: Column,
    frequent: int = FREQUENT,
    filter_bytes: int = FILTER_BYTES,
    source: Column | None = None,
) -> DataFrame:
    """What `lookup.lookup_in_rows` does, for a table (`key` unique, and values) of any size.

    `keys` are arrays of equal lengths, tried in turn; `output` is an array with a struct of the values
    for each place, null where no key is known. `size` tells a row's bytes, about. Rows are written
    once and otherwise stay where they are; there is one row out for every row in, and a row whose
    arrays are null gets an empty array. Null keys are known to no table. `source` is what keys may
    use under the name of `SOURCE`; it is worked out once for all of them, and not stored.
    """
    levels = len(keys)
    values = [c for c in table.columns if c != "key"]
    kept = df.columns
    part, row = "_part", "_nth_row"
    rows = in_parts(df, size, part, row)
    table = table.filter("key IS NOT NULL")
    words = df.sparkSession.sparkContext.broadcast(key_filter(table.select("key"), filter_bytes))

    key_columns = [f"_keys{i}" for i in range(levels)]
    hash_columns = [f"_hashes{i}" for i in range(levels)]

    def with_keys(*columns: str) -> DataFrame:
        found = rows if source is None else rows.select(*columns, source.alias(SOURCE))
        return found.select(*columns, *[k.alias(n) for k, n in zip(keys, key_columns)])

    keyed = with_keys(part, row)

    def asking(known: lookups.InMemory, rows: DataFrame) -> DataFrame:
        hashed = rows.withColumns(
            {
                h: F.transform(k, lambda x: F.xxhash64(x))
                for h, k in zip(hash_columns, key_columns)
            }
        )
        find = _asking(known, words, levels)
        return hashed.withColumn("_ask", find(*key_columns, *hash_columns)).drop(*hash_columns)

    def exploded(rows: DataFrame) -> DataFrame:
        asks = rows.select(part, row, *key_columns, F.explode("_ask").alias("a"))
        of_level = [
            F.when(F.col("a.level") == i, F.get(k, F.col("a.nth"))) for i, k in enumerate(key_columns)
        ]
        return asks.select(part, row, "a.nth", "a.level", F.coalesce(*of_level).alias("key"))

    # what is asked for most, counted in every task before the shuffle
    none = lookups.in_memory(table.limit(0))
    counts = lookups.key_counts(exploded(asking(none, keyed)), ["key"])
    known = table.join(counts, "key").orderBy(F.desc("_n"), "key").limit(frequent)
    known = lookups.in_memory(materialize(known.select(*table.columns), "frequent"))

    # written, since the look-up reads them three times, and keys take longer to work out than to read
    asked = materialize(exploded(asking(known, keyed)), "asked")
    found = lookups.lookup(
        asked, table.withColumn("value", F.struct(*values)).select("key", "value"), ["key"], fits=False
    )
    found = found.filter(F.col("value").isNotNull()).select(
        F.col(part).alias("_to_part"), F.col(row).alias("_to_row"), "nth", "level", "value"
    )

    full = with_keys(*kept, part, row)
    shared, kind = known.arrays, found.schema["value"].dataType
    schema = T.StructType([*df.schema.fields, T.StructField(output, T.ArrayType(kind))])

    def place(key: tuple, mine: pa.Table, answers: pa.Table) -> pa.Table:
        names, entries = shared.value
        answers = answers.sort_by(
            [("_to_row", "ascending"), ("nth", "ascending"), ("level", "ascending")]
        )
        arrays = [_whole(mine.column(k)) for k in key_columns]
        lengths = pc.fill_null(pc.list_value_length(arrays[0]), 0).to_numpy(zero_copy_only=False)
        hits = pc.coalesce(*[pc.index_in(a.flatten(), value_set=names) for a in arrays])
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        place_of_row = np.empty(len(lengths), np.int64)
        place_of_row[mine.column(row).to_numpy()] = np.arange(len(lengths))
        at = offsets[place_of_row[answers.column("_to_row").to_numpy()]] + answers.column("nth").to_numpy()
        at, first = np.unique(at, return_index=True)  # of several levels, the first
        value = _whole(answers.column("value")).cast(entries.type).take(pa.array(first))
        # frequent entries, then answers, which are of an earlier level than the frequent one
        joined = pa.concat_arrays([entries, value])
        flat = hits.to_numpy(zero_copy_only=False).astype(float)
        flat[at] = len(entries) + np.arange(len(at))
        picked = joined.take(pa.array(flat, from_pandas=True).cast(pa.int64()))
        out = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), picked)
        return mine.select(kept).append_column(output, out)

    return (
        full.groupBy(part)
        .cogroup(found.groupBy("_to_part"))
        .applyInArrow(place, schema)
    )
