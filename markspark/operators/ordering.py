"""Arrival order without a single-task sort: numbering, and "the first n rows"."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markspark.storage import materialize

ARRIVAL = ("source_rank", "ord")
SMALL_TOP = 1_000
ROW_BITS = 33  # monotonically_increasing_id keeps the row number in its lower 33 bits


def arrival(rank: str = "source_rank", ord_: str = "ord") -> Column:
    """A document's place as one decimal number that leaves room for places inside it.

    A number can be kept in a hash aggregate's buffer, a struct cannot: `min` over a struct
    makes Spark sort all exploded rows first. Compute it before a document is exploded; then
    `arrival + pos` sorts like (source_rank, ord, pos).
    """
    place = F.col(rank).cast("decimal(8,0)") * F.lit(Decimal(10**19)) + F.col(ord_).cast(
        "decimal(19,0)"
    )
    return (place.cast("decimal(27,0)") * F.lit(Decimal(10**10))).cast("decimal(37,0)")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by `keys` when the input has fewer partitions than the session has cores.

    One small file is one partition, however many cores wait. A large input has enough
    partitions already and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 2 * cores:
        return df
    return df.repartition(cores, *keys)


def _range_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def number_rows(df: DataFrame, order: Sequence[str], name: str = "row_no") -> DataFrame:
    """Number all rows 0..N-1 in `order` (a unique key), in parallel.

    The rows are range-partitioned and sorted inside each partition; the partitions' sizes,
    a table with one row per partition, then give every partition its first number.
    """
    ordered = (
        df.repartitionByRange(_range_partitions(df), *order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    ordered = materialize(ordered, "numbered").withColumn(
        "_part", F.shiftrightunsigned("_mid", ROW_BITS)
    )
    sizes = ordered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    row = F.col("_mid").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return (
        ordered.join(F.broadcast(firsts), "_part")  # one row per partition
        .withColumn(name, F.col("_first") + row)
        .drop("_mid", "_part", "_first")
    )


def first_rows(df: DataFrame, n: int, order: Sequence[str] = ARRIVAL) -> DataFrame:
    """The first `n` rows in `order` (a unique key); all rows when `n` is 0.

    Only the order columns are compared to find the n-th key; the rows themselves are then
    filtered by it where they lie, so no text goes through a single task.
    """
    if n <= 0:
        return df
    keys = df.select(*order)
    if n <= SMALL_TOP:
        last = keys.orderBy(*order).limit(n).agg(F.max(F.struct(*order)).alias("k")).first().k
    else:
        last = _nth_key(keys, n, order)
    if last is None:
        return df
    bound = F.struct(*[F.lit(v).cast(df.schema[c].dataType) for c, v in zip(order, last)])
    return df.filter(F.struct(*order) <= bound)


def _nth_key(keys: DataFrame, n: int, order: Sequence[str]):
    """The n-th smallest key, or None when there are fewer: counts per range first, then a
    sort of the one range that holds it."""
    ranged = keys.repartitionByRange(_range_partitions(keys), *order).withColumn(
        "_part", F.spark_partition_id()
    )
    ranged = materialize(ranged, "keys")
    left = n
    for part in ranged.groupBy("_part").count().orderBy("_part").collect():
        if left <= part["count"]:
            inside = ranged.filter(F.col("_part") == part._part)
            top = inside.orderBy(*order).limit(left)
            return top.agg(F.max(F.struct(*order)).alias("k")).first().k
        left -= part["count"]
    return None
