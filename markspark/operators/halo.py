"""What stands before and after each row within its group, for rows that are sorted once.

Rows are range-partitioned by group and order. In one pass over its partition, a task carries the last
`reach` characters of the group forwards and looks as far ahead; only what stands at a partition's two
ends is open then. The ends, one row per partition, tell the open rows the rest.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markspark.storage import materialize

PART, NTH = "_halo_part", "_halo_nth"
BEFORE, AFTER = "_halo_before", "_halo_after"
FIRST, LAST = "_halo_first", "_halo_last"
GROUP = "_halo_group"


def _ahead(batches: deque, more: Iterator, group, reach: int) -> tuple[str, bool]:
    """The text that follows the first batch of the queue in this group, and whether it is open, that
    is, whether it goes on behind the partition. Reads on as far as needed."""
    out, at = "", 1
    while True:
        if at == len(batches):
            batch = next(more, None)
            if batch is None:
                return out, True
            batches.append(batch)
        for g, t in zip(*batches[at][1:]):
            if g != group:
                return out, False
            if t is not None:
                out = (out + "\n" + t[:reach])[:reach]
            if len(out) >= reach:
                return out, False
        at += 1


def _framed(
    found: Iterator[pa.RecordBatch], reach: int, group: int, text: int, names: list[str]
) -> Iterator[pa.RecordBatch]:
    def parsed() -> Iterator[tuple]:
        for batch in found:
            if batch.num_rows:
                yield batch, batch.column(group).to_pylist(), batch.column(text).to_pylist()

    more, part = parsed(), TaskContext.get().partitionId()
    batches: deque = deque()
    nth, carry, current, in_first = 0, "", None, True
    while True:
        if not batches:
            batch = next(more, None)
            if batch is None:
                return
            batches.append(batch)
        batch, groups, texts = batches[0]
        n = len(groups)
        before, first = [], []
        for g, t in zip(groups, texts):
            if g != current:
                in_first = nth == 0 and not before
                carry, current = "", g
            before.append(carry)
            first.append(in_first)
            if t is not None:
                carry = (carry + t[-reach:] + "\n")[-reach:]
        follows, open_ = _ahead(batches, more, groups[-1], reach)
        after, last = [""] * n, [False] * n
        g = groups[-1]
        for i in range(n - 1, -1, -1):
            if groups[i] != g:
                g, follows, open_ = groups[i], "", False
            after[i], last[i] = follows, open_
            if texts[i] is not None:
                follows = ("\n" + texts[i][:reach] + follows)[:reach]
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns,
                pa.array([part] * n, pa.int32()),
                pa.array(range(nth, nth + n), pa.int64()),
                pa.array(before, pa.string()),
                pa.array(after, pa.string()),
                pa.array(first, pa.bool_()),
                pa.array(last, pa.bool_()),
            ],
            names,
        )
        nth += n
        batches.popleft()


def _rest(ends: list, reach: int) -> list[tuple[int, str, str]]:
    """For each partition, what stands before its first row's group run and after its last one's.
    `ends`: (part, first group, last group, head, tail), one for each partition, in order."""
    before, left = [], ""
    for k, (_, first, _, _, _) in enumerate(ends):
        if k:
            _, f, g, _, tail = ends[k - 1]
            whole = f == g  # the partition before is one run
            left = ((left if whole else "") + tail)[-reach:] if g == first else ""
        before.append(left)
    after, right = [""] * len(ends), ""
    for k in range(len(ends) - 1, -1, -1):
        if k + 1 < len(ends):
            _, f, g, head, _ = ends[k + 1]
            right = (head + (right if f == g else ""))[:reach] if f == ends[k][2] else ""
        after[k] = right
    return [(e[0], b, a) for e, b, a in zip(ends, before, after)]


def with_neighbours(
    rows: DataFrame, group: str, order: str, text: str, reach: int, before: str, after: str
) -> DataFrame:
    """Adds `before` and `after`: up to `reach` characters of the texts that precede and follow in the
    row's group, each text with a line break to the row's side.

    Rows without a text add nothing for others. Rows without a group are one group.
    """
    key = F.coalesce(F.col(group).cast("string"), F.lit("\x00"))  # no other group's text
    keyed = rows.withColumn(GROUP, key)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartitionByRange(n, GROUP, order).sortWithinPartitions(GROUP, order)
    fields = [(PART, T.IntegerType()), (NTH, T.LongType()), (BEFORE, T.StringType()),
              (AFTER, T.StringType()), (FIRST, T.BooleanType()), (LAST, T.BooleanType())]
    schema = T.StructType([*keyed.schema.fields, *(T.StructField(c, t) for c, t in fields)])
    g, t = keyed.columns.index(GROUP), keyed.columns.index(text)
    framed = ordered.mapInArrow(lambda b: _framed(b, reach, g, t, schema.names), schema)
    framed = materialize(framed, "framed")

    own = F.coalesce(F.col(text), F.lit(""))
    none = F.col(text).isNull()
    tail = F.when(none, F.col(BEFORE)).otherwise(
        F.concat(BEFORE, F.right(own, F.lit(reach)), F.lit("\n"))
    )
    head = F.when(none, F.col(AFTER)).otherwise(
        F.concat(F.lit("\n"), F.left(own, F.lit(reach)), AFTER)
    )
    ends = framed.groupBy(PART).agg(
        F.min_by(F.struct(GROUP, F.left(head, F.lit(reach)).alias("head")), NTH).alias("low"),
        F.max_by(F.struct(GROUP, F.right(tail, F.lit(reach)).alias("tail")), NTH).alias("high"),
    )
    ends = ends.select(PART, f"low.{GROUP}", F.col(f"high.{GROUP}").alias("last"), "low.head", "high.tail")
    # one row for each partition of the shuffle, 2 * reach characters each
    rest = _rest([tuple(r) for r in ends.orderBy(PART).collect()], reach)
    rest = rows.sparkSession.createDataFrame(rest, f"{PART} INT, _rest_before STRING, _rest_after STRING")
    joined = framed.join(F.broadcast(rest), PART)
    return joined.select(
        *rows.columns,
        F.right(
            F.concat(F.when(F.col(FIRST), F.col("_rest_before")).otherwise(""), BEFORE), F.lit(reach)
        ).alias(before),
        F.left(
            F.concat(AFTER, F.when(F.col(LAST), F.col("_rest_after")).otherwise("")), F.lit(reach)
        ).alias(after),
    )
