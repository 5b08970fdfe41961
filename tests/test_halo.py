"""Rows with what stands before and after them in their group."""

import random

import pytest

from markspark.operators import halo


def brute(rows, reach):
    out = []
    for k, (g, o, t) in enumerate(rows):
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: r[1])
        before = "".join(r[2] + "\n" for r in mine if r[1] < o and r[2] is not None)
        after = "".join("\n" + r[2] for r in mine if r[1] > o and r[2] is not None)
        out.append((g, o, t, before[-reach:], after[:reach]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("reach", [1, 6, 40])
@pytest.mark.parametrize("batch", [1, 1000])
def test_equals_brute_force(spark, reach, batch):
    """Groups from one row to one that fills several partitions; empty and missing texts, no group."""
    rnd = random.Random(reach)
    groups = [0] * 150 + [1] * 3 + [2] * 40 + [None] * 9 + list(range(3, 30))
    rows = [(g, k, rnd.choice([None, "", "a", "bcd", "é" * 9, "x" * 50])) for k, g in enumerate(groups)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "g LONG, o LONG, text STRING").repartition(3)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = halo.with_neighbours(df, "g", "o", "text", reach, "before", "after").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sorted(map(tuple, got), key=repr) == brute(rows, reach)


def test_ends_pass_through_partitions_that_are_one_run():
    ends = [(0, "a", "b", "\nx", "1\n"), (2, "b", "b", "\ny", "2\n"), (3, "b", "b", "\nz", "3\n"), (5, "b", "c", "\nw", "4\n")]
    got = {p: (b, a) for p, b, a in halo._rest(ends, 10)}
    assert got == {
        0: ("", "\ny\nz\nw"), 2: ("1\n", "\nz\nw"), 3: ("1\n2\n", "\nw"), 5: ("1\n2\n3\n", ""),
    }


def test_no_rows(spark):
    df = spark.createDataFrame([], "g LONG, o LONG, text STRING")
    assert halo.with_neighbours(df, "g", "o", "text", 3, "before", "after").count() == 0
