"""Look-ups in tables of any size, for rows that stay in place."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from markspark.operators import faraway
from markspark.operators.lookup import in_memory, lookup_in_rows


def test_the_filter_misses_no_key_and_lets_few_others_through(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    hashes = spark.range(40_000).select(F.xxhash64(F.concat(F.lit("k"), "id")).alias("h"))
    hashes = np.array([r.h for r in hashes.collect()], np.int64).view(np.uint64)
    words = faraway.key_filter(keys)
    known = faraway.may_know(words, hashes)
    assert known[:20_000].all() and known[20_000:].mean() < 0.05
    small = faraway.key_filter(keys, 1_024)  # bounded: nearly all bits are set, still no key is missed
    assert len(small) * 8 <= 1_024 and faraway.may_know(small, hashes)[:20_000].all()


@pytest.mark.parametrize("frequent, filter_bytes, part_bytes", [(0, 64, 50), (3, 1 << 20, 1 << 20), (100, 8, 1)])
def test_equals_the_look_up_in_memory(spark, monkeypatch, frequent, filter_bytes, part_bytes):
    """Two levels of keys; rows that repeat, empty and missing arrays, null keys, unknown keys."""
    monkeypatch.setattr(faraway, "PART_BYTES", part_bytes)
    rnd = random.Random(frequent)
    rows = [(i % 40, [rnd.choice(["a", "b", "c", "x", "y", None, "zz"]) for _ in range(rnd.randrange(7))]) for i in range(120)]
    rows += [(None, ["a", "q"]), (1, None), (1, []), (1, [])]
    df = spark.createDataFrame(rows, "doc_id LONG, w ARRAY<STRING>").repartition(5)
    table = spark.createDataFrame(
        [("a", 1, "A"), ("c", 2, None), ("x!", 3, "X"), ("b!", 4, "B"), ("a!", 5, "never"), ("n", 6, "N")],
        "key STRING, n LONG, v STRING",
    )
    keys = [F.col("w"), F.transform("w", lambda x: F.concat(x, F.lit("!")))]
    want = lookup_in_rows(df, keys, in_memory(table), "found")
    got = faraway.lookup_in_place(
        df, keys, table, "found", F.size("w"), frequent=frequent, filter_bytes=filter_bytes
    )
    assert got.schema["found"].dataType == want.schema["found"].dataType
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_no_rows(spark):
    df = spark.createDataFrame([], "w ARRAY<STRING>")
    table = spark.createDataFrame([("a", 1)], "key STRING, n LONG")
    assert faraway.lookup_in_place(df, [F.col("w")], table, "found", F.lit(1)).count() == 0
    one = spark.createDataFrame([(["a"],)], "w ARRAY<STRING>")
    found = faraway.lookup_in_place(one, [F.col("w")], table.limit(0), "found", F.lit(1)).first().found
    assert found == [None]


def test_a_part_is_a_bounded_share_of_a_task(spark):
    """Parts come into a Python task whole, with several keys for each letter: they have to be small."""
    texts = spark.range(12).select("id", F.repeat(F.lit("x"), 400_000).alias("text")).repartition(1)
    parts = faraway.in_parts(texts, F.octet_length("text"), "part", "row")
    sizes = [r.n for r in parts.groupBy("part").agg(F.sum(F.length("text")).alias("n")).collect()]
    assert len(sizes) >= 4 and max(sizes) <= 2 << 20 and sum(sizes) == 12 * 400_000


def test_what_is_asked_is_worked_out_once_for_the_look_up(spark, monkeypatch):
    """Questions are written before the look-up, which reads them three times."""
    names = []
    kept = faraway.materialize
    monkeypatch.setattr(faraway, "materialize", lambda df, name: names.append(name) or kept(df, name))
    df = spark.createDataFrame([("a b",), ("b c",), (None,)], "text STRING")
    table = spark.createDataFrame([("a", 1), ("c", 2)], "key STRING, n LONG")
    got = faraway.lookup_in_place(
        df, [F.col(faraway.SOURCE)], table, "found", F.lit(1), source=F.split("text", " ")
    )
    assert got.columns == ["text", "found"] and "asked" in names
    assert {r.text: [f and f.n for f in r.found] for r in got.collect()} == {"a b": [1, None], "b c": [None, 2], None: []}
