"""Connected components by contraction, with plain joins and aggregates.

Every node takes its smallest neighbour as parent, parents are followed to their roots, and edges
are drawn between roots; nodes at least halve each time. No link or label reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markspark.llm.common import forget_shuffles, join_groups
from markspark.storage import materialize


def _parents_of(rows: DataFrame, column: str, parents: DataFrame, total: int) -> DataFrame:
    """Replaces a column by its parents; many rows may hold the same node."""
    counted = rows.groupBy(column).agg(F.count("*").alias("_n"))
    table = parents.select(F.col("id").alias(column), F.col("parent").alias("_up"))
    found = join_groups(rows, table.join(counted, column), [column], "_n", total)
    return found.withColumn(column, F.coalesce("_up", column)).drop("_up", "_n")


def _roots(parents: DataFrame) -> DataFrame:
    """Follows parents until each node points at a root."""
    total = parents.count()
    while True:
        parents = materialize(parents, "parents")
        deeper = parents.alias("a").join(
            parents.filter("id <> parent").select(F.col("id").alias("parent")).alias("b"),
            "parent",
            "left_semi",
        )
        if deeper.isEmpty():
            return parents
        parents = _parents_of(parents, "parent", parents, total)


def components(edges: DataFrame) -> DataFrame:
    """`id, component` (the smallest id reachable) for every id in `edges` (`a, b`, not null).

    Loops and repeated edges do no harm; an empty table gives an empty result.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = None
    rest = materialize(both.distinct(), "edges")
    while True:
        parents = rest.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("least"))
        parents = _roots(parents.select("id", F.least("id", "least").alias("parent")))
        if labels is None:
            labels = parents.select("id", F.col("parent").alias("component"))
        else:
            labels = _parents_of(labels, "component", parents, labels.count())
        labels = materialize(labels, "labels")
        total = rest.count()
        # written in between: a plan of both steps would hold the first one several times over
        drawn = materialize(_parents_of(rest, "a", parents, total), "drawn")
        drawn = _parents_of(drawn, "b", parents, total)
        rest = materialize(drawn.filter("a <> b").distinct(), "edges")
        forget_shuffles(edges.sparkSession)
        if rest.isEmpty():
            return labels
