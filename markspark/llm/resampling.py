"""Importance resampling: documents drawn so that their n-grams look like those of a target.

Every run of one to three terms is a feature and falls into a bucket. A bucket's gain is the log of
how much more often the target hits it than the raw documents do; a document's weight is the sum over
its features. Added noise (Gumbel, from a hash of the id) turns the largest scores into a draw without
replacement by weight. Features are interned batch by batch (`gramtable`): each distinct one gets its
bucket once, and the slots of the occurrences gather the gains.

Bucket counts are summed per task before anything is shuffled; `buckets` numbers is all that reaches
the driver or is sent to tasks. The draw needs no sort of all documents: a quantile sketch gives a
score that certainly lies below the draw, and only what is above it is put in order.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markspark.llm.common import unused
from markspark.llm.gramtable import GramTable, batches
from markspark.operators.ordering import number_rows
from markspark.storage import materialize

RANK_ERROR = 0.0005
"""Largest error of the quantile sketch, as a share of the rows."""


@dataclass(frozen=True)
class Features:
    """Runs of 1 to `longest` terms, in so many buckets."""

    longest: int = 3
    buckets: int = 10_000


@dataclass(frozen=True)
class Gains:
    features: Features
    raw_total: int
    target_total: int
    by_bucket: np.ndarray
    """A whole number for each bucket, in thousandths of a natural logarithm."""


def _texts(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def bucket_counts(docs: DataFrame, features: Features, text_col: str = "text") -> DataFrame:
    """`bucket, n` over all features of all texts, repeats included; buckets without any are left out."""

    def count(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(features.buckets, np.int64)
        for batch in found:
            for parts in batches(_texts(batch.column(0)), features.longest):
                sums += GramTable(parts, features.longest, features.buckets).bucket_counts(
                    features.buckets
                )
        held = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(sums[held])], ["bucket", "n"])

    counted = docs.select(text_col).mapInArrow(count, "bucket LONG, n LONG")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def fit(
    raw: DataFrame, target: DataFrame, features: Features = Features(), text_col: str = "text"
) -> Gains:
    """Gains from all raw and all target texts. An empty table has no feature in any bucket."""

    def counts(docs: DataFrame) -> np.ndarray:
        out = np.zeros(features.buckets, np.int64)
        rows = bucket_counts(docs, features, text_col).toArrow()  # one row per bucket at most
        out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
        return out

    s, t = counts(raw), counts(target)
    raw_total, target_total = int(s.sum()), int(t.sum())
    n = features.buckets
    gains = [
        math.floor(1000 * math.log((b + 1) * (raw_total + n) / ((a + 1) * (target_total + n))))
        for a, b in zip(s.tolist(), t.tolist())
    ]
    return Gains(features, raw_total, target_total, np.array(gains, np.int64))


def noise(seed: int, doc_id: object) -> int:
    """Gumbel noise in thousandths, the same for an id wherever it is worked out."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(
    docs: DataFrame, gains: Gains, seed: int = 42, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """`id_col, n_words, n_features, weight, score` for each row of `docs`.

    Null and empty texts have no feature and weight 0. A row without an id has no score, since the
    noise comes from the id. Rows that share an id are weighed each for itself, with the same noise.
    """

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            texts = _texts(batch.column(1))
            words, weight = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for parts in batches(texts, gains.features.longest):
                for part in parts:
                    words[part.text] += len(part.terms) - part.carried
                table = GramTable(parts, gains.features.longest, gains.features.buckets)
                weight += table.sums(gains.by_bucket, len(texts))
            runs = sum(np.maximum(words - n, 0) for n in range(gains.features.longest))
            scores = [
                None if i is None else w + noise(seed, i)
                for i, w in zip(batch.column(0).to_pylist(), weight.tolist())
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(words),
                    pa.array(runs),
                    pa.array(weight),
                    pa.array(scores, pa.int64()),
                ],
                ["id", "n_words", "n_features", "weight", "score"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, text_col).mapInArrow(
        run, f"id {kind}, n_words LONG, n_features LONG, weight LONG, score LONG"
    )
    return rows.withColumnRenamed("id", id_col)


def ranked(
    weighed: DataFrame,
    share: int = 5,
    of: int = 100,
    least_words: int = 20,
    id_col: str = "doc_id",
) -> DataFrame:
    """All rows of `weigh`, with `rank` (1, 2, 3...) for the drawn ones and null for the others.

    Of the N rows with a score and at least `least_words` words, floor(share * N / of) are drawn: the
    highest scores, ties to the smaller id, then to fewer features. An empty table gives no rows.
    """
    weighed = materialize(weighed, "weighed")
    able = F.col("score").isNotNull() & (F.col("n_words") >= least_words)
    low = max(0.0, 1 - share / of - 4 * RANK_ERROR)
    sketch = F.percentile_approx("score", F.lit(low), F.lit(round(1 / RANK_ERROR)))
    n, bound = weighed.filter(able).agg(F.count("*"), sketch).first()
    drawn = share * n // of
    if not drawn:
        return weighed.withColumn("rank", F.lit(None).cast("long"))
    above: Column = able & (F.col("score") >= bound)
    if weighed.filter(above).count() < drawn:  # the sketch promises otherwise
        above = able
    order, place = unused(weighed, "order"), unused(weighed, "place")
    top = weighed.filter(above).withColumn(order, -F.col("score"))
    keys = [order, id_col, "n_features", "n_words"]
    top = number_rows(top, keys, place).withColumn(
        "rank", F.when(F.col(place) < drawn, F.col(place) + 1).cast("long")
    )
    others = weighed.filter(~F.coalesce(above, F.lit(False)))
    return top.drop(order, place).unionByName(others, allowMissingColumns=True)


def draw(docs: DataFrame, ranks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of `docs` whose id was drawn."""
    drawn = ranks.filter("rank IS NOT NULL").select(id_col).distinct()
    return docs.join(drawn, id_col, "left_semi")
