"""Trained letter classifiers over hashed context n-grams: a fitted multinomial logistic regression,
and a multinomial log-odds model of counts, which takes every letter and can be merged."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import FeatureHasher
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markspark.operators.lookup import in_memory, lookup, lookup_in_rows
from markspark.storage import materialize

FEATURES = ("f_self", "f_l1", "f_r1", "f_l2", "f_r2", "f_l3", "f_r3", "f_c1", "f_c2", "f_c3")


def with_features(rows: DataFrame, size: int = 6) -> DataFrame:
    """Context n-grams as categorical columns, from `context_rows`."""
    ctx, mid = F.col("ctx"), size + 1
    features = {"f_self": F.substring(ctx, mid, 1)}
    for n in (1, 2, 3):
        features[f"f_l{n}"] = F.concat(F.substring(ctx, mid - n, n), features["f_self"])
        features[f"f_r{n}"] = F.concat(features["f_self"], F.substring(ctx, mid + 1, n))
        features[f"f_c{n}"] = F.substring(ctx, mid - n, 2 * n + 1)
    return rows.withColumns(features)


REACH = 3
"""The features look at so many characters on either side of the letter."""


def counted_letters(rows: DataFrame, size: int = 6) -> DataFrame:
    """`ctx, label, n`: letters with equal features and labels counted, in each task before the
    shuffle, and written once. `ctx` is what the features look at, `min(size, REACH)` characters on
    either side."""
    if size > REACH:
        rows = rows.withColumn("ctx", F.substring("ctx", size - REACH + 1, 2 * REACH + 1))
    counts = rows.groupBy("ctx", "label").agg(F.count("*").alias("n"))
    return materialize(counts, "training-letters")


def train_letter_classifier(
    rows: DataFrame,
    size: int = 6,
    num_features: int = 1 << 14,
    max_iter: int = 15,
) -> PipelineModel:
    """Fit on all candidate letters: equal ones are one row that weighs as much as they do, so an
    iteration reads distinct letters only. Save the result with `model.write().save(path)`."""
    letters = counted_letters(rows, size)
    hasher = FeatureHasher(
        inputCols=list(FEATURES), outputCol="features", numFeatures=num_features
    )
    regression = LogisticRegression(
        featuresCol="features",
        labelCol="y",
        weightCol="n",
        family="multinomial",
        maxIter=max_iter,
        regParam=1e-6,
        standardization=False,
    )
    train = with_features(letters, min(size, REACH)).withColumn("y", F.col("label").cast("double"))
    return Pipeline(stages=[hasher, regression]).fit(train.select("y", "n", *FEATURES))


def classify_letters(rows: DataFrame, model: PipelineModel, size: int = 6) -> DataFrame:
    """Adds `pred` and `confidence`; equal probabilities give the lowest label."""
    scored = model.transform(with_features(rows, size))
    p = vector_to_array(F.col("probability"))
    best = F.array_max(p)
    return scored.select(
        *rows.columns,
        (F.array_position(p, best) - 1).cast("tinyint").alias("pred"),
        best.alias("confidence"),
    )


# --- counts -----------------------------------------------------------------------------------

BUCKETS = 1 << 18
LABELS = (0, 1, 2)


def _bucket(name: str, value: str, buckets: int) -> Column:
    """A feature's bucket, from its name and value alone, as other engines work it out too."""
    return F.pmod(F.crc32(F.concat_ws("=", F.lit(name), F.col(value))), F.lit(buckets))


def _buckets(buckets: int) -> Column:
    return F.array(*[_bucket(name, name, buckets) for name in FEATURES])


def letter_counts(rows: DataFrame, size: int = 6, buckets: int = BUCKETS) -> DataFrame:
    """`bucket, n0, n1, n2`: how often each bucket comes with each label, over all rows; bucket -1
    counts the rows. Counts of several corpora add up (`merged_counts`).

    Equal contexts are counted before they are taken apart, and every task counts before the shuffle.
    """
    counted = rows.groupBy("ctx", "label").agg(F.count("*").alias("n"))
    featured = with_features(counted, size)
    places = F.concat(F.array(F.lit(-1).cast("long")), _buckets(buckets))
    taken = featured.select("label", "n", F.explode(places).alias("bucket"))
    own = [F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in LABELS]
    return taken.groupBy("bucket").agg(*own)


def merged_counts(*parts: DataFrame) -> DataFrame:
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("bucket").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in LABELS])


def log_odds(counts: DataFrame, alpha: float = 1.0, buckets: int = BUCKETS) -> DataFrame:
    """`bucket, w1, w2`: what a feature adds to the log-odds of labels 1 and 2 against 0; bucket -1 has
    the bias. Counts are smoothed by `alpha`. At most `buckets` rows, whatever the corpus."""
    total = counts.filter("bucket = -1").select(*[F.col(f"n{k}").alias(f"t{k}") for k in LABELS])
    both = counts.join(F.broadcast(total))  # one row

    def share(k: int) -> Column:
        letters = F.col(f"t{k}") * len(FEATURES)
        return F.log((F.col(f"n{k}") + alpha) / (letters + alpha * buckets))

    def prior(k: int) -> Column:
        return F.log((F.col(f"t{k}") + alpha) / (F.col("t0") + alpha))

    def weight(k: int) -> Column:
        return F.when(F.col("bucket") == -1, prior(k)).otherwise(share(k) - share(0))

    return both.select("bucket", *[weight(k).alias(f"w{k}") for k in LABELS[1:]])


def unseen_weights(counts: DataFrame, alpha: float = 1.0, buckets: int = BUCKETS) -> tuple[float, float]:
    """The weights of a bucket without any count."""
    t = counts.filter("bucket = -1").first()
    if t is None:
        return 0.0, 0.0
    rest = [math.log(alpha / (t[f"n{k}"] * len(FEATURES) + alpha * buckets)) for k in LABELS]
    return rest[1] - rest[0], rest[2] - rest[0]


def classify_by_counts(
    rows: DataFrame,
    counts: DataFrame,
    size: int = 6,
    alpha: float = 1.0,
    buckets: int = BUCKETS,
    shrink: float = 0.5,
) -> DataFrame:
    """Adds `pred` and `confidence`; equal odds give the lowest label.

    Features of one letter overlap, so each counts by `shrink` only. Distinct contexts are scored, and
    their answers looked up for the rows; weights are at most `buckets` rows, and looked up by Arrow
    where the contexts lie.
    """
    weights = log_odds(counts, alpha, buckets)
    unseen = unseen_weights(counts, alpha, buckets)
    contexts = rows.select("ctx").distinct()
    featured = with_features(contexts, size)
    known = in_memory(weights.filter("bucket >= 0").withColumnRenamed("bucket", "key"))
    featured = featured.select("ctx", _buckets(buckets).alias("_buckets"))
    found = lookup_in_rows(featured, [F.col("_buckets")], known, "_found")

    def total(k: int) -> Column:
        add = lambda s, w: s + F.coalesce(w[f"w{k}"], F.lit(unseen[k - 1]))
        return F.aggregate("_found", F.lit(0.0), add).alias(f"s{k}")

    sums = found.select("ctx", *[total(k) for k in LABELS[1:]])
    bias = weights.filter("bucket = -1").select(F.col("w1").alias("b1"), F.col("w2").alias("b2"))
    scored = sums.join(F.broadcast(bias))  # one row
    odds = [F.lit(0.0), *[F.col(f"b{k}") + shrink * F.col(f"s{k}") for k in LABELS[1:]]]
    top = F.greatest(*odds)
    pred = F.when(odds[0] == top, 0).when(odds[1] == top, 1).otherwise(2)
    mass = sum((F.exp(x - top) for x in odds), F.lit(0.0))
    answers = scored.select("ctx", pred.cast("tinyint").alias("pred"), (1 / mass).alias("confidence"))
    return lookup(rows, materialize(answers, "answers"), ["ctx"])
