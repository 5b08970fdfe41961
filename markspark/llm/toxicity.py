"""Toxic texts by compression distance.

Two zstandard dictionaries are trained, on ordinary and on toxic text. Both know ordinary prose (a
toxic text is mostly that as well), so the second is the first followed by what was trained on the
words that set toxic texts apart. A text's window is compressed with either; the bytes that the
toxic dictionary saves are its distance. A window is a run of words that ordinary texts seldom use:
the others compress alike and would only thin it out. Thresholds and weights on a text's distances
are calibrated on labelled texts that the dictionaries never saw.

Training takes a bounded sample of labelled rows (`Sample`); scoring takes every whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from markspark.llm.common import leave_earlier_work, unused

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.5
WINDOW_WORDS = 8
LEVEL = 3
WORD = re.compile(r"[^\W_]+")
CLEAR = 3
"""A window that saves so many bytes counts as clear."""


@dataclass(frozen=True)
class Sample:
    """Bounds of the training sample. Rows are taken in the order of a hash of their id."""

    toxic: int = 2500
    ordinary: int = 7500
    longest: int = 20_000
    """Longer texts are scored like all others, but not learnt from."""
    lexicon: int = 200_000
    least_docs: int = 3
    contrast: float = 8.0
    shares: tuple[float, ...] = (0.005, 0.01, 0.015, 0.02, 0.03)
    """A word of the toxic dictionary is in at least this share of toxic texts; calibration
    chooses which."""
    ordinary_bytes: int = 65_536
    toxic_bytes: int = 2_048
    toxic_weight: float = 1.0


@dataclass
class Model:
    """Everything that scoring needs: at most a few megabytes, by the bounds of `Sample`."""

    prior: float
    lexicon: frozenset[str] = frozenset()
    ordinary: bytes = b""
    toxic: bytes = b""
    centre: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def _joined(some: list[str]) -> bytes:
    return (" " + "  ".join(some) + " ").encode()


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; the plain text where there is too little to train on."""
    try:
        return zstandard.train_dictionary(size, samples, k=16, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class Distance:
    """Bytes saved by the toxic dictionary, window by window."""

    def __init__(self, model: Model) -> None:
        self.lexicon = model.lexicon
        self.compress = [self._with(x) for x in (model.ordinary, model.ordinary + model.toxic)]

    @staticmethod
    def _with(content: bytes):
        settings = zstandard.ZstdCompressionParameters.from_level(
            LEVEL,
            format=zstandard.FORMAT_ZSTD1_MAGICLESS,
            write_content_size=0,
            write_checksum=0,
            write_dict_id=0,
        )
        known = zstandard.ZstdCompressionDict(content)
        known.precompute_compress(compression_params=settings)
        return zstandard.ZstdCompressor(dict_data=known, compression_params=settings).compress

    def of(self, text: str | None) -> np.ndarray:
        rare = [w for w in words(text) if w not in self.lexicon]
        ordinary, toxic = self.compress
        out = []
        for i in range(0, len(rare), WINDOW_WORDS):
            window = _joined(rare[i : i + WINDOW_WORDS])
            out.append(len(ordinary(window)) - len(toxic(window)))
        return np.array(out or [0], float)


def features(distances: np.ndarray) -> list[float]:
    top = np.sort(distances)[::-1]
    clear = float((distances >= CLEAR).sum())
    return [
        top[0], top[:3].sum(), distances.mean(), min(clear, 5.0), clear / len(distances),
        np.log1p(len(distances)),
    ]


def _logistic(x: np.ndarray, y: np.ndarray, toxic_weight: float) -> np.ndarray:
    """Weighted logistic regression by Newton's method, with a small penalty."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    cost = np.where(y == 1, toxic_weight, 1.0)
    penalty = np.diag([1e-6, *[0.1] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(
            (x * (cost * p * (1 - p) + 1e-9)[:, None]).T @ x + penalty,
            x.T @ (cost * (y - p)) - penalty @ w,
        )
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train_model(rows: list[tuple[str, int]], sample: Sample) -> Model:
    """From `(text, toxic)`: three of five rows make the dictionaries, two calibrate."""
    if not rows:
        return Model(0.0)
    prior = sum(t for _, t in rows) / len(rows)
    learnt = {k: [x for i, (x, t) in enumerate(r) if i % 5 < 3] for k, r in (
        (k, [r for r in rows if r[1] == k]) for k in (0, 1)
    )}
    ordinary, toxic = learnt[0], learnt[1]
    if not ordinary or not toxic:
        return Model(prior)
    seen = Counter(w for t in ordinary for w in set(words(t)))
    in_toxic = Counter(w for t in toxic for w in set(words(t)))
    held = [
        (x, t) for k in (0, 1) for i, (x, t) in enumerate(r for r in rows if r[1] == k) if i % 5 >= 3
    ]
    if len({t for _, t in held}) < 2:
        held = rows
    best, least = Model(prior), np.inf
    tried = set()
    for share in sample.shares:
        docs = max(sample.least_docs, round(share * len(toxic)))
        # a word sets toxic texts apart if it is much more frequent there
        apart = {
            w for w, n in in_toxic.items()
            if n >= docs and n / len(toxic) >= sample.contrast * (seen[w] + 0.5) / len(ordinary)
        }
        if docs not in tried:
            tried.add(docs)
            model, loss = _calibrated(ordinary, toxic, seen, apart, held, sample)
            if loss < least:
                best, least = model, loss
    return best


def _calibrated(
    ordinary: list[str], toxic: list[str], seen: Counter, apart: set[str], held: list, sample: Sample
) -> tuple[Model, float]:
    """The model for these words, and its mean loss on the held rows."""
    usual = [w for w, n in seen.most_common(sample.lexicon) if n >= sample.least_docs]
    lexicon = frozenset(usual) - apart
    plain = []
    for text in ordinary:
        rare = [w for w in words(text) if w not in lexicon]
        plain += [_joined(rare[i : i + 40]) for i in range(0, len(rare), 40)]
    marked = [_joined([w for w in words(t) if w in apart]) for t in toxic]
    model = Model(
        sum(t for _, t in held) / len(held),
        lexicon,
        _dictionary(plain, sample.ordinary_bytes),
        _dictionary([x for x in marked if len(x) > 8], sample.toxic_bytes),
    )
    distance = Distance(model)
    x = np.array([features(distance.of(text)) for text, _ in held])
    y = np.array([t for _, t in held], float)
    model.centre, model.scale = x.mean(0), x.std(0) + 1e-9
    x = (x - model.centre) / model.scale
    model.weights = _logistic(x, y, sample.toxic_weight)
    p = 1 / (1 + np.exp(-np.clip(model.weights[0] + x @ model.weights[1:], -30, 30)))
    return model, float(-np.mean(np.log(np.where(y == 1, p, 1 - p))))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    sample: Sample = Sample(),
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> Model:
    """Learns from labelled rows outside the held-out fold, as many as `sample` allows."""
    key = F.col("id").cast("string").cast("binary")
    known = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic"))
        .dropna()
        .groupBy("id")
        .agg(F.max("toxic").alias("toxic"))
        .filter(F.crc32(key) % FOLDS != HELD_OUT)
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    short = texts.filter(F.length("text") <= sample.longest)
    # which labelled rows have a text to learn from: ids alone meet here
    there = known.join(short.select("id").distinct(), "id")
    by_hash = F.xxhash64("id")
    chosen = there.filter("toxic = 1").orderBy(by_hash, "id").limit(sample.toxic).unionByName(
        there.filter("toxic = 0").orderBy(by_hash, "id").limit(sample.ordinary)
    )
    rows = short.join(F.broadcast(chosen), "id").groupBy("id", "toxic").agg(F.min("text").alias("text"))
    taken = rows.select("text", "toxic", "id").orderBy(by_hash, "id").collect()
    return train_model([(r.text, r.toxic) for r in taken], sample)


def with_score(docs: DataFrame, model: Model, text_col: str, score_col: str) -> DataFrame:
    """`docs` with one column more; the text's place is found by position, names may repeat."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leave_earlier_work()
        model = shared.value
        distance = Distance(model) if len(model.weights) else None
        for batch in batches:
            scores = []
            for text in batch.column(place):
                if distance is None:
                    scores.append(model.prior)
                    continue
                x = (np.array(features(distance.of(text.as_py()))) - model.centre) / model.scale
                logit = float(np.clip(model.weights[0] + x @ model.weights[1:], -30, 30))
                scores.append(1 / (1 + np.exp(-logit)))
            columns = [*batch.columns, pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, score_col])

    schema = StructType([*docs.schema.fields, StructField(score_col, DoubleType())])
    return docs.mapInArrow(run, schema)


def score(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of `docs`: `id_col, held_out, score, predicted`.

    The score lies between 0 and 1 and depends on the whole text alone. Null, empty and blank
    texts have no windows and get the score of a text that saves nothing. Null ids are not held
    out. Without labelled rows of both kinds the score is the share of toxic ones (0 without any).
    Rows that repeat get equal scores; an empty table gives none; other columns are ignored.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scored = with_score(source, model, "text", "score")
    fold = F.crc32(F.col("id").cast("string").cast("binary")) % FOLDS
    return scored.select(
        F.col("id").alias(id_col),
        F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_clean(
    docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5
) -> DataFrame:
    """The rows of `docs` with a score below the threshold, with all their columns."""
    name = unused(docs, "toxicity")
    scored = with_score(docs, model, text_col, name)
    return scored.filter(F.col(name) < threshold).drop(name)
