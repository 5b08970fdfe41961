"""Model folders: the tables of a fitted model beside a JSON contract that is checked on load."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from markspark.language import LABEL_NAMES, ROMANIAN, MarkProfile
from markspark.operators import context, lexicon
from markspark.plans.evaluate import Restore
from markspark.sources import sinks

FORMAT_VERSION = 1
KINDS = ("frequent", "context")


@dataclass(frozen=True)
class ModelConfig:
    """What a reader must know to use the tables beside it."""

    kind: str
    threshold: float = 0.5
    context_sizes: tuple[int, ...] = context.SIZES
    labels: tuple[str, ...] = LABEL_NAMES
    candidate_accuracy: float | None = None
    format_version: int = FORMAT_VERSION

    def __post_init__(self) -> None:
        checks = [
            (
                self.format_version == FORMAT_VERSION,
                f"unsupported model format {self.format_version}",
            ),
            (self.kind in KINDS, f"unknown kind of model {self.kind!r}"),
            (0 <= self.threshold <= 1, "threshold is a share between 0 and 1"),
            (tuple(self.labels) == LABEL_NAMES, f"labels must be {', '.join(LABEL_NAMES)}"),
            (
                len(self.context_sizes) > 0
                and list(self.context_sizes) == sorted(set(self.context_sizes), reverse=True),
                "context_sizes must be distinct and descending",
            ),
        ]
        problems = [message for ok, message in checks if not ok]
        if problems:
            raise ValueError("this is no usable model: " + "; ".join(problems))


def save_model(spark: SparkSession, location: str, table: DataFrame, config: ModelConfig) -> None:
    """The table first, the contract last: a folder without a contract is no model."""
    table.write.mode("overwrite").parquet(f"{location}/table")
    sinks.write_json_row(spark, json.dumps(asdict(config), sort_keys=True), f"{location}/config")


def load_config(spark: SparkSession, location: str) -> ModelConfig | None:
    text = sinks.read_json_row(spark, f"{location}/config")
    if text is None:
        return None
    data = json.loads(text)
    if data.get("format_version") != FORMAT_VERSION:
        raise ValueError(f"unsupported model format {data.get('format_version')}")
    for name in ("context_sizes", "labels"):
        data[name] = tuple(data[name])
    return ModelConfig(**data)


def load_restorer(
    spark: SparkSession, location: str, profile: MarkProfile = ROMANIAN, key: str = "doc_id"
) -> Restore:
    """The restorer a folder holds, for use in batches and streams alike. The model is measured, and
    sent to the executors if it is small enough, here and not with every use."""
    config = load_config(spark, location)
    if config is None:
        raise ValueError(f"{location} holds no model")
    table = spark.read.parquet(f"{location}/table")
    if config.kind == "frequent":
        known = lexicon.loaded(table)
        return partial(
            lexicon.restore_frequent,
            dictionary=table,
            key=key,
            profile=profile,
            known=known,
            max_rows=0,
        )
    known = context.loaded(table, config.context_sizes)
    return partial(
        context.restore_context,
        model=table,
        known=known,
        max_rows=0,
        threshold=config.threshold,
        sizes=config.context_sizes,
        key=key,
        profile=profile,
    )


def save_if_better(
    spark: SparkSession,
    directory: str,
    table: DataFrame,
    config: ModelConfig,
    names: Sequence[str] = ("best-a", "best-b"),
) -> str:
    """Save as the best model only when its validation accuracy is strictly higher.

    Two folders take turns, so the best model so far stays whole while a better one is
    written. Returns the folder of the best model.
    """
    if config.candidate_accuracy is None:
        raise ValueError("a model needs its validation accuracy to be compared")
    known = {name: load_config(spark, f"{directory}/{name}") for name in names}
    scored = {n: c.candidate_accuracy for n, c in known.items() if c is not None}
    best = max(scored, key=scored.get, default=None)
    if best is not None and config.candidate_accuracy <= scored[best]:
        return f"{directory}/{best}"
    free = next(name for name in names if name != best)
    save_model(spark, f"{directory}/{free}", table, config)
    return f"{directory}/{free}"
