"""The tables a built dataset consists of."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markspark.operators.alphabet import alphabet_json
from markspark.operators.windows import split_counts
from markspark.storage import read_table

WINDOW_SCHEMA = (
    "doc_id STRING, win_no INT, start INT, n INT, input_ids ARRAY<SMALLINT>, "
    "labels ARRAY<TINYINT>, split STRING"
)


def write_windows(windows: DataFrame, location: str, window: int, name: str = "windows") -> None:
    """Windows partitioned by split, then their row counts, taken from what was written."""
    windows.select("doc_id", "win_no", "start", "n", "input_ids", "labels", "split").write.mode(
        "overwrite"
    ).partitionBy("split").parquet(f"{location}/{name}")
    written = windows.sparkSession.read.schema(WINDOW_SCHEMA).parquet(f"{location}/{name}")
    meta = split_counts(written, window)
    meta.coalesce(1).write.mode("overwrite").parquet(f"{location}/{name}_meta")


def open_split(spark: SparkSession, location: str, split: str, name: str = "windows") -> DataFrame:
    """Windows of one split; only its partition is read. Empty when it was never written."""
    table = read_table(spark, f"{location}/{name}")
    if table is None:
        return spark.createDataFrame([], WINDOW_SCHEMA).drop("split")
    return spark.read.schema(WINDOW_SCHEMA).parquet(f"{location}/{name}").filter(
        F.col("split") == split
    ).drop("split")


def split_rows(spark: SparkSession, location: str, split: str, name: str = "windows") -> int:
    """Rows of one split from the written counts; 0 when it was never written."""
    meta = read_table(spark, f"{location}/{name}_meta")
    row = meta.filter(F.col("split") == split).first() if meta is not None else None
    return row["rows"] if row is not None else 0


def is_complete(spark: SparkSession, location: str, window: int) -> bool:
    """Whether a directory holds an alphabet and whole train and valid windows of this size."""
    meta = read_table(spark, f"{location}/windows_meta")
    if meta is None or read_alphabet(spark, location) is None:
        return False
    table = read_table(spark, f"{location}/windows")
    if table is None:
        return False
    found = {r["split"]: r["count"] for r in table.groupBy("split").count().collect()}
    noted = {r["split"]: r for r in meta.collect()}
    return all(
        split in noted
        and noted[split]["window"] == window
        and noted[split]["rows"] == found.get(split, 0) > 0
        for split in ("train", "valid")
    )


def write_json_row(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value STRING").coalesce(1).write.mode("overwrite").text(path)


def read_json_row(spark: SparkSession, path: str) -> str | None:
    try:
        row = spark.read.text(path).first()
    except Exception as err:
        if getattr(err, "getCondition", lambda: None)() == "PATH_NOT_FOUND":
            return None
        raise
    return row.value if row is not None else None


def write_alphabet(spark: SparkSession, chars: str, location: str) -> None:
    write_json_row(spark, alphabet_json(chars), f"{location}/alphabet")


def read_alphabet(spark: SparkSession, location: str) -> str | None:
    """The alphabet's characters in id order, or None when there is no alphabet."""
    text = read_json_row(spark, f"{location}/alphabet")
    return json.loads(text)["chars"] if text is not None else None


def write_summary(spark: SparkSession, summary: dict, location: str, name: str) -> None:
    write_json_row(spark, json.dumps(summary, sort_keys=True), f"{location}/{name}")


def read_summary(spark: SparkSession, location: str, name: str) -> dict | None:
    text = read_json_row(spark, f"{location}/{name}")
    return json.loads(text) if text is not None else None
