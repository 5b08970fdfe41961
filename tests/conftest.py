import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("markspark-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def docs(spark):
    """Builds `doc_id, text, source_rank, ord` from texts."""

    def build(*texts, start=0):
        rows = [(str(i), t, 0, i) for i, t in enumerate(texts, start)]
        return spark.createDataFrame(
            rows, "doc_id STRING, text STRING, source_rank INT, ord LONG"
        )

    return build


@pytest.fixture
def value(spark):
    """Evaluates a column function on one text."""
    from pyspark.sql import functions as F

    def run(function, text):
        df = spark.createDataFrame([(text,)], "text STRING")
        return df.select(function(F.col("text")).alias("v")).first().v

    return run
