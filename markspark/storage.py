"""Intermediate tables in the cluster's shared folder, and stamped builds.

Nothing here keeps data on one machine: an intermediate result that several jobs read is
written once to the folder the session names in `spark.checkpoint.dir`, so it survives the
loss of any executor.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR, WAREHOUSE = "spark.checkpoint.dir", "spark.sql.warehouse.dir"


def shared_folder(spark: SparkSession) -> str:
    """The session's shared folder: the one named for checkpoints, else the warehouse."""
    return (spark.conf.get(CHECKPOINT_DIR, None) or spark.conf.get(WAREHOUSE)).rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/markspark/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used before."""
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove_intermediate(spark: SparkSession) -> None:
    """Deletes all that this session's jobs wrote to the shared folder. Results that are read
    from there have to be written elsewhere first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a result once and read it back: later jobs share it and its lineage is cut."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(written: DataFrame) -> None:
    """Deletes a table that `materialize` wrote and that no later job reads, so that the disk holds
    only what is still needed. Nothing outside this session's folder is touched."""
    spark = written.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    own = jvm.org.apache.hadoop.fs.Path(_own_folder(spark)).toUri().getPath()
    for name in {f.rsplit("/", 1)[0] for f in written.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        if path.getParent().toUri().getPath() == own:
            path.getFileSystem(conf).delete(path, True)


def materialize_bucketed(df: DataFrame, by: str, buckets: int, name: str = "table") -> DataFrame:
    """Like `materialize`, but what groups or joins the result by `by` alone need not shuffle it:
    each task writes its rows to the files of their buckets, and nothing moves."""
    path = new_path(df.sparkSession, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.bucketBy(buckets, by).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


# --- stamped builds ---------------------------------------------------------------------------

_STATE_SCHEMA = "seq LONG, status STRING, stamp STRING, location STRING"
BUILDING, COMPLETE = "building", "complete"


@dataclass(frozen=True)
class Build:
    location: str
    rebuilt: bool


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at `path`, or None when there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as err:
        if err.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _last_state(spark: SparkSession, directory: str, status: str | None = None):
    try:
        log = spark.read.schema(_STATE_SCHEMA).json(f"{directory}/state")
    except AnalysisException as err:
        if err.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    if status is not None:
        log = log.filter(F.col("status") == status)
    return log.orderBy(F.desc("seq")).first()


def _record(spark: SparkSession, directory: str, seq: int, *state: str) -> None:
    row = spark.createDataFrame([(seq, *state)], _STATE_SCHEMA)
    row.coalesce(1).write.mode("append").json(f"{directory}/state")


def current_build(spark: SparkSession, directory: str) -> str | None:
    """Where the last complete build lies; None when there was none. A build that runs, or that
    broke off, does not hide it."""
    state = _last_state(spark, directory, COMPLETE)
    return state.location if state is not None else None


def materialize_stamped(
    spark: SparkSession,
    directory: str,
    stamp: str,
    build: Callable[[str], None],
    is_complete: Callable[[str], bool],
) -> Build:
    """Run `build(location)` unless the last complete build has the same stamp.

    The state is a log that is only ever appended to: a row before the work begins and another
    when it is done. Each build has a folder of its own, and readers go by the last row that
    says done. A directory without any log counts as built if `is_complete(directory)` holds.
    """
    state = _last_state(spark, directory)
    seq = state.seq if state is not None else 0
    if state is not None and state.status == COMPLETE and state.stamp == stamp:
        return Build(state.location, rebuilt=False)
    if state is None and is_complete(directory):
        _record(spark, directory, 1, COMPLETE, stamp, directory)
        return Build(directory, rebuilt=False)

    location = f"{directory}/build-{uuid.uuid4().hex}"
    _record(spark, directory, seq + 1, BUILDING, stamp, location)
    build(location)
    _record(spark, directory, seq + 2, COMPLETE, stamp, location)
    return Build(location, rebuilt=True)
