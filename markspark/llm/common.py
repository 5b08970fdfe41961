"""What several of these operators need: tables, decisions joined back, shared files."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markspark.storage import new_path

HOT_GROUPS = 500
"""At most this many groups can each hold more than 1/HOT_GROUPS of the rows."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_groups(
    rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int
) -> DataFrame:
    """`rows` left-joined with one row per group, however unequal the groups are.

    `size` is the group's number of rows and `total` that of all rows. Fewer than `HOT_GROUPS`
    groups can be larger than `total / HOT_GROUPS`; those few are broadcast and their rows stay
    where they are. The rows of the other groups are shuffled, and no such group is large.
    Keys must not be null.
    """
    least = max(total // HOT_GROUPS, 1)
    large = F.broadcast(groups.filter(F.col(size) > least))
    others = groups.filter(F.col(size) <= least)
    here = rows.join(large, keys, "inner")
    moved = rows.join(large.select(*keys), keys, "left_anti").join(others, keys, "left")
    return here.unionByName(moved)


def unused(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


BROADCAST_KEYS = 200_000


def without(rows: DataFrame, dropped: DataFrame, keys: list[str]) -> DataFrame:
    """`rows` that have no equal keys (null-safe) in `dropped`, which is broadcast only if it has
    at most `BROADCAST_KEYS` rows."""
    names = [unused(rows, f"gone_{i}") for i in range(len(keys))]
    gone = dropped.select(*[F.col(k).alias(n) for k, n in zip(keys, names)])
    if gone.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        gone = F.broadcast(gone)
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)]
    return rows.join(gone, same, "left_anti")


def forget_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs whose results were written and are read from
    there: it does so when the driver's garbage is collected, which may otherwise be late."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_kept: list[Callable[[], None]] = []


def kept_by_worker(clear: Callable[[], None]) -> None:
    """Names a way to empty what an operator keeps in a worker from task to task."""
    _kept.append(clear)


def leave_earlier_work() -> None:
    """For a worker that takes up another operator's tasks: empties what earlier operators kept in it,
    and gives the memory back to the machine. A worker outlives its stage, and its caches would count
    against the executor all along the stages that follow."""
    for clear in _kept:
        clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def shared_files(spark: SparkSession, name: str) -> str:
    """A new folder for files that tasks write and map, as a path they can open.

    It lies in the shared folder of the session, which must be mounted under the same path on
    every machine for this (NFS, FUSE and the like): a file can be mapped in no other way.
    """
    parts = urlsplit(new_path(spark, name))
    if parts.scheme not in ("", "file"):
        raise ValueError(f"files in {parts.scheme}:// can't be mapped; name a mounted folder")
    path = unquote(parts.path)
    os.makedirs(path, exist_ok=True)
    return path


def mapped(path: str, dtype: str, entries: int) -> np.ndarray:
    """A file of so many entries that another task wrote, mapped. One that is missing or has another
    size, because the folder is not shared or was cleared, is an error, and not an empty file."""
    size = os.path.getsize(path) if os.path.exists(path) else 0
    if size != entries * np.dtype(dtype).itemsize:
        raise FileNotFoundError(f"{path} holds {size} bytes, not {entries} entries of {dtype}")
    return np.memmap(path, dtype, "r") if entries else np.empty(0, dtype)


def write_file(path: str, content: bytes) -> None:
    """All or nothing, so that a repeated task leaves the same file."""
    temporary = f"{path}.{os.getpid()}.{os.urandom(4).hex()}"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(temporary, "wb") as f:
        f.write(content)
    os.replace(temporary, path)
