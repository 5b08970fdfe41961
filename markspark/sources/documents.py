"""Document tables: Parquet shards, text directories, corrections, and chains of sources."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from markspark.functions import marks, words
from markspark.operators.corpus import hash_sample
from markspark.operators.lookup import lookup
from markspark.operators.ordering import number_rows
from markspark.language import ROMANIAN, MarkProfile
from markspark.storage import materialize

COLUMNS = ("doc_id", "text", "source_rank", "ord")
COMMENT = "#"
RANKS = "ranks"
FILES_AT_ONCE = 4_000_000
"""Files whose places are broadcast, 64 MB in all; beyond, `lookup` goes by the keys."""
_ROWS_PER_FILE_BITS = 36
_LINES_PER_FILE_BITS = 31


class SourceUnavailable(Exception):
    """A source could not be read: missing path, missing columns or a bad format."""


def parquet_documents(
    spark: SparkSession,
    paths: str | Sequence[str],
    every: int = 1,
    rank: int = 0,
    id_col: str = "id",
    text_col: str = "text",
) -> DataFrame:
    """Documents of Parquet shards in path order, one in `every` by id hash.

    Arrival order is the file's place in the list and the row's place in its file. Columns
    other than id and text are never read. Files are known by a hash of their names, so that a
    file's place takes 16 bytes of a broadcast: enough for `FILES_AT_ONCE` files.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    try:
        shards = spark.read.parquet(*paths).select(
            id_col,
            text_col,
            F.col("_metadata.row_index").alias("_row"),
            file_key().alias("_key"),
        )
        ranks = file_ranks(spark, paths)
        placed = lookup(shards, ranks, ["_key"], FILES_AT_ONCE, 16 * FILES_AT_ONCE)
        documents = placed.select(
            F.col(id_col).cast("string").alias("doc_id"),
            F.col(text_col).alias("text"),
            F.lit(rank).alias("source_rank"),
            (F.shiftleft("rank", _ROWS_PER_FILE_BITS) + F.col("_row")).alias("ord"),
        )
    except AnalysisException as err:
        raise SourceUnavailable(f"read {', '.join(paths)}: {err.getCondition()}") from err
    return hash_sample(documents, every)


def file_ranks(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """`(_key, rank)`: each input file's place, paths as listed, files in one path by name.

    Names alone are listed, without opening a file, and numbered in parallel. None of them gets to
    the driver's Python.
    """
    listed = [
        spark.read.format("binaryFile")
        .load(path)
        .select(F.lit(i).alias("path_no"), uri("_metadata.file_path").alias("name"))
        for i, path in enumerate(paths)
    ]
    return ranked_names(reduce(DataFrame.unionByName, listed))


def ranked_names(listed: DataFrame) -> DataFrame:
    """`file_ranks` of `(path_no, name)`; a name that several paths hold counts with the first."""
    first = listed.groupBy("name").agg(F.min("path_no").alias("path_no"))
    places = number_rows(first, ["path_no", "name"], "rank")
    ranks = materialize(places.select(name_key("name").alias("_key"), "rank"), "file-ranks")
    twice = ranks.groupBy("_key").count().filter("count > 1")
    if not twice.isEmpty():
        raise ValueError("two files have the same hash; rename one, or read them one after another")
    return ranks


def file_key() -> Column:
    """What `file_ranks` knows the file of a row by."""
    return name_key("_metadata.file_path")


def name_key(name: str) -> Column:
    return F.xxhash64(uri(name))


def uri(column: str) -> Column:
    """File names as Spark reports them differ in the number of slashes after the scheme."""
    return F.regexp_replace(F.col(column), "^([a-z0-9]+):/+", "$1:/")


def table_documents(
    table: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    ord_col: str | None = None,
    rank: int = 0,
    keep: Iterable[str] = (),
) -> DataFrame:
    """Documents of any table; `ord_col` (the id by default) must be a unique whole number."""
    return table.select(
        F.col(id_col).cast("string").alias("doc_id"),
        F.col(text_col).alias("text"),
        F.lit(rank).alias("source_rank"),
        F.col(ord_col or id_col).cast("long").alias("ord"),
        *keep,
    )


def read_text_files(spark: SparkSession, directory: str) -> DataFrame:
    """`(path, content)` of every `*.txt` file directly in a directory."""
    files = spark.read.text(directory, wholetext=True, pathGlobFilter="*.txt")
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def file_stem(path: str = "path") -> Column:
    """File name without directories and without its last extension."""
    name = F.element_at(F.split(F.col(path), "/"), -1)
    return F.regexp_replace(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), r"\.[^.]*$", "")


def documents_of_files(files: DataFrame, rank: int = 0) -> DataFrame:
    """One document per file, its stem as id.

    Files arrive in name order. A directory has no numbers to order by, so the place is a
    count of smaller names, taken on the names alone.
    """
    named = files.select("path", file_stem().alias("doc_id"), F.col("content").alias("text"))
    places = number_rows(named.select("path"), ["path"], "ord")
    return lookup(named, places, ["path"]).select(
        "doc_id", "text", F.lit(rank).alias("source_rank"), F.col("ord").cast("long").alias("ord")
    )


def text_file_documents(spark: SparkSession, directory: str, rank: int = 0) -> DataFrame:
    """Documents of a directory of UTF-8 `*.txt` files; a missing directory is an error."""
    try:
        files = read_text_files(spark, directory)
    except AnalysisException as err:
        raise SourceUnavailable(f"{directory} is not a directory") from err
    return documents_of_files(files, rank)


def correction_lines(
    files: DataFrame, rank: int = 0, profile: MarkProfile = ROMANIAN
) -> DataFrame:
    """Sentences of `(stem, content)` files, one per line, as cleaned documents.

    The id is `stem:line`, counted from 1 over all lines; blank lines and `#` comments are
    left out. Files come in the order of their names: only names are numbered, and a line's
    place is its file's number and its own.
    """
    places = number_rows(files.select("stem").distinct(), ["stem"], "file_no")
    numbered = lookup(files.select("stem", "content"), places, ["stem"])
    lines = numbered.select(
        "stem", "file_no", F.posexplode(words.split_lines(F.col("content"))).alias("p", "l")
    )
    trimmed = lines.select(
        "stem",
        F.col("file_no").cast("long").alias("file_no"),
        (F.col("p") + 1).alias("line_no"),
        words.strip_ws(F.col("l")).alias("text"),
    )
    used = trimmed.filter((F.col("text") != "") & ~F.col("text").startswith(COMMENT))
    return used.select(
        F.concat_ws(":", "stem", "line_no").alias("doc_id"),
        marks.clean_text(F.col("text"), profile).alias("text"),
        F.lit(rank).alias("source_rank"),
        (F.shiftleft("file_no", _LINES_PER_FILE_BITS) + F.col("line_no")).alias("ord"),
        "stem",
        "line_no",
    )


def correction_documents(
    spark: SparkSession, directory: str, rank: int = 0, profile: MarkProfile = ROMANIAN
) -> DataFrame:
    """Corrections of a directory; a missing directory gives none."""
    try:
        files = read_text_files(spark, directory).select(file_stem().alias("stem"), "content")
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        files = spark.createDataFrame([], "stem STRING, content STRING")
    return correction_lines(files, rank, profile)


def chain(*sources: DataFrame | None) -> DataFrame:
    """Sources one after another; absent ones are skipped.

    `source_rank` is the place in the chain. A source that is a chain itself takes as many places
    as it has ranks (kept with the column), so that its own order and the uniqueness of
    `(source_rank, ord)` stay. The result has the columns that all sources have.
    """
    present = [s for s in sources if s is not None]
    if not present:
        raise ValueError("a chain needs at least one source")
    shared = [c for c in present[0].columns if all(c in s.columns for s in present)]
    ranked, first = [], 0
    for source in present:
        inner = source.schema["source_rank"].metadata.get(RANKS)
        place = F.lit(first) if inner is None else F.col("source_rank") + first
        ranked.append(source.withColumn("source_rank", place.cast("int")).select(*shared))
        first += 1 if inner is None else inner
    whole = reduce(DataFrame.unionByName, ranked)
    return whole.withMetadata("source_rank", {RANKS: first})
