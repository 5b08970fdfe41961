"""Streams of documents and lines.

Every job takes a streaming DataFrame and writes to folders that the caller names on shared
storage. Filtering needs no state at all. Restoring and measuring run per micro-batch with
the batch operators, and each batch writes its own folder, so that a batch that is run again
after a failure replaces its earlier output instead of adding to it. What has to be known of
earlier batches is state: running counts lie in the query's state store, and the number of lines
so far lies beside each batch's output. Both go on where they were after a restart.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from markspark.operators import corpus, evaluation, lexicon
from markspark.operators.lookup import lookup
from markspark.operators.ordering import ROW_BITS
from markspark.language import ROMANIAN, MarkProfile
from markspark.settings import CorpusSettings

STATE = "_firsts"
"""Names with a leading underscore are no data to Spark's readers."""
FIRSTS = "part LONG, first LONG"


def line_stream(spark: SparkSession, directory: str, max_files: int | None = None) -> DataFrame:
    """`value, file`: lines of text files that arrive in a directory."""
    reader = spark.readStream
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(directory).select("value", F.col("_metadata.file_path").alias("file"))


def filter_stream(
    documents: DataFrame, settings: CorpusSettings, profile: MarkProfile = ROMANIAN
) -> DataFrame:
    """Usable documents with their split, one row at a time. Streams know no document limit."""
    unlimited = corpus.filtered(
        documents, settings.min_doc_chars, settings.min_mark_ratio, 0, profile
    )
    return corpus.with_split(unlimited, settings.valid_every)


def write_filtered(documents: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Append usable documents as Parquet, partitioned by split, until the input is used up."""
    return (
        documents.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .partitionBy("split")
        .trigger(availableNow=True)
        .start(output)
    )


def _per_batch(
    stream: DataFrame,
    step: Callable[[DataFrame], DataFrame],
    output: str,
    checkpoint: str,
) -> StreamingQuery:
    def run(batch: DataFrame, batch_id: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


Restorer = Callable[[DataFrame], DataFrame]


def word_restorer(dictionary: DataFrame, text: str, profile: MarkProfile = ROMANIAN) -> Restorer:
    """A restorer that measures and sends the dictionary once, for all batches."""
    known = lexicon.loaded(dictionary)
    return lambda batch: lexicon.restore_frequent(
        batch, dictionary, text=text, profile=profile, known=known
    )


def restore_stream(
    documents: DataFrame,
    model: DataFrame | Restorer,
    output: str,
    checkpoint: str,
    profile: MarkProfile = ROMANIAN,
) -> StreamingQuery:
    """Restore each batch's documents: `model` is a dictionary, or any function from documents to
    documents with `restored`, such as `models.load_restorer` gives."""
    restore = model if callable(model) else word_restorer(model, "text", profile)
    return _per_batch(documents, restore, output, checkpoint)


def restore_line_stream(
    lines: DataFrame,
    model: DataFrame | Restorer,
    output: str,
    checkpoint: str,
    profile: MarkProfile = ROMANIAN,
) -> StreamingQuery:
    """Line in, restored line out: the columns stay, `restored` and `line_no` are added.

    `model` is a dictionary, or any function from documents (`text`) to documents with `restored`,
    such as `models.load_restorer` gives. Lines are restored where they lie; inside a batch, `line_no`
    ascends in the order in which they were read (file by file, without being consecutive).
    `restored_lines` reads the output with consecutive numbers over all batches and restarts.
    """
    restore = model if callable(model) else word_restorer(model, "text", profile)

    def run(batch: DataFrame, batch_id: int) -> None:
        numbered = batch.withColumn("line_no", F.monotonically_increasing_id())
        restored = restore(numbered.withColumnRenamed("value", "text"))
        path = f"{output}/batch={batch_id}"
        restored.withColumnRenamed("text", "value").write.mode("overwrite").parquet(path)
        _write_firsts(batch.sparkSession, output, batch_id)

    return (
        lines.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _write_firsts(spark: SparkSession, output: str, batch_id: int) -> None:
    """Notes which number the first line of each of a batch's partitions has, and in a row without
    partition, which the next batch's first line has. Of earlier batches only the last is read."""
    so_far = 0
    if batch_id > 0:
        before = spark.read.schema(FIRSTS).parquet(f"{output}/{STATE}/batch={batch_id - 1}")
        so_far = before.filter("part is null").first()["first"]
    written = spark.read.parquet(f"{output}/batch={batch_id}")
    sizes = written.groupBy(F.shiftrightunsigned("line_no", ROW_BITS).alias("part")).agg(
        F.count("*").alias("n")
    )
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    firsts = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    end = sizes.agg(F.lit(None).cast("long").alias("part"), F.coalesce(F.sum("n"), F.lit(0)).alias("first"))
    state = firsts.unionByName(end).withColumn("first", F.col("first") + so_far)
    state.coalesce(1).write.mode("overwrite").parquet(f"{output}/{STATE}/batch={batch_id}")


def restored_lines(spark: SparkSession, output: str) -> DataFrame:
    """The output of `restore_line_stream`, its lines numbered from 0 over all batches, in the order
    of the batches. Repeated and restarted batches do not change the numbers of others."""
    firsts = spark.read.schema(f"{FIRSTS}, batch LONG").parquet(f"{output}/{STATE}")
    firsts = firsts.filter("part is not null").withColumnRenamed("part", "_part")
    rows = spark.read.parquet(output).withColumn("batch", F.col("batch").cast("long"))
    rows = rows.withColumn("_part", F.shiftrightunsigned("line_no", ROW_BITS))
    row = F.col("line_no").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    numbered = lookup(rows, firsts, ["batch", "_part"])
    return numbered.withColumn("line_no", F.col("first") + row).drop("_part", "first")


def metrics_stream(
    texts: DataFrame,
    output: str,
    checkpoint: str,
    by: Sequence[str] = (),
    profile: MarkProfile = ROMANIAN,
) -> StreamingQuery:
    """Append each batch's tallies; `merged_tallies` sums them up."""
    return _per_batch(
        texts, lambda batch: evaluation.tallies(batch, by=by, profile=profile), output, checkpoint
    )


def running_metrics_stream(
    texts: DataFrame,
    output: str,
    checkpoint: str,
    by: Sequence[str] = (),
    profile: MarkProfile = ROMANIAN,
) -> StreamingQuery:
    """Tallies over everything read so far, kept in the state store by group and code.

    Each batch writes the totals that it changed; `running_tallies` gives the last one of each. The
    state is at most eleven numbers a group, however much was read.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    return (
        evaluation.tallies(texts, by=by, profile=profile)
        .writeStream.foreachBatch(run)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def running_tallies(spark: SparkSession, output: str, by: Sequence[str] = ()) -> DataFrame:
    """The totals after the last batch."""
    parts = spark.read.parquet(output)
    return parts.groupBy(*by, "code").agg(F.max_by("n", "batch").alias("n"))


def merged_tallies(spark: SparkSession, output: str, by: Sequence[str] = ()) -> DataFrame:
    parts = spark.read.parquet(output)
    return parts.groupBy(*by, "code").agg(F.sum("n").alias("n"))
