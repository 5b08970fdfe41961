"""Web archives: writing captures as WARC records, reading archives back, one row per capture.

A capture is a response (or a revisit of an equal payload), its request and its metadata record,
tied together by `WARC-Concurrent-To`. Archives are written by Spark's own text writer, with the
carriage return and line feed that end a record as its separator, so they reach any store Spark
writes to, and a task that is repeated leaves no second copy.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from markspark.llm.common import join_groups
from markspark.storage import materialize

END = "\r\n"
DATE = "2024-01-01T00:00:00Z"
LEAST_REVISIT = 100
RECORDS_PER_FILE = 3000
"""Bounds an archive: three records a capture."""
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD_SCHEMA = (
    "record_id STRING, type STRING, concurrent_to STRING, target_uri STRING, warc_date STRING, "
    "content_type STRING, payload_digest STRING, http_status STRING, payload_length LONG, "
    "content BINARY"
)


def _safe(value: Column) -> Column:
    """A header's value holds no line ends."""
    return F.regexp_replace(value, "[\\r\\n]", " ")


def _record(kind: str | Column, headers: list[Column], block: Column) -> Column:
    """One record without its last line end. Null headers are left out."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind)]
    lines += [*headers, F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(END, *lines), F.lit(END * 2), block, F.lit(END))


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(name + ": "), value)


def mark_revisits(
    pages: DataFrame, id_col: str, payload_col: str, least: int = LEAST_REVISIT
) -> DataFrame:
    """Adds `_digest, _bytes, _first`: of equal payloads of `least` bytes the smallest id."""
    payload = F.coalesce(payload_col, F.lit(""))
    rows = pages.withColumns(
        {
            "_payload": payload,
            "_digest": F.sha2(payload.cast("binary"), 256),
            "_bytes": F.octet_length(payload).cast("long"),
        }
    )
    facts = rows.select(F.col(id_col).alias("_id"), "_digest", "_bytes")
    groups = (
        facts.groupBy("_digest")
        .agg(
            F.count("*").alias("_size"),
            F.min(F.struct(F.col("_id").isNull(), "_id"))["_id"].alias("_first"),
            F.max("_bytes").alias("_most"),
        )
        .filter((F.col("_most") >= least) & (F.col("_size") > 1))
        .drop("_most")
    )
    groups = materialize(groups, "payload-groups")
    return join_groups(rows, groups, ["_digest"], "_size", facts.count())


def warc_records(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html"
) -> DataFrame:
    """Column `value`: three records for each page, as text."""
    source = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(payload_col).alias("html")
    )
    marked = mark_revisits(source, "page_id", "html")
    # ids are made once for a row; all three records come from that row
    rows = marked.withColumns({f"_{k}": F.expr("uuid()") for k in ("main", "request", "metadata")})
    known = F.col("_first").isNotNull() & F.col("page_id").isNotNull()
    revisit = known & (F.col("page_id") != F.col("_first")) | (
        F.col("_first").isNotNull() & F.col("page_id").isNull()
    )
    urn = lambda c: F.concat(F.lit("<urn:uuid:"), F.col(c), F.lit(">"))
    uri, date = _header("WARC-Target-URI", _safe(F.col("url"))), F.lit(f"WARC-Date: {DATE}")
    # the scheme and host go into the request's first lines
    path = F.regexp_replace(F.regexp_extract(F.coalesce("url", F.lit("")), "://[^/?#]*([^#]*)", 1), "\\s", "%20")
    host = F.regexp_replace(F.regexp_extract(F.coalesce("url", F.lit("")), "://([^/?#]*)", 1), "\\s", "")
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
        F.col("_bytes").cast("string"),
        F.lit(END * 2),
    )
    request = F.concat(
        F.lit("GET "), F.when(path == "", "/").otherwise(path),
        F.lit(f" HTTP/1.1{END}Host: "), host, F.lit(END * 2),
    )
    fields = F.concat_ws(END, _header("page_id", F.col("page_id").cast("string")), F.lit(""))
    main = _record(
        F.when(revisit, "revisit").otherwise("response"),
        [
            _header("WARC-Record-ID", urn("_main")), uri, date,
            F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
            _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "_digest")),
            F.lit("Content-Type: application/http; msgtype=response"),
        ],
        F.concat(http, F.when(revisit, "").otherwise(F.col("_payload"))),
    )
    side = lambda kind, content_type, block: _record(
        F.lit(kind),
        [
            _header("WARC-Record-ID", urn(f"_{kind}")), uri, date,
            _header("WARC-Concurrent-To", urn("_main")),
            F.lit(f"Content-Type: {content_type}"),
        ],
        block,
    )
    asked = side("request", "application/http; msgtype=request", request)
    told = side("metadata", "application/warc-fields", fields)
    return rows.select(F.explode(F.array(main, asked, told)).alias("value"))


def write_warc(records: DataFrame, path: str) -> None:
    """Archives `path/*.txt.gz`, a few thousand records each."""
    (
        records.write.option("lineSep", END)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", RECORDS_PER_FILE)
        .text(path)
    )


def parse_warc(content: bytes) -> Iterator[dict]:
    """The records of one archive, plain or compressed in one or many members."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    at = 0
    while (at := content.find(b"WARC/", at)) >= 0:
        stop = content.find(b"\r\n\r\n", at)
        if stop < 0:
            raise ValueError("an archive ends inside a record's header")
        lines = content[at:stop].decode("utf-8", "replace").split(END)[1:]
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start, length = stop + 4, int(head["content-length"])
        if start + length > len(content):
            raise ValueError("an archive ends inside a record's block")
        yield head | {"block": content[start : start + length]}
        at = start + length


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
    kinds = {"payload_length": pa.int64(), "content": pa.binary()}
    schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])

    def row(head: dict) -> dict:
        block, out = head["block"], {"http_status": None, "payload_length": None}
        if head.get("content-type", "").startswith("application/http"):
            http, _, body = block.partition(b"\r\n\r\n")
            first, *lines = http.decode("utf-8", "replace").split(END)
            out["http_status"], block = first, body
            for name, _, value in (x.partition(":") for x in lines):
                if name.lower() == "content-length":
                    out["payload_length"] = int(value)
        return out | {
            "record_id": head.get("warc-record-id"),
            "type": head.get("warc-type"),
            "concurrent_to": head.get("warc-concurrent-to"),
            "target_uri": head.get("warc-target-uri"),
            "warc_date": head.get("warc-date"),
            "content_type": head.get("content-type"),
            "payload_digest": head.get("warc-payload-digest"),
            "content": block,
        }

    for batch in batches:
        for content in batch.column("content"):
            rows, size = [], 0
            for head in parse_warc(content.as_py() or b""):
                rows.append(row(head))
                size += len(rows[-1]["content"])
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under `path`. `content` is the block, of HTTP blocks
    the body; `payload_length` is what the HTTP header says, also of a body left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(_read_batches, RECORD_SCHEMA)


def assemble_captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: `record_id, main, request, metadata` (structs).

    `main` is the response or revisit; request and metadata are joined to it by `concurrent_to`.
    Any of those two may be missing (null). Of several, the one with the smallest record id is
    taken. Records without an id, and those tied to no response, are no captures. `records` may
    hold any further columns.
    """
    columns = [c for c in records.columns if c not in ("record_id", "concurrent_to")]
    main = records.filter("type IN ('response', 'revisit') AND record_id IS NOT NULL").select(
        "record_id", F.struct(*columns).alias("main")
    )

    def side(kind: str) -> DataFrame:
        rows = records.filter((F.col("type") == kind) & F.col("concurrent_to").isNotNull())
        nested = F.struct("record_id", *columns)
        return rows.groupBy(F.col("concurrent_to").alias("record_id")).agg(
            F.min_by(nested, "record_id").alias(kind)
        )

    return main.join(side("request"), "record_id", "left").join(
        side("metadata"), "record_id", "left"
    )



def revisits_by_digest(captures: DataFrame) -> DataFrame:
    """Adds `refers_to`: for a revisit, the page whose response has the same payload digest.

    `captures` has `page_id, payload_digest, record_type`. Of several such responses the smallest
    id is taken; a revisit without any refers to null.
    """
    captures = materialize(captures, "captures")
    targets = captures.groupBy("payload_digest").agg(
        F.count("*").alias("_size"),
        F.min(F.when(F.col("record_type") == "response", F.col("page_id"))).alias("_target"),
        F.max(F.when(F.col("record_type") == "revisit", F.lit(1))).alias("_revisited"),
    )
    targets = targets.filter("_revisited = 1").drop("_revisited")
    revisits = captures.filter("record_type = 'revisit'")
    found = join_groups(revisits, targets, ["payload_digest"], "_size", captures.count())
    found = found.withColumn("refers_to", F.col("_target")).drop("_size", "_target")
    others = captures.filter("record_type <> 'revisit'")
    return found.unionByName(others, allowMissingColumns=True)
