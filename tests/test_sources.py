import gzip
import zlib

import pytest
from pyspark.sql import functions as F

from markspark.operators.ordering import first_rows
from markspark.sources import documents as sources
from markspark.sources import lines, sinks
from markspark.sources.documents import SourceUnavailable


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_parquet_documents_in_path_and_row_order(spark, tmp_path):
    for name, start in (("b", 0), ("a", 100)):
        rows = [(start + i, f"t{start + i}", "http://x") for i in range(100)]
        df = spark.createDataFrame(rows, "id LONG, text STRING, url STRING").coalesce(1)
        df.write.parquet(str(tmp_path / name))
    docs = sources.parquet_documents(spark, [str(tmp_path / "b"), str(tmp_path / "a")])
    assert docs.columns == ["doc_id", "text", "source_rank", "ord"]
    assert [r.doc_id for r in docs.orderBy("ord").collect()] == [str(i) for i in range(200)]
    plan = docs._jdf.queryExecution().executedPlan().toString()
    assert "url" not in plan


def test_parquet_documents_sample_by_id(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(500).select("id", F.lit("x").alias("text")).write.parquet(path)
    docs = sources.parquet_documents(spark, path, every=4)
    want = {str(i) for i in range(500) if zlib.crc32(str(i).encode()) % 4 == 0}
    assert {r.doc_id for r in docs.collect()} == want


def test_a_million_file_names_are_ranked_and_sent(spark, tmp_path):
    """Names are numbered in parallel; texts are not moved to learn their file's place."""
    n = 1_000_000
    names = spark.range(n, numPartitions=8).select(
        (F.col("id") % 3).cast("int").alias("path_no"),
        F.format_string("s3a:/corpus/part=%d/%012d.parquet", F.col("id") % 3, F.col("id")).alias("name"),
    )
    ranks = sources.ranked_names(names.unionByName(names.withColumn("path_no", F.lit(9))))
    texts = names.select(sources.name_key("name").alias("_key"), "name")
    placed = sources.lookup(texts, ranks, ["_key"], sources.FILES_AT_ONCE, 16 * sources.FILES_AT_ONCE)
    assert "Exchange hashpartitioning" not in placed._jdf.queryExecution().executedPlan().toString()
    number = F.substring_index(F.substring_index("name", "/", -1), ".", 1).cast("long")
    thirds = F.floor(number / 3) + F.when(number % 3 == 0, 0).when(
        number % 3 == 1, (n + 2) // 3
    ).otherwise((n + 2) // 3 + (n + 1) // 3)
    assert placed.filter(F.coalesce(F.col("rank"), F.lit(-1)) != thirds).isEmpty()


def test_odd_file_names_keep_their_order(spark, tmp_path):
    folder = tmp_path / "a b%20c"
    for name in ("z+1", "é 2", "a%"):
        rows = spark.createDataFrame([(name, "t")], "id STRING, text STRING")
        rows.coalesce(1).write.parquet(str(folder / name))
    docs = sources.parquet_documents(spark, [str(folder / n) for n in ("é 2", "a%", "z+1")])
    assert [r.doc_id for r in docs.orderBy("ord").collect()] == ["é 2", "a%", "z+1"]


def test_missing_sources(spark, tmp_path):
    with pytest.raises(SourceUnavailable):
        sources.parquet_documents(spark, str(tmp_path / "none"))
    with pytest.raises(SourceUnavailable):
        sources.text_file_documents(spark, str(tmp_path / "none"))
    with pytest.raises(SourceUnavailable):
        lines.text_lines(spark, str(tmp_path / "none.gz"))
    assert sources.correction_documents(spark, str(tmp_path / "none")).count() == 0
    spark.range(3).write.parquet(str(tmp_path / "bad"))
    with pytest.raises(SourceUnavailable):
        sources.parquet_documents(spark, str(tmp_path / "bad"))


def test_line_dump(spark, tmp_path):
    path = tmp_path / "dump.gz"
    content = b"".join(f"  line {i} \n".encode() for i in range(49)) + b"\xff bad\n"
    content += b"".join(b"\n" if i % 10 == 0 else f"l{i}\n".encode() for i in range(50, 157))
    with gzip.open(path, "wb") as f:
        f.write(content)
    docs = {r.doc_id: r for r in lines.line_documents(spark, str(path), every=1).collect()}
    assert sorted(docs) == ["subtitles:0", "subtitles:1", "subtitles:2"]
    first = docs["subtitles:0"].text.split("\n")
    assert first[0] == "line 0" and first[49] == "� bad" and len(first) == 50
    assert docs["subtitles:1"].text.split("\n")[:2] == ["", "l51"]
    sampled = {r.doc_id for r in lines.line_documents(spark, str(path), every=2).collect()}
    assert sampled == {d for d in docs if zlib.crc32(d.encode()) % 2 == 0}


def test_lines_are_numbered_where_they_are_read(spark, tmp_path):
    """Many small splits and batches; a filter does not change the numbers; nothing is shuffled before
    the sample; files that change in between are noticed."""
    content = [f"{i} " + "x" * (i * 7 % 90) for i in range(3_000)]
    for k in range(3):
        (tmp_path / f"{k}.txt").write_text("\n".join(content[k * 1_000 : (k + 1) * 1_000]) + "\n")
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")
    old = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ("5000", "7")):
        spark.conf.set(n, v)
    try:
        numbered = lines.numbered_lines(spark, str(tmp_path))
        got = sorted((r.line_no, r.value) for r in numbered.collect())
        assert got == list(enumerate(content))
        some = {r.line_no for r in numbered.filter("value LIKE '%7 %'").collect()}
        assert some == {i for i, t in enumerate(content) if "7 " in t}
        plan = lines.line_chunks(numbered, every=4)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "crc32" in plan[plan.index("Exchange") :]
        spark.conf.set(names[0], "6001")
        with pytest.raises(Exception, match="changed while they were read"):
            numbered.select("line_no").collect()
    finally:
        for n, v in zip(names, old):
            spark.conf.set(n, v)


def test_line_numbers_over_splits_and_files(spark, tmp_path):
    paths, want = [], []
    for name, n in (("z.txt", 4_000), ("a.txt", 1_500), ("m.txt", 1)):
        path = tmp_path / name
        texts = [f"{name} {i} " + "x" * (i % 40) for i in range(n)]
        path.write_text("\n".join(texts) + "\n")
        paths.append(str(path))
        want += texts
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        numbered = lines.numbered_lines(spark, paths)
        got = sorted((r.line_no, r.value) for r in numbered.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == list(enumerate(want))


def test_text_files(spark, tmp_path):
    for name, text in (("b.txt", "două\nlinii"), ("a b.txt", "unu"), ("note.md", "nu")):
        (tmp_path / name).write_text(text, encoding="utf-8")
    docs = sources.text_file_documents(spark, str(tmp_path))
    assert [(r.doc_id, r.text) for r in docs.orderBy("ord").collect()] == [
        ("a b", "unu"), ("b", "două\nlinii")
    ]


def test_corrections(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# no\n\n  Şi așa. \nzăpadă\n", encoding="utf-8")
    (tmp_path / "README.md").write_text("not a sentence")
    docs = sources.correction_documents(spark, str(tmp_path))
    assert rows_of(docs, "doc_id", "text") == [("a:3", "Și așa."), ("a:4", "zăpadă")]


def test_chains_in_chains_keep_their_order(spark, docs):
    files = spark.createDataFrame([("b", "doi\ntrei"), ("a", "unu")], "stem STRING, content STRING")
    fixes = sources.correction_lines(files)
    inner = sources.chain(docs("a0", "a1"), docs("b0"))
    chained = sources.chain(inner, None, sources.chain(fixes, docs("d0")), docs("e0"))
    order = [r.text for r in chained.orderBy("source_rank", "ord").collect()]
    assert order == ["a0", "a1", "b0", "unu", "doi", "trei", "d0", "e0"]
    assert chained.columns == list(sources.COLUMNS)
    assert chained.select("source_rank", "ord").distinct().count() == len(order)
    assert [r.text for r in first_rows(chained, 3).orderBy("source_rank", "ord").collect()] == order[:3]


def test_chain_keeps_the_order_of_its_sources(docs):
    chained = sources.chain(docs("a", "b"), None, docs("c", start=7))
    assert rows_of(chained, "source_rank", "ord", "text") == [(0, 0, "a"), (0, 1, "b"), (1, 7, "c")]
    with pytest.raises(ValueError):
        sources.chain(None)


def test_summary_and_alphabet_files(spark, tmp_path):
    location = str(tmp_path)
    assert sinks.read_summary(spark, location, "s") is None
    assert sinks.read_alphabet(spark, location) is None
    sinks.write_summary(spark, {"a": 0.5}, location, "s")
    sinks.write_alphabet(spark, " aș", location)
    assert sinks.read_summary(spark, location, "s") == {"a": 0.5}
    assert sinks.read_alphabet(spark, location) == " aș"


def test_corpus_of_the_settings(spark, tmp_path):
    from markspark.plans.dataset import corpus_source, fit_context
    from markspark.settings import CorpusSettings, ModelSettings, Settings

    for name in ("wiki", "web"):
        rows = [(f"{name}{i}", f"casă {name} {i}") for i in range(40)]
        spark.createDataFrame(rows, "id STRING, text STRING").coalesce(1).write.parquet(str(tmp_path / name))
    with gzip.open(tmp_path / "lines.txt.gz", "wt") as f:
        f.write("".join(f"linia {i}\n" for i in range(200)))
    chosen = Settings(
        corpus=CorpusSettings(lines_every=1, web_every=2), model=ModelSettings(context_sizes=(2, 0))
    )
    docs = corpus_source(
        spark, chosen, [str(tmp_path / "wiki")], [str(tmp_path / "lines.txt.gz")], [str(tmp_path / "web")]
    )
    by_rank = {r.source_rank: r["count"] for r in docs.groupBy("source_rank").count().collect()}
    assert by_rank[0] == 40 and by_rank[1] == 4 and 0 < by_rank[2] < 40
    assert {r.k for r in fit_context(docs, chosen).select("k").distinct().collect()} == {2, 0}
