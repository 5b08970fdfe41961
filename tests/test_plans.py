import dataclasses

import pytest
from pyspark.sql import functions as F

from markspark.operators import context, lexicon
from markspark.operators.lookup import lookup
from markspark.plans import dataset, evaluate, queries
from markspark.settings import CorpusSettings, ModelSettings, Settings, WindowSettings
from markspark.sources import documents as sources
from markspark.sources import sinks
from markspark.storage import (
    BUILDING,
    _record,
    current_build,
    materialize,
    new_path,
    remove_intermediate,
    shared_folder,
)
from markspark.streaming import jobs

SENTENCES = [
    "Și dacă țara după așa, fără casă când și ea.",
    "În țară când este așa, într-o casă fără apă și după masă.",
]
TINY = Settings(
    corpus=CorpusSettings(min_doc_chars=20, valid_every=2),
    windows=WindowSettings(vocab_size=64, window=16, overlap=4),
    model=ModelSettings(corrections_repeat=3),
)


@pytest.fixture
def corpus_docs(docs):
    return docs(*[" ".join(SENTENCES) * 3] * 8)


def test_build_is_skipped_when_nothing_changed(spark, corpus_docs, docs, tmp_path):
    directory = str(tmp_path / "d")
    first = dataset.build_dataset(spark, corpus_docs, directory, TINY)
    assert first.rebuilt and current_build(spark, directory) == first.location
    again = dataset.build_dataset(spark, corpus_docs.repartition(3), directory, TINY)
    assert not again.rebuilt and again.location == first.location
    other = dataclasses.replace(TINY, corpus=dataclasses.replace(TINY.corpus, valid_every=3))
    changed = dataset.build_dataset(spark, corpus_docs, directory, other)
    assert changed.rebuilt and changed.location != first.location
    rows = sinks.split_rows(spark, first.location, "train")
    assert rows == sinks.open_split(spark, first.location, "train").count() > 0
    assert sinks.split_rows(spark, first.location, "never") == 0


def test_another_corpus_is_another_build(spark, corpus_docs, docs, tmp_path):
    directory = str(tmp_path / "d")
    first = dataset.build_dataset(spark, corpus_docs, directory, TINY)
    other = docs(*[" ".join(reversed(SENTENCES)) * 3] * 8)
    assert dataset.build_dataset(spark, other, directory, TINY).rebuilt
    # a name given for the corpus is taken at its word
    assert dataset.build_dataset(spark, other, directory, TINY, source="v2").rebuilt
    assert not dataset.build_dataset(spark, corpus_docs, directory, TINY, source="v2").rebuilt
    broken = other.withColumn("text", F.raise_error(F.lit("broken")).cast("string"))
    last = current_build(spark, directory)
    with pytest.raises(Exception, match="broken"):
        dataset.build_dataset(spark, broken, directory, TINY, source="v3")
    assert current_build(spark, directory) == last != first.location


def test_intermediate_tables_can_be_removed(spark, corpus_docs):
    kept = materialize(corpus_docs.select("doc_id"))
    assert kept.count() == 8 and new_path(spark, "x").startswith(shared_folder(spark))
    remove_intermediate(spark)
    with pytest.raises(Exception):
        kept.count()


def test_interrupted_build_is_never_adopted(spark, corpus_docs, tmp_path):
    directory = str(tmp_path / "d")
    with pytest.raises(Exception, match="broken"):
        broken = corpus_docs.withColumn("text", F.raise_error(F.lit("broken")).cast("string"))
        dataset.build_dataset(spark, broken, directory, TINY)
    assert current_build(spark, directory) is None
    assert dataset.build_dataset(spark, corpus_docs, directory, TINY).rebuilt


def test_complete_data_without_a_stamp_is_adopted(spark, corpus_docs, tmp_path):
    built = dataset.build_dataset(spark, corpus_docs, str(tmp_path / "d"), TINY).location
    assert not dataset.build_dataset(spark, corpus_docs, built, TINY).rebuilt
    smaller = dataclasses.replace(TINY, windows=WindowSettings(64, 8, 2))
    assert not sinks.is_complete(spark, built, smaller.windows.window)
    # more rows written than noted: not whole
    other = dataset.build_dataset(spark, corpus_docs, str(tmp_path / "e"), TINY).location
    extra = spark.read.schema(sinks.WINDOW_SCHEMA).parquet(f"{other}/windows").limit(1)
    extra.write.mode("append").partitionBy("split").parquet(f"{other}/windows")
    assert dataset.build_dataset(spark, corpus_docs, other, TINY).rebuilt


def test_partial_marker_forces_a_rebuild(spark, corpus_docs, tmp_path):
    built = dataset.build_dataset(spark, corpus_docs, str(tmp_path / "d"), TINY).location
    _record(spark, built, 1, BUILDING, "", built)
    assert dataset.build_dataset(spark, corpus_docs, built, TINY).rebuilt


def test_corrections_are_mixed_into_training(spark, corpus_docs, tmp_path):
    location = dataset.build_dataset(spark, corpus_docs, str(tmp_path / "d"), TINY).location
    known = tmp_path / "corrections"
    none = sources.correction_documents(spark, str(known))
    assert dataset.build_corrections(spark, none, location, TINY) == 0
    train = sinks.split_rows(spark, location, "train")
    assert dataset.training_windows(spark, location, TINY).count() == train
    known.mkdir()
    (known / "known.txt").write_text(
        "# known\n\nPe câmp erau flori.\nMama ei a cules o floare.\n", encoding="utf-8"
    )
    rows = dataset.build_corrections(
        spark, sources.correction_documents(spark, str(known)), location, TINY
    )
    assert rows == 4  # windows of 16: each sentence spans two
    assert dataset.training_windows(spark, location, TINY).count() == train + 3 * rows


def test_baseline_is_cached_with_the_build(spark, corpus_docs, tmp_path):
    location = dataset.build_dataset(spark, corpus_docs, str(tmp_path / "d"), TINY).location
    summary = evaluate.baseline(spark, location, TINY)
    assert 0.95 < summary["candidate_accuracy"] < 1.0  # țara and țară share a key
    sinks.write_summary(spark, {"kept": 1}, location, "baseline")
    assert evaluate.baseline(spark, location, TINY) == {"kept": 1}


def test_settings_report_all_problems_at_once():
    with pytest.raises(ValueError) as err:
        Settings(
            corpus=CorpusSettings(valid_every=1, min_mark_ratio=2),
            windows=WindowSettings(vocab_size=300, overlap=256),
        )
    for part in ("valid_every", "min_mark_ratio", "vocab_size", "overlap"):
        assert part in str(err.value)


def test_settings_from_environment_and_overrides():
    env = {"WINDOW": "128", "MIN_MARK_RATIO": "0.1", "VALID_EVERY": "7"}
    settings = Settings.from_env(env, valid_every=9)
    assert settings.windows.window == 128
    assert settings.corpus.min_mark_ratio == 0.1 and settings.corpus.valid_every == 9
    assert Settings.from_env({}) == Settings()
    with pytest.raises(ValueError, match="WINDOW"):
        Settings.from_env({"WINDOW": "x"})
    with pytest.raises(ValueError, match="unknown"):
        Settings.from_env({}, widnow=3)


def test_shared_folder_is_the_sessions(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


# --- plans that must not change ---------------------------------------------------------------


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_restored_where_they_lie(spark, corpus_docs, tmp_path):
    forms = lexicon.fit(corpus_docs)
    letters = context.train(context.context_rows(corpus_docs.select("doc_id", "text")))
    for out in (
        lexicon.restore_frequent(corpus_docs, forms),
        context.restore_context(corpus_docs, materialize(letters, "contexts")),
    ):
        plan = plan_of(out)
        assert "Exchange" not in plan and "Generate" not in plan


def exchanges_above_text(df):
    """The shuffles that rows with a column `text` go through."""
    found = []

    def walk(node, above):
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return walk(node.initialPlan(), above)
        name = node.nodeName()
        if "Exchange" in name:
            above = [*above, node.simpleString(200)]
        if "Scan" in name and "text#" in node.output().toString():
            found.append(above)
        for i in range(node.children().size()):
            walk(node.children().apply(i), above)

    walk(df._jdf.queryExecution().executedPlan(), [])
    return found


def test_texts_stay_where_they_lie_under_a_large_model(spark, corpus_docs, tmp_path):
    forms = lexicon.fit(corpus_docs)
    letters = context.train(context.context_rows(corpus_docs.select("doc_id", "text")))
    for out in (
        lexicon.restore_frequent(corpus_docs, forms, max_rows=0),
        context.restore_context(corpus_docs, materialize(letters, "contexts"), max_rows=0),
    ):
        whole, *asking = exchanges_above_text(out)
        assert whole == []  # the rows that come out
        for above in asking:  # what is asked for, and what comes back
            assert above and all("_part" in x or "key" in x for x in above)


def test_form_counts_are_hash_aggregated(corpus_docs):
    plan = plan_of(lexicon.form_counts(corpus_docs))
    assert plan.count("Exchange") == 1 and "SortAggregate" not in plan


def test_large_dictionary_is_not_broadcast(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2)], "k STRING, i LONG")
    table = spark.createDataFrame([("a", "x")], "k STRING, v STRING")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(lookup(left, table, ["k"], max_rows=0))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan


def test_a_hot_key_is_spread_over_the_partitions(spark):
    """One key on nine of ten rows: none of them is shuffled, so they stay spread as they were."""
    left = spark.range(0, 40_000, 1, 8).selectExpr(
        "id", "IF(id % 10 < 9, 'hot', concat('k', id)) AS k"
    )
    table = spark.range(40_000).selectExpr("concat('k', id) AS k", "id AS v")
    table = table.unionByName(spark.createDataFrame([("hot", -1)], "k STRING, v LONG"))
    out = lookup(left, table, ["k"], max_rows=0)
    assert out.count() == 40_000 and out.filter("k = 'hot' AND v = -1").count() == 36_000
    by_part = out.filter("k = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    assert len(by_part) >= 8 and max(r["count"] for r in by_part) <= 2 * 36_000 / 8


def test_split_report_sets_corrections_beside_validation(corpus_docs, docs):
    known = docs("fără", "țară", start=900)
    bare = lambda texts: texts.withColumn("restored", F.translate("text", "ăâîșț", "aaist"))
    as_is = lambda texts: texts.withColumn("restored", F.col("text"))
    report = lambda restore, sentences: {
        r.split: r.candidate_accuracy
        for r in evaluate.split_report(corpus_docs, sentences, restore, 2).collect()
    }
    assert report(as_is, known) == {"valid": 1.0, "corrections": 1.0}
    assert report(bare, known)["corrections"] == 1 / 5  # of ă ă, ț a ă, the a alone
    assert set(report(as_is, known.limit(0))) == {"valid"}


# --- streams ----------------------------------------------------------------------------------


def test_filter_stream(spark, corpus_docs, docs, tmp_path):
    for i, batch in enumerate([corpus_docs, docs("too short", "fara nimic " * 9, start=50)]):
        batch.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(corpus_docs.schema).option("maxFilesPerTrigger", 1).parquet(
        str(tmp_path / "in")
    )
    kept = jobs.filter_stream(stream, TINY.corpus)
    for _ in range(2):  # run again: nothing new, nothing twice
        jobs.write_filtered(kept, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    out = spark.read.schema(kept.schema).parquet(str(tmp_path / "out"))
    assert out.count() == 8 and {r.split for r in out.collect()} == {"train", "valid"}


def test_line_stream_restores_every_line(spark, corpus_docs, tmp_path):
    forms = lexicon.fit(corpus_docs)
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.txt").write_text("dupa masa\n\ndupa masa\n")
    (folder / "2.txt").write_text("Tara si casa\ndupa masa\n")
    stream = jobs.line_stream(spark, str(folder), max_files=1)
    jobs.restore_line_stream(
        stream, forms, str(tmp_path / "out"), str(tmp_path / "cp")
    ).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert {"line_no", "value", "restored"} <= set(out.columns)
    assert sorted((r.value, r.restored) for r in out.collect()) == [
        ("", ""), ("Tara si casa", "Țara și casă"), *[("dupa masa", "după masă")] * 3
    ]


def test_metrics_stream_merges_batches(spark, docs, tmp_path):
    from markspark.operators.evaluation import metrics_summary, summary_of

    texts = docs("casă în țara", "așa", "fără apă").withColumn("restored", F.lit(None))
    texts = texts.withColumn("restored", F.translate("text", "ăâîșț", "ăaist"))
    for row in texts.collect():
        spark.createDataFrame([row], texts.schema).write.mode("append").parquet(
            str(tmp_path / "in")
        )
    stream = spark.readStream.schema(texts.schema).option("maxFilesPerTrigger", 1).parquet(
        str(tmp_path / "in")
    )
    jobs.metrics_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    merged = jobs.merged_tallies(spark, str(tmp_path / "out"))
    assert metrics_summary(merged).first() == summary_of(texts).first()


def test_running_metrics_go_on_after_a_restart(spark, docs, tmp_path):
    from markspark.operators.evaluation import tallies

    texts = docs("casă în țara", "așa", "fără apă", "țară").withColumn("lang", F.col("ord") % 2)
    texts = texts.withColumn("restored", F.translate("text", "ăâîșț", "ăaist"))
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    for i in range(4):  # a run of its own for each text
        texts.filter(F.col("ord") == i).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(texts.schema).parquet(str(tmp_path / "in"))
        jobs.running_metrics_stream(stream, out, checkpoint, ["lang"]).awaitTermination()
        so_far = tallies(texts.filter(F.col("ord") <= i), by=["lang"])
        found = jobs.running_tallies(spark, out, ["lang"])
        assert sorted(found.collect()) == sorted(so_far.select("lang", "code", "n").collect())


def test_line_numbers_go_on_after_a_restart(spark, corpus_docs, tmp_path):
    forms = lexicon.fit(corpus_docs)
    folder, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    folder.mkdir()
    texts = {"1": "dupa masa\n\nsi\n", "2": "Tara si casa\ndupa masa\n", "3": "asa\n", "4": ""}
    for name, text in texts.items():
        (folder / f"{name}.txt").write_text(text)
        stream = jobs.line_stream(spark, str(folder))
        jobs.restore_line_stream(stream, forms, out, checkpoint).awaitTermination()
    found = [r.value for r in jobs.restored_lines(spark, out).orderBy("line_no").collect()]
    assert found == ["dupa masa", "", "si", "Tara si casa", "dupa masa", "asa"]
    numbers = [r.line_no for r in jobs.restored_lines(spark, out).collect()]
    assert sorted(numbers) == list(range(6))
    # the batch before has to be there, or numbers would start at 0 again
    with pytest.raises(Exception):
        jobs._write_firsts(spark, out, 9)


# --- models -----------------------------------------------------------------------------------


def test_models_are_saved_checked_and_loaded(spark, corpus_docs, docs, tmp_path):
    from markspark.operators import context
    from markspark.plans import models

    texts = docs("Si daca tara dupa asa, fara casa cand si ea.")
    frequent, contexts = str(tmp_path / "f"), str(tmp_path / "c")
    models.save_model(spark, frequent, lexicon.fit(corpus_docs), models.ModelConfig("frequent"))
    rows = context.context_rows(corpus_docs.select("doc_id", "text"))
    models.save_model(spark, contexts, context.train(rows), models.ModelConfig("context", 0.6))
    for location in (frequent, contexts):
        restore = models.load_restorer(spark, location)
        assert restore(texts).first().restored == SENTENCES[0]
    with pytest.raises(ValueError, match="holds no model"):
        models.load_restorer(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="labels must be.*|threshold"):
        models.ModelConfig("context", threshold=2, labels=("a",))
    sinks.write_json_row(spark, '{"format_version": 99}', str(tmp_path / "old" / "config"))
    with pytest.raises(ValueError, match="format 99"):
        models.load_config(spark, str(tmp_path / "old"))


def test_only_a_strictly_better_model_replaces_the_best(spark, tmp_path):
    from markspark.plans import models

    def offer(name, accuracy):
        table = spark.createDataFrame([(name, name)], "key STRING, form STRING")
        config = models.ModelConfig("frequent", candidate_accuracy=accuracy)
        best = models.save_if_better(spark, str(tmp_path), table, config)
        return spark.read.parquet(f"{best}/table").first().key

    assert [offer("a", 0.5), offer("b", 0.5), offer("c", 0.7), offer("d", 0.6), offer("e", 0.9)] == [
        "a", "a", "c", "c", "e"
    ]


def test_reports_of_any_restorer(spark, corpus_docs, docs):
    from markspark.functions import marks

    def identity(df):
        return df.withColumn("restored", marks.strip_marks(F.col("text")))

    row = evaluate.evaluate_restorer(corpus_docs, identity, 2, sample=1).first()
    assert row.precision_none < 1.0 and row.recall_none == 1.0
    wrong, totals = evaluate.corrections_report(docs("fără", "bine"), identity)
    assert [tuple(r) for r in wrong.collect()] == [("0", "fara", "fără")]
    assert (totals.first().sentences, totals.first().still_wrong) == (2, 1)


@pytest.mark.parametrize("files", [1, 3])
def test_streams_read_a_file_and_a_folder_of_files(spark, tmp_path, files):
    """The table of documents may be one file, or a folder that Spark wrote."""
    rows = [(i, "Și dacă așa țara " * 20, "ro", "web") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING, source STRING")
    df.repartition(files).write.parquet(str(tmp_path / "written"))
    table = tmp_path / "t" / "documents.parquet"
    table.parent.mkdir()
    if files == 1:
        next((tmp_path / "written").glob("*.parquet")).rename(table)
    else:
        (tmp_path / "written").rename(table)
    (table.parent / "other.parquet").write_text("no table")
    for name in ("stream_restore", "stream_filter"):
        assert queries.QUERIES[name](spark, str(table.parent)).count() == 12
    assert queries.QUERIES["stream_metrics"](spark, str(table.parent)).count() == 1
