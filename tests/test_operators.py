import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from markspark.functions import codec, marks, quality
from markspark.operators import (
    alphabet,
    classifier,
    context,
    corpus,
    evaluation,
    lexicon,
    longtext,
    scoring,
    threshold,
    vectors,
    windows,
)
from markspark.operators.lookup import fits_broadcast, lookup
from markspark.operators.ordering import first_rows, number_rows
from markspark.plans import queries


def pairs(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


# --- order ------------------------------------------------------------------------------------


def test_number_rows_follows_the_order(spark):
    keys = random.Random(1).sample(range(100_000), 3_000)
    df = spark.createDataFrame([(k, f"t{k}") for k in keys], "k LONG, t STRING").repartition(7)
    rows = number_rows(df, ["k"], "n").collect()
    assert {(r.k, r.n) for r in rows} == set(zip(sorted(keys), range(len(keys))))
    assert all(r.t == f"t{r.k}" for r in rows)


@pytest.mark.parametrize("n", [0, 1, 37, 999, 1_500, 2_999, 3_000, 9_999])
def test_first_rows(spark, n):
    rows = [(i % 3, i, "x") for i in range(3_000)]
    df = spark.createDataFrame(rows, "source_rank INT, ord LONG, text STRING").repartition(5)
    want = sorted(rows)[: n or None]
    assert pairs(first_rows(df, n), "source_rank", "ord", "text") == want


def test_filtered_with_a_limit_reads_the_corpus_once(spark, docs, tmp_path):
    good = "și dacă fără după " * 30
    docs(*[good + str(i) for i in range(30)], "bare").write.parquet(str(tmp_path / "c"))
    first = corpus.filtered(spark.read.parquet(str(tmp_path / "c")), limit=7)
    # what comes back was filtered by the pass that wrote it
    assert not [f for f in first.inputFiles() if str(tmp_path / "c") in f]
    assert sorted(r.ord for r in first.collect()) == list(range(7))


def test_filtered_limit_counts_kept_documents(docs):
    good = "Și dacă țara după așa, fără casă când și ea. " * 8
    d = docs(good, "fara nimic " * 40, good, start=1)
    assert [r.doc_id for r in corpus.filtered(d, 200, 0.05, 1).collect()] == ["1"]
    assert pairs(corpus.filtered(d, 200, 0.05, 0), "doc_id") == [("1",), ("3",)]


# --- look-up ----------------------------------------------------------------------------------


def test_lookup_by_shuffle_equals_broadcast_with_a_hot_key(spark):
    rng = random.Random(2)
    keys = ["hot"] * 4_000 + ["hot2"] * 2_000 + [f"k{rng.randrange(900)}" for _ in range(4_000)]
    left = spark.createDataFrame([(i, k) for i, k in enumerate(keys)] + [(-1, None)], "i LONG, k STRING")
    table = spark.createDataFrame(
        [("hot", "H")] + [(f"k{i}", f"v{i}") for i in range(0, 900, 2)], "k STRING, v STRING"
    )
    small = lookup(left, table, ["k"])
    large = lookup(left, table, ["k"], max_rows=0)
    assert small.count() == large.count() == len(keys) + 1
    assert large.columns == ["i", "k", "v"]
    key = lambda r: r.i
    assert [(r.k, r.v) for r in sorted(small.collect(), key=key)] == [
        (r.k, r.v) for r in sorted(large.collect(), key=key)
    ]


def test_fits_broadcast_counts_rows_and_bytes(spark):
    table = spark.createDataFrame([("a" * 100, 1)] * 10, "k STRING, v LONG")
    assert fits_broadcast(table, 10, 10_000)
    assert not fits_broadcast(table, 9, 10_000)
    assert not fits_broadcast(table, 10, 900)


# --- alphabet ---------------------------------------------------------------------------------


def test_alphabet(docs):
    counts = alphabet.char_counts(docs("aaab  c"))
    kept = alphabet.build_alphabet(counts, 4)
    assert pairs(kept, "ch", "char_id") == [(" ", 2), ("a", 3)]
    with pytest.raises(ValueError, match="no room"):
        alphabet.build_alphabet(counts, 2)


def test_alphabet_ties_go_to_the_first_seen(docs):
    counts = alphabet.char_counts(docs("zz", "yx", "xy", "w").repartition(3))
    kept = alphabet.build_alphabet(counts, 4)  # z, y and x occur twice; z and y come first
    assert alphabet.alphabet_string(kept) == "yz"


def test_marks_are_taken_off_while_characters_are_counted(docs):
    texts = docs("bă", "aâ Ș", "😀ș")
    counted = alphabet.char_counts(texts)
    got = {r.ch: (r.n, r.first_seen.doc.ord, r.first_seen.nth) for r in counted.collect()}
    assert got == {
        "b": (1, 0, 0), "a": (3, 0, 1), " ": (1, 1, 2), "S": (1, 1, 3), "😀": (1, 2, 0), "s": (1, 2, 1)
    }


def test_no_text_is_translated_or_written_to_count_characters(spark, monkeypatch, tmp_path):
    rows = [(k, "en", "web", "romana si fara dupa asa cand " * 12) for k in range(12)]
    documents = spark.createDataFrame(rows, "doc_id LONG, lang STRING, source STRING, text STRING")
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    written = []
    monkeypatch.setattr(queries, "materialize", lambda df, name="t": (written.append(name), df)[1])
    queries.sink_alphabet(spark, str(tmp_path)).collect()
    assert "usable" not in written


@pytest.mark.parametrize("min_ratio", [0.0, 0.05])
def test_texts_without_marks_are_dropped_before_letters_are_counted(docs, min_ratio):
    texts = ["plain words only " * 20, "băț și dacă fără " * 20, None, "ţară şi după " * 20, "ă"]
    found = docs(*texts).withColumn("keep", quality.keep_document(F.col("text"), 200, min_ratio))
    ratio = quality.mark_ratio(F.col("text")) >= min_ratio
    slow = ratio & quality.marks_every_letter(F.col("text")) & ~quality.drops_marks(F.col("text"))
    wanted = docs(*texts).withColumn("keep", (F.length("text") >= 200) & slow)
    assert pairs(found, "doc_id", "keep") == pairs(wanted, "doc_id", "keep")
    plan = found._jdf.queryExecution().analyzed().toString()
    assert ("Contains" in plan or "contains" in plan) == (min_ratio > 0)


def test_alphabet_json_round_trip(spark):
    text = alphabet.alphabet_json(" aș")
    assert text == '{"pad_id": 0, "unk_id": 1, "chars": " aș"}'
    assert pairs(alphabet.alphabet_table(spark, text), "ch", "char_id") == [
        (" ", 2), ("a", 3), ("ș", 4)
    ]
    with pytest.raises(ValueError, match="twice"):
        alphabet.alphabet_table(spark, '{"chars": "aa"}')


# --- lexicon ----------------------------------------------------------------------------------


@pytest.mark.parametrize("limits", [{}, {"max_rows": 0}])
def test_restore_frequent(docs, limits):
    d = docs("brânză brânză branza Pâine pâine", "laşi")
    full = lexicon.fit_dictionary(lexicon.form_counts(d))
    assert full.count() == 3
    forms = lexicon.fit(d)
    texts = docs("Branza paine lasi; qq", "BRANZA", "İzmir", "", "?!", "  lasi\n")
    out = lexicon.restore_frequent(texts, forms, **limits)
    assert [r.restored for r in out.orderBy("ord").collect()] == [
        "Brânză pâine lași; qq", "BRÂNZĂ", "İzmir", "", "?!", "  lași\n",
    ]
    assert pairs(out, "doc_id", "text") == pairs(texts, "doc_id", "text")


ODD_ROWS = [("1", "casa"), ("1", "tara"), ("1", "casa"), (None, "casa"), ("2", ""), ("3", None)]


@pytest.mark.parametrize("limits", [{}, {"max_rows": 0}])
def test_restorers_keep_every_row(spark, docs, limits):
    """Equal ids, equal rows, empty and missing texts: one row out for each that goes in."""
    d = docs("casă", "casă", "țară", "țară")
    texts = spark.createDataFrame(ODD_ROWS, "doc_id STRING, text STRING").repartition(3)
    letters = context.train(context.context_rows(d.select("doc_id", "text"))).cache()
    by_word = lexicon.restore_frequent(texts, lexicon.fit(d), **limits)
    by_letter = context.restore_context(texts, letters, **limits)
    marked = {"casa": "casă", "tara": "țară", "": "", None: None}
    want = sorted(((i, t, marked[t]) for i, t in ODD_ROWS), key=repr)
    for out in (by_word, by_letter):
        got = sorted((tuple(r) for r in out.select("doc_id", "text", "restored").collect()), key=repr)
        assert got == want


def test_ties_between_forms_go_to_the_first_seen(docs):
    d = docs("x fata", "fată fată fata", "fața").repartition(3)
    assert ("fata", "fata") in pairs(
        lexicon.fit_dictionary(lexicon.form_counts(d)), "key", "form"
    )


def test_pruned_dictionary_restores_the_same(docs):
    d = docs("casă kelvin bună Ok ǆep bere")
    full = lexicon.fit(d, prune=False)
    pruned = lexicon.fit(d)
    assert pruned.count() < full.count()
    texts = docs("casa Kelvin KELVIN buna oK ǅep bere")
    a = lexicon.restore_frequent(texts, full).first().restored
    assert a == lexicon.restore_frequent(texts, pruned).first().restored
    assert a.startswith("casă Kelvin KELVIN bună")


def test_form_counts_in_any_partitioning(docs):
    d = docs(*["și Și SI dacă"] * 50)
    for parts in (1, 6):
        counts = lexicon.form_counts(d.repartition(parts))
        assert pairs(counts, "key", "form", "n") == [
            ("daca", "dacă", 50), ("si", "si", 50), ("si", "și", 100)
        ]


# --- windows ----------------------------------------------------------------------------------

PLANS = [
    (0, 8, 2, []),
    (5, 8, 2, [(0, 5, 0, 5)]),
    (8, 8, 2, [(0, 8, 0, 8)]),
    (9, 8, 2, [(0, 8, 0, 2), (1, 9, 2, 9)]),
    (14, 8, 2, [(0, 8, 0, 7), (6, 14, 7, 14)]),
    (20, 8, 4, [(0, 8, 0, 6), (4, 12, 6, 10), (8, 16, 10, 14), (12, 20, 14, 20)]),
    (10, 4, 0, [(0, 4, 0, 4), (4, 8, 4, 6), (6, 10, 6, 10)]),
    (7, 3, 1, [(0, 3, 0, 2), (2, 5, 2, 4), (4, 7, 4, 7)]),
]


@pytest.mark.parametrize(("length", "window", "overlap", "want"), PLANS)
def test_plan_windows(spark, length, window, overlap, want):
    plan = spark.range(1).select(windows.plan_windows(F.lit(length), window, overlap).alias("w"))
    assert [tuple(w) for w in plan.first().w] == want


@pytest.mark.parametrize(("window", "overlap"), [(8, 0), (8, 2), (8, 5), (16, 4), (3, 1)])
def test_kept_ranges_partition_every_text(spark, docs, window, overlap):
    texts = ["".join(chr(97 + i % 26) for i in range(n)) for n in range(60)]
    rows = windows.windows_text(docs(*texts).select("doc_id", "text"), window, overlap).collect()
    kept = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.win_no)):
        assert r.piece == texts[int(r.doc_id)][r.start : r.end]
        kept.setdefault(r.doc_id, []).extend(range(r.keep_from, r.keep_to))
    for n in range(1, 60):
        assert kept[str(n)] == list(range(n))


@pytest.mark.parametrize(("window", "overlap"), [(0, 0), (4, 4), (4, -1)])
def test_window_arguments(window, overlap):
    with pytest.raises(ValueError):
        windows.plan_windows(F.lit(9), window, overlap)


def test_windows_train_pads_the_last_row(docs):
    rows = windows.windows_train(docs("casă casă", "c"), " acs", 4, 1).orderBy("doc_id", "win_no")
    got = [(r.doc_id, r.start, r.n, r.input_ids, r.labels) for r in rows.collect()]
    assert got == [
        ("0", 0, 4, [4, 3, 5, 3], [0, 0, 0, 1]),
        ("0", 3, 4, [3, 2, 4, 3], [1, 0, 0, 0]),
        ("0", 6, 3, [3, 5, 3, 0], [0, 0, 1, 0]),
        ("1", 0, 1, [4, 0, 0, 0], [0, 0, 0, 0]),
    ]


def test_window_rows_agree_with_the_column_functions(docs):
    from markspark.functions import codec

    text = "Şi ţara 🙂 한글 âîșțĂ x" * 3
    letters = "".join(sorted(set("Sarat is🙂한Tz")))
    both = windows.windows_train(docs(text, "🙃"), letters, 100, 0).orderBy("doc_id").collect()
    plain = docs(text, "🙃").select(codec.encode_example(F.col("text"), letters).alias("e"))
    for row, example in zip(both, [r.e for r in plain.collect()]):
        n = row.n
        assert row.input_ids == example.input_ids + [0] * (100 - n)
        assert row.labels == example.labels + [0] * (100 - n)


@pytest.mark.parametrize(("window", "overlap"), [(4, 1), (8, 2), (8, 6), (5, 0), (7, 3)])
def test_training_starts(docs, window, overlap):
    """Every full window at a multiple of the stride, and one more for what is left over."""
    stride = window - overlap
    rows = windows.windows_train(docs(*["x" * n for n in range(40)]), "x", window, overlap).collect()
    for n in range(40):
        full = 0 if n < window else (n - window) // stride + 1
        want = {(k * stride, window) for k in range(full)}
        if full * stride < n:
            want.add((full * stride, n - full * stride))
        assert {(r.start, r.n) for r in rows if r.doc_id == str(n)} == want


def test_stitch(docs):
    texts = ["abcdefghijklmnopqrstuvwxyz" * 3, "short"]
    pieces = windows.windows_text(docs(*texts).select("doc_id", "text"), 16, 4)
    lettered = pieces.withColumn("v", marks.chars(F.col("piece")))
    assert windows.window_stitch(lettered, "doc_id", "v", "v").count() == 2
    rows = docs(*texts, "", None)
    whole = windows.window_stitch(lettered, "doc_id", "v", "v", rows)
    assert pairs(whole.filter("v IS NULL"), "doc_id") == [("2",), ("3",)]
    whole = whole.filter("v IS NOT NULL")
    assert pairs(whole.select("doc_id", F.array_join("v", "").alias("t")), "doc_id", "t") == [
        ("0", texts[0]), ("1", texts[1])
    ]


# --- evaluation -------------------------------------------------------------------------------


def texts_df(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id STRING, text STRING, restored STRING")


def test_metrics(spark):
    """Marked letters: â ă ă ă. The first and second are left bare, the last gets another mark."""
    df = texts_df(spark, ("1", "lângă pădure stă aici", "langă padure stâ aici"))
    row = evaluation.summary_of(df).first()
    assert row.recall_circumflex == 0.0 and row.recall_breve_comma == pytest.approx(1 / 3)
    assert row.precision_circumflex == 0.0 and row.precision_breve_comma == 1.0
    assert row.word_accuracy == pytest.approx(1 / 4)
    counts = {(r["true"], r.pred): r.n for r in evaluation.confusion(evaluation.tallies(df)).collect()}
    assert len(counts) == 9 and counts[2, 0] == counts[1, 0] == counts[1, 2] == 1


def test_other_numbers_of_words_are_an_error(spark):
    df = texts_df(spark, ("1", "a b", "a_b"))
    for result in (evaluation.summary_of(df), evaluation.still_wrong(df)):
        with pytest.raises(Exception, match="of 2 and 1 words"):
            result.collect()


def test_metrics_without_words_or_candidates(spark):
    row = evaluation.summary_of(texts_df(spark, ("1", " ", " "))).first()
    assert row.word_accuracy is None and row.candidate_accuracy == 0.0


def test_metrics_length_mismatch_is_an_error(spark):
    with pytest.raises(Exception, match="different lengths"):
        evaluation.summary_of(texts_df(spark, ("1", "ab", "a"))).collect()


def test_still_wrong_and_summary(spark):
    df = texts_df(
        spark, ("a", "„Așa”, în casă!", "„Asa”, în casa!"), ("b", "bine", "bine")
    )
    assert pairs(evaluation.still_wrong(df), "doc_id", "wrote", "want") == [
        ("a", "Asa casa", "Așa casă")
    ]
    row = evaluation.corrections_summary(df).first()
    assert (row.sentences, row.still_wrong, row.word_accuracy) == (2, 1, 0.5)


def test_log_loss(spark):
    df = spark.createDataFrame([(0.5,), (0.25,)], "p_true DOUBLE")
    want = (math.log(2) + math.log(4)) / 2
    assert evaluation.candidate_log_loss(df).first().log_loss == pytest.approx(want)
    assert evaluation.candidate_log_loss(df.limit(0)).first().log_loss == 0.0


def test_best_is_chosen_on_validation_and_the_earliest_wins(spark):
    rows = [("m1", 1, "valid", 0.9), ("m2", 2, "valid", 0.9), ("m3", 3, "corrections", 1.0)]
    df = spark.createDataFrame(
        rows, "model_id STRING, step INT, split STRING, candidate_accuracy DOUBLE"
    )
    assert evaluation.best_on_validation(df).first().model_id == "m1"


# --- context model ----------------------------------------------------------------------------


def brute_contexts(text, size):
    base = text.translate(str.maketrans("ăâîșțĂÂÎȘȚ", "aaistAAIST"))
    padded = "\x02" * size + base.lower() + "\x02" * size
    spots = [i for i, c in enumerate(base) if c in "aistAIST"]
    return [(n, base[i], padded[i : i + 2 * size + 1]) for n, i in enumerate(spots)]


def test_context_rows(docs):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aăâsșxyz Ti\n🙂🙃") for _ in range(n)) for n in (0, 1, 5, 140, 700)]
    texts.append("İSTANBUL İ")
    rows = context.context_rows(docs(*texts).select("doc_id", "text"))
    for i, text in enumerate(texts):
        got = pairs(rows.filter(F.col("doc_id") == str(i)), "nth", "letter", "ctx")
        assert got == [(n, c, x) for n, c, x in brute_contexts(text.replace("İ", "ı"), 6)]


@pytest.mark.parametrize("limits", [{}, {"max_rows": 0}])
def test_restore_context(docs, limits):
    train = docs(*["o casă și o masă în țară" for _ in range(3)]).select("doc_id", "text")
    model = context.train(context.context_rows(train))
    texts = docs("o casa si o masa in tara" * 20, "", "xyz", "Casa").select("doc_id", "text")
    out = context.restore_context(texts, model, **limits)
    got = dict(pairs(out, "doc_id", "restored"))
    assert got["0"].startswith("o casă și o masă în țar")
    assert [len(got[str(i)]) for i in range(4)] == [480, 0, 3, 4]
    assert pairs(out, "doc_id", "text") == pairs(texts, "doc_id", "text")


def test_missing_texts_stay_missing(spark, docs):
    d = docs("casă").select("doc_id", "text")
    model, forms = context.train(context.context_rows(d)), lexicon.fit(docs("casă"))
    texts = spark.createDataFrame([("1", None), ("2", "")], "doc_id STRING, text STRING")
    for limits in ({}, {"max_rows": 0}):
        for out in (
            context.restore_context(texts, model, **limits),
            lexicon.restore_frequent(texts, forms, **limits),
        ):
            got = {r.doc_id: (r.text, r.restored) for r in out.collect()}
            assert got == {"1": (None, None), "2": ("", "")}


def test_unknown_letters_stay(spark, docs):
    model = context.train(context.context_rows(docs("zzz").select("doc_id", "text")))
    out = context.score(context.context_rows(docs("asa").select("doc_id", "text")), model)
    assert {(r.pred, r.confidence, r.k) for r in out.collect()} == {(0, 0.0, None)}


def test_weighted_training_equals_repetition(docs):
    d = docs("casă și masă", "o țară").select("doc_id", "text")
    rows = context.context_rows(d)
    weighted = context.train(rows.withColumn("w", F.lit(3)), weight="w")
    repeated = context.train(context.context_rows(corpus.repeat_rows(d, 3).drop("copy")))
    columns = ("k", "ctx", "n0", "n1", "n2")
    assert pairs(weighted, *columns) == pairs(repeated, *columns)


def test_threshold_sweep(spark):
    rows = [("a", 1, 1, 0.95), ("a", 0, 1, 0.55), ("s", 0, 0, 1.0), ("s", 0, 2, 0.9)]
    df = spark.createDataFrame(
        rows, "letter STRING, label INT, pred TINYINT, confidence DOUBLE"
    )
    sweep = {round(r.threshold, 1): r for r in context.threshold_sweep(df).collect()}
    assert len(sweep) == 11
    assert sweep[0.5].precision_breve_comma == 0.5
    assert sweep[0.6].precision_breve_comma == 1.0
    assert sweep[1.0].recall_breve_comma == 0.0


def test_letter_classifier_learns(docs):
    train = docs(*["o casă și o masă în țară"] * 20).select("doc_id", "text")
    rows = context.context_rows(train)
    model = classifier.train_letter_classifier(rows, num_features=1 << 10, max_iter=20)
    out = classifier.classify_letters(rows, model)
    assert out.filter("pred <> label").count() == 0
    assert out.agg(F.min("confidence")).first()[0] > 0.5


def test_letter_classifier_learns_from_every_letter(spark):
    """However many letters there are, no context is left out."""
    k = F.col("id") % 16
    side = F.expr("char(98 + id % 16)")
    ctx = F.concat(F.repeat(side, F.lit(6)), F.lit("a"), F.repeat(side, F.lit(6)))
    rows = spark.range(6_400_000).select(ctx.alias("ctx"), (k % 3).cast("int").alias("label"))
    model = classifier.train_letter_classifier(rows)
    out = classifier.classify_letters(rows.distinct(), model).collect()
    assert len(out) == 16
    assert all(r.pred == r.label for r in out)


@pytest.mark.parametrize("size", [2, 3, 6])
def test_letters_counted_for_training_have_the_same_features(docs, size):
    train = docs(*["o casă și o masă în țară", "masa asta", "ță"] * 5, "s", "").select("doc_id", "text")
    rows = context.context_rows(train, size)
    counted = classifier.counted_letters(rows, size)
    columns = ("label", *classifier.FEATURES)
    wanted = classifier.with_features(rows, size).select(*columns).collect()
    again = classifier.with_features(counted, min(size, classifier.REACH)).select("n", *columns)
    assert counted.count() == counted.select("ctx", "label").distinct().count() < len(wanted)
    assert sorted(tuple(r)[1:] for r in again.collect() for _ in range(r.n)) == sorted(map(tuple, wanted))


# --- scoring ----------------------------------------------------------------------------------


def marking_a(texts):
    return [
        np.array([[0.1, 0.8, 0.1] if c in "ast" else [0.9, 0.05, 0.05] for c in t]).reshape(-1, 3)
        for t in texts
    ]


def test_restore_scored(docs):
    texts = docs("casa " * 100, "x", "tă")
    out = scoring.restore_scored(texts, lambda: marking_a, 32, 8, 0.5)
    assert dict(pairs(out, "doc_id", "restored")) == {"0": "cășă " * 100, "1": "x", "2": "ță"}
    none = scoring.restore_scored(texts, lambda: marking_a, 32, 8, 0.81)
    assert dict(pairs(none, "doc_id", "restored"))["2"] == "ta"


def test_predictor_with_a_wrong_length_is_an_error(docs):
    with pytest.raises(Exception, match="length 3 got 1"):
        scoring.restore_scored(
            docs("abc"), lambda: lambda texts: [np.ones((1, 3)) for _ in texts]
        ).collect()


# --- vectors ----------------------------------------------------------------------------------


def test_quantization_error_bound(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-3, 3) for _ in range(64)]) for i in range(20)] + [(99, [0.0] * 64)]
    df = spark.createDataFrame(rows, "id INT, v ARRAY<DOUBLE>")
    out = vectors.vector_quantize(df, "v").withColumn("back", vectors.dequantize(F.col("groups")))
    for r in out.collect():
        top = max(map(abs, r.v))
        assert max(abs(a - b) for a, b in zip(r.v, r.back)) <= top / 14 + 1e-3
        assert all(1 <= c <= 15 for g in r.groups for c in g.codes)
    report = vectors.quantization_error(df, "v").first()
    assert (report.vectors, report.bytes_before, report.bytes_after) == (21, 21 * 256, 21 * 48)
    assert report.max_error_steps <= 0.5 + 1e-9
    stored = out.select("groups", vectors.packed_groups(F.col("groups")).alias("p"))
    back = stored.select("groups", "p", vectors.unpacked_groups(F.col("p")).alias("again")).collect()
    assert all(r.groups == r.again and [len(g.codes) for g in r.p] == [16, 16] for r in back)


def test_half_precision_rounds_as_numpy_does(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    patterns = np.arange(0, 31 << 10, 7, dtype=np.uint16).view(np.float16).astype(np.float64)
    middles = (patterns[:-1] + patterns[1:]) / 2
    powers = [2.0**e * f for e in range(-26, 17) for f in (1 - 2**-23, 1.0, 1 + 2**-23, 1 + 2**-11)]
    values = [*patterns, *middles, *powers, *np.exp(rng.uniform(-20, 12, 2000)), 0.0, 65519.9, 65520.0]
    values = np.array(values).astype(np.float32)
    df = spark.createDataFrame([(float(v),) for v in values], "x DOUBLE")
    out = df.select("x", vectors.half(F.col("x")).alias("h")).collect()
    with np.errstate(over="ignore"):
        for r in out:
            wanted = np.float16(np.float32(r.x))
            assert (r.h.bits, r.h.value) == (int(wanted.view(np.uint16)), float(wanted)), r.x


def test_stored_vectors_hold_the_bytes_of_single_precision_arithmetic(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    scales = [1e-6, 1e-3, 1.0, 40.0, 3e4]
    rows = [(i, (rng.normal(size=64) * scales[i % 5]).astype(np.float32).tolist()) for i in range(60)]
    rows += [(99, [0.0] * 64), (100, []), (101, None)]
    df = spark.createDataFrame(rows, "id INT, v ARRAY<FLOAT>")
    stored = df.withColumn("s", vectors.stored_vector(F.col("v")))
    out = {r.id: r for r in stored.withColumn("back", vectors.loaded_vector(F.col("s"))).collect()}
    for i, v in rows[:60]:
        groups = np.array(v, np.float32).reshape(-1, 32)
        scale = np.maximum(np.abs(groups).max(axis=1) / np.float32(7), np.float32(1e-8)).astype(np.float16)
        wide = scale.astype(np.float32)[:, None]
        codes = (np.rint(groups / wide).clip(-7, 7) + 8).astype(np.uint8).ravel()
        assert bytes(out[i].s.packed) == (codes[0::2] | (codes[1::2] << 4)).tobytes()
        assert bytes(out[i].s.scales) == scale.astype("<f2").tobytes()
        again = ((codes.astype(np.float32) - 8).reshape(-1, 32) * wide).ravel()
        assert out[i].back == again.tolist()
    assert (bytes(out[99].s.packed), out[99].back) == (b"\x88" * 32, [0.0] * 64)
    assert (bytes(out[100].s.packed), bytes(out[100].s.scales), out[100].back) == (b"", b"", [])
    assert out[101].s is None and out[101].back is None
    with pytest.raises(Exception, match="no multiple of 32"):
        df.select(vectors.stored_vector(F.array(F.lit(1.0)))).collect()
    with pytest.raises(Exception, match="no scale in half precision"):
        df.select(vectors.stored_vector(F.array_repeat(F.lit(5e5), 32))).collect()


def test_quantize_an_empty_vector(spark):
    df = spark.createDataFrame([([],)], "v ARRAY<DOUBLE>")
    assert vectors.vector_quantize(df, "v").first().groups == []


def test_quantize_needs_whole_groups(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "v ARRAY<DOUBLE>")
    with pytest.raises(Exception, match="no multiple of 32"):
        vectors.vector_quantize(df, "v").collect()


# --- long and grouped texts -------------------------------------------------------------------


def breaks_of(text, most):
    """Where a text that is too long may be cut: the best places first, a hard cut last."""
    half = -(-most // 2)
    spots = range(most, half - 1, -1)
    for mark in "\n ":
        if found := [k for k in spots if k < len(text) and text[k] == mark]:
            return found[0]
    return most


@pytest.mark.parametrize("most", [7, 10, 64])
def test_split_long_text(docs, most):
    rng = random.Random(most)
    texts = ["".join(rng.choice("abcdef🙂 \n") for _ in range(n)) for n in range(0, 260, 13)]
    texts.append("word " * (longtext.RUN * most))  # more pieces than are summed up in one run
    rows = longtext.split_long_text(docs(*texts).select("doc_id", "text"), most).collect()
    for i, text in enumerate(texts):
        mine = sorted((r.no, r.start, r.piece) for r in rows if r.doc_id == str(i))
        assert "".join(p for *_, p in mine) == text
        assert [no for no, *_ in mine] == list(range(len(mine)))
        for (_, start, piece), following in zip(mine, [*mine[1:], None]):
            assert text.startswith(piece, start) and len(piece) <= most
            if following is not None:
                assert len(piece) == breaks_of(text[start : start + most + 1], most)
            else:
                assert start + len(piece) == len(text)


def test_missing_texts_are_not_lost(docs):
    d = docs("abc", None, "xyz")
    pieces = longtext.split_long_text(d.select("doc_id", "text"), 10).collect()
    assert sorted((r.doc_id, r.piece) for r in pieces if r.piece) == [("0", "abc"), ("2", "xyz")]
    assert [r.doc_id for r in pieces if r.piece is None] == ["1"]
    ok, refused = longtext.max_chars_guard(d, 2)
    assert [r.doc_id for r in ok.collect()] == ["1"] and refused.count() == 2
    out = longtext.restore_where_needed(d, lambda t: t.withColumn("restored", F.upper("text")))
    assert {r.doc_id: r.restored for r in out.collect()} == {"0": "ABC", "1": None, "2": "xyz"}


def test_guard(docs):
    ok, refused = longtext.max_chars_guard(docs("a" * 5, "a" * 6), 5)
    assert (ok.count(), refused.count()) == (1, 1)


def test_texts_without_candidates_pass_through(docs):
    seen = []

    def restore(df):
        seen.append(pairs(df, "text"))
        return df.withColumn("restored", F.upper("text"))

    out = longtext.restore_where_needed(docs("xyz", "șț", "abc"), restore)
    assert seen == [[("abc",)]]
    assert pairs(out, "text", "restored") == [("abc", "ABC"), ("xyz", "xyz"), ("șț", "șț")]


def test_what_a_writer_typed(docs):
    """Skip, cut, restore, join, keep the writer's own marks, count."""
    forms = lexicon.fit(docs("masă țară", "masă țară"))
    texts = docs("masa si tara " * 9, "țara mâsa", "xyz", None, "", "masa")
    out = longtext.restore_written(texts, lambda t: lexicon.restore_frequent(t, forms), 20)
    assert [(r.text, r.restored, r.changed) for r in out.orderBy("ord").collect()] == [
        ("masa si tara " * 9, "masă si țară " * 9, 27),
        ("țara mâsa", "țară mâsă", 2),
        ("xyz", "xyz", 0), (None, None, 0), ("", "", 0), ("masa", "masă", 1),
    ]


def test_diffs(spark):
    df = spark.createDataFrame([("1", "casa si", "casă și", "casă si")], "id STRING, a STRING, b STRING, p STRING")
    got = longtext.diff_chars(df.select("id", "a", "b"), "a", "b")
    assert pairs(got, "id", "pos", "from_ch", "to_ch") == [("1", 3, "a", "ă"), ("1", 5, "s", "ș")]
    fresh = longtext.fresh_changes(df, "a", "p", "b")
    assert pairs(fresh, "pos", "fresh") == [(3, False), (5, True)]


def test_restore_grouped_equals_restoring_the_joined_text(spark, docs):
    rng = random.Random(5)
    train = docs(*["".join(rng.choice("așsăat i") for _ in range(200)) for _ in range(6)])
    model = context.train(context.context_rows(train.select("doc_id", "text"))).cache()
    turns = [
        (c, t, "".join(rng.choice("asti xA") for _ in range(rng.choice([0, 1, 2, 3, 9, 40]))))
        for c in range(5)
        for t in range(12)
    ]
    df = spark.createDataFrame(turns, "conv LONG, turn LONG, text STRING").repartition(3)
    out = longtext.restore_grouped(
        df,
        "conv",
        "turn",
        lambda d: context.restore_context(d, model, 0.4, key="piece_no"),
        reach=6,
    )
    got = {(r.conv, r.turn): r.restored for r in out.collect()}
    whole = spark.createDataFrame(
        [(str(c), "\n".join(t for k, _, t in turns if k == c)) for c in range(5)],
        "doc_id STRING, text STRING",
    )
    joined = dict(pairs(context.restore_context(whole, model, 0.4), "doc_id", "restored"))
    assert any(got[c, t] != text for c, t, text in turns)
    for c in range(5):
        assert "\n".join(got[c, t] for t in range(12)) == joined[str(c)]


# --- thresholds -------------------------------------------------------------------------------


@pytest.mark.parametrize("precision", [0.5, 0.8, 0.9, 1.1])
def test_choose_threshold(spark, precision):
    rnd = random.Random(8)
    rows = []
    for lang, sure in (("ro", 0.95), ("en", 0.3), (None, 0.8)):
        for _ in range(700):
            confidence = rnd.randrange(40) / 40
            pred = rnd.choice([0, 1, 2])
            right = rnd.random() < sure * (0.4 + 0.6 * confidence)
            rows.append((lang, "s", pred if right else (pred + 1) % 3, pred, confidence))
    df = spark.createDataFrame(rows, "lang STRING, letter STRING, label INT, pred INT, confidence DOUBLE")
    got = {r.lang: r for r in threshold.choose_threshold(df.repartition(5), precision, ["lang"]).collect()}
    for lang in ("ro", "en", None):
        # label 2 is no mark of an s, so such a prediction places nothing
        mine = [r for r in rows if r[0] == lang]
        best = None
        for t in sorted({r[4] for r in mine}):
            placed = [r for r in mine if r[4] >= t and r[3] == 1]
            n, hits = len(placed), sum(r[2] == r[3] for r in placed)
            if not n:
                continue
            z, p = threshold.Z, hits / n
            low = (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
            if low >= precision and any(r[4] == t and r[3] == 1 for r in mine):
                best = (t, n, hits, low)
                break
        r = got[lang]
        assert r.marked == sum(x[2] != 0 for x in mine)
        if best is None:
            assert (r.threshold, r.placed, r.correct, r.lower) == (None,) * 4
        else:
            assert (r.threshold, r.placed, r.correct) == best[:3] and abs(r.lower - best[3]) < 1e-12


def test_a_model_of_counts(spark, docs):
    """Counts of two halves add up to those of the whole; learning beats never marking; weights are
    what the counts say; contexts that nothing has told about get the most frequent label."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["casă", "țară", "masă", "sat", "tot", "asta"]) for _ in range(60)) for _ in range(8)]
    rows = context.context_rows(docs(*texts).select("doc_id", "text"))
    whole = classifier.letter_counts(rows)
    parts = [classifier.letter_counts(rows.filter(f"doc_id % 2 = {k}")) for k in (0, 1)]
    columns = ("bucket", "n0", "n1", "n2")
    assert pairs(classifier.merged_counts(*parts), *columns) == pairs(whole, *columns)
    got = classifier.classify_by_counts(rows, whole).collect()
    assert len(got) == rows.count() and all(1 / 3 <= r.confidence <= 1 for r in got)
    right = sum(r.pred == r.label for r in got)
    assert right > 0.95 * len(got) > sum(r.label == 0 for r in got)
    weights = {r.bucket: (r.w1, r.w2) for r in classifier.log_odds(whole).collect()}
    total = next(r for r in whole.collect() if r.bucket == -1)
    assert weights[-1][0] == pytest.approx(math.log((total.n1 + 1) / (total.n0 + 1)))
    none = classifier.letter_counts(rows.limit(0))
    assert {r.pred for r in classifier.classify_by_counts(rows, none).collect()} <= {0, None}


def test_windows_are_put_together_in_their_row(docs):
    """Small budgets of characters, several Arrow batches: the same result and no shuffle."""
    texts = docs("casa mare" * 30, "", "a", "xyz" * 11, "sat la casa " * 9)
    want = pairs(scoring.restore_scored(texts, lambda: marking_a, 32, 8, 0.5), "doc_id", "restored")
    scored = scoring.score_texts(texts, lambda: marking_a, 32, 8, batch_size=3, batch_chars=10)
    for r in scored.collect():
        assert len(r.pred) == len(r.confidence) == len(r.text)
        assert [p == 1 for p in r.pred] == [c in "ast" for c in r.text]
    out = scoring.restore_scored(texts, lambda: marking_a, 32, 8, 0.5)
    assert pairs(out, "doc_id", "restored") == want
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_texts_are_stitched_as_texts(docs):
    """The same as by arrays of characters, without one element a character in the shuffle."""
    rows = docs("abcdefgh🙃jklmnopqrstuvwxyz" * 3, "short", "", None, "ăș\n" * 20)
    pieces = windows.windows_text(rows.select("doc_id", "text"), 16, 4)
    whole = windows.window_stitch(pieces, "doc_id", "piece", "whole", rows)
    assert whole.schema["whole"].dataType.typeName() == "string"
    assert {r.doc_id: r.whole for r in whole.collect()} == {
        r.doc_id: r.text or None for r in rows.collect()
    }


def test_diffs_of_other_lengths_and_wide_characters(spark):
    rows = [(1, "a🙃b", "a🙂b"), (2, "ab", "abcd"), (3, "abc", "x"), (4, None, "a"), (5, "a", None),
            (6, "", ""), (7, "", "q"), (8, "same", "same"), (2, "\x00a", "\x00b")]
    df = spark.createDataFrame(rows, "id INT, a STRING, b STRING").repartition(2)
    got = longtext.diff_chars(df, "a", "b")
    found = sorted(map(tuple, got.select("id", "pos", "from_ch", "to_ch").collect()), key=repr)
    assert found == sorted(
        [(1, 1, "🙃", "🙂"), (2, 2, None, "c"), (2, 3, None, "d"), (3, 0, "a", "x"), (3, 1, "b", None),
         (3, 2, "c", None), (7, 0, None, "q"), (2, 1, "a", "b")], key=repr
    )
    # characters are compared in Arrow batches, once, and not one by one in lambdas
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "lambdafunction" not in plan


def test_scored_texts_are_decoded_where_they_are_scored(docs):
    """The same letters as by `decode_restore`, but labels and confidences do not leave the task."""
    def steady(texts):
        return [np.array([[(ord(c) * 7 + k * 5) % 11 / 10 for k in range(3)] for c in t]).reshape(-1, 3) for t in texts]

    texts = docs("aist AIST ăâîșț 🙃" * 30, "", None, "tsia", "ÎȘŢţ xyz")
    stripped = texts.withColumn("text", marks.fix_and_strip(F.col("text")))
    scored = scoring.score_texts(stripped.filter("text <> ''"), lambda: steady, 32, 8)
    predictions = F.arrays_zip(F.col("pred").alias("label"), F.col("confidence"))
    for least in (0.0, 0.7, 1.0):
        want = scored.select("doc_id", codec.decode_restore(F.col("text"), predictions, least).alias("r"))
        out = scoring.restore_scored(texts, lambda: steady, 32, 8, least)
        assert pairs(out.filter("restored <> ''"), "doc_id", "restored") == pairs(want, "doc_id", "r")
    assert {r.doc_id: r.restored for r in out.collect() if not r.restored} == {"1": "", "2": None}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "zip_with" not in plan


def test_counted_letters_give_what_letters_give(docs):
    """A row that stands for several equal letters: the same thresholds, losses, sweeps and tallies."""
    train = docs("casă și masă", "țara și casa", "așa și așa", "masa și așă")
    model = context.train(context.context_rows(train.select("doc_id", "text"))).cache()
    texts = docs("casă și masa", "așa și țara", "casa și așă", "casă și masa", "", "xyz").withColumn("lang", F.col("ord") % 2)
    rows = context.context_rows(texts.select("doc_id", "lang", "text"))
    counted = context.counted_rows(rows, ["lang"], "times")
    assert counted.count() < rows.count() == counted.agg(F.sum("times")).first()[0]
    for fits in (True, False):
        one, many = (context.score(r, model, fits=fits) for r in (rows, counted))
        assert sorted(threshold.choose_threshold(one, 0.3, ["lang"]).collect()) == sorted(
            threshold.choose_threshold(many, 0.3, ["lang"], weight="times").collect()
        )
        assert sorted(context.threshold_sweep(one).collect()) == sorted(
            context.threshold_sweep(many, weight="times").collect()
        )
        assert sorted(evaluation.pair_tallies(one, "label", "pred", ["lang"]).collect()) == sorted(
            evaluation.pair_tallies(many, "label", "pred", ["lang"], "times").collect()
        )
        one, many = (s.withColumn("p_true", context.label_probability(F.col("label"))) for s in (one, many))
        want = {r.lang: r.log_loss for r in evaluation.candidate_log_loss(one, by=["lang"]).collect()}
        got = {r.lang: r.log_loss for r in evaluation.candidate_log_loss(many, by=["lang"], weight="times").collect()}
        assert got == pytest.approx(want)


def test_contexts_are_classified_where_they_lie(docs):
    """Weights are looked up in arrays: one row per context on the way, not one per feature."""
    rows = context.context_rows(docs("casă și masă", "țara și casa").select("doc_id", "text"))
    names = []
    kept = classifier.materialize
    counts = kept(classifier.letter_counts(rows), "counts")

    def noted(df, name):
        names.append(df._jdf.queryExecution().optimizedPlan().toString())
        return kept(df, name)

    classifier.materialize = noted
    try:
        assert classifier.classify_by_counts(rows, counts).count() == rows.count()
    finally:
        classifier.materialize = kept
    assert "ArrowEvalPython" in names[0] and "Generate explode(" not in names[0]
