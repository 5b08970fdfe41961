"""One query per operator over the given tables. Every query reads whole tables.

The documents hold English, French, German and Spanish prose. `romanised` maps each
language's own accented letters to ă ș ț â î, so that the rules have something to find.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from markspark.functions import codec, marks, quality, words
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
from markspark.operators.lookup import lookup
from markspark.operators.ordering import number_rows, spread
from markspark.plans import dataset, evaluate
from markspark.language import ROMANIAN
from markspark.settings import CorpusSettings, Settings
from markspark.sources import documents as sources
from markspark.sources import lines, sinks
from markspark.storage import materialize, new_path
from markspark.streaming import jobs

VALID_EVERY = 5
SETTINGS = Settings(corpus=CorpusSettings(valid_every=VALID_EVERY))
WINDOW, OVERLAP = SETTINGS.windows.window, SETTINGS.windows.overlap

ROMANISED = """
case lang when 'fr' then translate(text, 'éèêçÉÈÊÇ', 'ășțâĂȘȚÂ')
          when 'de' then translate(text, 'äöüßÄÖÜ', 'ășțîĂȘȚ')
          when 'es' then translate(text, 'óñíéÓÑÍÉ', 'ășțâĂȘȚÂ')
          else text end
|| case when doc_id % 4 = 0 then ' și dacă fără după așa când' else '' end
|| case when doc_id % 6 = 0 then ' Si daca fara' else '' end
"""
ROMANISED_PLAIN = "translate(text, 'éèêçÉÈÊÇ', 'ășțâĂȘȚÂ')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def romanised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`doc_id, text, source_rank, ord, lang, source` of all documents."""
    raw = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    marked = spread(raw, "doc_id").withColumn("text", F.expr(ROMANISED))
    return sources.table_documents(marked, keep=("lang", "source"))


def romanised_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return spread(raw, "conv_id", "turn").withColumn("text", F.expr(ROMANISED_PLAIN))


def usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.usable(romanised(spark, sf_dir), SETTINGS.corpus)


def usable_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usable documents, written once, for jobs that read them more than once."""
    return materialize(usable(spark, sf_dir), "usable")


def restored_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation documents restored by the forms of the training documents."""
    return evaluate.fit_and_restore(usable_table(spark, sf_dir), VALID_EVERY)


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.fit(corpus.training(usable(spark, sf_dir), VALID_EVERY))


def joined(array: Column | str, sep: str = ",") -> Column:
    return F.array_join(F.col(array) if isinstance(array, str) else array, sep)


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({name: F.round(name, digits) for name in doubles})


def longs(df: DataFrame) -> DataFrame:
    """Whole-number columns as BIGINT."""
    whole = ("byte", "short", "integer", "long")
    names = [f.name for f in df.schema.fields if f.dataType.typeName() in whole]
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# --- sources and sinks ------------------------------------------------------------------------


def src_parquet(spark, sf_dir):
    docs = sources.parquet_documents(spark, f"{sf_dir}/documents.parquet", id_col="doc_id")
    return docs.select("doc_id", "ord", F.length("text").alias("n_chars"), F.md5("text").alias("h"))


def src_hash_sample(spark, sf_dir):
    docs = sources.parquet_documents(spark, f"{sf_dir}/documents.parquet", 4, id_col="doc_id")
    return docs.select("doc_id", F.md5("text").alias("h"))


def src_line_chunks(spark, sf_dir):
    raw = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("value"))
    numbered = number_rows(raw, ["doc_id"], "line_no")
    chunks = lines.line_chunks(numbered, every=2)
    return chunks.select("doc_id", "ord", F.length("text").alias("n"), F.md5("text").alias("h"))


def src_line_files(spark, sf_dir):
    """All documents as lines of files, read back in fifties."""
    one_line = F.translate(F.coalesce("text", F.lit("")), "\r\n", "  ")
    raw = table(spark, sf_dir, "documents").select("doc_id", one_line.alias("value"))
    ordered = raw.repartitionByRange(7, "doc_id").sortWithinPartitions("doc_id")
    path = new_path(spark, "lines")
    ordered.select("value").write.text(path)
    chunks = lines.line_documents(spark, path, every=1)
    return chunks.select("doc_id", "ord", F.length("text").alias("n"), F.md5("text").alias("h"))


def src_text_files(spark, sf_dir):
    files = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("/pages/page "), "page_id", F.lit(".v1.txt")).alias("path"),
        F.col("html").alias("content"),
    )
    return sources.documents_of_files(files).select("doc_id", "ord", F.md5("text").alias("h"))


def src_corrections(spark, sf_dir):
    raw = romanised(spark, sf_dir)
    files = raw.select(F.col("doc_id").alias("stem"), F.col("text").alias("content"))
    return sources.correction_lines(files).select("doc_id", F.md5("text").alias("h"))


def src_chain(spark, sf_dir):
    talks = table(spark, sf_dir, "conversations").withColumn(
        "id", F.concat_ws(":", "conv_id", "turn")
    ).withColumn("ord", F.shiftleft("conv_id", 31) + F.col("turn"))
    inner = sources.chain(
        sources.table_documents(talks, "id", ord_col="ord"),
        None,
        sources.table_documents(table(spark, sf_dir, "benchmark"), "item_id"),
    )
    chained = sources.chain(sources.table_documents(table(spark, sf_dir, "documents")), inner)
    return longs(chained.select("doc_id", "source_rank", "ord", F.md5("text").alias("h")))


def src_lines(spark, sf_dir):
    """Restore line by line: every document's lines, each on its own."""
    docs = romanised(spark, sf_dir)
    split = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "text"))
    keyed = split.select(F.concat_ws(":", "doc_id", "p").alias("doc_id"), "text")
    restored = lexicon.restore_frequent(keyed, dictionary(spark, sf_dir))
    return restored.select("doc_id", "restored")


def _window_rows(spark, sf_dir) -> tuple[str, DataFrame]:
    docs = usable_table(spark, sf_dir)
    chars = alphabet.alphabet_string(alphabet.build_alphabet(alphabet.char_counts(docs), 256))
    split = corpus.with_split(docs, VALID_EVERY)
    return chars, windows.windows_train(split, chars, WINDOW, OVERLAP)


def sink_windows(spark, sf_dir):
    location = new_path(spark, "windows")
    sinks.write_windows(_window_rows(spark, sf_dir)[1], location, WINDOW)
    return longs(spark.read.parquet(f"{location}/windows_meta").select("split", "rows", "window"))


def src_windows(spark, sf_dir):
    location = new_path(spark, "windows")
    sinks.write_windows(_window_rows(spark, sf_dir)[1], location, WINDOW)
    valid = sinks.open_split(spark, location, "valid")
    return longs(
        valid.groupBy("doc_id").agg(
            F.count("*").alias("rows"),
            F.sum("n").alias("chars"),
            F.lit(sinks.split_rows(spark, location, "never written")).alias("missing"),
        )
    )


def sink_alphabet(spark, sf_dir):
    location = new_path(spark, "alphabet")
    kept = alphabet.build_alphabet(alphabet.char_counts(usable(spark, sf_dir)), 40)
    sinks.write_alphabet(spark, alphabet.alphabet_string(kept), location)
    text = sinks.read_json_row(spark, f"{location}/alphabet")
    return longs(alphabet.alphabet_table(spark, text))


def sink_summary(spark, sf_dir):
    location = new_path(spark, "summary")
    row = evaluation.summary_of(restored_valid(spark, sf_dir)).first()
    sinks.write_summary(spark, row.asDict(), location, "baseline")
    kept = sinks.read_summary(spark, location, "baseline")
    return rounded(spark.createDataFrame([kept]))


def materialize_stamped_(spark, sf_dir):
    directory = new_path(spark, "dataset")
    first = dataset.build_dataset(spark, romanised(spark, sf_dir), directory, SETTINGS)
    again = dataset.build_dataset(spark, romanised(spark, sf_dir), directory, SETTINGS)
    meta = spark.read.parquet(f"{again.location}/windows_meta")
    return longs(
        meta.select(
            "split",
            "rows",
            F.lit(first.rebuilt).alias("first_built"),
            F.lit(again.rebuilt).alias("second_built"),
        )
    )


# --- text functions ---------------------------------------------------------------------------


def _per_document(build: Callable[[Column], Column], name: str):
    def query(spark, sf_dir):
        docs = romanised(spark, sf_dir)
        return docs.select("doc_id", build(F.col("text")).alias(name))

    return query


def _legacy(text: Column) -> Column:
    return F.translate(text, ROMANIAN.legacy_fixed, ROMANIAN.legacy)


def _decomposed(text: Column) -> Column:
    return F.replace(_legacy(text), F.lit("ă"), F.lit("a\u0306"))


fix_cedilla = _per_document(lambda t: marks.fix_cedilla(_legacy(t)), "text")
strip_marks = _per_document(lambda t: marks.fix_and_strip(_legacy(t)), "text")
clean_text = _per_document(lambda t: marks.clean_text(_decomposed(t)), "text")
is_candidate = _per_document(
    lambda t: F.size(F.filter(marks.candidates_of(marks.strip_marks(t)), lambda c: c)).cast("long"),
    "candidates",
)
labels_of = _per_document(lambda t: joined(marks.labels_of(_legacy(t)), ""), "labels")
lower_upper = _per_document(
    lambda t: F.concat_ws("|", F.lower(t), F.upper(F.replace(t, F.lit("ß"), F.lit("ss")))), "text"
)
strip_ws = _per_document(
    lambda t: words.strip_ws(F.concat(F.lit(" \u3000\t"), t, F.lit("\u00a0 \n"))), "text"
)
split_ws = _per_document(lambda t: joined(words.split_ws(t), "|"), "words")
strip_punct = _per_document(
    lambda t: joined(F.transform(words.split_ws(t), lambda w: words.strip_punct(w)), " "), "words"
)
case_transfer = _per_document(
    lambda t: codec.case_transfer(marks.strip_marks(t), F.lower(t)), "text"
)
merge_keep_marked = _per_document(
    lambda t: codec.merge_keep_marked(_legacy(t), F.translate(marks.strip_marks(t), "at", "ăț")),
    "text",
)
mark_ratio = _per_document(lambda t: F.round(quality.mark_ratio(t), 9), "ratio")
marks_every_letter = _per_document(quality.marks_every_letter, "passes")
drops_marks = _per_document(quality.drops_marks, "drops")


def max_chars_guard(spark, sf_dir):
    accepted, refused = longtext.max_chars_guard(romanised(spark, sf_dir))
    flagged = [
        df.select("doc_id", F.lit(ok).alias("accepted")) for df, ok in ((accepted, True), (refused, False))
    ]
    return flagged[0].unionByName(flagged[1])


def tokenize_w(spark, sf_dir):
    docs = romanised(spark, sf_dir)
    tokens = docs.select(F.explode(words.tokenize_w(F.col("text"))).alias("word"))
    return tokens.groupBy("word").agg(F.count("*").alias("n"))


def tokenize_letters(spark, sf_dir):
    docs = romanised(spark, sf_dir)
    tokens = docs.select(F.explode(words.tokenize_letters(F.col("text"))).alias("word"))
    return tokens.groupBy("word").agg(F.count("*").alias("n"))


def encode_chars(spark, sf_dir):
    docs = usable_table(spark, sf_dir)
    chars = alphabet.alphabet_string(alphabet.build_alphabet(alphabet.char_counts(docs), 40))
    stripped = marks.fix_and_strip(F.col("text"))
    return docs.select("doc_id", joined(codec.encode_chars(stripped, chars)).alias("ids"))


def encode_example(spark, sf_dir):
    docs = usable_table(spark, sf_dir)
    chars = alphabet.alphabet_string(alphabet.build_alphabet(alphabet.char_counts(docs), 256))
    example = docs.select("doc_id", codec.encode_example(F.col("text"), chars).alias("e"))
    mask = F.transform("e.candidates", lambda c: c.cast("int"))
    return example.select(
        "doc_id",
        joined("e.input_ids").alias("input_ids"),
        joined("e.labels", "").alias("labels"),
        joined(mask, "").alias("candidates"),
    )


def decode_restore(spark, sf_dir):
    """The text's own labels as predictions, with confidences 0.0, 0.1 ... 0.9 in turn."""
    docs = romanised(spark, sf_dir)
    predictions = F.transform(
        marks.labels_of(F.col("text")),
        lambda label, i: F.struct(
            label.alias("label"), ((i * 7 % 10).cast("double") / 10).alias("confidence")
        ),
    )
    restored = codec.decode_restore(marks.fix_and_strip(F.col("text")), predictions, 0.5)
    return docs.select("doc_id", restored.alias("restored"))


def skip_no_candidates(spark, sf_dir):
    """Distinct words as texts; those without a, i, s, t are not scored at all."""
    texts = tokenize_letters(spark, sf_dir).select(F.col("word").alias("text"))
    texts = texts.withColumn("doc_id", F.col("text"))
    forms = dictionary(spark, sf_dir)
    out = longtext.restore_where_needed(texts, lambda t: lexicon.restore_frequent(t, forms))
    return out.select("text", "restored", marks.has_candidates(F.col("text")).alias("scored"))


def diff_chars(spark, sf_dir):
    docs = romanised(spark, sf_dir)
    pairs = docs.select("doc_id", marks.strip_marks(F.col("text")).alias("stripped"), "text")
    return longs(longtext.diff_chars(pairs, "stripped", "text"))


def count_changed(spark, sf_dir):
    restored = restored_valid(spark, sf_dir)
    changed = codec.count_changed(F.col("text"), F.col("restored"))
    return longs(restored.select("doc_id", changed.alias("changed")))


def split_long_text(spark, sf_dir):
    pieces = longtext.split_long_text(romanised(spark, sf_dir).select("doc_id", "text"), 2_000)
    return longs(pieces)


def restore_grouped(spark, sf_dir):
    forms = dictionary(spark, sf_dir)
    out = longtext.restore_grouped(
        romanised_turns(spark, sf_dir),
        "conv_id",
        "turn",
        lambda t: lexicon.restore_frequent(t, forms, key="piece_no"),
        reach=0,
    )
    return out.select("conv_id", "turn", "restored")


def restore_grouped_context(spark, sf_dir):
    """Turns of a conversation by a context model, which looks over the ends of a turn."""
    model = _context_model(usable_table(spark, sf_dir))
    out = longtext.restore_grouped(
        romanised_turns(spark, sf_dir),
        "conv_id",
        "turn",
        lambda t: context.restore_context(t, model, 0.6, key="piece_no"),
        reach=context.SIZES[0],
    )
    return out.select("conv_id", "turn", "restored")


# --- filters ----------------------------------------------------------------------------------


def keep_document(spark, sf_dir):
    keep = quality.keep_document(F.col("text"))
    return romanised(spark, sf_dir).select("doc_id", keep.alias("keep"))


def is_validation(spark, sf_dir):
    docs = romanised(spark, sf_dir)
    return docs.select("doc_id", quality.is_validation(F.col("doc_id"), VALID_EVERY).alias("valid"))


def filtered(spark, sf_dir):
    """The first 100 usable documents."""
    kept = corpus.filtered(romanised(spark, sf_dir), limit=100)
    return kept.select("doc_id", "ord", F.md5("text").alias("h"))


def usable_(spark, sf_dir):
    split = corpus.with_split(usable(spark, sf_dir), VALID_EVERY)
    return split.select("doc_id", "lang", "split", F.md5("text").alias("h"))


# --- joins ------------------------------------------------------------------------------------


def join_dictionary(spark, sf_dir):
    """Every distinct word of the validation documents with the form it is looked up as."""
    docs = usable_table(spark, sf_dir)
    valid = corpus.validation(docs, VALID_EVERY)
    stripped = marks.fix_and_strip(F.col("text"))
    tokens = valid.select(F.explode(words.tokenize_letters(stripped)).alias("word"))
    keys = tokens.groupBy(F.lower("word").alias("key")).agg(F.count("*").alias("n"))
    forms = lexicon.fit(corpus.training(docs, VALID_EVERY), prune=False)
    return lookup(keys, forms, ["key"])


def join_alphabet(spark, sf_dir):
    """Characters of all documents with their ids; 1 for those the alphabet does not hold."""
    counts = alphabet.char_counts(usable_table(spark, sf_dir))
    kept = alphabet.build_alphabet(counts, 40).select("ch", "char_id")
    seen = alphabet.char_counts(romanised(spark, sf_dir)).select("ch", "n")
    ids = F.coalesce("char_id", F.lit(1)).cast("long")
    return seen.join(F.broadcast(kept), "ch", "left").select("ch", "n", ids.alias("char_id"))


def semi_always_marked(spark, sf_dir):
    docs = romanised(spark, sf_dir)
    tokens = docs.select("lang", F.explode(words.tokenize_w(F.col("text"))).alias("word"))
    bare, marked = F.col("word").isin(*ROMANIAN.bare_words), F.col("word").isin(
        *ROMANIAN.always_marked
    )
    return (
        tokens.filter(bare | marked)
        .groupBy("lang", "word", bare.alias("bare"), marked.alias("marked"))
        .agg(F.count("*").alias("n"))
    )


def zip_positional(spark, sf_dir):
    """Word pairs (wanted, restored) at equal places, counted."""
    restored = restored_valid(spark, sf_dir)
    pairs = evaluation.zip_words(F.col("text"), F.col("restored"))
    words_at = restored.select(F.inline(pairs)).groupBy("r", "o").agg(F.count("*").alias("n"))
    return words_at.select(F.col("r").alias("want"), F.col("o").alias("got"), "n")


def join_class_names(spark, sf_dir):
    docs = romanised(spark, sf_dir)
    labels = docs.select(F.explode(marks.labels_of(F.col("text"))).alias("label"))
    counts = labels.groupBy("label").agg(F.count("*").alias("n"))
    return longs(counts.select("label", marks.label_name(F.col("label")).alias("name"), "n"))


def cross_repeat(spark, sf_dir):
    known = table(spark, sf_dir, "benchmark").select("item_id", "text")
    repeat = SETTINGS.model.corrections_repeat
    rows = corpus.repeat_rows(spread(known, "item_id"), repeat)
    return longs(rows.select("item_id", "copy", F.md5("text").alias("h")))


def corrections_mix(spark, sf_dir):
    train = usable(spark, sf_dir).select("doc_id", "text")
    known = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("known:"), "item_id").alias("doc_id"), "text"
    )
    mixed = corpus.mix_corrections(train, known, SETTINGS.model.corrections_repeat)
    return mixed.groupBy("doc_id").agg(
        F.count("*").alias("copies"), F.sum(F.length("text")).alias("chars")
    )


# --- aggregations -----------------------------------------------------------------------------


def char_counts(spark, sf_dir):
    return alphabet.char_counts(usable_table(spark, sf_dir)).select("ch", "n")


def alphabet_build(spark, sf_dir):
    return longs(alphabet.build_alphabet(alphabet.char_counts(usable_table(spark, sf_dir)), 40))


def form_counts(spark, sf_dir):
    train = corpus.training(usable(spark, sf_dir), VALID_EVERY)
    return lexicon.form_counts(train).select("key", "form", "n")


def fit_dictionary(spark, sf_dir):
    train = corpus.training(usable(spark, sf_dir), VALID_EVERY)
    return lexicon.fit_dictionary(lexicon.form_counts(train))


def dictionary_size(spark, sf_dir):
    return fit_dictionary(spark, sf_dir).agg(F.count("*").alias("size"))


def confusion(spark, sf_dir):
    counts = evaluation.tallies(restored_valid(spark, sf_dir), by=["lang"])
    return longs(evaluation.confusion(counts, ["lang"]))


def word_accuracy(spark, sf_dir):
    summary = evaluation.summary_of(restored_valid(spark, sf_dir), by=["source"])
    return rounded(summary.select("source", "word_accuracy"))


def precision_recall(spark, sf_dir):
    summary = evaluation.summary_of(restored_valid(spark, sf_dir), by=["source"])
    ratios = [c for c in summary.columns if c.startswith(("precision_", "recall_"))]
    return rounded(summary.select("source", *ratios))


def candidate_accuracy(spark, sf_dir):
    summary = evaluation.summary_of(restored_valid(spark, sf_dir), by=["source"])
    return rounded(summary.select("source", "candidate_accuracy"))


def metrics_summary(spark, sf_dir):
    summary = evaluation.summary_of(restored_valid(spark, sf_dir), by=["lang"], rollup=True)
    return rounded(summary.withColumn("lang", F.coalesce("lang", F.lit("all"))))


def eval_sample(spark, sf_dir):
    sample = evaluate.fit_and_restore(usable_table(spark, sf_dir), VALID_EVERY, 40)
    return rounded(evaluation.summary_of(sample))


def still_wrong(spark, sf_dir):
    return evaluation.still_wrong(restored_valid(spark, sf_dir))


def corrections_summary(spark, sf_dir):
    """Validation documents in the place of hand-written sentences."""
    return rounded(evaluation.corrections_summary(restored_valid(spark, sf_dir)))


def split_counts(spark, sf_dir):
    return longs(windows.split_counts(_window_rows(spark, sf_dir)[1], WINDOW))


def corrections_accuracy(spark, sf_dir):
    """Accuracy on validation documents beside that on training documents seen already."""
    docs = usable_table(spark, sf_dir)
    forms = lexicon.fit(corpus.training(docs, VALID_EVERY))
    restored = lexicon.restore_frequent(corpus.with_split(docs, VALID_EVERY), forms)
    return rounded(evaluate.split_metrics(restored))


def corrections_beside_validation(spark, sf_dir):
    """A model that learned benchmark sentences as corrections, twice each, judged on both."""
    docs = usable_table(spark, sf_dir)
    sentences = table(spark, sf_dir, "benchmark").withColumn("text", F.expr(ROMANISED_PLAIN))
    known = sources.table_documents(sentences, "item_id", rank=1).withColumn(
        "text", marks.clean_text(F.col("text"))
    )
    train = corpus.training(docs, VALID_EVERY).select(*known.columns)
    forms = lexicon.fit(corpus.mix_corrections(train, known, 2))
    report = evaluate.split_report(
        docs, known, lambda texts: lexicon.restore_frequent(texts, forms), VALID_EVERY
    )
    return rounded(report)


def best_on_validation(spark, sf_dir):
    """Identity and most-frequent-form model, the better one on validation documents."""
    docs = corpus.with_split(usable_table(spark, sf_dir), VALID_EVERY)
    forms = lexicon.fit(docs.filter(F.col("split") == "train"))
    restored = lexicon.restore_frequent(docs, forms)
    models = F.array(
        F.struct(F.lit("identity").alias("id"), F.lit(1).alias("step"),
                 marks.strip_marks(F.col("text")).alias("restored")),
        F.struct(F.lit("frequent").alias("id"), F.lit(2).alias("step"), F.col("restored")),
    )
    outputs = restored.select("split", "text", F.explode(models).alias("m")).select(
        "split", "text", F.col("m.id").alias("model_id"), "m.step", "m.restored"
    )
    table = evaluation.summary_of(outputs, by=["model_id", "step", "split"])
    return rounded(evaluation.best_on_validation(table))


# --- windows ----------------------------------------------------------------------------------


def windows_train(spark, sf_dir):
    rows = _window_rows(spark, sf_dir)[1]
    return longs(
        rows.select(
            "doc_id",
            "win_no",
            "start",
            "n",
            "split",
            joined("input_ids").alias("input_ids"),
            joined("labels", "").alias("labels"),
        )
    )


def windows_plan(spark, sf_dir):
    planned = windows.windows_text(
        romanised(spark, sf_dir).select("doc_id", "text"), WINDOW, OVERLAP
    )
    return longs(planned)


def window_stitch(spark, sf_dir):
    """The kept parts of all windows, put together, are the text."""
    docs = romanised(spark, sf_dir).select("doc_id", "text")
    pieces = windows.windows_text(docs, WINDOW, OVERLAP)
    whole = windows.window_stitch(pieces, "doc_id", "piece", "whole", docs)
    return whole.select("doc_id", F.coalesce("whole", "text").alias("text"))


# --- models -----------------------------------------------------------------------------------


def restore_frequent(spark, sf_dir):
    return restored_valid(spark, sf_dir).select("doc_id", "lang", "text", "restored")


def identity(spark, sf_dir):
    docs = corpus.validation(usable(spark, sf_dir), VALID_EVERY)
    floor = docs.withColumn("restored", marks.strip_marks(F.col("text")))
    return rounded(evaluation.summary_of(floor, by=["lang"]))


def _context_model(docs: DataFrame) -> DataFrame:
    train = corpus.training(docs, VALID_EVERY).select("doc_id", "text")
    return materialize(context.train(context.context_rows(train)), "contexts")


def train_context(spark, sf_dir):
    train = corpus.training(usable(spark, sf_dir), VALID_EVERY).select("doc_id", "text")
    return longs(context.train(context.context_rows(train)))


def restore_context(spark, sf_dir):
    docs = usable_table(spark, sf_dir)
    valid = corpus.validation(docs, VALID_EVERY).select("doc_id", "text")
    restored = context.restore_context(valid, _context_model(docs), 0.6)
    return restored.select("doc_id", "restored")


def restore_frequent_large(spark, sf_dir):
    """As with a dictionary that is too large to be sent."""
    docs = usable_table(spark, sf_dir)
    forms = lexicon.fit(corpus.training(docs, VALID_EVERY))
    valid = corpus.validation(docs, VALID_EVERY).select("doc_id", "lang", "text")
    return lexicon.restore_frequent(valid, forms, max_rows=0)


def restore_context_large(spark, sf_dir):
    """As with a model that is too large to be sent."""
    docs = usable_table(spark, sf_dir)
    valid = corpus.validation(docs, VALID_EVERY).select("doc_id", "text")
    restored = context.restore_context(valid, _context_model(docs), 0.6, max_rows=0)
    return restored.select("doc_id", "restored")


def choose_threshold(spark, sf_dir):
    chosen = threshold.choose_threshold(
        _scored_letters(spark, sf_dir), 0.6, ["lang"], weight="times"
    )
    return rounded(longs(chosen))


def _scored_letters(spark, sf_dir) -> DataFrame:
    """Validation letters, equal ones as one row that stands for `times` letters, scored."""
    docs = usable_table(spark, sf_dir)
    valid = corpus.validation(docs, VALID_EVERY).select("doc_id", "lang", "text")
    rows = context.counted_rows(context.context_rows(valid), ["lang"], "times")
    return context.score(rows, _context_model(docs))


def candidate_log_loss(spark, sf_dir):
    scored = _scored_letters(spark, sf_dir)
    rows = scored.withColumn("p_true", context.label_probability(F.col("label")))
    return rounded(evaluation.candidate_log_loss(rows, by=["lang"], weight="times"), 6)


def threshold_sweep(spark, sf_dir):
    return rounded(context.threshold_sweep(_scored_letters(spark, sf_dir), weight="times"))


def train_letter_classifier(spark, sf_dir):
    docs = usable_table(spark, sf_dir).select("doc_id", "lang", "text")
    train = context.context_rows(corpus.training(docs, VALID_EVERY))
    model = classifier.train_letter_classifier(train, max_iter=8)
    valid = context.context_rows(corpus.validation(docs, VALID_EVERY))
    rows = classifier.classify_letters(context.counted_rows(valid, ["lang"], "times"), model)
    counts = evaluation.pair_tallies(rows, "label", "pred", ["lang"], "times")
    return rounded(evaluation.metrics_summary(counts, ["lang"]).drop("word_accuracy"))


def count_letter_classifier(spark, sf_dir):
    """The model of counts, learnt from every training letter."""
    docs = usable_table(spark, sf_dir).select("doc_id", "lang", "text")
    train = context.context_rows(corpus.training(docs, VALID_EVERY))
    counts = materialize(classifier.letter_counts(train), "letter-counts")
    rows = context.context_rows(corpus.validation(docs, VALID_EVERY))
    scored = classifier.classify_by_counts(context.counted_rows(rows, ["lang"], "times"), counts)
    tallies = scored.groupBy("lang", "label", "pred").agg(
        F.sum("times").alias("n"),
        (F.sum(F.col("confidence") * F.col("times")) / F.sum("times")).alias("confidence"),
    )
    return rounded(longs(tallies), 6)


def score_windows(spark, sf_dir):
    """A stand-in for a network: marks letters in front of a space or after one."""

    def load():
        import numpy as np

        def predict(texts):
            answers = []
            for text in texts:
                points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
                space = np.concatenate([[False], points == 32, [False]])
                p = np.full((len(points), 3), 0.2)
                p[:, 0] = 0.6
                p[space[2:], 1] = 0.7
                p[space[:-2], 2] = 0.9
                answers.append(p)
            return answers

        return predict

    docs = romanised(spark, sf_dir).select("doc_id", "text")
    return scoring.restore_scored(docs, load, WINDOW, OVERLAP, 0.7)


def vector_quantize(spark, sf_dir):
    vecs = spread(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id")
    groups = vectors.vector_quantize(vecs, "embedding").select("vec_id", F.explode("groups").alias("g"))
    return groups.select(
        "vec_id",
        F.round("g.scale", 12).alias("scale"),
        joined("g.codes").alias("codes"),
        joined(vectors.pack_codes(F.col("g.codes"))).alias("packed"),
    )


def stored_vector(spark, sf_dir):
    """Vectors as weight files hold them, and the error of reading them back."""
    vecs = spread(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id")
    stored = vecs.withColumn("s", vectors.stored_vector(F.col("embedding")))
    back = stored.withColumn("back", vectors.loaded_vector(F.col("s")))
    worst = F.array_max(
        F.zip_with("embedding", "back", lambda a, b: F.abs(a.cast("double") - b.cast("double")))
    )
    return back.select(
        "vec_id",
        F.lower(F.hex("s.packed")).alias("packed"),
        F.lower(F.hex("s.scales")).alias("scales"),
        F.round(worst, 9).alias("worst"),
    )


def quantization_error(spark, sf_dir):
    vecs = spread(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"), "vec_id")
    return longs(rounded(vectors.quantization_error(vecs, "embedding", ["label"])))


# --- streams ----------------------------------------------------------------------------------


def _document_stream(spark, sf_dir) -> DataFrame:
    schema = table(spark, sf_dir, "documents").schema
    # a pattern, since a stream takes a single file by no other path; a folder of files fits as well
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/[d]ocuments.parquet")
    # The table is one file, hence one partition of one batch.
    stream = stream.repartition(spark.sparkContext.defaultParallelism, "doc_id")
    return sources.table_documents(
        stream.withColumn("text", F.expr(ROMANISED)), keep=("lang", "source")
    )


def _finish(query) -> None:
    query.awaitTermination()


def stream_filter(spark, sf_dir):
    out = new_path(spark, "stream")
    kept = jobs.filter_stream(_document_stream(spark, sf_dir), SETTINGS.corpus)
    _finish(jobs.write_filtered(kept, f"{out}/data", f"{out}/checkpoint"))
    schema = kept.schema
    docs = spark.read.schema(schema).parquet(f"{out}/data")
    return docs.select("doc_id", "lang", "split", F.md5("text").alias("h"))


def stream_restore(spark, sf_dir):
    out = new_path(spark, "stream")
    stream = _document_stream(spark, sf_dir)
    forms = dictionary(spark, sf_dir)
    _finish(jobs.restore_stream(stream, forms, f"{out}/data", f"{out}/checkpoint"))
    return spark.read.parquet(f"{out}/data").select("doc_id", "restored")


def stream_metrics(spark, sf_dir):
    out = new_path(spark, "stream")
    stream = _document_stream(spark, sf_dir).withColumn(
        "restored", marks.strip_marks(F.col("text"))
    )
    _finish(jobs.metrics_stream(stream, f"{out}/data", f"{out}/checkpoint", by=["lang"]))
    counts = jobs.merged_tallies(spark, f"{out}/data", ["lang"])
    return rounded(evaluation.metrics_summary(counts, ["lang"]))


def stream_running_metrics(spark, sf_dir):
    """Two runs with a restart: the counts of the first go on in the second."""
    out = new_path(spark, "stream")
    docs = romanised(spark, sf_dir).withColumn("restored", marks.strip_marks(F.col("text")))
    for rest in (0, 1):
        some = docs.filter(F.crc32("doc_id") % 2 == rest)
        some.select("lang", "text", "restored").write.mode("append").parquet(f"{out}/in")
        stream = spark.readStream.schema("lang STRING, text STRING, restored STRING").parquet(f"{out}/in")
        _finish(
            jobs.running_metrics_stream(stream, f"{out}/data", f"{out}/checkpoint", by=["lang"])
        )
    counts = jobs.running_tallies(spark, f"{out}/data", ["lang"])
    return rounded(evaluation.metrics_summary(counts, ["lang"]))


def stream_lines(spark, sf_dir):
    """Two runs with a restart, a line per document: numbers go on where the first run ended."""
    out = new_path(spark, "stream")
    forms = dictionary(spark, sf_dir)
    docs = romanised(spark, sf_dir).select("doc_id", F.translate("text", "\r\n", "  ").alias("text"))
    for rest in (0, 1):
        some = docs.filter(F.crc32("doc_id") % 2 == rest)
        some.select(F.concat_ws("\t", "doc_id", "text")).write.mode("append").text(f"{out}/in")
        lines_in = jobs.line_stream(spark, f"{out}/in")
        _finish(jobs.restore_line_stream(lines_in, forms, f"{out}/data", f"{out}/checkpoint"))
    found = jobs.restored_lines(spark, f"{out}/data")
    run = F.crc32(F.substring_index("value", "\t", 1)) % 2
    totals = found.groupBy(run.alias("run")).agg(
        F.min("line_no").alias("first_no"),
        F.max("line_no").alias("last_no"),
        F.countDistinct("line_no").alias("numbers"),
        F.sum(F.conv(F.substring(F.md5("restored"), 1, 7), 16, 10).cast("long")).alias("restored_sum"),
    )
    return longs(totals)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__.rstrip("_"): q
    for q in (
        src_parquet, src_hash_sample, src_line_chunks, src_line_files, src_text_files, src_corrections, src_chain,
        src_lines, sink_windows, src_windows, sink_alphabet, sink_summary, materialize_stamped_,
        tokenize_w, tokenize_letters, encode_chars, encode_example, decode_restore,
        skip_no_candidates, diff_chars, count_changed, split_long_text, restore_grouped,
        restore_grouped_context, restore_frequent_large, restore_context_large, choose_threshold,
        keep_document, is_validation, filtered, usable_,
        join_dictionary, join_alphabet, semi_always_marked, zip_positional, join_class_names,
        cross_repeat, corrections_mix,
        char_counts, alphabet_build, form_counts, fit_dictionary, dictionary_size, confusion,
        word_accuracy, precision_recall, candidate_accuracy, metrics_summary, eval_sample,
        still_wrong, corrections_summary, split_counts, corrections_accuracy,
        corrections_beside_validation, best_on_validation,
        windows_train, windows_plan, window_stitch,
        restore_frequent, identity, train_context, restore_context, candidate_log_loss,
        threshold_sweep, train_letter_classifier, count_letter_classifier, score_windows, vector_quantize, quantization_error,
        stored_vector, stream_filter, stream_restore, stream_metrics, stream_running_metrics,
        stream_lines,
    )
}
QUERIES |= {
    "fix_cedilla": fix_cedilla,
    "strip_marks": strip_marks,
    "clean_text": clean_text,
    "is_candidate": is_candidate,
    "labels_of": labels_of,
    "lower_upper": lower_upper,
    "strip_ws": strip_ws,
    "split_ws": split_ws,
    "strip_punct": strip_punct,
    "case_transfer": case_transfer,
    "merge_keep_marked": merge_keep_marked,
    "diacritic_ratio": mark_ratio,
    "marks_every_letter": marks_every_letter,
    "drops_marks": drops_marks,
    "max_chars_guard": max_chars_guard,
}
