"""Random texts against straight-line Python."""

import re
import unicodedata
from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from markspark.functions import marks, quality, words
from markspark.language import ROMANIAN
from markspark.operators import evaluation, lexicon, windows

LETTERS = st.text(alphabet="aăâiîsștțţşxyAĂÂIÎSȘTȚ é²🙂\n\t_-.7", max_size=60)
TEXTS = st.lists(LETTERS, min_size=1, max_size=12)
few = settings(
    max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
BASE = str.maketrans("ăâîșțĂÂÎȘȚ", "aaistAAIST")
FIX = str.maketrans("şţŞŢ", "șțȘȚ")


def frame(spark, texts):
    rows = [(str(i), t, 0, i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id STRING, text STRING, source_rank INT, ord LONG")


@few
@given(TEXTS)
def test_scalars(spark, texts):
    df = frame(spark, texts).select(
        "text",
        marks.clean_text(F.col("text")).alias("clean"),
        marks.fix_and_strip(F.col("text")).alias("stripped"),
        quality.mark_ratio(F.col("text")).alias("ratio"),
        quality.marks_every_letter(F.col("text")).alias("every"),
        words.tokenize_w(F.col("text")).alias("words"),
        words.split_ws(F.col("text")).alias("parts"),
    )
    for r in df.collect():
        fixed = r.text.translate(FIX)
        assert r.clean == unicodedata.normalize("NFC", r.text).translate(FIX)
        assert r.stripped == fixed.translate(BASE)
        spots = [c for c in fixed if c.translate(BASE) in "aistAIST"]
        marked = [c for c in spots if c in ROMANIAN.marked]
        assert r.ratio == pytest.approx(len(marked) / len(spots) if spots else 0.0)
        low = r.text.lower()
        n = Counter(low)
        shares = {(n[m] / (n[m] + n[p]) if n[m] + n[p] else 1.0) - k for p, m, k in ROMANIAN.min_marked}
        assert r.every == (min(shares) >= 0)
        assert r.words == re.findall(r"\w+", low)
        assert r.parts == r.text.split()


@few
@given(TEXTS, TEXTS)
def test_word_model(spark, train, texts):
    """A form is one of those seen, none is more frequent, and restoring writes these forms with
    the letters' own case and changes nothing else."""
    letters = re.compile(r"[^\W\d_]+")
    seen = [w.lower() for t in train for w in letters.findall(t.translate(FIX))]
    docs = frame(spark, train)
    forms = lexicon.fit_dictionary(lexicon.form_counts(docs.repartition(3)))
    best = {r.key: r.form for r in forms.collect()}
    assert set(best) == {w.translate(BASE) for w in seen}
    for key, form in best.items():
        rivals = Counter(w for w in seen if w.translate(BASE) == key)
        assert rivals[form] == max(rivals.values())
        assert form == next(w for w in seen if w in rivals and rivals[w] == rivals[form])

    for dictionary in (forms, lexicon.prune_dictionary(forms)):
        out = lexicon.restore_frequent(frame(spark, texts), dictionary)
        rows = out.collect()
        assert sorted(r.text for r in rows) == sorted(texts)
        for r in rows:
            bare = r.text.translate(FIX).translate(BASE)
            assert len(r.restored) == len(bare)
            assert letters.sub("", r.restored) == letters.sub("", bare)
            for old, new in zip(letters.finditer(bare), letters.finditer(r.restored)):
                form = best.get(old[0].lower(), old[0].lower())
                assert old.span() == new.span()
                if len(form) == len(old[0]):
                    assert new[0].lower() == form.lower()
                    assert [c.isupper() for c in new[0]] == [c.isupper() for c in old[0]]


@few
@given(st.lists(st.tuples(LETTERS, st.integers(0, 9)), min_size=1, max_size=8))
def test_tallies(spark, pairs):
    """Restored texts differ in marks, in letters, or not at all."""
    rows, want = [], Counter()
    for text, seed in pairs:
        text = text.translate(FIX)
        swap = {0: str, 1: lambda t: t.translate(BASE), 2: lambda t: t.replace("a", "ă"),
                3: lambda t: t.replace("s", "x")}.get(seed, str)
        out = swap(text)
        rows.append((text, out))
        label = {**dict.fromkeys("ășțĂȘȚ", 1), **dict.fromkeys("âîÂÎ", 2)}
        for r, o in zip(text, out):
            if r.translate(BASE) in "aistAIST":
                want[label.get(r, 0) * 3 + label.get(o, 0)] += 1
        for r, o in zip(text.split(), out.split()):
            want[10 if r == o else 9] += 1
    df = spark.createDataFrame(rows, "text STRING, restored STRING")
    got = {r.code: r.n for r in evaluation.tallies(df).collect() if r.n}
    assert got == {code: n for code, n in want.items() if n}


@few
@given(TEXTS, st.integers(2, 9), st.data())
def test_windows_join_to_the_text(spark, texts, window, data):
    overlap = data.draw(st.integers(0, window - 1))
    df = frame(spark, texts).select("doc_id", "text")
    rows = windows.windows_text(df, window, overlap).collect()
    joined = defaultdict(str)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.win_no)):
        assert len(r.piece) == r.end - r.start <= window
        joined[r.doc_id] += r.piece[r.keep_from - r.start : r.keep_to - r.start]
    assert dict(joined) == {str(i): t for i, t in enumerate(texts) if t}
    lettered = windows.windows_text(df, window, overlap).withColumn("v", marks.chars(F.col("piece")))
    whole = windows.window_stitch(lettered, "doc_id", "v", "v", df).collect()
    assert {r.doc_id: "".join(r.v or []) for r in whole} == {str(i): t for i, t in enumerate(texts)}
