import unicodedata

import pytest
from pyspark.sql import functions as F

from markspark.functions import codec, marks, quality, words

NORMALIZE = [
    ("", "", [], []),
    ("ab", "ab", [0, 0], [1, 0]),
    ("ăâîșț", "aaist", [1, 2, 2, 1, 1], [1, 1, 1, 1, 1]),
    ("ĂÂÎȘȚ", "AAIST", [1, 2, 2, 1, 1], [1, 1, 1, 1, 1]),
    ("aşa ţara", "asa tara", [0, 1, 0, 0, 1, 0, 0, 0], [1, 1, 1, 0, 1, 1, 0, 1]),
    ("Şi Ţara", "Si Tara", [1, 0, 0, 1, 0, 0, 0], [1, 1, 0, 1, 1, 0, 1]),
    ("În casă", "In casa", [2, 0, 0, 0, 0, 0, 1], [1, 0, 0, 0, 1, 1, 1]),
    ("când", "cand", [0, 2, 0, 0], [0, 1, 0, 0]),
    ("é 1 2", "é 1 2", [0] * 5, [0] * 5),
    ("a🙂ș", "a🙂s", [0, 0, 1], [1, 0, 1]),
]


def test_strip_labels_and_candidates(spark):
    df = spark.createDataFrame([(t,) for t, *_ in NORMALIZE], "text STRING")
    rows = df.select(
        "text",
        marks.fix_and_strip(F.col("text")).alias("stripped"),
        marks.strip_marks(marks.fix_cedilla(F.col("text"))).alias("two_steps"),
        marks.labels_of(F.col("text")).alias("labels"),
        marks.candidates_of(marks.fix_and_strip(F.col("text"))).alias("candidates"),
    ).collect()
    found = {r.text: r for r in rows}
    for text, stripped, labels, candidates in NORMALIZE:
        r = found[text]
        assert (r.stripped, r.two_steps) == (stripped, stripped)
        assert r.labels == labels
        assert r.candidates == [bool(c) for c in candidates]


@pytest.mark.parametrize(
    "text", ["zăpadă", "și", "é şi", "한글", "①ﬁ", "", "plain"]
)
def test_clean_text_is_nfc_then_comma(value, text):
    nfc = unicodedata.normalize("NFC", text)
    want = "".join({"ş": "ș", "ţ": "ț", "Ş": "Ș", "Ţ": "Ț"}.get(c, c) for c in nfc)
    assert value(marks.clean_text, text) == want


def test_clean_text_keeps_null(spark):
    df = spark.createDataFrame([(None,)], "text STRING")
    assert df.select(marks.clean_text(F.col("text")).alias("v")).first().v is None


def test_label_names(spark):
    df = spark.range(3).select(marks.label_name(F.col("id")).alias("v"))
    assert [r.v for r in df.collect()] == ["none", "breve_comma", "circumflex"]


def test_tokens(value):
    assert value(words.tokenize_w, "Și_a 12-x²") == ["și_a", "12", "x²"]
    assert value(words.tokenize_letters, "Și_a 12-x² într-un") == ["Și", "a", "x²", "într", "un"]
    assert value(words.gaps_between_letters, "«Da», nu!") == ["«", "», ", "!"]
    assert value(words.gaps_between_letters, "a") == ["", ""]
    assert value(words.gaps_between_letters, "") == [""]


@pytest.mark.parametrize(
    "text", ["", " ", "a", "  a  b ", "　a\xa0b\x1c\n", "a   \x85", "\ta\n\nb\r\n"]
)
def test_white_space_like_python(value, text):
    assert value(words.split_ws, text) == text.split()
    assert value(words.strip_ws, text) == text.strip()


def test_split_lines_like_python(value):
    text = "a\nb\r\nc\rd\x0be\x0cf\x1cg\x1dh\x1ei\x85j k l"
    assert value(words.split_lines, text) == text.splitlines()


def test_strip_punct(value):
    assert value(words.strip_punct, "„așa!”") == "așa"
    assert value(words.strip_punct, "(a.b),") == "a.b"


def test_ratio(value):
    assert value(quality.mark_ratio, "ă") == 1.0
    assert value(quality.mark_ratio, "xyz") == 0.0
    assert value(quality.mark_ratio, "aş") == 0.5
    assert value(quality.mark_ratio, "") == 0.0


GOOD = "Și dacă țara după așa, fără casă când și ea. " * 8


def test_keep_rules(value):
    assert value(quality.keep_document, GOOD)
    assert not value(quality.keep_document, GOOD[:150])
    bare = GOOD.translate(str.maketrans("ășțâîȘ", "astaiS"))
    assert not value(quality.keep_document, bare)
    # old encodings kept â and î but lost the other three
    lost = GOOD.translate(str.maketrans("ășțȘ", "astS")) + " când în mâine" * 9
    assert value(quality.mark_ratio, lost) >= 0.05
    assert not value(quality.marks_every_letter, lost)
    assert not value(quality.keep_document, lost)
    mixed = GOOD + " si daca fara" * 3
    assert value(quality.mark_ratio, mixed) >= 0.05 and value(quality.marks_every_letter, mixed)
    assert value(quality.drops_marks, mixed) and not value(quality.keep_document, mixed)


@pytest.mark.parametrize(("marked", "drops"), [(18, True), (19, False)])
def test_word_in_both_lists_counts_twice(value, marked, drops):
    # bare 1 > 0.05 * (1 + marked + 1): 18 marked words give 1 > 1.0, which is false
    text = "dintr " + "și " * marked
    want = 1 > 0.05 * (1 + marked + 1)
    assert value(quality.drops_marks, text) is want
    assert value(quality.drops_marks, "dintr " + "și " * 17)


def test_split_is_crc32_of_the_id(spark):
    import zlib

    ids = [str(i) for i in range(200)] + ["subtitles:7", "é"]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id STRING")
    rows = df.select("doc_id", quality.is_validation(F.col("doc_id"), 5).alias("v")).collect()
    assert all(r.v == (zlib.crc32(r.doc_id.encode()) % 5 == 0) for r in rows)


DECODE = [
    ("", [], 0.5, ""),
    ("casa", [(0, 0.9)] * 3 + [(1, 0.9)], 0.5, "casă"),
    ("casa", [(0, 0.9)] * 3 + [(1, 0.4)], 0.5, "casa"),
    ("cand", [(0, 0.9), (2, 0.9), (0, 0.9), (0, 0.9)], 0.5, "când"),
    ("in", [(2, 0.9), (0, 0.9)], 0.5, "în"),
    ("SI TARA", [(1, 0.9), (0, 0.9), (0, 0.9), (1, 0.9), (0, 0.9), (0, 0.9), (0, 0.9)], 0.5,
     "ȘI ȚARA"),
    ("sit", [(2, 0.9), (1, 0.9), (2, 0.9)], 0.5, "sit"),
    ("b", [(1, 0.9)], 0.5, "b"),
    ("a", [(1, 0.5)], 0.5, "ă"),
    ("AIi", [(2, 1.0)] * 3, 1.0, "ÂÎî"),
]
PREDICTIONS = "text STRING, p ARRAY<STRUCT<label: INT, confidence: DOUBLE>>, t DOUBLE"


def test_decode(spark):
    df = spark.createDataFrame([(t, p, th) for t, p, th, _ in DECODE], PREDICTIONS)
    out = df.select(codec.decode_restore(F.col("text"), F.col("p"), F.col("t")).alias("v"))
    assert [r.v for r in out.collect()] == [want for *_, want in DECODE]


def test_decode_length_mismatch_is_an_error(spark):
    df = spark.createDataFrame([("ab", [(0, 0.9)], 0.5)], PREDICTIONS)
    with pytest.raises(Exception, match="length 2 got 1 predictions"):
        df.select(codec.decode_restore(F.col("text"), F.col("p"), 0.5)).collect()


def test_encode(value):
    assert value(lambda t: codec.encode_chars(t, "abc"), "abxc") == [2, 3, 1, 4]
    assert value(lambda t: codec.encode_chars(t, " a"), "a z") == [3, 2, 1]
    example = value(lambda t: codec.encode_example(t, "ist"), "şi ț")
    assert example.input_ids == [3, 2, 1, 4]
    assert example.labels == [1, 0, 0, 1]
    assert example.candidates == [True, True, False, True]


@pytest.mark.parametrize(
    ("original", "form", "want"),
    [("CASA", "casă", "CASĂ"), ("Casa", "casă", "Casă"), ("tara", "țară", "țară"),
     ("ab", "abc", "ab"), ("STRASSE", "straßee", "STRAßEE".replace("ß", "S"))],
)
def test_case_transfer(spark, original, form, want):
    df = spark.createDataFrame([(original, form)], "o STRING, f STRING")
    assert df.select(codec.case_transfer(F.col("o"), F.col("f")).alias("v")).first().v == want


def test_merge_and_count(spark):
    df = spark.createDataFrame([("şi casa", "si casă"), ("ab", "abc")], "o STRING, r STRING")
    out = df.select(
        codec.merge_keep_marked(F.col("o"), F.col("r")).alias("m"),
        codec.count_changed(F.col("o"), F.col("r")).alias("n"),
    ).collect()
    assert out[0].m == "și casă" and out[0].n == 2
    assert out[1].m == "abc"
