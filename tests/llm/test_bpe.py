import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql.types import StructType
from tokenizers import Tokenizer

from markspark.llm import bpe, jaccard, toxicity
from tests.llm import samples

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    rnd = random.Random(11)
    letters = "abein st'’éü.,!10\n<|>"
    out = ["".join(rnd.choice(letters) for _ in range(300)) for _ in range(150)]
    spans = [(0x20, 0x250), (0x300, 0x3000), (0x10000, 0x1F900)]
    for _ in range(80):
        out.append("".join(chr(rnd.randrange(*rnd.choice(spans))) for _ in range(150)))
    out += [r[1] for r in samples.tricky()] + [t for _, t in samples.fixture_documents()]
    return out + ["ΣΑΣ İI ẞß ﬁ", "aaa aaaa aaaaaaaa " * 9, "x\x00y", "'s's 'll've I'Ve", "½²Ⅷ๑"]


def test_same_ids_and_decoded_texts_as_the_library(library):
    encoder = bpe.Encoder(PATH)
    some = texts()
    want = library.encode_batch_fast([t or "" for t in some], add_special_tokens=False)
    for text, w, got in zip(some, want, encoder.encode_all(some)):
        assert got.tolist() == w.ids, text
        assert encoder.encode(text).tolist() == w.ids
        assert encoder.decode(got) == library.decode(w.ids, skip_special_tokens=False)


def test_every_code_point_of_the_basic_plane(library):
    encoder = bpe.Encoder(PATH)
    for start in range(0, 0x10000, 0x400):
        points = [c for c in range(start, start + 0x400) if not 0xD800 <= c < 0xE000]
        some = [f"a{chr(c)}b {chr(c)}{chr(c)}" for c in points]
        want = library.encode_batch_fast(some, add_special_tokens=False)
        for text, w, got in zip(some, want, encoder.encode_all(some)):
            assert got.tolist() == w.ids, text


def test_a_cache_that_overflows(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 50)
    monkeypatch.setattr(bpe, "BATCH_CHARS", 1_000)
    some = [t for _, t in samples.fixture_documents()]
    want = library.encode_batch_fast(some, add_special_tokens=False)
    got = list(bpe.Encoder(PATH).encode_all(some))
    assert [g.tolist() for g in got] == [w.ids for w in want]


def test_frames(spark, library):
    docs = samples.documents(spark)
    encoded = bpe.encode(docs, PATH)
    decoded = {(r.doc_id, r.text) for r in bpe.decode(encoded, PATH).collect()}
    want = set()
    for i, t, *_ in samples.tricky():
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.add((i, library.decode(ids, skip_special_tokens=False)))
    assert decoded == want
    digests = bpe.encoded_digests(docs, PATH).collect()
    assert len(digests) == len(samples.tricky())
    assert {r.n_tokens for r in digests if r.doc_id in (4, 5, 6)} == {0}
    empty = docs.limit(0)
    assert bpe.encode(empty, PATH).count() == 0 and bpe.encoded_digests(empty, PATH).count() == 0
    assert bpe.decode(bpe.encode(empty, PATH), PATH).count() == 0


def test_null_ids_decode_to_nothing(spark):
    rows = spark.createDataFrame([(1, None), (2, [])], "doc_id LONG, ids ARRAY<INT>")
    assert [r.text for r in bpe.decode(rows, PATH).collect()] == ["", ""]
    assert bpe.Encoder(PATH).spell(np.array([3, 40], np.uint16)) == "3 40"


def test_other_operators_leave_no_caches_in_their_worker(spark):
    """A worker that scored or sketched texts after tokenizing used to keep the tokenizer's caches."""
    batch = pa.RecordBatch.from_pydict({"id": [1], "text": ["some words of a text"]})
    runs = []

    class Docs:
        schema = StructType.fromDDL("id LONG, text STRING")
        columns = ["id", "text"]
        sparkSession = spark

        def mapInArrow(self, run, schema):
            runs.append(run)

    jaccard._sketches(Docs(), 3, jaccard.Threshold())
    toxicity.with_score(Docs(), toxicity.Model(0.0), "text", "score")
    for run in runs:
        list(bpe.encoder(PATH).encode_all(["a text"]))
        assert bpe.encoder.cache_info().currsize
        assert sum(b.num_rows for b in run(iter([batch]))) == 1
        assert not bpe.encoder.cache_info().currsize
