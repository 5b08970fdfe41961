import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from markspark.llm import bpe, packing
from tests.llm import samples

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(df, texts, window):
    """Every id lies in one piece, sequences have no gaps, and little is padded."""
    library = Tokenizer.from_file(PATH)
    ids = defaultdict(list)
    for i, t in texts:
        encoded = library.encode(t or "", add_special_tokens=False).ids
        ids[i].append(np.array([*encoded, packing.END_ID], "<u4"))
    rows = df.collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        some = [x for x in ids[r.doc_id] if len(x) == r.doc_tokens]
        crcs = [zlib.crc32(x[r.start : r.start + r.length].tobytes()) for x in some]
        assert r.length > 0 and r.ids_crc32 in crcs
    assert set(pieces) == set(ids)
    for doc, found in pieces.items():
        assert sum(r.length for r in found) == sum(map(len, ids[doc]))
        if len(ids[doc]) == 1:
            at = 0
            for r in sorted(found, key=lambda r: r.start):
                assert r.start == at
                at += r.length
    padded = 0
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        padded += 0 if at & (at - 1) == 0 else window - at
    total = sum(len(x) for some in ids.values() for x in some)
    assert padded <= 0.01 * total
    return rows


@pytest.mark.parametrize("window, open_windows", [(4096, 32), (64, 4)])
def test_tricky_rows(spark, window, open_windows):
    texts = [(r[0], r[1]) for r in samples.tricky()]
    docs = samples.documents(spark)
    packed = packing.pack(docs, PATH, window=window, open_windows=open_windows)
    check(packed, texts, window)


def test_merging_in_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "MERGED_TASKS", 2)
    texts = samples.fixture_documents()
    docs = spark.createDataFrame(texts, "doc_id LONG, text STRING").repartition(9)
    rows = check(packing.pack(docs, PATH, open_windows=3, keep_ids=True), texts, 4096)
    for r in rows:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length


def test_best_fit_and_the_fullest_leaves_first():
    out = []
    packer = packing.Packer(out.append, 64, 2)
    for doc, n in (("a", 30), ("b", 50), ("c", 14), ("d", 34), ("e", 40)):
        packer.add(doc, 0, np.zeros(n, np.uint16), n)
    # c fits both and goes where less is left; d then fills the window of a
    assert [[(p[0], len(p[2])) for p in s] for s in out] == [[("b", 50), ("c", 14)], [("a", 30), ("d", 34)]]
    packer.finish()
    assert [sum(len(p[2]) for p in s) for s in out[2:]] == [32, 8]


def test_empty_and_window(spark):
    assert packing.pack(samples.documents(spark).limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        packing.pack(samples.documents(spark), PATH, window=100)


def test_small_caches_give_the_same_pieces(spark):
    """Packing had no way to bound what the tokenizer keeps in a worker."""
    docs = samples.documents(spark).coalesce(1)
    whole = packing.pack(docs, PATH).collect()
    small = packing.pack(docs, PATH, cached=10).collect()
    assert sorted(small, key=repr) == sorted(whole, key=repr)
    known = bpe.Encoder(PATH, 10)
    list(known.encode_all(f"word{i} and another{i}" for i in range(100)))
    for cache in (known.of_word, known.of_chunk):
        assert len(cache) <= 10 and len(cache.old) <= 10
