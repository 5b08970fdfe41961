import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from markspark.llm import gramtable, resampling
from tests.llm import samples

TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text):
    w = TERM.findall((text or "").translate(samples.LOWER))
    return len(w), [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def bucket(gram, buckets):
    return zlib.crc32(gram.encode()) % buckets


def brute(docs, target, share=5, buckets=10_000, least_words=20):
    s = Counter(bucket(g, buckets) for _, t in docs for g in grams(t)[1])
    t = Counter(bucket(g, buckets) for x in target for g in grams(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = {
        b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
        for b in s
    }
    out, able = [], []
    for i, text in docs:
        words, found = grams(text)
        weight = sum(gain[bucket(g, buckets)] for g in found)
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(found), weight, score, None, words])
        if score is not None and words >= least_words:
            able.append(out[-1])
    able.sort(key=lambda r: (-r[3], r[0], r[1], r[5]))
    for rank, row in enumerate(able[: share * len(able) // 100], 1):
        row[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=repr)


def result(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("share, batch", [(5, 1 << 19), (50, 1 << 10), (100, 1 << 19)])
def test_tricky_rows(spark, monkeypatch, share, batch):
    monkeypatch.setattr(gramtable, "BATCH_BYTES", batch)
    rows = [(r[0], r[1]) for r in samples.tricky()]
    target = [samples.PASSAGE, "w1 w2 w3", None, "", "one two"]
    goal = spark.createDataFrame([(t,) for t in target], "text STRING")
    docs = samples.documents(spark)
    gains = resampling.fit(docs, goal)
    got = resampling.ranked(resampling.weigh(docs, gains), share)
    assert result(got) == brute(rows, target, share)


def test_given_documents(spark):
    rows = samples.fixture_documents()
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(3)
    goal = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    weighed = resampling.weigh(docs, resampling.fit(docs, goal))
    ranks = resampling.ranked(weighed)
    assert result(ranks) == brute(rows, [r.text for r in goal.collect()])
    drawn = {r.doc_id for r in ranks.filter("rank IS NOT NULL").collect()}
    assert drawn and {r.doc_id for r in resampling.draw(docs, ranks).collect()} == drawn


def test_ties_and_few_buckets(spark):
    """Thousands of rows whose scores repeat; ids are told apart, rows with one id are not."""
    rows = [(i % 900, " ".join(["a b c d e"] * (4 + i % 3))) for i in range(2_000)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(5)
    goal = spark.createDataFrame([("a b",), ("z",)], "text STRING")
    gains = resampling.fit(docs, goal, resampling.Features(3, 7))
    got = resampling.ranked(resampling.weigh(docs, gains), 13)
    assert result(got) == brute(rows, ["a b", "z"], 13, 7)


def test_empty(spark):
    docs = samples.documents(spark)
    none = docs.limit(0)
    gains = resampling.fit(none, none)
    assert not gains.by_bucket.any()
    assert resampling.ranked(resampling.weigh(none, gains)).count() == 0
    assert {r.weight for r in resampling.weigh(docs, gains).collect()} == {0}


def test_hashes_and_checksums_are_those_of_the_libraries():
    rnd = np.random.default_rng(5)
    content = rnd.integers(0x30, 0x7A, 3_000).astype(np.uint8).tobytes()
    data = gramtable.Bytes(content)
    starts, lengths = rnd.integers(0, 2_300, 900), rnd.integers(0, 700, 900)
    parts = [content[a : a + n] for a, n in zip(starts.tolist(), lengths.tolist())]
    assert data.hashes(starts, lengths).tolist() == [xxhash.xxh64_intdigest(p) for p in parts]
    assert data.checksums(starts, lengths).tolist() == [zlib.crc32(p) for p in parts]


def test_equal_hashes_do_not_join_different_grams(monkeypatch):
    """With one hash for all, only the bytes tell n-grams apart."""
    texts = [b"alpha beta gamma", b"alpha beta gamma2", b"beta " + b"x" * 400, b"x" * 400 + b" y" + b"x" * 399]
    plain = gramtable.GramTable(next(gramtable.batches(texts, 3)), 3, 10_000)
    monkeypatch.setattr(gramtable.Bytes, "hashes", lambda self, a, n: np.zeros(len(a), np.uint64))
    crowded = gramtable.GramTable(next(gramtable.batches(texts, 3)), 3, 10_000)
    assert len(plain.used) == len(crowded.used)
    assert (plain.bucket_counts(10_000) == crowded.bucket_counts(10_000)).all()
    assert sorted(plain.counts[plain.used]) == sorted(crowded.counts[crowded.used])


def test_long_texts_in_segments(monkeypatch):
    text = " ".join(f"t{k % 50}" for k in range(500)).encode()
    whole = gramtable.GramTable(next(gramtable.batches([text], 3)), 3, 100).bucket_counts(100)
    parts = gramtable.term_pieces
    monkeypatch.setattr(gramtable, "term_pieces", lambda t: parts(t, 20))
    cut = list(gramtable.segments([text], 3))
    assert len(cut) > 50
    assert (gramtable.GramTable(cut, 3, 100).bucket_counts(100) == whole).all()
