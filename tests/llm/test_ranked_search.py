import math
import re
from collections import Counter

import numpy as np
import pytest

from markspark.llm import ranked_search as rs
from markspark.llm.terms import term_pieces
from tests.llm import samples

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
QUERIES = [
    (1, "w1 w2 w2 w3"), (2, "W1, w1; nothing-else"), (3, ""), (4, None), (5, "not in any text xyzzy"),
    (5, "word1 and1"), (None, "this passage of some length"), (7, "日本語 1234 it's"), (8, samples.PASSAGE),
    (8, samples.PASSAGE), (9, " ".join(f"w{k}" for k in range(60))), (10, "é"), (11, "one"),
]


def terms(text):
    return TERM.findall((text or "").translate(samples.LOWER))


def brute(docs, queries, k=20):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for q, text in queries:
        scored = []
        for i, c, n in held:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
                for t in terms(text)
                if c[t]
            )
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        for rank, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1):
            out.append((q, rank, i, -s))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


def queries(spark, rows=QUERIES):
    schema = "item_id LONG, text STRING, number LONG, score DOUBLE, id STRING"
    return spark.createDataFrame([(q, t, 1, 0.5, "x") for q, t in rows], schema)


@pytest.mark.parametrize("postings, k", [(1_000_000, 20), (40, 20), (40, 3), (500, 1)])
def test_tricky_rows(spark, monkeypatch, postings, k):
    monkeypatch.setattr(rs, "BLOCK_POSTINGS", postings)
    rows = [(r[0], r[1]) for r in samples.tricky()]
    got = rs.search(samples.documents(spark), queries(spark), k)
    assert result(got) == brute(rows, QUERIES, k)


def test_groups_of_queries(spark, monkeypatch):
    monkeypatch.setattr(rs, "GROUP_TERMS", 12)
    rows = [(r[0], r[1]) for r in samples.tricky()]
    assert result(rs.search(samples.documents(spark), queries(spark), 4)) == brute(rows, QUERIES, 4)


def test_given_documents(spark):
    rows = samples.fixture_documents()
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    asked = [(r.item_id, r.text) for r in items.collect()]
    assert result(rs.search(docs, items)) == brute(rows, asked)


def test_text_ids(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), (None, "x y"), ("c", "z")], "doc_id STRING, text STRING")
    found = rs.search(docs, queries(spark, [(1, "x")])).orderBy("rank").collect()
    assert [r.doc_id for r in found] == ["a", "b", None]


def test_empty(spark):
    none = samples.documents(spark).limit(0)
    assert rs.search(none, queries(spark)).count() == 0
    assert rs.search(samples.documents(spark), queries(spark).limit(0)).count() == 0


def lists_of(tfs, n_terms):
    term, doc = np.nonzero(tfs)
    return rs.Lists(doc, term, tfs[term, doc], np.arange(tfs.shape[1]), n_terms)


def test_ties_at_the_end_are_kept_and_reading_stops_early():
    rnd = np.random.default_rng(3)
    tfs = rnd.integers(0, 4, (5, 20_000)) * (rnd.random((5, 20_000)) < 0.4)
    tfs[:, 7_000:7_030] = 90  # thirty documents with equal scores, far above the others
    lists = lists_of(tfs, 5)
    terms, weights = np.arange(5), np.array([5, 4, 3, 2, 1])
    docs, scores, depth = lists.best(terms, weights, 20, 0)
    assert docs.tolist() == list(range(7_000, 7_020)) and set(scores.tolist()) == {90 * 15}
    assert depth < 1_000
    # a floor from other blocks keeps what equals it and stops as early
    docs, _, _ = lists.best(terms, weights, 20, 90 * 15)
    assert docs.tolist() == list(range(7_000, 7_020))
    docs, _, depth = lists.best(terms, weights, 20, 90 * 15 + 1)
    assert not len(docs) and depth < 1_000


def test_best_positions_follow_direct_accesses():
    """Two lists in opposite orders: whatever is met in one list is seen at the other's end, so that
    both are seen to the end when half of each was read in order."""
    tfs = np.array([np.arange(1, 1_025), np.arange(1_024, 0, -1)])
    _, _, depth = lists_of(tfs, 2).best(np.arange(2), np.array([1, 1]), 20, 0)
    assert depth < 1_024


def test_terms_come_whole_from_pieces():
    text = "Aé1_b!cc 日本 dd\x7fee".encode() * 50
    whole = [t for part in term_pieces(text) for t in part]
    assert whole == [t.encode() for t in terms(text.decode())]
    for size in (1, 7, 64):
        assert [t for part in term_pieces(text, size) for t in part] == whole
