import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from markspark.llm import chosenpath, components
from markspark.llm.jaccard import Threshold
from markspark.storage import materialize
from tests.llm import samples
from tests.llm.test_jaccard import brute


def result(df):
    rows = df.collect()
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in rows)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=repr)


@pytest.mark.parametrize("n, least", [(5, 85), (3, 70)])
def test_tricky_rows(spark, n, least):
    rows = [(r[0], r[1]) for r in samples.tricky()]
    got = chosenpath.similar_texts(samples.documents(spark), n, Threshold(least, 100))
    assert result(got) == brute(rows, n, least, 100)


@pytest.mark.parametrize("small, copies, shared", [(32, 25, 120), (4, 6, 20)])
def test_near_copies_in_chains_and_common_passages(spark, monkeypatch, small, copies, shared):
    """Texts drift away from a base step by step; others share one long passage and nothing else, so
    that many unlike sets choose one token and cells have to branch."""
    monkeypatch.setattr(chosenpath, "SMALL", small)
    rnd = random.Random(7)
    vocabulary = [f"v{k}" for k in range(400)]
    rows = []
    for _ in range(5):
        text = [rnd.choice(vocabulary) for _ in range(rnd.choice([12, 30, 90, 250]))]
        for _ in range(copies):
            rows.append((len(rows), " ".join(text)))
            for _ in range(rnd.choice([0, 1, 1, 2])):
                text[rnd.randrange(len(text))] = rnd.choice(vocabulary)
    passage = " ".join(rnd.choice(vocabulary) for _ in range(60))
    for _ in range(shared):
        rows.append((len(rows), passage + " " + " ".join(rnd.choice(vocabulary) for _ in range(30))))
    rnd.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    assert result(chosenpath.similar_texts(docs)) == brute(rows, 5, 85, 100)


def test_given_documents(spark):
    rows = samples.fixture_documents("sf0.01")
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(4)
    assert result(chosenpath.similar_texts(docs)) == brute(rows, 5, 85, 100)


def test_text_ids_and_no_rows(spark):
    text = " ".join(f"x{k}" for k in range(100))
    docs = spark.createDataFrame([("b", text), ("a", text + " y"), ("c", "x")], "doc_id STRING, text STRING")
    assert result(chosenpath.similar_texts(docs)) == [("a", 97, "a"), ("b", 96, "a"), ("c", 1, "c")]
    assert chosenpath.similar_texts(docs.limit(0)).count() == 0


def test_recall_of_links_at_the_threshold():
    """Pairs right at the threshold, simulated with the operator's own tokens: the share that some
    tree keeps together through `DEPTH` branchings is the recall asked for."""
    threshold = Threshold(85, 100)
    trees = chosenpath.trees_for(threshold, 0.99)
    rnd = np.random.default_rng(4)
    pairs = []
    for _ in range(400):
        both = rnd.integers(0, 1 << 63, 170, dtype=np.uint64)
        pairs += [
            np.concatenate([both, rnd.integers(0, 1 << 63, 15, dtype=np.uint64)]),
            np.concatenate([both, rnd.integers(0, 1 << 63, 15, dtype=np.uint64)]),
        ]
    chosen = np.array([chosenpath.minwise(pairs, k) for k in range(trees + 64)])
    same = chosen[:, 0::2] == chosen[:, 1::2]
    assert abs(same.mean() - 0.85) < 0.01
    assert (same[trees:].sum(axis=0) >= chosenpath.least_agreeing(threshold)).all()

    def together(pair, depth):
        if not depth:
            return True
        picks = 1 + (rnd.random() < chosenpath.second_pick(threshold))
        return any(
            same[trees + t, pair] and together(pair, depth - 1)
            for t in rnd.choice(64, picks, replace=False)
        )

    found = [
        any(same[t, p] and together(p, chosenpath.DEPTH) for t in range(trees)) for p in range(400)
    ]
    assert np.mean(found) > 0.97
    assert chosenpath.survival(threshold, 0) == 0.85


def test_trees_alone_find_what_brute_force_finds(spark):
    """Links of the given documents, pair by pair: the share of linked pairs in one class."""
    rows = samples.fixture_documents("sf0.01")
    sets, held = {}, defaultdict(list)
    for i, t in rows:
        w = samples.words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        for gram in sets[i]:
            held[gram].append(i)
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    classes = {r.doc_id: r.component_id for r in chosenpath.similar_texts(docs, recall=0.9).collect()}
    linked = found = 0
    for i, s in sets.items():
        for j, both in Counter(other for gram in s for other in held[gram]).items():
            if i < j and 100 * both >= 85 * (len(s) + len(sets[j]) - both):
                linked += 1
                found += classes[i] == classes[j]
    assert linked > 50 and found >= 0.9 * linked


def test_each_level_is_cleaned_up_after(spark, monkeypatch):
    levels, cleaned = [], []
    confirm, forget = chosenpath._Search.confirm, chosenpath.forget_shuffles
    monkeypatch.setattr(
        chosenpath._Search, "confirm", lambda self, pairs: (levels.append(1), confirm(self, pairs))[1]
    )
    monkeypatch.setattr(chosenpath, "forget_shuffles", lambda s: (cleaned.append(1), forget(s))[1])
    words = [f"w{k}" for k in range(80)]
    rows = [(k, " ".join([*words, f"x{k}"])) for k in range(6)] + [(9, "another text")]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    assert result(chosenpath.similar_texts(docs)) == brute(rows, 5, 85, 100)
    assert len(cleaned) >= len(levels) >= 1


def test_classes_are_contracted_one_end_at_a_time(spark, monkeypatch):
    """No plan holds the steps for both ends of an edge: that made it several times as large."""
    joins = []

    def written(df, name="table"):
        joins.append(df._jdf.queryExecution().analyzed().toString().count("Join "))
        return materialize(df, name)

    monkeypatch.setattr(components, "materialize", written)
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4)], "a LONG, b LONG")
    got = {r.id: r.component for r in components.components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}
    assert max(joins) <= 10


@pytest.mark.parametrize("leaf, small, named", [(4, 32, (1, 2)), (30, 4, (1, 2)), (8_192, 128, (1,))])
def test_leaves_and_branches_of_any_size(spark, monkeypatch, leaf, small, named):
    monkeypatch.setattr(chosenpath, "LEAF", leaf)
    monkeypatch.setattr(chosenpath, "SMALL", small)
    monkeypatch.setattr(chosenpath, "NAMED", named)
    rnd = random.Random(11)
    vocabulary = [f"v{k}" for k in range(400)]
    rows = []
    for _ in range(3):
        text = [rnd.choice(vocabulary) for _ in range(rnd.choice([12, 90, 250]))]
        for _ in range(12):
            rows.append((len(rows), " ".join(text)))
            for _ in range(rnd.choice([0, 1, 1, 2])):
                text[rnd.randrange(len(text))] = rnd.choice(vocabulary)
    passage = " ".join(rnd.choice(vocabulary) for _ in range(60))
    for _ in range(20):
        rows.append((len(rows), passage + " " + " ".join(rnd.choice(vocabulary) for _ in range(30))))
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    assert result(chosenpath.similar_texts(docs)) == brute(rows, 5, 85, 100)


def test_unlinked_near_copies_need_one_comparison_of_their_cells(spark, monkeypatch):
    """Texts alike by some 0.7 share cells without being linked. They used to stay together, level after
    level, and every pair of a small cell became a candidate; parities rule the pairs out at once."""
    cells, tested = [], []
    open_cells, confirm = chosenpath._Search.cells, chosenpath._Search.confirm

    def counted(self, pairs):
        tested.append(pairs.count())
        confirm(self, pairs)

    monkeypatch.setattr(
        chosenpath._Search, "cells", lambda self, rows: (cells.append(1), open_cells(self, rows))[1]
    )
    monkeypatch.setattr(chosenpath._Search, "confirm", counted)
    rnd = random.Random(3)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(300):
        text = list(base)
        for place in rnd.sample(range(200), 7):
            text[place] = f"x{k}-{place}"
        rows.append((k, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    got = result(chosenpath.similar_texts(docs))
    assert got == brute(rows, 5, 85, 100)
    assert len(cells) <= 3 and sum(tested) < 3_000
