import os
import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from markspark.llm import jaccard
from markspark.llm.common import mapped
from markspark.llm.components import components
from markspark.llm.language_model import Vocabulary
from markspark.storage import _own_folder, discard, materialize
from tests.llm import samples


def brute(rows, n, least, of):
    sets = []
    for i, t in rows:
        w = samples.words(t)
        grams = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
        sets.append((i, grams))
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = defaultdict(list)
    for place, (i, s) in enumerate(sets):
        if i is not None:
            for gram in s:
                held[gram].append(place)
    for place, (i, s) in enumerate(sets):
        if i is None:
            continue
        shared = Counter(other for gram in s for other in held[gram])
        for other, both in shared.items():
            if both * of >= least * (len(s) + len(sets[other][1]) - both):
                a, b = find(i), find(sets[other][0])
                parent[max(a, b)] = min(a, b)
    return sorted(
        ((i, len(s), None if i is None else find(i)) for i, s in sets), key=repr
    )


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


@pytest.mark.parametrize("n, least", [(3, 90), (5, 80)])
def test_tricky_rows(spark, n, least):
    rows = [(r[0], r[1]) for r in samples.tricky()]
    got = jaccard.similar_texts(samples.documents(spark), n, jaccard.Threshold(least, 100))
    assert result(got) == brute(rows, n, least, 100)


@pytest.mark.parametrize("n, least", [(3, 90), (5, 80)])
def test_near_copies_in_chains_and_large_groups(spark, n, least):
    """Texts drift away from a base step by step, so that classes hold far ends that are not
    similar; others are copies with a few words changed."""
    rnd = random.Random(7)
    vocabulary = [f"v{k}" for k in range(400)]
    rows = []
    for _ in range(6):
        text = [rnd.choice(vocabulary) for _ in range(rnd.choice([12, 30, 90, 250]))]
        for _ in range(25):
            rows.append((len(rows), " ".join(text)))
            for _ in range(rnd.choice([0, 1, 1, 2, max(1, len(text) // 40)])):
                text[rnd.randrange(len(text))] = rnd.choice(vocabulary)
    rnd.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    got = jaccard.similar_texts(docs, n, jaccard.Threshold(least, 100))
    assert result(got) == brute(rows, n, least, 100)


def test_given_documents(spark):
    rows = samples.fixture_documents()
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    assert result(jaccard.similar_texts(docs)) == brute(rows, 3, 90, 100)


@pytest.mark.parametrize("least", [80, 90, 95])
def test_bands_and_differences_miss_no_linked_sizes(least):
    t = jaccard.Threshold(least, 100)
    for small in [*range(1, 300), 1_000, 9_999, 123_456]:
        for large in {small, small * 100 // least, (small + small * 100 // least) // 2}:
            a, b = t.band(small), t.band(large)
            assert b - a in (0, 1)
            # linked sets of these sizes hold at least so many elements in common
            common = -(-least * (small + large) // (100 + least))
            assert small + large - 2 * common <= t.difference(a)


def test_sketches_differ_in_at_most_as_many_bits_as_sets_in_elements():
    rnd = np.random.default_rng(1)
    for _ in range(50):
        a = rnd.integers(0, 1 << 63, 200, dtype=np.uint64)
        b = np.unique(np.concatenate([a[:190], rnd.integers(0, 1 << 63, 9, dtype=np.uint64)]))
        x, y = jaccard.sketch(np.unique(a), 23), jaccard.sketch(b, 23)
        bits = sum(int(v).bit_count() for v in (x ^ y).view(np.uint64))
        assert bits <= len(np.setxor1d(a, b)) and (x == y).sum() >= 23 - bits


@pytest.mark.parametrize("least", [80, 90])
def test_linked_sets_agree_in_a_number_they_both_tell(least):
    rnd = np.random.default_rng(least)
    t = jaccard.Threshold(least, 100)
    for size in [1, 2, 5, 9, 10, 11, 19, 30, 64, 100, 333, 1_000]:
        for _ in range(40):
            a = np.unique(rnd.integers(0, 1 << 63, size, dtype=np.uint64))
            out = rnd.integers(0, t.difference(t.band(len(a))) + 1)
            gone = int(rnd.integers(0, min(out, len(a) - 1) + 1))
            new = rnd.integers(0, 1 << 63, out - gone, dtype=np.uint64)
            b = np.unique(np.concatenate([a[gone:], new]))
            both = len(np.intersect1d(a, b))
            if 100 * both < least * (len(a) + len(b) - both):
                continue
            bands = set(jaccard._bands_of(len(a), t)) & set(jaccard._bands_of(len(b), t))
            assert any(
                np.isin(jaccard.block_numbers(a, k, t), jaccard.block_numbers(b, k, t)).any()
                for k in bands
            )


def test_partners_are_links_and_hold_classes_together(spark):
    rnd = random.Random(11)
    rows = []
    for size in (60, 150):
        text = [f"u{rnd.randrange(900)}" for _ in range(size)]
        for _ in range(40):
            copy = list(text)
            for _ in range(rnd.choice([0, 1, 1, 2, 3])):
                copy[rnd.randrange(size)] = f"x{rnd.randrange(9)}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(900, "alone in this table"), (901, ""), (902, None), (None, rows[0][1])]
    sets = {}
    for i, t in rows[:-1]:
        w = samples.words(t)
        sets[i] = {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(3)
    got = jaccard.similar_texts(docs).collect()
    linked = 0
    for r in got:
        if r.doc_id is None or not r.n_shingles:
            assert r.partner_id is None
        elif r.partner_id is not None:
            a, b = sets[r.doc_id], sets[r.partner_id]
            assert r.doc_id != r.partner_id and 100 * len(a & b) >= 90 * len(a | b)
            linked += 1
        else:
            others = [i for i, s in sets.items() if i != r.doc_id and s != sets[r.doc_id]]
            near = [i for i in others if 100 * len(sets[i] & sets[r.doc_id]) >= 90 * len(sets[i] | sets[r.doc_id])]
            assert not near and r.component_id == r.doc_id
    assert linked > 40


def test_rows_with_one_id_and_two_texts(spark):
    """1 has two different texts; 2 is near the one and 3 near the other."""
    first, second = ([f"{c}{k}" for k in range(100)] for c in "xy")
    rows = [(1, " ".join(first)), (1, " ".join(second)), (2, " ".join([*first, "z"])), (3, " ".join([*second, "z"]))]
    got = jaccard.similar_texts(spark.createDataFrame(rows, "doc_id LONG, text STRING")).collect()
    assert {r.component_id for r in got} == {1}
    assert {r.partner_id for r in got if r.doc_id > 1} == {1}


def test_a_missing_file_is_an_error(tmp_path):
    np.arange(5, dtype="<u8").tofile(tmp_path / "0")
    assert mapped(str(tmp_path / "0"), "<u8", 5).tolist() == [0, 1, 2, 3, 4]
    assert not len(mapped(str(tmp_path / "1"), "<u8", 0))
    for name, entries in (("0", 4), ("0", 6), ("1", 1)):
        with pytest.raises(FileNotFoundError):
            mapped(str(tmp_path / name), "<u8", entries)
    gone = Vocabulary(str(tmp_path / "nowhere"), 1, (0, 7))
    with pytest.raises(FileNotFoundError):
        gone.ids(np.array([3, 4], np.uint64))


@pytest.mark.parametrize("least", [70, 75, 80, 90])
def test_large_sets_have_differences(least):
    threshold = jaccard.Threshold(least, 100)
    for size in [*range(2, 200_000, 89), *(1 << k for k in range(18, 33))]:
        small = -(-size * least // 100)
        # linked sets of `small` and `size` elements share all of the smaller one
        assert threshold.difference(threshold.band(small)) >= size - small
        assert all(threshold.difference(b) >= 0 for b in jaccard._bands_of(size, threshold)), size


def test_near_copies_of_a_hundred_thousand_words(spark):
    words = [f"w{k}" for k in range(100_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-9], "end"])), (3, "w1 w2 w3 w4 w5 w6")]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    got = jaccard.similar_texts(docs, 5, jaccard.Threshold(80, 100))
    assert result(got) == [(1, 99_996, 1), (2, 99_988, 1), (3, 2, 3)]
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_empty(spark):
    assert jaccard.similar_texts(samples.documents(spark).limit(0)).count() == 0


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(230)]
    edges += [(1_000 + k, 1_001 + k) for k in range(60)] + [(5_000, k) for k in range(6_000, 6_200)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(edges, "a LONG, b LONG")).collect()
    assert {r.id: r.component for r in got} == {x: find(x) for x in parent} and len(got) == len(parent)


def test_tables_that_are_done_with_leave_the_disk(spark):
    rng = random.Random(5)
    rows = []
    for i in range(40):
        base = [f"w{rng.randrange(500)}" for _ in range(60)]
        rows.append((3 * i, " ".join(base)))
        rows.append((3 * i + 1, " ".join([*base[:-1], "end"])))
        rows.append((3 * i + 2, " ".join(["start", *base[1:]])))
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    folder = Path(_own_folder(spark).removeprefix("file:"))
    before = set(os.listdir(folder)) if folder.exists() else set()
    assert result(jaccard.similar_texts(docs)) == brute(rows, 3, 90, 100)
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before}
    assert left.isdisjoint(
        {"sketches", "nodes", "block-members", "open-members", "members", "centres", "sets"}
    )


def test_only_tables_of_the_session_are_discarded(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a")], "doc_id LONG, text STRING")
    docs.write.parquet(str(tmp_path / "input"))
    discard(spark.read.parquet(str(tmp_path / "input")))
    assert spark.read.parquet(str(tmp_path / "input")).count() == 1
    written = materialize(docs, "some table")
    discard(written)
    assert not any(name.startswith("some table") for name in os.listdir(_own_folder(spark)))
