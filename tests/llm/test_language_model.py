import math
import zlib
from collections import Counter, defaultdict

import pytest

from markspark.llm import language_model, runs
from tests.llm import samples


def brute(rows):
    """The same model over dictionaries of words."""
    tokens = [(i, [*samples.words(t), None]) for i, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    learnt = [t for (_, t), h in zip(tokens, held) if not h]
    counts = Counter(w for t in learnt for w in t)
    total, size = sum(counts.values()), len(counts)
    before = lambda t: ["<start>", *[(w,) for w in t]]
    pairs = Counter(p for t in learnt for p in zip(before(t), t))
    seconds = Counter(b for _, b in pairs)
    contexts = defaultdict(lambda: [0, 0, 0, 0])
    for (a, _), n in pairs.items():
        contexts[a][0] += n
        contexts[a][min(n, 3)] += 1

    def discounts(values):
        n = Counter(values)
        d = language_model.Discounts.of([n[1], n[2], n[3], n[4]])
        return [0, d.one, d.two, d.more]

    d, e = discounts(pairs.values()), discounts(seconds.values())
    mass = sum(e[min(n, 3)] for n in seconds.values()) / max(len(pairs), 1) if pairs else 1.0

    def p(a, b):
        n = seconds.get(b, 0)
        lower = max(n - e[min(n, 3)], 0) / max(len(pairs), 1) + mass / (size + 1)
        if a not in contexts:
            return lower
        c, n = contexts[a], pairs.get((a, b), 0)
        rest = (d[1] * c[1] + d[2] * c[2] + d[3] * c[3]) / c[0]
        return max(n - d[min(n, 3)], 0) / c[0] + rest * lower

    out = []
    for (i, t), h in zip(tokens, held):
        score = sum(math.log10(p(a, b)) for a, b in zip(before(t), t))
        base = sum(math.log10((counts.get(w, 0) + 1) / (total + size + 1)) for w in t)
        out.append((i, h, len(t), sum(w in counts for w in t), total, base, score))
    return sorted(out, key=repr), p, counts


def compare(scored, rows):
    got = sorted((tuple(r)[:7] for r in scored.collect()), key=repr)
    want = brute(rows)[0]
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)


def test_tricky_rows(spark):
    rows = [(r[0], r[1]) for r in samples.tricky()]
    docs = samples.documents(spark)
    model = language_model.fit(docs)
    compare(language_model.score(docs, model), rows)
    model.remove()


def test_many_ranges_and_held_out_gain(spark, monkeypatch):
    monkeypatch.setattr(language_model, "RANGE_BYTES", 40_000)
    monkeypatch.setattr(language_model, "KEPT", 2_000)
    monkeypatch.setattr(language_model, "BATCH_BYTES", 30_000)
    rows = samples.fixture_documents()
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(5)
    model = language_model.fit(docs)
    scored = language_model.score(docs, model).cache()
    compare(scored, rows)
    assert model.ranges > 4
    held = scored.filter("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert held.s > held.b
    scored.unpersist()


def test_probabilities_add_up_to_one():
    rows = [(i, t) for i, t in samples.fixture_documents()[:40]]
    _, p, counts = brute(rows)
    for context in ("<start>", ("the",), ("never seen",)):
        assert sum(p(context, w) for w in counts) + p(context, "unknown") == pytest.approx(1)


def test_nothing_to_learn_from(spark):
    empty = samples.documents(spark).limit(0)
    model = language_model.fit(empty)
    assert language_model.score(empty, model).count() == 0
    one = language_model.score(samples.documents(spark, [(1, "a b")]), model).first()
    assert one.n_tokens == 3 and one.n_known == 0 and one.score == pytest.approx(0)


def test_runs_come_back_as_they_were():
    import numpy as np

    keys = np.array([0, 5, 1 << 40, (1 << 64) - 1], np.uint64)
    counts = np.array([1, 1 << 50, 3, 4], np.int64)
    back = runs.unpack(runs.pack(keys, counts, -counts), 2)
    assert [x.tolist() for x in back] == [keys.tolist(), counts.tolist(), (-counts).tolist()]
    empty = runs.unpack(runs.pack(keys[:0], counts[:0]))
    assert [len(x) for x in empty] == [0, 0]
    counted = runs.Counts(3)
    for _ in range(4):
        counted.add(keys, counts)
    assert counted.take()[1].tolist() == (4 * counts).tolist()
