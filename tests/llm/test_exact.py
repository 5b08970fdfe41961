import hashlib
from collections import defaultdict

import pytest

from markspark.llm import exact
from tests.llm import samples


def brute(rows):
    def plain(text):
        return "".join(c for c in text or "" if c not in " \t\n\x0b\f\r")

    groups = defaultdict(list)
    for i, t in rows:
        groups[plain(t)].append((i, t))
    out = []
    for i, t in rows:
        group = groups[plain(t)]
        best = min(group, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        sha = hashlib.sha256(plain(t).encode()).hexdigest()
        same = i == best[0] and len(t or "") == len(best[1] or "")
        out.append((i, best[0], len(group), len(group) == 1 or same, sha))
    return sorted(out, key=repr)


@pytest.mark.parametrize("every", [True, False])
def test_against_brute_force(spark, every):
    rows = [(r[0], r[1]) for r in samples.tricky()]
    got = exact.exact_duplicates(samples.documents(spark), every_digest=every).collect()
    want = brute(rows)
    assert sorted([tuple(r)[:4] for r in got], key=repr) == sorted([w[:4] for w in want], key=repr)
    shas = {w[4] for w in want}
    assert all(r.text_sha256 in shas for r in got if r.text_sha256 is not None)
    if every:
        assert sorted(map(tuple, got), key=repr) == want


def test_longest_original_stays_then_smallest_id(spark):
    docs = samples.documents(spark, [(5, "a b"), (1, "ab"), (3, "a b"), (2, "a  b c")])
    kept = {r.doc_id: (r.keep_id, r.kept) for r in exact.exact_duplicates(docs).collect()}
    assert kept == {5: (3, False), 3: (3, True), 1: (3, False), 2: (2, True)}


def test_full_hash_only_for_rows_that_share_length_and_prefix(spark):
    docs = samples.documents(spark, [(1, "abc"), (2, "abd"), (3, "a b c"), (4, "longer")])
    shas = {r.doc_id: r.text_sha256 for r in exact.exact_duplicates(docs).collect()}
    assert [i for i, s in shas.items() if s is None] and shas[1] and shas[3]
    assert shas[2] is None and shas[4] is None


def test_one_id_with_texts_alike_in_length_and_prefix(spark):
    head = "x" * exact.PREFIX_CHARS
    docs = samples.documents(spark, [(1, head + "a"), (1, head + "b"), (2, head + "b")])
    sizes = sorted(r.group_size for r in exact.exact_duplicates(docs).collect())
    assert sizes == [1, 2, 2]


def test_keep_first_keeps_all_columns_and_one_of_equal_rows(spark):
    kept = exact.keep_first(samples.documents(spark))
    assert kept.columns == samples.documents(spark).columns
    got = kept.collect()
    assert [r.doc_id for r in got].count(25) == 1
    assert not {3, 9} & {r.doc_id for r in got} and {1, 2, 7, 8} <= {r.doc_id for r in got}
    assert len({(r.text or "").translate({ord(c): None for c in exact.SPACES}) for r in got}) == len(got)


def test_keep_first_with_copies_under_one_id(spark):
    rows = [(5, "a b"), (5, "ab"), (6, "ab"), (7, "other"), (7, "ot her "), (8, None), (9, " ")]
    kept = exact.keep_first(samples.documents(spark, rows)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(5, "a b"), (7, "ot her "), (9, " ")]


def test_keep_first_where_one_text_of_an_id_goes(spark):
    rows = [(1, "long text"), (2, "longtext"), (2, "a second text"), (3, "long text"), (None, "x"), (4, "x")]
    kept = exact.keep_first(samples.documents(spark, rows)).collect()
    got = sorted((r.doc_id, r.text) for r in kept)
    assert got == [(1, "long text"), (2, "a second text"), (4, "x")]


def test_empty(spark):
    empty = samples.documents(spark).limit(0)
    assert exact.exact_duplicates(empty).count() == 0 and exact.keep_first(empty).count() == 0


def test_a_group_that_holds_most_rows(spark):
    docs = spark.range(4_000).selectExpr("id AS doc_id", "IF(id % 4 = 0, concat('x', id), 'same') AS text")
    got = exact.exact_duplicates(docs, every_digest=True).groupBy("group_size").count().collect()
    assert {r.group_size: r["count"] for r in got} == {1: 1_000, 3_000: 3_000}
