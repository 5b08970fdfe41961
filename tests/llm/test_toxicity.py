import random

import pytest

from markspark.llm import toxicity
from tests.llm import samples

BAD = ["moronic", "worthless", "scumbags", "disgusting", "vequlex"]


def corpus(n=600):
    rnd = random.Random(4)
    parts = ["tion", "er", "an", "the", "ing", "ou", "re", "sh", "nd", "al"]
    word = lambda: "".join(rnd.choice(parts) for _ in range(rnd.choice([1, 1, 2, 2, 3, 4])))
    texts, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rnd.choice([60, 150, 400]))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(max(4, len(words) // 20)):
                words[rnd.randrange(len(words))] = rnd.choice(BAD)
        texts.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return texts, labels


def test_held_out_accuracy(spark):
    texts, labels = corpus()
    docs = spark.createDataFrame(texts, "doc_id LONG, text STRING")
    marks = spark.createDataFrame(labels, "doc_id LONG, toxic INT")
    scored = toxicity.score(docs, toxicity.fit(docs, marks)).join(marks, "doc_id")
    held = scored.filter("held_out").collect()
    assert len(held) > 90
    caught = [r.predicted for r in held if r.toxic]
    wrong = [r.predicted for r in held if not r.toxic]
    assert sum(caught) >= 0.9 * len(caught) and sum(wrong) <= 0.03 * len(wrong)


def test_given_documents_beat_the_share_of_clean_ones(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    marks = spark.read.parquet(f"{folder}/labels.parquet")
    scored = toxicity.score(docs, toxicity.fit(docs, marks)).join(marks, "doc_id")
    held = scored.filter("held_out").collect()
    right = sum(r.predicted == r.toxic for r in held)
    assert right > sum(r.toxic == 0 for r in held)


def test_held_out_labels_change_nothing(spark):
    texts, labels = corpus(200)
    docs = spark.createDataFrame(texts, "doc_id LONG, text STRING")
    marks = spark.createDataFrame(labels, "doc_id LONG, toxic INT")
    flipped = marks.selectExpr("doc_id", "IF(crc32(cast(doc_id AS STRING)) % 5 = 0, 1 - toxic, toxic) AS toxic")
    a, b = toxicity.fit(docs, marks), toxicity.fit(docs, flipped)
    assert a.toxic == b.toxic and a.weights.tolist() == b.weights.tolist()


def test_tricky_rows(spark):
    docs = samples.documents(spark)
    texts, labels = corpus(200)
    model = toxicity.fit(
        spark.createDataFrame(texts, "doc_id LONG, text STRING"),
        spark.createDataFrame([*labels, (None, 1), (3, None), (6, 1)], "doc_id LONG, toxic INT"),
    )
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (4, 5, 6)}) == 1
    assert not any(r.held_out for r in rows if r.doc_id is None)
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.score < 0.5 for r in rows)
    assert toxicity.score(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("labels, score", [([], 0.0), ([(1, 0), (2, 0)], 0.0), ([(1, 1), (2, 1)], 1.0)])
def test_labels_of_one_kind(spark, labels, score):
    docs = samples.documents(spark)
    marks = spark.createDataFrame(labels, "doc_id LONG, toxic INT")
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, marks)).collect()} == {score}
