"""Small tables with everything that operators have to stand: nulls, empty and long texts, ties,
repeated rows, extra columns whose names clash with the operators' own."""

from __future__ import annotations

import random
import re

LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(9_000))
PASSAGE = "This passage of some length is held by several documents, word for word, to the end."

SCHEMA = (
    "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, "
    "id LONG, size STRING, key STRING, block LONG, score DOUBLE, kept BOOLEAN, _sha STRING"
)


def rows(texts: list[tuple]) -> list[tuple]:
    """Documents with clashing extra columns, some of them null."""
    return [
        (i, t, None, f"s{(i or 0) % 3}", len(t or ""), -1, "x", None, 7, 0.5, False, None)
        for i, t in texts
    ]


def tricky() -> list[tuple]:
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    base = [" ".join(rnd.choice(words) for _ in range(80)) for _ in range(4)]
    near = base[0].split()
    near[40] = "other"
    texts = [
        (1, base[0]), (2, base[1]), (3, base[0]), (4, None), (5, ""), (6, " \t\n\x0b\f\r "),
        (7, " ".join(near)), (8, base[0].upper()), (9, base[0].replace(" ", "\n")),
        (10, "one"), (11, "one two"), (12, "One  two"), (13, LONG), (14, LONG + " tail"),
        (15, PASSAGE + " Then something else. " + base[2]), (16, "Before it. " + PASSAGE),
        (17, base[3] + " " + PASSAGE), (18, "é" * 60 + "ß" + base[2]), (19, "é" * 60 + "x"),
        (20, "\x1c\x1f    odd\u0085space"), (21, "日本語 ☃ 🎉 it's I'LL 1234"),
        (22, "<|endoftext|> in a text <|startoftext|>"), (23, "a" * 5_000), (24, "ab" * 2_500),
        (None, "a text without an id, and long enough to be cut, cut, cut, cut, cut"),
        (None, None), (25, "twice the same row"), (25, "twice the same row"),
        (26, "one id"), (26, "and another text for it"), (-3, base[1] + " more"),
    ]
    return rows(texts)


def documents(spark, texts: list[tuple] | None = None):
    return spark.createDataFrame(tricky() if texts is None else rows(texts), SCHEMA).repartition(3)


WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def fixture_documents(sf: str = "sf0.001") -> list[tuple[int, str]]:
    import pyarrow.parquet as pq

    found = pq.read_table(f"/root/testdata/{sf}/documents.parquet", columns=["doc_id", "text"])
    return sorted((r["doc_id"], r["text"]) for r in found.to_pylist())
