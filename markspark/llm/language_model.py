"""Scores of a language model: interpolated modified Kneser-Ney on pairs of words.

Words and pairs are counted in Spark: tasks send sorted runs of numbers, one run for each range of
numbers, and each range is merged by one group. Ranges grow in number with the corpus, so a group's
memory does not. What a group makes of its range are sorted arrays in files of the shared folder;
workers map them and look up sorted numbers, so that scoring shuffles nothing and holds no model in
memory.

The folder has to be mounted under the same path on all machines. A word is its 64-bit number
(`wordhash`), known words have ids in the order of these numbers.
"""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markspark.llm import runs
from markspark.llm.common import mapped, shared_files, write_file
from markspark.llm.wordhash import words_of
from markspark.storage import materialize

FOLDS, HELD_OUT = 7, 2
END = np.uint64(1)
"""Number of the end of a text."""
BATCH_BYTES = 8 << 20
RANGE_BYTES = 32 << 20
"""Text behind one range of words or pairs."""
KEPT = 3_000_000
"""Entries that a task collects before it sends them."""
START_ID, UNKNOWN_ID = (1 << 32) - 1, (1 << 32) - 2
"""Stand for the start of a text and for words never counted."""


@dataclass(frozen=True)
class Discounts:
    """What is taken off counts of 1, 2, and 3 or more."""

    one: float
    two: float
    more: float

    @classmethod
    def of(cls, n: list[int]) -> Discounts:
        """From how many things were counted once, twice, three and four times. Where these are
        too few to tell, a half of the usual estimate's bounds."""
        n1, n2, n3, n4 = (float(x) for x in n)
        if min(n1, n2) == 0:
            return cls(0.5, 0.5, 0.5)
        y = n1 / (n1 + 2 * n2)
        raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
        top = (1.0, 2.0, 3.0)
        return cls(*(min(max(d, 0.05), t - 0.05) for d, t in zip(raw, top)))

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        steps = np.array([0.0, self.one, self.two, self.more])
        return steps[np.minimum(counts, 3)]


@dataclass(frozen=True)
class LanguageModel:
    """Where the arrays lie, and the few numbers that hold for all of them."""

    path: str
    ranges: int
    firsts: tuple[int, ...]
    """Id of the first word of each range of numbers, and how many words there are."""
    tokens: int
    pairs: Discounts
    words: Discounts
    followed: int
    """Distinct pairs."""
    lower_mass: float

    def remove(self) -> None:
        shutil.rmtree(self.path, ignore_errors=True)


def is_held_out(doc_id: Column) -> Column:
    fold = F.crc32(doc_id.cast("string").cast("binary")) % FOLDS
    return F.coalesce(fold == HELD_OUT, F.lit(False))


def _batches(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Texts as bytes in runs of bounded size, each with the place of its first."""
    first, out, size = 0, [], 0
    for i, text in enumerate(column):
        raw = (text.as_py() or "").encode()
        out.append(raw)
        size += len(raw)
        if size > BATCH_BYTES:
            yield first, out
            first, out, size = i + 1, [], 0
    if out:
        yield first, out


def _range_of(numbers: np.ndarray, ranges: int) -> np.ndarray:
    """Which of `ranges` (a power of two) equal parts a number lies in."""
    bits = ranges.bit_length() - 1
    return numbers >> np.uint64(64 - bits) if bits else np.zeros(len(numbers), np.uint64)


def _sent(part: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """One row per part; `part` ascends with the keys."""
    names, first = np.unique(part, return_index=True)
    ends = [*first[1:], len(keys)]
    blobs = [runs.pack(keys[a:b], counts[a:b]) for a, b in zip(first, ends)]
    return pa.RecordBatch.from_arrays(
        [pa.array(names.astype(np.int64)), pa.array(blobs, pa.binary())], ["part", "run"]
    )


SENT = "part LONG, run BINARY"


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    found = [runs.unpack(x.as_py()) for x in table.column("run")]
    return runs.group_sums(
        np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
    )


def _counts_of_counts(counts: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(counts, 5), minlength=6)[1:5].tolist()


class Vocabulary:
    """Mapped arrays of the words: numbers, counts, and in how many pairs each comes second."""

    def __init__(self, path: str, ranges: int, firsts: tuple[int, ...]) -> None:
        self.path, self.ranges, self.firsts = path, ranges, firsts
        self.maps: dict[tuple[str, int], np.ndarray] = {}

    def array(self, kind: str, part: int, dtype: str) -> np.ndarray:
        """One file, mapped; empty where no group wrote one."""
        key = (kind, part)
        if key not in self.maps:
            name = f"{self.path}/{kind}-{part}"
            if kind in ("words", "counts"):
                entries = self.firsts[part + 1] - self.firsts[part]
                self.maps[key] = mapped(name, dtype, entries)
                return self.maps[key]
            there = os.path.exists(name) and os.path.getsize(name)
            self.maps[key] = np.memmap(name, dtype, "r") if there else np.empty(0, dtype)
        return self.maps[key]

    def by_part(self, parts: np.ndarray) -> Iterator[tuple[int, slice]]:
        """The parts that occur in an ascending array, with their places."""
        names, first = np.unique(parts, return_index=True)
        for name, a, b in zip(names.tolist(), first, [*first[1:], len(parts)]):
            yield int(name), slice(a, b)

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        """Ids of ascending numbers; -1 for those never counted."""
        out = np.full(len(numbers), -1, np.int64)
        for part, at in self.by_part(_range_of(numbers, self.ranges)):
            known = self.array("words", part, "<u8")
            place = np.searchsorted(known, numbers[at])
            inside = np.minimum(place, max(len(known) - 1, 0))
            hit = known[inside] == numbers[at] if len(known) else np.zeros(len(place), bool)
            out[at] = np.where(hit, self.firsts[part] + place, -1)
        return out

    def values(self, kind: str, dtype: str, ids: np.ndarray) -> np.ndarray:
        """A column of ascending ids; 0 for -1."""
        out = np.zeros(len(ids), np.int64)
        part = np.searchsorted(np.array(self.firsts), ids, side="right") - 1
        for name, at in self.by_part(part):
            if 0 <= name < self.ranges:
                column = self.array(kind, name, dtype)
                out[at] = column[ids[at] - self.firsts[name]] if len(column) else 0
        return out


def _numbered(texts: list[bytes], vocabulary: Vocabulary):
    """Distinct numbers, their ids, and each text's tokens as places in these; ends included."""
    found = words_of(texts, fold_case=True)
    distinct, places = np.unique(np.append(found.numbers, END), return_inverse=True)
    end_place = places[-1]
    places = places[:-1]
    n = np.diff(found.firsts)
    # one end after each text
    total = len(places) + len(texts)
    tokens = np.full(total, end_place, np.int64)
    ends = np.cumsum(n + 1) - 1
    is_word = np.ones(total, bool)
    is_word[ends] = False
    tokens[is_word] = places
    return distinct, vocabulary.ids(distinct), tokens, ends


def _pair_codes(ids: np.ndarray, tokens: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """First and second word's id of each token and the one before it, in one number."""
    here = np.where(ids < 0, UNKNOWN_ID, ids)[tokens]
    before = np.concatenate([[START_ID], here[:-1]])
    before[ends[:-1] + 1] = START_ID
    before[0] = START_ID
    return (before.astype(np.uint64) << np.uint64(32)) | here.astype(np.uint64)


def _pair_part(firsts: np.ndarray, ranges: int, size: int) -> np.ndarray:
    """Which part a pair lies in, by the id of its first word; text starts have the last one."""
    part = firsts.astype(np.float64) * (ranges / max(size, 1))
    return np.where(firsts == START_ID, ranges, np.minimum(part, ranges - 1)).astype(np.int64)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LanguageModel:
    """Counts whole texts of all rows outside the held-out fold. A null text is an empty one."""
    spark = docs.sparkSession
    texts = docs.filter(~is_held_out(F.col(id_col))).select(F.col(text_col).alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    ranges = 1 << max(0, (int(size) // RANGE_BYTES)).bit_length()
    path = shared_files(spark, "language-model")

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = runs.Counts(KEPT)

        def out() -> pa.RecordBatch:
            keys, sums = counts.take()
            return _sent(_range_of(keys, ranges), keys, sums)

        for batch in batches:
            for _, some in _batches(batch.column(0)):
                numbers = np.append(words_of(some, fold_case=True).numbers, END)
                keys, n = np.unique(numbers, return_counts=True)
                n[keys == END] += len(some) - 1
                if counts.add(keys, n.astype(np.int64)):
                    yield out()
        if counts.size:
            yield out()

    def merge_words(key: tuple, table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        keys, sums = _merged(table)
        write_file(f"{path}/words-{part}", keys.astype("<u8").tobytes())
        write_file(f"{path}/counts-{part}", sums.astype("<i8").tobytes())
        return pa.table({"part": [part], "size": [len(keys)], "tokens": [int(sums.sum())]})

    sent = texts.mapInArrow(count_words, SENT)
    merged = sent.groupBy("part").applyInArrow(merge_words, "part LONG, size LONG, tokens LONG")
    sizes = {r.part: (r["size"], r.tokens) for r in merged.collect()}  # one row per range
    firsts = [0]
    for part in range(ranges):
        firsts.append(firsts[-1] + sizes.get(part, (0, 0))[0])
    vocabulary_size = firsts[-1]
    if vocabulary_size >= UNKNOWN_ID:
        raise ValueError("ids of words have 32 bits")
    known = tuple(firsts)

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, vocabulary = runs.Counts(KEPT), Vocabulary(path, ranges, known)

        def out() -> pa.RecordBatch:
            keys, sums = counts.take()
            return _sent(_pair_part(keys >> np.uint64(32), ranges, vocabulary_size), keys, sums)

        for batch in batches:
            for _, some in _batches(batch.column(0)):
                _, ids, tokens, ends = _numbered(some, vocabulary)
                keys, n = np.unique(_pair_codes(ids, tokens, ends), return_counts=True)
                if counts.add(keys, n.astype(np.int64)):
                    yield out()
        if counts.size:
            yield out()

    def merge_pairs(key: tuple, table: pa.Table) -> pa.Table:
        """Writes the pairs and their contexts; sends how often each word comes second."""
        part = key[0].as_py()
        keys, sums = _merged(table)
        first = np.flatnonzero(np.concatenate([[True], np.diff(keys >> np.uint64(32)) > 0]))
        kept = [np.add.reduceat(x.astype(np.int64), first) for x in (sums, sums == 1, sums == 2, sums >= 3)]
        write_file(f"{path}/pairs-{part}", keys.astype("<u8").tobytes())
        write_file(f"{path}/times-{part}", sums.astype("<i8").tobytes())
        write_file(f"{path}/contexts-{part}", (keys[first] >> np.uint64(32)).astype("<u8").tobytes())
        write_file(f"{path}/sums-{part}", np.column_stack(kept).astype("<i8").tobytes())
        seconds, n = np.unique(keys & np.uint64(0xFFFFFFFF), return_counts=True)
        parts = np.searchsorted(np.array(known), seconds.astype(np.int64), side="right") - 1
        sent = _sent(parts, seconds, n.astype(np.int64))
        tally = _counts_of_counts(sums)
        extra = pa.table({"part": [-1], "run": [b""], "tally": [tally], "pairs": [len(keys)]})
        rows = pa.table(
            {
                "part": sent.column(0),
                "run": sent.column(1),
                "tally": pa.array([None] * sent.num_rows, pa.list_(pa.int64())),
                "pairs": pa.array([0] * sent.num_rows, pa.int64()),
            }
        )
        return pa.concat_tables([rows, extra.cast(rows.schema)])

    def merge_seconds(key: tuple, table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        keys, sums = _merged(table)
        dense = np.zeros(known[part + 1] - known[part], np.int64)
        dense[keys.astype(np.int64) - known[part]] = sums
        write_file(f"{path}/seconds-{part}", dense.astype("<i8").tobytes())
        top = int((sums >= 3).sum())
        return pa.table({"tally": [_counts_of_counts(sums)], "more": [top]})

    pairs = materialize(
        texts.mapInArrow(count_pairs, SENT)
        .groupBy("part")
        .applyInArrow(merge_pairs, "part LONG, run BINARY, tally ARRAY<LONG>, pairs LONG"),
        "pair-counts",
    )
    tallies = pairs.filter("part = -1").agg(
        *(F.sum(F.col("tally")[i]).alias(f"n{i}") for i in range(4)), F.sum("pairs").alias("pairs")
    )
    t = tallies.first()
    seconds = (
        pairs.filter("part >= 0")
        .select("part", "run")
        .groupBy("part")
        .applyInArrow(merge_seconds, "tally ARRAY<LONG>, more LONG")
    )
    s = seconds.agg(
        *(F.sum(F.col("tally")[i]).alias(f"n{i}") for i in range(4)), F.sum("more").alias("more")
    ).first()
    word_discounts = Discounts.of([s[f"n{i}"] or 0 for i in range(4)])
    followed = t.pairs or 0
    mass = (
        word_discounts.one * (s.n0 or 0) + word_discounts.two * (s.n1 or 0)
        + word_discounts.more * (s.more or 0)
    ) / max(followed, 1)
    return LanguageModel(
        path, ranges, known, sum(x[1] for x in sizes.values()),
        Discounts.of([t[f"n{i}"] or 0 for i in range(4)]), word_discounts, followed,
        mass if followed else 1.0,
    )


def _pair_lookup(model: LanguageModel, vocabulary: Vocabulary, codes: np.ndarray):
    """For ascending codes: how often the pair was counted, and its context's four sums."""
    times = np.zeros(len(codes), np.int64)
    sums = np.zeros((len(codes), 4), np.int64)
    firsts = codes >> np.uint64(32)
    for part, at in vocabulary.by_part(_pair_part(firsts, model.ranges, model.firsts[-1])):
        pairs = vocabulary.array("pairs", part, "<u8")
        if not len(pairs):
            continue
        place = np.minimum(np.searchsorted(pairs, codes[at]), len(pairs) - 1)
        hit = pairs[place] == codes[at]
        times[at] = np.where(hit, vocabulary.array("times", part, "<i8")[place], 0)
        contexts = vocabulary.array("contexts", part, "<u8")
        place = np.minimum(np.searchsorted(contexts, firsts[at]), len(contexts) - 1)
        hit = contexts[place] == firsts[at]
        kept = vocabulary.array("sums", part, "<i8").reshape(-1, 4)
        sums[at] = np.where(hit[:, None], kept[place], 0)
    return times, sums


def _score_texts(model: LanguageModel, vocabulary: Vocabulary, texts: list[bytes]):
    """Per text: tokens, known tokens, base score and score."""
    distinct, ids, tokens, ends = _numbered(texts, vocabulary)
    order = np.argsort(ids, kind="stable")
    size = model.firsts[-1]
    counts, seconds = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    counts[order] = vocabulary.values("counts", "<i8", ids[order])
    seconds[order] = vocabulary.values("seconds", "<i8", ids[order])
    base = np.log10((counts + 1) / (model.tokens + size + 1))
    lower = np.maximum(seconds - model.words(seconds), 0) / max(model.followed, 1)
    lower = lower + model.lower_mass / (size + 1)

    # an unknown second word has no pair; an unknown first word is a context without any
    codes = _pair_codes(ids, tokens, ends)
    pairs, places = np.unique(codes, return_inverse=True)
    times, sums = _pair_lookup(model, vocabulary, pairs)
    total = np.maximum(sums[:, 0], 1)
    d = model.pairs
    seen = np.maximum(times - d(times), 0) / total
    rest = (d.one * sums[:, 1] + d.two * sums[:, 2] + d.more * sums[:, 3]) / total
    rest = np.where(sums[:, 0] > 0, rest, 1.0)
    # the lower order's part goes by the token itself: unknown words share one id
    logs = np.log10(seen[places] + rest[places] * lower[tokens])
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = ends - starts + 1
    known = np.add.reduceat((counts > 0)[tokens].astype(np.int64), starts)
    return n, known, np.add.reduceat(base[tokens], starts), np.add.reduceat(logs, starts)


def score(
    docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of `docs`: `id_col, held_out, n_tokens, n_known, train_tokens, base_score,
    score, perplexity`. Scores are sums of log10 over the words and one end of the whole text.

    A null or empty text is its end alone. Null ids are not held out, so such rows are learnt
    from. Repeated rows count, and are scored, each for itself. A model of no rows gives every
    token the same probability. An empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(model.path, model.ranges, model.firsts)
        for batch in batches:
            for first, texts in _batches(batch.column(1)):
                found = _score_texts(model, vocabulary, texts)
                columns = [pa.array(x) for x in found]
                ids = batch.column(0).slice(first, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [ids, *columns], ["id", "n_tokens", "n_known", "base_score", "score"]
                )

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema[0].dataType.simpleString()
    schema = f"id {kind}, n_tokens LONG, n_known LONG, base_score DOUBLE, score DOUBLE"
    scored = source.mapInArrow(run, schema)
    return scored.select(
        F.col("id").alias(id_col),
        is_held_out(F.col("id")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
