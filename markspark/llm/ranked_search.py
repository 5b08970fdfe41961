"""Ranked search over lists of impacts, by the Best Position Algorithm.

What a term adds to a document's score, its impact, depends on the document and the term alone, so
each term has a list of documents by falling impact. For a query, its terms' lists are read side by
side from the top. Every document met is looked up in all other lists at once (direct accesses), and
the positions found there count as seen too. In each list, the first position that nothing has seen
yet bounds the impact of every document not met so far; once the sum of these bounds is strictly
below the k-th best score, no other document can matter, ties included.

Lists are built per block of documents, in the task that holds the block, from a table of term counts
that is written once; no list is gathered from several tasks, however common its term. Statistics
(documents, terms, document frequencies) are those of all documents, so scores of different blocks
compare, and a block's k-th score lets the next blocks of the task stop sooner. The best k of each
block meet in two steps.

Queries come in groups of bounded size, each of which is searched for in all documents at once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from markspark.llm.common import unused
from markspark.llm.terms import term_pieces
from markspark.storage import materialize

GROUP_TERMS = 500_000
"""Distinct terms of queries, about, that are searched for at once."""
BLOCK_POSTINGS = 1_000_000
"""Entries of the lists that a task holds at once (and one document's more, if it has more)."""
FIRST_STEP = 32
"""Positions read from each list in the first step; each next step reads twice as many."""
MERGED_APART = 64


def count_terms(text: bytes | None) -> Counter:
    """Terms of a UTF-8 text with their numbers."""
    counts: Counter = Counter()
    for terms in term_pieces(text or b""):
        counts.update(terms)
    return counts


def term_weight(documents: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


def impacts(tf: np.ndarray, lengths: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """What one occurrence of a term in a query adds for a document, before the term's weight."""
    m = 100 - 25 + (25 * lengths * documents) // terms
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Lists:
    """Impact lists of one block of documents.

    `doc, term, impact` are the entries (any order); `order` ranks the documents for ties.
    """

    def __init__(self, doc, term, impact, order, n_terms: int) -> None:
        self.n_docs = len(order)
        self.order = order
        by_impact = np.lexsort((order[doc], -impact, term))
        self.doc, self.impact = doc[by_impact], impact[by_impact]
        self.first = np.searchsorted(term[by_impact], np.arange(n_terms + 1))
        place = term[by_impact] * self.n_docs + self.doc
        self._at = np.argsort(place, kind="stable")
        self._places = place[self._at]

    def positions(self, terms: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Where each of these documents stands in the list of each of these terms; -1: it doesn't."""
        wanted = terms[:, None] * self.n_docs + docs[None, :]
        at = np.minimum(np.searchsorted(self._places, wanted), len(self._places) - 1)
        return np.where(self._places[at] == wanted, self._at[at], -1)

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, floor: int) -> tuple:
        """The k best documents (by score, then order) with a score of `floor` or more, and scores.

        Terms are distinct, weights positive. Also returned: how many positions were read in order.
        """
        starts, ends = self.first[terms], self.first[terms + 1]
        held = ends > starts
        terms, weights, starts, ends = terms[held], weights[held], starts[held], ends[held]
        scores = np.zeros(self.n_docs, np.int64)
        met = np.zeros(self.n_docs, bool)
        seen = [np.zeros(b - a + 1, bool) for a, b in zip(starts.tolist(), ends.tolist())]
        unseen = np.zeros(len(terms), np.int64)  # the first position not seen yet
        depth, step = 0, FIRST_STEP
        top = np.empty(0, np.int64)
        while len(terms):
            read = [self.doc[a + depth : min(a + depth + step, b)] for a, b in zip(starts, ends)]
            new = np.unique(np.concatenate(read))
            new = new[~met[new]]
            met[new] = True
            found = self.positions(terms, new)
            there = found >= 0
            gained = np.where(there, self.impact[np.maximum(found, 0)], 0)
            scores[new] = weights @ gained
            bound = 0
            for i, a in enumerate(starts.tolist()):
                marks = seen[i]
                marks[found[i][there[i]] - a] = True
                at = unseen[i]
                at += np.argmin(marks[at:])  # the mark behind the last position is never set
                unseen[i] = at
                if a + at < ends[i]:
                    bound += int(weights[i]) * int(self.impact[a + at])
            top = np.concatenate([top, scores[new]])
            if len(top) > k:
                top = np.partition(top, len(top) - k)[-k:]
            least = max(floor, int(top.min()) if len(top) == k else 1)
            depth += step
            step *= 2
            if bound < least:
                break
        docs = np.flatnonzero(met & (scores >= max(floor, 1)))
        docs = docs[np.lexsort((self.order[docs], -scores[docs]))][:k]
        return docs, scores[docs], depth


@dataclass
class Group:
    """Queries that are searched for together: numbers of their terms, and how often each occurs."""

    numbers: list[int]
    vocabulary: dict[bytes, int]
    terms: list[np.ndarray]
    repeats: list[np.ndarray]


def _query_groups(queries: DataFrame, text_col: str, number: str) -> Iterator[Group]:
    """Queries by groups of some `GROUP_TERMS` terms; only one group is here at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [count_terms(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([list(c) for c in found], pa.list_(pa.binary())),
                    pa.array([list(c.values()) for c in found], pa.list_(pa.int64())),
                ],
                ["number", "terms", "repeats"],
            )

    rows = queries.select(number, text_col).mapInArrow(
        run, "number LONG, terms ARRAY<BINARY>, repeats ARRAY<LONG>"
    )
    rows = materialize(rows.filter(F.size("terms") > 0), "queries")
    total = rows.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("n")).first().n
    groups = -(-total // GROUP_TERMS)
    for group in range(groups):
        mine = rows.filter(F.pmod(F.xxhash64("number"), F.lit(groups)) == group).toArrow()
        vocabulary: dict[bytes, int] = {}
        terms = [
            np.array([vocabulary.setdefault(t, len(vocabulary)) for t in row], np.int64)
            for row in mine.column("terms").to_pylist()
        ]
        repeats = [np.array(row, np.int64) for row in mine.column("repeats").to_pylist()]
        if terms:
            yield Group(mine.column("number").to_pylist(), vocabulary, terms, repeats)


def _counts(docs: DataFrame, id_col: str, text_col: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """`id, length, terms, tfs` of each row with a term; `terms` are those of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, terms, tfs = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                counts = count_terms(text)
                lengths.append(sum(counts.values()))
                known = [(vocabulary[t], n) for t, n in counts.items() if t in vocabulary]
                terms.append([t for t, _ in known])
                tfs.append([n for _, n in known])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(lengths, pa.int64()),
                    pa.array(terms, pa.list_(pa.int32())),
                    pa.array(tfs, pa.list_(pa.int64())),
                ],
                ["id", "length", "terms", "tfs"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, length LONG, terms ARRAY<INT>, tfs ARRAY<LONG>"
    return docs.select(id_col, text_col).mapInArrow(run, schema).filter("length > 0")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of `_counts` in tables of some `BLOCK_POSTINGS` entries."""
    held, size = [], 0
    for batch in batches:
        entries = batch.column(2).offsets.to_numpy().astype(np.int64)
        begin = 0
        while begin < batch.num_rows:
            room = entries[begin] + max(BLOCK_POSTINGS - size, 1)
            end = max(begin + 1, int(np.searchsorted(entries, room, "right")) - 1)
            held.append(batch.slice(begin, end - begin))
            size += int(entries[end] - entries[begin])
            begin = end
            if size >= BLOCK_POSTINGS:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if size:
        yield pa.Table.from_batches(held)


def _search(counts: DataFrame, group: Group, k: int) -> DataFrame:
    """`number, id, score`: the k best of each block, for each query."""
    facts = counts.agg(F.count("*").alias("n"), F.sum("length").alias("terms")).first()
    found = counts.select(F.explode("terms").alias("term")).groupBy("term").agg(
        F.count("*").alias("df")
    )
    found = found.toArrow()  # at most one row per term of the group
    df = np.zeros(len(group.vocabulary), np.int64)
    df[found.column("term").to_numpy()] = found.column("df").to_numpy()
    weight = np.array([term_weight(facts.n, f) for f in df.tolist()], np.int64)
    n_docs, n_terms, n_vocabulary = facts.n, facts.terms, len(df)
    queries = []
    for number, terms, repeats in zip(group.numbers, group.terms, group.repeats):
        useful = (weight[terms] > 0) & (df[terms] > 0)
        queries.append((number, terms[useful], (weight[terms] * repeats)[useful]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = {number: np.empty(0, np.int64) for number, _, _ in queries}
        for block in _blocks(batches):
            block = block.combine_chunks()
            ids = block.column("id").combine_chunks()
            ranks = np.empty(len(ids), np.int64)
            ranks[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
            terms = block.column("terms").combine_chunks()
            doc = np.repeat(np.arange(len(ids)), np.diff(terms.offsets.to_numpy()))
            tf = block.column("tfs").combine_chunks().flatten().to_numpy()
            lengths = block.column("length").to_numpy()[doc]
            lists = Lists(
                doc,
                terms.flatten().to_numpy().astype(np.int64),
                impacts(tf, lengths, n_docs, n_terms),
                ranks,
                n_vocabulary,
            )
            numbers, docs, scores = [], [], []
            for number, own, weights in queries:
                top = tops[number]
                floor = int(top.min()) if len(top) == k else 0
                best, score, _ = lists.best(own, weights, k, floor)
                tops[number] = np.sort(np.concatenate([top, score]))[-k:]
                numbers.append(np.full(len(best), number))
                docs.append(best)
                scores.append(score)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(numbers)),
                    ids.take(pa.array(np.concatenate(docs))),
                    pa.array(np.concatenate(scores)),
                ],
                ["number", "id", "score"],
            )

    kind = counts.schema["id"].dataType.simpleString()
    return counts.mapInArrow(run, f"number LONG, id {kind}, score LONG")


def _best(found: DataFrame, k: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(
    docs: DataFrame,
    queries: DataFrame,
    k: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    query_id: str = "item_id",
    query_text: str = "text",
) -> DataFrame:
    """The k best documents of each row of `queries`: `query_id, rank, id_col, score`.

    Equal scores come by ascending id (null last); only scores above 0 count. Null and empty texts
    have no terms: such documents are not counted and never found, such queries find nothing. Rows
    that share an id are documents (or queries) of their own. Empty tables give an empty result; other
    columns are ignored. The ids' columns must not have the same name.
    """
    number = unused(queries, "number")
    asked = materialize(
        queries.select(F.col(query_id), F.col(query_text)).withColumn(
            number, F.monotonically_increasing_id()
        ),
        "asked",
    )
    kind = docs.schema[id_col].dataType.simpleString()
    every = docs.sparkSession.createDataFrame([], f"number LONG, id {kind}, score LONG, rank INT")
    for group in _query_groups(asked, query_text, number):
        counts = materialize(_counts(docs, id_col, text_col, group.vocabulary), "term-counts")
        found = _search(counts, group, k).withColumn(
            "part", F.pmod(F.spark_partition_id(), F.lit(MERGED_APART))
        )
        found = _best(_best(found, k, "number", "part").drop("part", "rank"), k, "number")
        every = every.unionByName(materialize(found, "found"))
    asked = asked.select(F.col(query_id).alias("query"), F.col(number).alias("number"))
    return every.join(asked, "number").select(
        F.col("query").alias(query_id),
        F.col("rank").cast("int").alias("rank"),
        F.col("id").alias(id_col),
        "score",
    )
