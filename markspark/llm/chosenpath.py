"""Near duplicates by chosen paths: a randomised similarity join of word n-gram sets.

Each tree deals the sets out by a minwise token, the smallest element of the set under a hash of the
tree's own; similar sets mostly choose the same one. A cell of the tree with at most `LEAF` sets is a
leaf and compared exhaustively, by sketches in one task. A larger one branches: the cell's path picks one
or two of 64 further minwise tokens, and its sets follow the tokens they have there. As the expected
number of picks is one over the threshold, a linked pair is expected to stay together in one child at
least, and unlike sets part. Trees are independent, and as many as the recall wants.

Comparing means: sets of unequal size, sets whose parity sketches differ in more bits than linked sets
can, and sets that agree in too few of the 64 tokens are ruled out, the others are confirmed on their
full sets, which travel once per group of pairs, not once per pair. Links join sets to classes, and pairs
of one class need no comparison any more. So each set of a leaf first names a few of the others that it
may be linked to, and names more of them, in the end all, only while they are of other classes. A large
cell does not branch if few of its sets are outside its largest class: these few meet all others. Else
all its sets meet one of them, drawn by hash, before it branches. No cell, however large, has all its
pairs written as rows.

Rows with equal sets are one node from the start.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markspark.llm.common import forget_shuffles, join_groups
from markspark.llm.components import components
from markspark.llm.jaccard import Threshold, shingle_sets, sketch
from markspark.llm.wordhash import mix
from markspark.storage import materialize

BATCH_BYTES = 2 << 20
GROUP_SETS = 1_000
"""Sets of one group, about, that are in a task at once to be confirmed."""
LEAF = 8_192
"""Sets of a cell that is compared in one task."""
NAMED = (8,)
"""Others that a set of a leaf names at most, the first times its cell is compared; then all."""
SMALL = 128
"""Sets outside its largest class that a cell beyond `LEAF` may have to be compared exhaustively."""
DEPTH = 4
"""Levels below the first that the recall is worked out for."""
BROADCAST_IDS = 500_000
LABEL_ROUNDS = 3
LANES, TOKENS = 8, 64
"""Tokens are kept as bytes, eight to a number."""
FOLD_WORDS = 8
"""Numbers of 64 bits in a set's parity sketch."""
MISSED = 1e-5
"""Chance that a linked pair agrees in too few tokens."""
_LOW_BITS = 0x0101010101010101
_rng = np.random.default_rng(20_180_416)
_FLIPS = _rng.integers(0, 1 << 63, 4_096, dtype=np.uint64)
_FACTORS = _rng.integers(0, 1 << 62, 4_096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_KEY = np.uint64(0xA0761D6478BD642F)


def survival(threshold: Threshold, depth: int) -> float:
    """Chance that a pair right at the threshold is together in a cell of one tree, `depth` levels
    below the first, if all cells above branch."""
    similar = threshold.least / threshold.of
    twice = second_pick(threshold)
    p = 1.0
    for _ in range(depth):
        p = (1 - twice) * similar * p + twice * (1 - (1 - similar * p) ** 2)
    return similar * p


def second_pick(threshold: Threshold) -> float:
    """How often a cell picks two tokens: one over the similarity, less one."""
    return min(1.0, threshold.of / threshold.least - 1)


def trees_for(threshold: Threshold, recall: float) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - survival(threshold, DEPTH))))


def least_agreeing(threshold: Threshold) -> int:
    """The number of tokens in which a linked pair agrees, but for a chance of `MISSED`."""
    p, below, k = threshold.least / threshold.of, 0.0, 0
    while True:
        below += math.comb(TOKENS, k) * p**k * (1 - p) ** (TOKENS - k)
        if below > MISSED:
            return k
        k += 1


def minwise(sets: list[np.ndarray], function: int) -> np.ndarray:
    """The smallest hash of each (non-empty) set."""
    flat = np.concatenate(sets)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    hashes = (flat ^ _FLIPS[function]) * _FACTORS[function]
    return np.minimum.reduceat(hashes, np.cumsum(sizes) - sizes)


def _batches(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    first, out, size = 0, [], 0
    for i, text in enumerate(column.cast(pa.binary())):
        out.append(text.as_py() or b"")
        size += len(out[-1])
        if size > BATCH_BYTES:
            yield first, out
            first, out, size = i + 1, [], 0
    if out:
        yield first, out


def _set_keys(sets: list[np.ndarray]) -> list[pa.Array]:
    """Size and two hashes of each set, which tell sets apart."""
    sums = [
        (len(s), int(np.bitwise_xor.reduce(mix(s + _KEY)).view(np.int64)), int(s.sum(dtype=np.uint64).view(np.int64)))
        if len(s)
        else (0, 0, 0)
        for s in sets
    ]
    return [pa.array([x[i] for x in sums], pa.int64()) for i in range(3)]


KEYS = ["n_shingles", "key_a", "key_b"]
LANE_COLUMNS = [f"s{i}" for i in range(LANES)]
FOLD_COLUMNS = [f"f{i}" for i in range(FOLD_WORDS)]
SKETCH_COLUMNS = ["n_shingles", *LANE_COLUMNS, *FOLD_COLUMNS]


def _facts(texts: DataFrame, n: int, trees: int) -> DataFrame:
    """`id`, `KEYS`, the first tokens of all trees (`r0`...), the lanes of further tokens (`s0`...) and
    the parity sketch (`f0`...)."""
    roots = [f"r{t}" for t in range(trees)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, found in _batches(batch.column(1)):
                sets = shingle_sets(found, n)
                held = np.flatnonzero([len(s) > 0 for s in sets])
                filled = [sets[i] for i in held]
                columns = []
                for function in range(trees + TOKENS):
                    column = np.zeros(len(sets), np.uint64)
                    if filled:
                        column[held] = mix(minwise(filled, function))
                    columns.append(column)
                tokens = np.array(columns[trees:]).astype(np.uint8).reshape(LANES, TOKENS // LANES, -1)
                lanes = np.ascontiguousarray(tokens.transpose(0, 2, 1)).view("<i8")[..., 0]
                folds = np.array([sketch(s, FOLD_WORDS) for s in sets]).T
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(found)),
                        *_set_keys(sets),
                        *[pa.array(c.view(np.int64)) for c in columns[:trees]],
                        *[pa.array(c) for c in lanes],
                        *[pa.array(np.ascontiguousarray(c)) for c in folds],
                    ],
                    ["id", *KEYS, *roots, *LANE_COLUMNS, *FOLD_COLUMNS],
                )

    kind = texts.schema["id"].dataType.simpleString()
    longs = ", ".join(f"{c} LONG" for c in [*KEYS, *roots, *LANE_COLUMNS, *FOLD_COLUMNS])
    return texts.mapInArrow(run, f"id {kind}, {longs}")


def _sets(texts: DataFrame, n: int) -> DataFrame:
    """`KEYS, elements`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, found in _batches(batch.column(1)):
                sets = shingle_sets(found, n)
                elements = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*_set_keys(sets), elements], [*KEYS, "elements"])

    return texts.select("id", "text").mapInArrow(
        run, "n_shingles LONG, key_a LONG, key_b LONG, elements ARRAY<LONG>"
    )


def _may_link(a: dict[str, Column], b: dict[str, Column], threshold: Threshold) -> Column:
    """False where sizes, parities or tokens rule a link out."""
    differing = F.lit(0)
    for c in LANE_COLUMNS:
        bits = a[c].bitwiseXOR(b[c])
        for shift in (4, 2, 1):  # the lowest bit of each byte gathers the byte's bits
            bits = bits.bitwiseOR(F.shiftrightunsigned(bits, shift))
        differing = differing + F.bit_count(bits.bitwiseAND(F.lit(_LOW_BITS)))
    odd = F.lit(0)
    for c in FOLD_COLUMNS:
        odd = odd + F.bit_count(a[c].bitwiseXOR(b[c]))
    sizes = a["n_shingles"], b["n_shingles"]
    return (
        (F.least(*sizes) * threshold.of >= F.greatest(*sizes) * threshold.least)
        & (odd * (threshold.of + threshold.least) <= (sizes[0] + sizes[1]) * (threshold.of - threshold.least))
        & (differing <= TOKENS - least_agreeing(threshold))
    )


LEAF_COLUMNS = ["cell", "node", "label", "size", *SKETCH_COLUMNS]


def _near(rows: np.ndarray, named: int, threshold: Threshold) -> Iterator[tuple[int, np.ndarray, bool]]:
    """Of the rows (`LEAF_COLUMNS`) of a cell: a node, at most so many nodes with other labels that it may
    be linked to, those with the smallest numbers, and whether there are more. Each pair comes up once."""
    rows = rows[np.lexsort((rows[:, 1], rows[:, 4]))]
    nodes, labels, sizes = rows[:, 1], rows[:, 2], rows[:, 4]
    tokens = np.ascontiguousarray(rows[:, 5 : 5 + LANES]).view(np.uint8)
    folds = np.ascontiguousarray(rows[:, 5 + LANES :]).view(np.uint64)
    least = least_agreeing(threshold)
    # sets that are not too small for a link stand from here on
    firsts = np.searchsorted(sizes, -(-sizes * threshold.least // threshold.of))
    for k, first in enumerate(firsts.tolist()):
        at = np.flatnonzero(labels[first:k] != labels[k]) + first
        # sets differ in no fewer elements than their parities in bits
        odd = np.bitwise_count(folds[at] ^ folds[k]).sum(axis=1, dtype=np.int64)
        at = at[odd * (threshold.of + threshold.least) <= (sizes[at] + sizes[k]) * (threshold.of - threshold.least)]
        at = at[(tokens[at] == tokens[k]).sum(axis=1) >= least]
        if len(at):
            yield int(nodes[k]), np.sort(nodes[at])[:named], len(at) > named


def _compared(
    batches: Iterator[pa.RecordBatch], named: int, threshold: Threshold
) -> Iterator[pa.RecordBatch]:
    """`cell, node, size, others, more` of the leaves in `batches` (`LEAF_COLUMNS`; cells in a row)."""

    def table(cells: list[np.ndarray]) -> pa.RecordBatch:
        found = [(*rows[0, [0, 3]].tolist(), *x) for rows in cells for x in _near(rows, named, threshold)]
        columns = [[x[i] for x in found] for i in (0, 2, 1, 3, 4)]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.bool_())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], ["cell", "node", "size", "others", "more"]
        )

    held = np.empty((0, len(LEAF_COLUMNS)), np.int64)
    for batch in batches:
        rows = np.concatenate([held, np.column_stack([c.to_numpy() for c in batch.columns])])
        cells = np.split(rows, np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1)
        held = cells.pop()
        yield table(cells)
    if len(held):
        yield table([held])


def _part(of: str) -> Column:
    """The group in which a member's pairs are confirmed: one of its cell's (or lead's) groups of
    some `GROUP_SETS` members."""
    groups = F.ceil(F.col("size") / GROUP_SETS)
    return F.xxhash64(of, F.pmod(F.xxhash64("node"), groups))


def _confirmed(batches: Iterator[pa.RecordBatch], threshold: Threshold) -> Iterator[pa.RecordBatch]:
    """Links within each group of rows (`part, node, label, others, elements`; groups in a row).
    Pairs that earlier links of the group have joined are left out."""

    def links(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        sets = {node: (label, elements) for _, node, label, _, elements in rows}
        above = {label: label for label, _ in sets.values()}

        def top(x: int) -> int:
            while above[x] != x:
                above[x] = x = above[above[x]]
            return x

        for _, a, label, others, elements in rows:
            for b in others or ():
                x, y = top(label), top(sets[b][0])
                other = sets[b][1]
                if x != y:
                    shared = len(np.intersect1d(elements, other, assume_unique=True))
                    if shared * threshold.of >= threshold.least * (len(elements) + len(other) - shared):
                        above[max(x, y)] = min(x, y)
                        yield a, b

    def table(rows: list[tuple]) -> pa.RecordBatch:
        found = list(links(rows))
        return pa.RecordBatch.from_arrays(
            [pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"]
        )

    held: list[tuple] = []
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(4)]
        for row in zip(*columns, (x.values.to_numpy() for x in batch.column(4))):
            if held and held[0][0] != row[0]:
                yield table(held)
                held = []
            held.append(row)
    if held:
        yield table(held)


class _Search:
    """Links found so far, and a label for each node that has one: nodes with equal labels are of one
    class. (Nodes of one class may still have different labels; that only costs comparisons.)"""

    def __init__(self, texts: DataFrame, nodes: DataFrame, n: int, threshold: Threshold) -> None:
        self.texts, self.nodes, self.n, self.threshold = texts, nodes, n, threshold
        self.sketches = nodes.select("node", *SKETCH_COLUMNS)
        self.links = nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
        self.labels: DataFrame | None = None

    def labelled(self, rows: DataFrame) -> DataFrame:
        """`rows` with the column `label`, the node itself while it has no link."""
        if self.labels is None:
            return rows.withColumn("label", F.col("node"))
        found = rows.join(self.labels, "node", "left")
        return found.withColumn("label", F.coalesce("label", "node"))

    def cells(self, rows: DataFrame) -> DataFrame:
        """`cell, node, label, lead, size, main, others` of the rows (`cell, node`) whose cell has
        several labels. `lead` is a node of the cell, `main` its most frequent label, and `others`
        counts the nodes with another one."""
        drawn = F.min_by("node", F.xxhash64("cell", "node"))
        sizes = rows.groupBy("cell").agg(F.count("*").alias("size"), drawn.alias("lead"))
        rows = rows.join(sizes.filter("size > 1"), "cell")
        rows = materialize(self.labelled(rows), "members")
        labels = rows.groupBy("cell", "label").agg(F.count("*").alias("n"))
        cells = labels.groupBy("cell").agg(
            (F.sum("n") - F.max("n")).alias("others"), F.max_by("label", "n").alias("main")
        )
        cells = materialize(cells.filter("others > 0"), "open-cells")
        return rows.join(cells, "cell")

    def lead_pairs(self, members: DataFrame) -> DataFrame:
        """`a, b, part`: members against the lead of their cell, where a link is possible."""
        pairs = members.filter("label <> lead AND node <> lead")
        pairs = pairs.select("node", "lead", _part("lead").alias("part"))
        pairs = pairs.groupBy("node", "lead").agg(F.min("part").alias("part"))
        own = [F.col(c).alias(f"lead_{c}") for c in SKETCH_COLUMNS]
        leads = self.sketches.select(F.col("node").alias("lead"), *own)
        both = pairs.join(self.sketches, "node").join(leads, "lead")
        near = _may_link(
            {c: F.col(c) for c in SKETCH_COLUMNS},
            {c: F.col(f"lead_{c}") for c in SKETCH_COLUMNS},
            self.threshold,
        )
        return both.filter(near).select(F.col("node").alias("a"), F.col("lead").alias("b"), "part")

    def leaves(self, members: DataFrame, named: int) -> DataFrame:
        """`cell, node, size, others, more` (written): nodes that members of leaves may be linked to."""
        rows = members.join(self.sketches, "node").select(*LEAF_COLUMNS)
        rows = rows.repartition(F.col("cell")).sortWithinPartitions("cell")
        threshold = self.threshold
        found = rows.mapInArrow(
            lambda batches: _compared(batches, named, threshold),
            "cell LONG, node LONG, size LONG, others ARRAY<LONG>, more BOOLEAN",
        )
        return materialize(found, "near")

    def leaf_pairs(self, found: DataFrame) -> DataFrame:
        """`a, b, part` of what `leaves` found; what came up in several trees is one pair."""
        rows = found.groupBy("node").agg(
            F.min(_part("cell")).alias("part"),
            F.array_distinct(F.flatten(F.collect_list("others"))).alias("others"),
        )
        return rows.select(F.col("node").alias("a"), F.explode("others").alias("b"), "part")

    def other_pairs(self, members: DataFrame) -> DataFrame:
        """`a, b, part`: members of cells against the few outside the most frequent label."""
        rows = materialize(members.join(self.sketches, "node"), "compared")
        few = rows.filter("label <> main").groupBy("cell").agg(  # at most SMALL entries
            F.collect_list(F.struct("node", "label", *SKETCH_COLUMNS)).alias("few")
        )

        def worth(x: Column) -> Column:
            own = {c: F.col(c) for c in SKETCH_COLUMNS}
            near = _may_link(own, {c: x[c] for c in SKETCH_COLUMNS}, self.threshold)
            once = (F.col("label") == F.col("main")) | (x["node"] < F.col("node"))
            return F.when((x["label"] != F.col("label")) & once, near).otherwise(F.lit(False))

        met = rows.join(few, "cell")
        found = met.select("node", _part("cell").alias("part"), F.explode(F.filter("few", worth)).alias("x"))
        return found.select(F.col("node").alias("a"), F.col("x.node").alias("b"), "part")

    def children(self, members: DataFrame) -> DataFrame:
        """`cell, node` one level below these cells."""
        rows = members.select("cell", "node").join(self.sketches, "node")
        lanes = F.array(*LANE_COLUMNS)

        def child(pick: int) -> Column:
            token = F.pmod(F.xxhash64("cell", F.lit(pick)), F.lit(TOKENS)).cast("int")
            place = (F.pmod(token, F.lit(8)) * 8).cast("int")
            lane = F.element_at(lanes, F.floor(token / 8).cast("int") + 1)
            value = F.call_function("shiftrightunsigned", lane, place).bitwiseAND(F.lit(0xFF))
            return F.xxhash64("cell", token, value)

        chance = F.pmod(F.xxhash64("cell", F.lit("second")), F.lit(1_000_000)) / 1_000_000
        second = F.when(chance < second_pick(self.threshold), child(2))
        picked = F.array_distinct(F.array_compact(F.array(child(1), second)))
        return rows.select(F.explode(picked).alias("cell"), "node")

    def confirm(self, pairs: DataFrame) -> None:
        """Adds pairs (`a, b, part`) whose full sets are similar enough to the links: as many as hold
        their classes together."""
        low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
        pairs = pairs.select(low, high, "part").groupBy("a", "b").agg(F.min("part").alias("part"))
        pairs = materialize(pairs, "candidates")
        ends = pairs.groupBy("part", F.col("a").alias("node")).agg(F.collect_list("b").alias("others"))
        rest = pairs.select("part", F.col("b").alias("node")).distinct()
        ends = ends.unionByName(rest.withColumn("others", F.lit(None).cast("array<bigint>")))
        wanted = self.nodes.select("node", "id", *KEYS).join(ends.select("node").distinct(), "node", "left_semi")
        wanted = materialize(wanted, "wanted")
        n_wanted = wanted.count()
        if not n_wanted:
            return
        ids = wanted.select("id").distinct()
        if n_wanted <= BROADCAST_IDS:
            ids = F.broadcast(ids)
        sets = _sets(self.texts.join(ids, "id", "left_semi"), self.n)
        sets = sets.join(wanted.drop("id"), KEYS).dropDuplicates(KEYS).select("node", "elements")
        # each set goes to a group once, whatever the number of its pairs there
        rows = self.labelled(ends).join(sets, "node").select("part", "node", "label", "others", "elements")
        threshold = self.threshold
        rows = rows.repartition(F.col("part")).sortWithinPartitions("part")
        links = rows.mapInArrow(lambda batches: _confirmed(batches, threshold), "a LONG, b LONG")
        links = materialize(links, "links")
        # shuffles and broadcasts of a level would stay in the driver's care until the end
        forget_shuffles(links.sparkSession)
        self.links = self.links.unionByName(links)

    def label(self) -> None:
        """Labels from links: the smallest label of all neighbours, and that label's own, a few times."""
        ends = self.links.unionByName(self.links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ends = materialize(ends, "ends")
        labels = ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"))
        labels = materialize(labels.select("node", F.least("node", "b").alias("label")), "labels")
        for _ in range(LABEL_ROUNDS):
            near = ends.join(labels.withColumnRenamed("node", "b"), "b")
            near = near.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
            labels = labels.join(near, "node").select("node", F.least("label", "near").alias("label"))
            up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
            labels = labels.join(up, "label").select("node", F.col("up").alias("label"))
            labels = materialize(labels, "labels")
        self.labels = labels
        forget_shuffles(labels.sparkSession)

    def run(self, rows: DataFrame) -> None:
        """Links between all nodes that meet in the cells of `rows` (`cell, node`)."""
        for turn in itertools.count():
            members = materialize(self.cells(rows), "open-members")
            forget_shuffles(members.sparkSession)
            if members.isEmpty():
                return
            small, large = members.filter(F.col("size") <= LEAF), members.filter(F.col("size") > LEAF)
            found = self.leaves(small, NAMED[turn] if turn < len(NAMED) else LEAF)
            pairs = self.leaf_pairs(found)
            # once labels are known, leaves are compared again where sets had more to name
            again = found.filter("more").select("cell").distinct()
            rows = small.select("cell", "node").join(again, "cell", "left_semi")
            if not large.isEmpty():
                few = large.filter(F.col("others") <= SMALL)
                many = large.filter(F.col("others") > SMALL)
                pairs = pairs.unionByName(self.other_pairs(few)).unionByName(self.lead_pairs(many))
                rows = rows.unionByName(self.children(many))
            rows = materialize(rows, "next-cells")
            self.confirm(pairs)
            if rows.isEmpty():
                return
            self.label()


def similar_texts(
    docs: DataFrame,
    n: int = 5,
    threshold: Threshold = Threshold(85, 100),
    recall: float = 0.9999,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of `docs`: `id_col, n_shingles, component_id, kept, set_copies`.

    Words are runs of bytes other than `[\\x20\\x09-\\x0D]`, A-Z in lower case; a text's set holds its
    distinct n-grams of words, one for all words if they are fewer. Sets are linked when
    `of * intersection >= least * union`; each link is confirmed on full sets, and one right at the
    threshold is found with a chance of `recall` (in cells of up to `DEPTH` further levels). `component_id`
    is the smallest id reachable by links, the row's own included; `kept` marks the rows whose own
    it is; `set_copies` counts rows with an equal set.

    Null and empty texts, and texts of white space, have empty sets and no links. Rows with the same
    id are one document. Rows with a null id have a null component and no links, and are kept. An empty
    table gives an empty result; other columns are ignored.
    """
    trees = trees_for(threshold, recall)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    facts = materialize(_facts(texts, n, trees), "facts")
    sets = facts.filter("n_shingles > 0 AND id IS NOT NULL")
    carried = [*(f"r{t}" for t in range(trees)), *LANE_COLUMNS, *FOLD_COLUMNS]
    nodes = sets.groupBy(*KEYS).agg(
        F.min("id").alias("id"),
        F.count("*").alias("set_copies"),
        *[F.min(c).alias(c) for c in carried],  # equal for equal sets
    )
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    search = _Search(texts, nodes, n, threshold)
    cells = [F.xxhash64(F.lit(t), f"r{t}") for t in range(trees)]
    search.run(nodes.select(F.explode(F.array(*cells)).alias("cell"), "node"))

    links = search.links
    several = sets.groupBy("id").agg(F.min("key_a").alias("x"), F.max("key_a").alias("y"))
    several = materialize(several.filter("x <> y").select("id"), "several-sets")
    if not several.isEmpty():  # rows that share an id are one document
        rows = sets.select("id", *KEYS).join(several, "id", "left_semi")
        rows = rows.join(nodes.select(*KEYS, "node"), KEYS).select("id", "node").distinct()
        least = rows.groupBy("id").agg(F.min("node").alias("b"))
        links = links.unionByName(rows.join(least, "id").select(F.col("node").alias("a"), "b"))
    classes = components(links).select(F.col("id").alias("node"), F.col("component").alias("class"))
    groups = nodes.select("node", "id", "set_copies", *KEYS).join(classes, "node", "left")
    groups = groups.withColumn("class", F.coalesce("class", "node"))
    groups = materialize(groups, "classed")
    classes = groups.groupBy("class").agg(
        F.min("id").alias("component_id"), F.count("*").alias("members")
    )
    groups = join_groups(groups.drop("id"), classes, ["class"], "members", groups.count())
    groups = groups.select(*KEYS, "set_copies", "component_id")
    found = join_groups(sets.select("id", *KEYS), groups, KEYS, "set_copies", sets.count())
    alone = facts.filter("n_shingles = 0 OR id IS NULL").select(
        "id", "n_shingles", F.lit(1).cast("long").alias("set_copies"), F.col("id").alias("component_id")
    )
    every = found.select(*alone.columns).unionByName(alone)
    return every.select(
        F.col("id").alias(id_col),
        "n_shingles",
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
        "set_copies",
    )
