"""Similarity join of texts by the Jaccard similarity of their word n-grams, exact.

Each text's set of n-grams becomes a parity sketch: every n-gram flips one bit. Two sketches differ
in at most as many bits as the sets differ in elements, so of more blocks than that difference may
be large, at least one is untouched. Texts are taken by bands of set size, since the allowed
difference grows with the sets; a band decides the number of blocks. Besides its bits, a block
combines the hashes of its n-grams by exclusive or; texts that agree in such a number are
candidates, the bits of whole sketches rule wrong ones out, and the sets themselves decide.

There are some blocks to spare: linked texts agree in more than `spare` of them. So each text keeps
quiet about its `spare` blocks with the fewest n-grams, which agree by chance the most. Of the blocks
in which two linked texts agree, the fullest has at least `spare` others below it in either text, so
both tell its number.

Candidates of a block are not paired with each other but with a few centres: one at first, more in
later rounds. Links join texts to classes; only texts of one block that are still in different
classes meet again, with the next centres, until there are none. A member carries its set's size and
a parity sketch of `FOLD_WORDS` words, which bounds the difference from below as well: a member
meets only those centres that size and bound allow, so most texts that share a block by chance
never become a pair. Texts with equal sets are one node from the start.
"""

from __future__ import annotations

import itertools
import shutil
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from markspark.llm import runs
from markspark.llm.common import (
    forget_shuffles,
    join_groups,
    leave_earlier_work,
    mapped,
    shared_files,
    without,
    write_file,
)
from markspark.llm.components import components
from markspark.llm.wordhash import mix, words_of
from markspark.storage import discard, materialize

BATCH_BYTES = 1 << 20
CENTRES = (1, 16, 128, 1024)
"""Centres of a block in the first rounds; the last number holds for all further ones."""
FOLD_WORDS = 4
SPARE = 2
"""One spare block for so many that may differ."""
BROADCAST_IDS = 500_000
PAIRS_PER_SALT = 500
RANGE_BLOCKS = 2_000_000
"""Blocks of sketches behind one range of their numbers."""
KEPT = 500_000
"""Numbers that a task collects before it sends them."""
MEMBER = ["id", "band", "n_shingles", "fold"]
_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


@dataclass(frozen=True)
class Threshold:
    """Linked when `of * intersection >= least * union`."""

    least: int = 90
    of: int = 100

    def band(self, size: int) -> int:
        """Linked sets are of one band or of neighbouring ones."""
        return _bands(self.least, self.of, size.bit_length())[0].searchsorted(size, "right") - 1

    def difference(self, band: int) -> int:
        """How many elements linked sets can differ by, if the smaller one is of this band."""
        bits = 8
        starts = _bands(self.least, self.of, bits)[0]
        while band + 1 >= len(starts):  # how many bands a doubling has depends on the threshold
            bits += 4
            starts = _bands(self.least, self.of, bits)[0]
        small = int(starts[band + 1]) - 1
        large = small * self.of // self.least
        # |A| + |B| elements, of which the union holds at least (of / (of + least)) of them
        return (small + large) * (self.of - self.least) // (self.of + self.least)

    def spare(self, band: int) -> int:
        return self.difference(band) // SPARE

    def blocks(self, band: int) -> int:
        return self.difference(band) + 1 + self.spare(band)


@lru_cache(maxsize=64)
def _bands(least: int, of: int, bits: int) -> tuple[np.ndarray]:
    """First size of each band, up to sizes of so many bits: a set linked to one of a band's
    first size is at least as large as the first size of the band before."""
    starts = [0, 1]
    while starts[-1] <= 1 << (bits + 1):
        # the smallest size that no set of the band's first size can be linked to
        starts.append(starts[-1] * of // least + 1)
    return (np.array(starts, np.int64),)


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Distinct n-grams of words of each text, as sorted numbers; fewer words are one n-gram."""
    found = words_of(texts, fold_case=True)
    w = found.numbers
    places = max(len(w) - n + 1, 0)
    grams = np.full(places, np.uint64(n))
    for i in range(n):
        grams = mix(grams * _MULTIPLIERS[0] + w[i : i + places] * _MULTIPLIERS[i % 3])
    out = []
    for a, b in zip(found.firsts[:-1].tolist(), found.firsts[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            whole = np.full(1, np.uint64(b - a))
            for i in range(a, b):
                whole = mix(whole * _MULTIPLIERS[0] + w[i : i + 1] * _MULTIPLIERS[1])
            out.append(whole)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def sketch(elements: np.ndarray, blocks: int) -> np.ndarray:
    """Parities of 64 * blocks bits, as 64-bit words."""
    bits = (elements % np.uint64(64 * blocks)).astype(np.int64)
    odd = np.bincount(bits, minlength=64 * blocks) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def _batches(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    first, out, size = 0, [], 0
    for i, text in enumerate(column):
        out.append((text.as_py() or "").encode())
        size += len(out[-1])
        if size > BATCH_BYTES:
            yield first, out
            first, out, size = i + 1, [], 0
    if out:
        yield first, out


def block_numbers(elements: np.ndarray, band: int, threshold: Threshold) -> np.ndarray:
    """One number for each block that the text has to speak up for."""
    blocks = threshold.blocks(band)
    block = (elements % np.uint64(64 * blocks)).astype(np.int64) >> 6
    order = np.argsort(block, kind="stable")
    block, hashes = block[order], mix(elements[order] + _MULTIPLIERS[1])
    first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    combined = np.zeros(blocks, np.uint64)
    combined[block[first]] = np.bitwise_xor.reduceat(hashes, first)
    held = np.zeros(blocks, np.int64)
    held[block[first]] = np.diff(np.append(first, len(block)))
    where = (np.uint64(band) << np.uint64(40)) | np.arange(blocks, dtype=np.uint64)
    numbers = mix(mix(where + _MULTIPLIERS[0]) ^ combined)
    fullest = np.lexsort((np.arange(blocks), held))[threshold.spare(band) :]
    return numbers[fullest]


def _bands_of(size: int, threshold: Threshold) -> list[int]:
    """A set's own band and the one below, whose larger partners it may be."""
    top = threshold.band(size) if size else 0
    return [b for b in (top, top - 1) if b > 0]


def _sketches(docs: DataFrame, n: int, threshold: Threshold) -> DataFrame:
    """`id, n_shingles, key_a, key_b, fold` (the short sketch), `sketches` (band and numbers of its
    blocks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leave_earlier_work()
        kind = pa.list_(pa.struct([("band", pa.int32()), ("keys", pa.list_(pa.int64()))]))
        for batch in batches:
            for first, texts in _batches(batch.column(1)):
                sizes, key_a, key_b, folds, sketches = [], [], [], [], []
                for s in shingle_sets(texts, n):
                    sizes.append(len(s))
                    mixed = mix(s + _MULTIPLIERS[2])
                    key_a.append(int(np.bitwise_xor.reduce(mixed).astype(np.int64)) if len(s) else 0)
                    key_b.append(int(s.sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0)
                    folds.append(sketch(s, FOLD_WORDS))
                    sketches.append(
                        [
                            {"band": b, "keys": block_numbers(s, b, threshold).view(np.int64)}
                            for b in _bands_of(len(s), threshold)
                        ]
                    )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(texts)),
                        pa.array(sizes, pa.int64()),
                        pa.array(key_a, pa.int64()),
                        pa.array(key_b, pa.int64()),
                        pa.array(folds, pa.list_(pa.int64())),
                        pa.array(sketches, kind),
                    ],
                    ["id", "n_shingles", "key_a", "key_b", "fold", "sketches"],
                )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(
        run,
        f"id {kind}, n_shingles LONG, key_a LONG, key_b LONG, fold ARRAY<LONG>, "
        "sketches ARRAY<STRUCT<band: INT, keys: ARRAY<LONG>>>",
    )


def _sets(docs: DataFrame, n: int, threshold: Threshold) -> DataFrame:
    """`id, elements` (sorted), `sketches` (band and words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("band", pa.int32()), ("words", pa.list_(pa.int64()))]))
        for batch in batches:
            for first, texts in _batches(batch.column(1)):
                sets = shingle_sets(texts, n)
                sketches = [
                    [
                        {"band": b, "words": sketch(s, threshold.blocks(b))}
                        for b in _bands_of(len(s), threshold)
                    ]
                    for s in sets
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(texts)),
                        pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                        pa.array(sketches, kind),
                    ],
                    ["id", "elements", "sketches"],
                )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(
        run,
        f"id {kind}, elements ARRAY<LONG>, sketches ARRAY<STRUCT<band: INT, words: ARRAY<LONG>>>",
    )


def _block_keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All block numbers of a batch of sketches (column `keys`), and the row of each."""
    keys = batch.column(batch.schema.get_field_index("keys"))
    sizes = np.diff(keys.offsets.to_numpy().astype(np.int64))
    row = np.repeat(np.arange(len(sizes)), sizes)
    return keys.flatten().to_numpy().view(np.uint64), row


def _shared_blocks(sketches: DataFrame) -> DataFrame:
    """`id, band, n_shingles, fold, key` of the blocks that two or more rows of `sketches` agree in.

    Tasks count the numbers of their blocks and send them as sorted runs, by ranges; a number that
    comes up twice in its range goes into the range's file. Tasks then map these files and keep
    the blocks found there. So no row of a block is moved unless it has a partner.
    """
    spark = sketches.sparkSession
    path = shared_files(spark, "shared-blocks")
    n = sketches.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0)).alias("n")).first().n
    ranges = 1 << max(0, int(n) // RANGE_BLOCKS).bit_length()
    parts_of = ranges.bit_length() - 1

    def part(keys: np.ndarray) -> np.ndarray:
        shift = np.uint64(64 - parts_of)
        return (keys >> shift).astype(np.int64) if parts_of else np.zeros(len(keys), np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = runs.Counts(KEPT)

        def out() -> pa.RecordBatch:
            keys, sums = counts.take()
            names, first = np.unique(part(keys), return_index=True)
            ends = [*first[1:], len(keys)]
            sent = [runs.pack(keys[a:b], np.minimum(sums[a:b], 2)) for a, b in zip(first, ends)]
            return pa.RecordBatch.from_arrays(
                [pa.array(names), pa.array(sent, pa.binary())], ["part", "run"]
            )

        for batch in batches:
            keys, _ = _block_keys(batch)
            keys, sums = np.unique(keys, return_counts=True)
            if counts.add(keys, sums.astype(np.int64)):
                yield out()
        if counts.size:
            yield out()

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        found = [runs.unpack(x.as_py()) for x in table.column("run")]
        keys, sums = runs.group_sums(
            np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
        )
        keys = keys[sums > 1]
        write_file(f"{path}/{key[0].as_py()}", keys.astype("<u8").tobytes())
        return pa.table({"part": [key[0].as_py()], "shared": [len(keys)]})

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[int, np.ndarray] = {}
        for batch in batches:
            keys, row = _block_keys(batch)
            order = np.argsort(keys)
            ordered = keys[order]
            kept = np.zeros(len(keys), bool)
            names, first = np.unique(part(ordered), return_index=True)
            for name, a, b in zip(names.tolist(), first, [*first[1:], len(keys)]):
                if name not in maps:
                    maps[name] = mapped(f"{path}/{name}", "<u8", int(shared[name]))
                known = maps[name]
                if len(known):
                    at = np.minimum(np.searchsorted(known, ordered[a:b]), len(known) - 1)
                    kept[order[a:b]] = known[at] == ordered[a:b]
            row = pa.array(row[kept])
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(name).take(row) for name in MEMBER],
                    pa.array(keys[kept].view(np.int64)),
                ],
                [*MEMBER, "key"],
            )

    sent = sketches.select("keys").mapInArrow(count, "part LONG, run BINARY").groupBy("part")
    sizes = sent.applyInArrow(merge, "part LONG, shared LONG").toArrow()  # one row per range
    shared = np.zeros(ranges, np.int64)
    shared[sizes.column("part").to_numpy()] = sizes.column("shared").to_numpy()
    kind = sketches.schema["id"].dataType.simpleString()
    rows = sketches.select(*MEMBER, "keys").mapInArrow(
        keep, f"id {kind}, band INT, n_shingles LONG, fold ARRAY<LONG>, key LONG"
    )
    rows = materialize(rows, "block-members")
    shutil.rmtree(path, ignore_errors=True)
    return rows


def _both_sides(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """Pairs with the values of `a` and of `b` (structs `_a`, `_b`).

    A centre (`b`) can be in any number of pairs: its value is repeated, and its pairs dealt out,
    in proportion to that number.
    """
    value = F.struct(*[c for c in values.columns if c != "id"])
    of_b = pairs.groupBy("b").agg(F.count("*").alias("_n"))
    salts = F.ceil(F.col("_n") / PAIRS_PER_SALT).cast("int")
    of_b = materialize(of_b.withColumn("_salts", salts), "centre-sizes")
    total = of_b.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first().n
    counted = join_groups(pairs, of_b, ["b"], "_n", total)
    salted = counted.withColumn("_salt", F.pmod(F.xxhash64("a"), F.col("_salts")).cast("int"))
    left = salted.drop("_n", "_salts").join(
        values.select(F.col("id").alias("a"), value.alias("_a")), "a"
    )
    right = values.select(F.col("id").alias("b"), value.alias("_b")).join(
        of_b.select("b", "_salts"), "b"
    )
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
    return left.join(right.drop("_salts"), ["b", "_salt"])


def _linked(pairs: DataFrame, docs: DataFrame, n: int, threshold: Threshold) -> DataFrame:
    """The pairs (`a, b, band`) whose sets are similar enough, as `a, b` (written)."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    ids = ids.distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    chosen = docs.join(ids, "id", "left_semi").select("id", "text")
    sets = materialize(_sets(chosen, n, threshold), "sets")
    both = _both_sides(pairs, sets)

    def words(side: str) -> Column:
        same = F.filter(F.col(f"{side}.sketches"), lambda s: s["band"] == F.col("band"))
        return F.get(same, F.lit(0))["words"]

    bits = F.aggregate(
        F.zip_with(words("_a"), words("_b"), lambda x, y: F.bit_count(x.bitwiseXOR(y))),
        F.lit(0),
        lambda s, x: s + x,
    )
    sizes = F.size("_a.elements") + F.size("_b.elements")
    # sets that differ in more elements than this are not linked, and sketches differ in no more
    most = F.floor(sizes * (threshold.of - threshold.least) / (threshold.of + threshold.least))
    shared = F.size(F.array_intersect("_a.elements", "_b.elements"))
    similar = shared * threshold.of >= (sizes - shared) * threshold.least
    linked = both.filter(F.when(bits <= most, similar).otherwise(F.lit(False)))
    links = materialize(linked.select("a", "b").distinct(), "links")
    discard(sets)
    return links


def _may_link(a: Column, b: Column, threshold: Threshold) -> Column:
    """Whether the sizes and short sketches of two members leave room for a link; a null sketch does."""
    sizes = a["n_shingles"] + b["n_shingles"]
    most = F.floor(sizes * (threshold.of - threshold.least) / (threshold.of + threshold.least))
    bits = F.lit(0)
    for i in range(FOLD_WORDS):
        bits = bits + F.bit_count(a["fold"][i].bitwiseXOR(b["fold"][i]))
    fits = (F.abs(a["n_shingles"] - b["n_shingles"]) <= most) & (bits <= most)
    return F.coalesce(fits, F.lit(True))


def _ordered() -> tuple[Column, Column]:
    """A pair's ids, the smaller one first."""
    return F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")


def _classes(links: DataFrame) -> DataFrame:
    """`id, component, class_size`."""
    found = components(links)
    sizes = found.groupBy("component").agg(F.count("*").alias("class_size"))
    return materialize(
        join_groups(found, sizes, ["component"], "class_size", found.count()), "classes"
    )


def _one_band(pairs: DataFrame) -> DataFrame:
    """Each pair once, with one of the bands in which it came up."""
    return pairs.groupBy("a", "b").agg(F.min("band").alias("band"))


def similar_texts(
    docs: DataFrame,
    n: int = 3,
    threshold: Threshold = Threshold(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of `docs`: `id_col, n_shingles, component_id, set_copies, partner_id`.

    Words are runs of bytes other than `[\\x20\\x09-\\x0D]`, A-Z in lower case; a text's set holds
    its distinct n-grams of words, one for all words if they are fewer. `component_id` is the
    smallest id reachable by links, the row's own included. `set_copies` counts rows with an equal
    set. `partner_id` names a confirmed link of the row: the first row of its own set, or, for that
    first row, the smallest id that was tested and is linked to it; null where there is none. So each
    class comes as its rows and links that hold it together, and copies are not expanded into pairs.

    Null and empty texts, and texts of white space, have empty sets and no links. Rows with the
    same id are one node. Rows with a null id have a null component and no links. An empty table
    gives an empty result; other columns are ignored.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sketched = materialize(_sketches(texts, n, threshold), "sketches")
    facts = materialize(sketched.drop("fold", "sketches"), "facts")
    sets = facts.filter("n_shingles > 0 AND id IS NOT NULL")
    keys = ["n_shingles", "key_a", "key_b"]
    groups = sets.groupBy(*keys).agg(F.min("id").alias("node"), F.count("*").alias("set_copies"))
    groups = materialize(groups, "equal-sets")
    total = facts.count()
    # the first row of each set stands for it
    nodes = sketched.join(
        groups.select(*keys, F.col("node").alias("id")), [*keys, "id"], "left_semi"
    ).dropDuplicates(["id", *keys])
    # an id on rows with different sets: which of them a member stands for can't be told by the id
    twice = sets.groupBy("id").agg(F.min("key_a").alias("x"), F.max("key_a").alias("y"))
    twice = materialize(twice.filter("x <> y").select("id"), "ids-of-several-sets")
    ids_of_several = not twice.isEmpty()
    if ids_of_several:
        alike = without(nodes, twice, ["id"])
        unlike = nodes.join(twice, "id", "left_semi").withColumn(
            "fold", F.lit(None).cast("array<bigint>")
        )
        unlike = unlike.withColumn("n_shingles", F.lit(None).cast("long"))
        nodes = alike.unionByName(unlike)
    sketches = nodes.select("id", "n_shingles", "fold", F.explode("sketches").alias("s"))
    sketches = materialize(
        sketches.select("id", "s.band", "n_shingles", "fold", "s.keys"), "nodes"
    )
    discard(sketched)
    forget_shuffles(docs.sparkSession)
    members = _shared_blocks(sketches)
    discard(sketches)
    forget_shuffles(docs.sparkSession)
    node, none = F.col("node"), groups.limit(0)
    tested = none.select(node.alias("low"), node.alias("high"))
    links = none.select(node.alias("a"), node.alias("b"))
    classes = none.select(
        node.alias("id"), node.alias("component"), F.col("set_copies").alias("class_size")
    )

    for turn in itertools.count():
        # members in their classes; blocks with a single class are done
        labelled = members.join(classes, "id", "left").select(
            *MEMBER, "key",
            F.coalesce("component", "id").alias("class"),
            F.coalesce("class_size", F.lit(1)).alias("class_size"),
        )
        several = labelled.groupBy("key").agg(
            F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("size")
        )
        several = materialize(several.filter("low <> high").drop("low", "high"), "open-blocks")
        n_rows = several.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first().n
        if not n_rows:
            break
        before = members
        members = join_groups(labelled, several, ["key"], "size", n_rows).filter("size IS NOT NULL")
        members = materialize(members, "open-members")
        discard(before)
        forget_shuffles(docs.sparkSession)
        n_centres = CENTRES[min(turn, len(CENTRES) - 1)]
        # the members of small classes: once they have met all others, one class is left
        smallest = Window.partitionBy("key").orderBy("class_size", "id")
        centres = members.withColumn("rank", F.row_number().over(smallest))
        centres = centres.filter(F.col("rank") <= n_centres).groupBy("key", "size").agg(
            F.collect_list(  # at most n_centres
                F.struct(F.col("id").alias("b"), F.col("class").alias("b_class"), "n_shingles", "fold")
            ).alias("centres"),
            F.max(F.struct("class_size", "id")).alias("last"),
        )
        centres = materialize(centres, "centres")
        met = join_groups(members.drop("size"), centres, ["key"], "size", n_rows)
        met = met.withColumn("is_centre", F.struct("class_size", "id") <= F.col("last"))
        # every member meets the centres of other classes that may be linked to it, two centres once
        own = F.struct("n_shingles", "fold")
        others = F.filter(
            "centres",
            lambda c: (c["b_class"] != F.col("class"))
            & (~F.col("is_centre") | (c["b"] < F.col("id")))
            & _may_link(own, c, threshold),
        )
        pairs = met.select("id", "band", F.explode(others).alias("c"))
        pairs = _one_band(pairs.select(F.col("id").alias("a"), F.col("c.b").alias("b"), "band"))
        pairs = pairs.withColumns({c: v for c, v in zip(("low", "high"), _ordered())})
        # a pair that was tested is linked, and then of one class, or it is not
        new = pairs.join(tested, ["low", "high"], "left_anti").dropDuplicates(["low", "high"])
        new = materialize(new, "pairs")
        forget_shuffles(docs.sparkSession)
        found = _linked(new.drop("low", "high"), texts, n, threshold)
        forget_shuffles(docs.sparkSession)
        if not found.isEmpty():
            links = materialize(links.unionByName(found), "links")
            classes = _classes(links)
        tested = tested.unionByName(new.select("low", "high"))
        before = members
        members = materialize(met.filter(~F.col("is_centre")).select(*MEMBER, "key"), "members")
        discard(before)
        discard(centres)

    discard(members)
    classes = classes.select(F.col("id").alias("node"), "component")
    ends = links.select("a", "b").unionByName(links.select(F.col("a").alias("b"), F.col("b").alias("a")))
    partners = ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("partner"))
    groups = groups.join(classes, "node", "left").join(partners, "node", "left")
    if ids_of_several:  # such an id joins its sets
        groups = _joined_by_id(sets, groups, keys, total)
    found = join_groups(sets.select("id", *keys), groups, keys, "set_copies", total)
    found = found.withColumn("component_id", F.coalesce("component", "node"))
    alone = facts.filter("n_shingles = 0 OR id IS NULL").select(
        "id", "n_shingles", F.col("id").alias("component_id"), F.lit(1).cast("long").alias("set_copies"),
    )
    every = found.unionByName(alone, allowMissingColumns=True)
    own = F.when(F.col("id") != F.col("node"), F.col("node")).otherwise(F.col("partner"))
    return every.select(
        F.col("id").alias(id_col),
        "n_shingles",
        "component_id",
        "set_copies",
        own.alias("partner_id"),
    )


def _joined_by_id(sets: DataFrame, groups: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Classes once more, with a link between the nodes of rows that share an id."""
    own = F.coalesce("component", "node").alias("b")
    edges = join_groups(
        sets.select("id", *keys), groups.select(*keys, own, "set_copies"), keys, "set_copies", total
    )
    classes = components(edges.select(F.col("id").alias("a"), "b"))
    classes = classes.withColumnRenamed("id", "node")
    return groups.drop("component").join(classes, "node", "left")
