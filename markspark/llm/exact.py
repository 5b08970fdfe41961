"""Exact duplicates by progressive refinement: length, then a prefix hash, then the full hash.

Each step drops the rows that have no partner, so that the full text is hashed only where length
and prefix agree with another row (unless every row's digest is asked for).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markspark.llm.common import BROADCAST_KEYS, join_groups, unused, without
from markspark.storage import materialize

SPACES = " \t\n\x0b\f\r"
PREFIX_CHARS = 256


def normalised(text: Column) -> Column:
    """Without the characters of `[\\x20\\x09-\\x0D]`; null is the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def digest(text: Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def _with_partner(rows: DataFrame, keys: list[str], total: int) -> DataFrame:
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_size")).filter("_size > 1")
    return join_groups(rows, sizes, keys, "_size", total).filter("_size > 1").drop("_size")


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    every_digest: bool = False,
) -> DataFrame:
    """One row per row of `docs`: `id_col, keep_id, group_size, kept, text_sha256`.

    Texts are equal when they are the same without white space. Of equal texts, the one with the
    most code points in the original text stays, then the smallest id.

    Null and empty texts are equal to each other and to texts of white space alone. A null id
    comes after all others. Rows that repeat both id and text get the same decision. An empty
    table gives an empty result; other columns of `docs` are ignored. `text_sha256` is null where
    the full text never had to be hashed, unless `every_digest`.
    """
    decided = _decisions(docs, id_col, text_col, every_digest)
    return decided.select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256"
    )


def _decisions(docs: DataFrame, id_col: str, text_col: str, every_digest: bool) -> DataFrame:
    """`id, n_chars, keep_id, group_size, kept, text_sha256`: see `exact_duplicates`."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    plain = normalised(F.col("text"))
    columns = [
        "id",
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
        F.length(plain).alias("length"),
        F.xxhash64(F.left(plain, F.lit(PREFIX_CHARS))).alias("prefix"),
    ]
    if every_digest:
        columns.append(digest(F.col("text")).alias("sha"))
    facts = materialize(source.select(*columns), "exact-facts")
    total = facts.count()

    same_length = _with_partner(facts, ["length"], total)
    survivors = _with_partner(same_length, ["length", "prefix"], total)
    if not every_digest:
        # the second reading: full texts of the survivors alone
        ids = survivors.select("id").distinct()
        again = source.join(ids, source["id"].eqNullSafe(ids["id"]), "left_semi")
        hashed = again.select(
            "id",
            F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
            F.length(normalised(F.col("text"))).alias("length"),
            F.xxhash64(F.left(normalised(F.col("text")), F.lit(PREFIX_CHARS))).alias("prefix"),
            digest(F.col("text")).alias("sha"),
        )
        survivors = materialize(hashed, "exact-survivors")
        keys = ["id", "n_chars", "length", "prefix"]
        # a row's full hash goes by id and all that is known of its text
        known = survivors.groupBy(*keys).agg(
            F.min("sha").alias("sha"), F.countDistinct("sha").alias("shas")
        )
        several = known.filter("shas > 1")
        if not several.isEmpty():  # one id with texts alike in length and prefix: hash every row
            return _decisions(docs, id_col, text_col, every_digest=True)
        joined = facts.alias("f").join(
            known.alias("k"), [F.col(f"f.{k}").eqNullSafe(F.col(f"k.{k}")) for k in keys], "left"
        )
        facts = joined.select("f.*", "k.sha")
    groups = (
        survivors.groupBy("sha")
        .agg(
            F.count("*").alias("size"),
            F.min(F.struct(-F.col("n_chars"), F.col("id").isNull(), "id"))["id"].alias("keep"),
            F.max("n_chars").alias("most"),
        )
        .filter("size > 1")
    )
    alone = facts.filter("sha IS NULL") if not every_digest else facts.limit(0)
    grouped = join_groups(facts.filter("sha IS NOT NULL"), groups, ["sha"], "size", total)
    rows = grouped.unionByName(alone, allowMissingColumns=True)
    in_group = F.col("size").isNotNull()
    return rows.select(
        "id",
        "n_chars",
        F.when(in_group, F.col("keep")).otherwise(F.col("id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (~in_group | (F.col("id").eqNullSafe(F.col("keep")) & (F.col("n_chars") == F.col("most"))))
        .alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns.

    Of rows that repeat both id and text, one stays. Otherwise as `exact_duplicates` says. Full texts
    are hashed only for rows that agree with another one in length and prefix, and once more for
    rows whose id is to go; only where an id is on several rows of which some go, every row is.
    """
    decided = materialize(_decisions(docs, id_col, text_col, every_digest=False), "decisions")
    keys = ["id", "n_chars", "text_sha256"]
    dropped = decided.filter("NOT kept").select(*keys).distinct()
    alike = decided.filter("kept AND group_size > 1").groupBy(*keys).count().filter("count > 1")
    by_id = dropped.groupBy("id").agg(
        F.count("*").alias("texts"), *[F.min(k).alias(k) for k in keys[1:]]
    )
    by_id = materialize(by_id, "dropped-ids")
    n_chars = F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long")
    if alike.isEmpty() and by_id.filter("texts > 1").isEmpty():
        names = [unused(docs, f"gone_{k}") for k in keys]
        gone = by_id.select(*[F.col(k).alias(n) for k, n in zip(keys, names)])
        if gone.count() <= BROADCAST_KEYS:
            gone = F.broadcast(gone)
        marked = docs.join(gone, F.col(id_col).eqNullSafe(F.col(names[0])), "left")
        goes = F.when(F.col(names[1]) == n_chars, digest(F.col(text_col)) == F.col(names[2]))
        return marked.filter(~F.coalesce(goes, F.lit(False))).drop(*names)
    sha, size = unused(docs, "_digest"), unused(docs, "_n_chars")
    marked = docs.withColumns({size: n_chars, sha: digest(F.col(text_col))})
    own = [id_col, size, sha]
    stay = without(marked, _renamed(dropped, keys, own), own)
    if not alike.isEmpty():
        twice = materialize(_renamed(alike, keys, own), "repeated-rows")
        same = [F.col(f"s.{k}").eqNullSafe(F.col(f"t.{k}")) for k in own]
        several = stay.alias("s").join(twice.alias("t"), same, "left_semi")
        stay = without(stay, twice, own).unionByName(several.dropDuplicates(own))
    return stay.drop(size, sha)


def _renamed(rows: DataFrame, names: list[str], others: list[str]) -> DataFrame:
    return rows.select(*[F.col(a).alias(b) for a, b in zip(names, others)])
