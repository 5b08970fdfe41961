"""One query per operator of this folder, over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from markspark.llm import (
    bpe,
    chosenpath,
    exact,
    fingerprints,
    hosts,
    jaccard,
    language_model,
    packing,
    ranked_search,
    repeats,
    resampling,
    toxicity,
    warc,
)
from markspark.llm.common import table
from markspark.storage import materialize, new_path

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_jaccard(spark, sf_dir):
    return jaccard.similar_texts(table(spark, sf_dir, "documents"))


def op2_kneser_ney(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language_model.fit(docs)
    scored = materialize(language_model.score(docs, model), "scores")
    model.remove()
    return scored


def op3_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op4_exact_dedup(spark, sf_dir):
    return exact.exact_duplicates(table(spark, sf_dir, "documents"), every_digest=True)


def op6_fingerprints(spark, sf_dir):
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op7_warc(spark, sf_dir):
    path = new_path(spark, "warc")
    warc.write_warc(warc.warc_records(table(spark, sf_dir, "pages")), path)
    records = warc.read_warc(spark, path)
    # the digest of what was read; a revisit says what it left out
    digested = records.select(
        "record_id",
        "type",
        "concurrent_to",
        F.when(F.col("type") == "response", F.octet_length("content"))
        .otherwise(F.col("payload_length"))
        .cast("long")
        .alias("payload_bytes"),
        F.when(F.col("type") == "response", F.sha2("content", 256))
        .when(F.col("type") == "revisit", F.regexp_extract("payload_digest", "sha256:(.*)", 1))
        .alias("payload_digest"),
        F.when(
            F.col("type") == "metadata",
            F.regexp_extract(F.col("content").cast("string"), "page_id: (-?[0-9]+)", 1),
        ).alias("page"),
    )
    captures = warc.assemble_captures(digested).select(
        F.expr("try_cast(metadata.page AS LONG)").alias("page_id"),
        "main.payload_bytes",
        "main.payload_digest",
        F.col("main.type").alias("record_type"),
    )
    return warc.revisits_by_digest(captures).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op8_bpe(spark, sf_dir):
    return bpe.encoded_digests(table(spark, sf_dir, "documents"), TOKENIZER)


def op5_suffix_array(spark, sf_dir):
    return repeats.cut_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


RULES = [
    hosts.Rule("com", "/", "allow"),
    hosts.Rule("example.com", "/en/", "block"),
    hosts.Rule("www.example.com", "/en/", "allow"),
    hosts.Rule("net", "/es/", "block"),
    hosts.Rule("net", "/fr/", "block"),
]


def op9_url_filter(spark, sf_dir):
    """A labelled document stands for the outcome of the page with its number."""
    labels = table(spark, sf_dir, "labels")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    outcomes = labels.select(F.col("doc_id").alias("page_id"), bad.cast("int").alias("bad"))
    judged = hosts.judge_urls(table(spark, sf_dir, "pages"), outcomes, RULES)
    return judged.withColumns({c: F.round(c, 6) for c in ("bad_rate", "bad_low")})


def op10_pack(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op11_ranked_search(spark, sf_dir):
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_chosen_path(spark, sf_dir):
    return chosenpath.similar_texts(table(spark, sf_dir, "documents"))


def op13_resampling(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    gains = resampling.fit(docs, table(spark, sf_dir, "benchmark"))
    return resampling.ranked(resampling.weigh(docs, gains)).select(
        "doc_id", "n_features", "weight", "score", "rank"
    )


LLM_QUERIES = {
    "op1_jaccard": op1_jaccard,
    "op2_kneser_ney": op2_kneser_ney,
    "op3_toxicity": op3_toxicity,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_suffix_array": op5_suffix_array,
    "op6_fingerprints": op6_fingerprints,
    "op7_warc": op7_warc,
    "op8_bpe": op8_bpe,
    "op9_url_filter": op9_url_filter,
    "op10_pack": op10_pack,
    "op11_ranked_search": op11_ranked_search,
    "op12_chosen_path": op12_chosen_path,
    "op13_resampling": op13_resampling,
}
