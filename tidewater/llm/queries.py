"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tidewater.llm import bloom_dedup, bloom_lm, byte_codec, chebyshev_whitening, edit_embedding, hilbert_shards, hyper_language, image_features, license_scan, source_mix, token_count, turn_repair, weighted_minhash
from tidewater.llm.common import documents, fold_of
from tidewater.sources.staging import cut


def op1_byte_codec(spark, sf_dir):
    return byte_codec.digest(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_license_scan(spark, sf_dir):
    return license_scan.scan(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op3_hilbert_shards(spark, sf_dir):
    return hilbert_shards.digest(documents(spark, sf_dir))


def op4_image_features(spark, sf_dir):
    """Pictures drawn from all vectors; edited copies of those whose id is divisible by 50 are looked for among them.

    A match has the least id among equal pictures; for every vector, a row
    without a query says which id that is (member: the vector's own).
    """
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    asked = image_features.pictures(vectors.where(F.col("vec_id") % 50 == 0), "vec_id", "embedding", True)
    base = cut(image_features.pictures(vectors, "vec_id", "embedding", False))  # drawn once, read three times
    found = image_features.copies(asked, base)
    return found.unionByName(image_features.members(base), allowMissingColumns=True)


def op5_bloom_lm(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text").withColumn("held_out", fold_of("doc_id", 10) == 0)
    return bloom_lm.score(docs, docs.where("not held_out"))


def op6_hyper_language(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang").withColumn("held_out", fold_of("doc_id", 5) == 0)
    profiles = hyper_language.prototypes(docs.where("not held_out"))
    return hyper_language.predict(docs.select("doc_id", "text", "held_out"), profiles).select("doc_id", "held_out", "lang_pred", "score")


def op7_bloom_dedup(spark, sf_dir):
    return bloom_dedup.dedup(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_token_count(spark, sf_dir):
    return token_count.count_tokens(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op9_weighted_minhash(spark, sf_dir):
    return weighted_minhash.classes(documents(spark, sf_dir))


def op10_source_mix(spark, sf_dir):
    return source_mix.mix(documents(spark, sf_dir).select("doc_id", "source", "text"), carry=["doc_id"])


def op11_edit_embedding(spark, sf_dir):
    found = edit_embedding.edited(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edited_bands", "next_bands")


def op12_chebyshev_whitening(spark, sf_dir):
    return chebyshev_whitening.components(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), "vec_id", "embedding")


def op13_turn_repair(spark, sf_dir):
    """Every original conversation; one of which no row is left has zeros, an empty audit and the hash of nothing."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = turn_repair.digest(turn_repair.repair(turn_repair.damaged(rows)))
    every = rows.select(F.col("conv_id").alias("id")).distinct()
    left = every.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id").withColumnRenamed("id", "conv_id")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return left.fillna(0, counts).fillna("", ["audit"]).withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256))).select("conv_id", *counts, "audit", "repaired_sha256")


QUERIES = {f.__name__: f for f in (op1_byte_codec, op2_license_scan, op3_hilbert_shards, op4_image_features, op5_bloom_lm, op6_hyper_language, op7_bloom_dedup, op8_token_count, op9_weighted_minhash, op10_source_mix, op11_edit_embedding, op12_chebyshev_whitening, op13_turn_repair)}

ORACLES = {
    "op7_bloom_dedup": """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS s FROM documents),
g AS (SELECT s, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY s)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.s AS text_sha256 FROM d JOIN g USING (s)""",
}
