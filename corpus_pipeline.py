"""From raw documents to token ids: language, exact copies, near copies, source mix, byte-level BPE.

Every stage takes all documents that the one before kept, as a written table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import bloom_dedup, byte_codec, hyper_language, source_mix, weighted_minhash
from tidewater.llm.common import documents, text_key, text_of
from tidewater.sources.staging import write_stage


#: A cosine that random vectors of 1024 dimensions reach with probability 0.02, and the letters from which it tells.
CHANCE, MIN_LETTERS = 2 / 1024**0.5, 20


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language: a null text, one without a letter, and one of at least MIN_LETTERS letters
    whose cosine with its nearest language is below CHANCE, that is no nearer than noise (letter salad, or a
    language of which no document bears a label).  Shorter texts stay; so do all with a letter where no language is found."""
    profiles = hyper_language.prototypes(docs)
    # a column name of its own for each output, so that the documents' columns survive
    found = hyper_language.predict(docs.select(F.struct("*").alias("__doc"), F.col("text").alias("__text")), profiles, "__text")
    text = text_of("__text")
    short = F.length(F.regexp_replace(text, r"[^\p{L}]", "")) < MIN_LETTERS
    stays = (F.col("lang_pred") == "und") | (F.col("score") >= CHANCE) | short
    return found.where(hyper_language.has_letter(text) & stays).select("__doc.*")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document of the largest id stays; of several with that id the largest in all columns, once."""
    marked = bloom_dedup.dedup(docs.select(F.struct("*").alias("__doc"), "doc_id", "text")).where("kept")
    alone = marked.where("group_size = 1").select("__doc")
    # one row a text in all but repeated ids; combined before the shuffle
    tied = marked.where("group_size > 1").groupBy("text_sha256").agg(F.max("__doc").alias("__doc")).select("__doc")
    return alone.union(tied).select("__doc.*")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document of the largest id stays; of equal ids the one of the largest text key.

    Rows are told apart by id and text, so a clean document that shares its id with a near copy, or has none, stays.
    """
    gone = weighted_minhash.classes(docs.select("doc_id", "text"), key="__key").where("not kept").select(F.col("doc_id").alias("__id"), "__key").distinct()
    keyed = docs.withColumn("__k", text_key(text_of("text")))
    return keyed.join(gone, (F.col("__k") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_anti").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the schedule of its source begins to take it: never, once, or up to three times."""
    keyed = docs.withColumn("__key", text_key(text_of("text")))
    times = source_mix.mix(keyed, carry=["doc_id", "__key"]).where("taken > 0")
    times = times.groupBy(F.col("doc_id").alias("__id"), F.col("__key").alias("__k")).agg(F.max(F.ceil(F.col("taken") / F.col("size"))).alias("__times"))
    both = keyed.join(times, F.col("__key").eqNullSafe(F.col("__k")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    return both.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int")))).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, as digests with those of the decoded text."""
    return byte_codec.digest(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language", known_language), ("exact_dedup", without_copies), ("near_dedup", without_near_copies), ("mix", mixed), ("encode", encoded)]

#: Sampling and sequential merges can't be written in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = write_stage(stage(spark, docs, sf_dir), name)
    return docs
