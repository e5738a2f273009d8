"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(name: str) -> Column:
    """The text, null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fold_of(name: str, folds: int) -> Column:
    """crc32 of the value as text, modulo ``folds``; a null value counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def text_key(c: Column) -> Column:
    """128 bits of the text's sha256: equal texts, and in practice only those, share it."""
    return F.substring(F.unhex(F.sha2(c.cast("binary"), 256)), 1, 16)


def with_outputs(df: DataFrame, outputs: dict[str, Column]) -> DataFrame:
    """``df`` with the named outputs; an input column of such a name gives way (names compare without case)."""
    taken = {c.lower() for c in outputs}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken], *[v.alias(k) for k, v in outputs.items()])
