"""Written intermediate tables: computed once, read by many, safe to lose executors.

A panel that several statistics read is written as parquet below the folder
named by ``spark.checkpoint.dir``.  That cuts the lineage and the plan, keeps
column pruning and filter pushdown, and survives the loss of any executor.
Only a local session without that setting gets a folder of its own.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_DONE: dict[tuple[str, str], DataFrame] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []


def stage_dir(spark: SparkSession) -> str:
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="spark-tidewater-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return _LOCAL[app]


def write_stage(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once and returns the table read back."""
    spark = df.sparkSession
    path = f"{stage_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """An intermediate that several later branches read: written once, not recomputed per branch."""
    return write_stage(df, "cut")


def staged(spark: SparkSession, root: str, name: str, build) -> DataFrame:
    """The staged table ``name`` of ``root``, built on first use in this application."""
    return shared(spark, root, name, lambda: write_stage(build(), name))


def shared(spark: SparkSession, root: str, name: str, build) -> DataFrame:
    """The table ``name`` of ``root``, for a ``build`` that writes what is dear and leaves cheap columns to the reader."""
    key = (f"{spark.sparkContext.applicationId}:{root}", name)
    if key not in _DONE:
        _DONE[key] = build()
    return _DONE[key]


def forget() -> None:
    """Drops the index of staged tables and deletes the folders this application wrote, on whatever file system they are.

    For use between independent queries, or after the source tables have
    changed; results that still read a staged table must be taken before.
    """
    _DONE.clear()
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        if spark.sparkContext._jsc is not None:  # a stopped session has no file system to ask
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
