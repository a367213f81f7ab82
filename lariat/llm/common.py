"""Helpers that several corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import math
import os
import tempfile
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prefix of the columns that operators add on the way; a caller's own columns never start with it.
OWN = "__ll_"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Computes df once and cuts its lineage with a reliable checkpoint.

    The folder is the session's spark.checkpoint.dir, which all executors share. Only where
    that setting is absent (tests on one machine) a temporary folder is set.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "lariat-checkpoints"))
    return df.checkpoint(eager=True)


def tidy() -> None:
    """Gives back what a Python worker's libraries keep of memory that is free, at the end of a task: workers outlive it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def text_key(text: str = "text") -> Column:
    """64-bit hash of a text; with the document's id it names a row without a row number.

    Rows that agree in id and text are one document to the operators that join on this key.
    """
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """Marks df, which must be cheap to count, for broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, allowed: Column | None = None) -> DataFrame:
    """doc_id, label and text of at most `most` labelled documents: those whose ids have the smallest hashes.

    The bound is the caller's documented parameter. Labels and texts that are null do not count;
    of several labels for one id the largest holds, of several texts the least.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    own = own.where(allowed) if allowed is not None else own
    own = own.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    have = own.count()
    hashed, width = F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id")), F.lit(1 << 40)), 1 << 40
    share = min(1.0, (most + 10 * math.sqrt(most) + 100) / max(1, have))  # enough by ten deviations, so that few rows are sorted
    ids = own.withColumn(f"{OWN}h", hashed).where(F.col(f"{OWN}h") <= int(share * width)).orderBy(f"{OWN}h", "doc_id").limit(most).drop(f"{OWN}h")
    texts = docs.select("doc_id", F.col("text").alias("text")).where(F.col("text").isNotNull())
    met = texts.join(F.broadcast(ids), "doc_id")  # bounded by `most`
    return met.groupBy("doc_id").agg(F.first("label").alias("label"), F.min("text").alias("text"))
