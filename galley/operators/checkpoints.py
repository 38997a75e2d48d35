"""Resuming: finished chunks by fingerprint, so that nothing is asked twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(*parts: Column) -> Column:
    """Sixteen hex digits of what makes a run: file, options, glossary and prompt contents."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]), 256), 1, 16)


def file_fingerprint(path: Column, size: Column, modified: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", path, size.cast("string"), modified.cast("bigint").cast("string")), 256), 1, 16)


def pending(packs: DataFrame, done: DataFrame, run: str) -> DataFrame:
    """Packs of a run that have no finished chunk."""
    return packs.join(done.filter(F.col("fingerprint") == run).select("chunk_id"), "chunk_id", "left_anti")


def finished(packs: DataFrame, done: DataFrame, run: str) -> DataFrame:
    """Packs with their finished texts; of several entries of a chunk the latest counts."""
    last = done.filter(F.col("fingerprint") == run).groupBy("chunk_id").agg(F.max_by("texts", "line_no").alias("texts"))
    return packs.join(last, "chunk_id")


def read_journal(spark: SparkSession, path: str, run: str) -> DataFrame:
    """(fingerprint, chunk_id, texts, line_no) of a journal of JSON lines whose head is {fingerprint, meta}.

    Another run's journal counts as empty; lines that cannot be read (a torn tail) are skipped.
    """
    schema = "struct<fingerprint:string,id:string,texts:array<string>>"
    # file by file, split by split, and within a split as they are read
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select(F.from_json("value", schema).alias("x"), place.alias("line_no"))
    head = lines.filter("x.fingerprint IS NOT NULL").agg(F.min_by("x.fingerprint", "line_no").alias("fingerprint"))
    body = lines.filter("x.id IS NOT NULL AND x.texts IS NOT NULL").select(F.lit(run).alias("fingerprint"), F.col("x.id").alias("chunk_id"), "x.texts", "line_no")
    return body.join(head.filter(F.col("fingerprint") == run), "fingerprint", "left_semi")


def append(done: DataFrame, path: str) -> None:
    """Adds finished chunks to a parquet journal; idempotent by (fingerprint, chunk_id) when read through ``finished``."""
    done.write.mode("append").partitionBy("fingerprint").parquet(path)
