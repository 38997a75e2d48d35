"""Samples of a document: its beginning for detection, strides through it for a glossary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galley.functions.text import blank, strip

LIMIT, EXCERPTS, EXCERPT = 8000, 10, 700


def sample_parts(segments: DataFrame, key: str, order: list[str], limit: int = LIMIT) -> DataFrame:
    """(key, part_no, part): stripped texts in order until ``limit`` characters are reached, the crossing one included.

    Each document's first ``limit`` segments hold more than the limit, so no more than that
    is ranked by size: the rank is cut before the running sum, never the texts. Keys and
    lengths alone are sorted; the texts of the few that stay are joined. ``order`` is unique.
    """
    sizes = segments.filter(~blank("text")).select(key, *order, F.length(strip("text")).alias("_n"))
    ranked = sizes.withColumn("part_no", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("part_no") <= limit)
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = ranked.withColumn("_b", before).filter(F.col("_b") < limit)
    return _with_texts(segments, kept, key, order).select(key, "part_no", strip("text").alias("part"))


def _with_texts(segments: DataFrame, kept: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``kept`` rows of ``segments`` with their ``text``; a null of a key is a key."""
    names = [key, *order]
    right = segments.select(*[F.col(c).alias(f"_{c}") for c in names], "text")
    return kept.join(right, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names]))


def joined_parts(parts: DataFrame, key: str, sep: str = "\n") -> DataFrame:
    """(key, text): a few parts of each document joined in order."""
    ordered = F.array_sort(F.collect_list(F.struct("part_no", "part")))
    return parts.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["part"]), sep).alias("text"))


def excerpts(segments: DataFrame, key: str, order: list[str], count: int = EXCERPTS, size: int = EXCERPT) -> DataFrame:
    """(key, text): every n-th text's beginning, ``count`` of them; a document of no more than ``count`` texts whole, cut once."""
    w = Window.partitionBy(key)
    ranked = segments.select(key, *order).withColumn("i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("n", F.count("*").over(w))
    step = F.greatest(F.floor(F.col("n") / count), F.lit(1))
    few = F.col("n") <= count
    taken = _with_texts(segments, ranked.filter(few | (F.col("i") % step == 0) & (F.floor(F.col("i") / step) < count)), key, order)
    taken = taken.withColumn("t", F.coalesce("text", F.lit("")))
    part: Column = F.when(few, F.col("t")).otherwise(F.left("t", F.lit(size)))
    ordered = F.array_sort(F.collect_list(F.struct("i", part.alias("p"))))
    text = F.array_join(F.transform(ordered, lambda x: x["p"]), "\n\n")
    out = taken.groupBy(key).agg(text.alias("text"), F.max("n").alias("n"))
    return out.select(key, F.when(F.col("n") <= count, F.left("text", F.lit(count * size))).otherwise(F.col("text")).alias("text"))
