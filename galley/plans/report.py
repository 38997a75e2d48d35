"""Plans: what a run would send, by chapter and in all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.functions.cost import job_chars
from galley.functions.rules import needs_rewrite
from galley.operators.packs import greedy_packs, pack_segments
from galley.operators.programs import chars, job_array, with_programs
from galley.session import checkpointed


def program_summary(programs: DataFrame, *keys: str) -> DataFrame:
    """(keys..., keep_chars, replace_chars, keep_ratio, n_jobs) from edit programs."""
    jobs = F.size(F.filter("program", lambda x: x["kind"] == "REPLACE"))
    sums = programs.groupBy(*keys).agg(F.sum(chars(F.col("program"), "KEEP")).alias("keep_chars"), F.sum(chars(F.col("program"), "REPLACE")).alias("replace_chars"), F.sum(jobs).alias("n_jobs"))
    total = F.col("keep_chars") + F.col("replace_chars")
    return sums.withColumn("keep_ratio", F.round(F.when(total > 0, F.col("keep_chars") / total).otherwise(F.lit(1.0)), 6))


def plan_passages(segments: DataFrame, max_chars: int = 1800, skip_mode: str = "auto") -> DataFrame:
    """``plan`` of a translation: packs of whole segments, oversized ones in pieces of their own."""
    slim = segments.select("item_id", "seg_index", "seg_id", F.explode(F.array(needs_rewrite("text", "tag", "translate", skip_mode))).alias("dirty"), "text")
    routed = slim.groupBy("item_id").agg(F.count("*").alias("paragraphs"), F.sum(F.col("dirty").cast("bigint")).alias("dirty"))
    sent = pack_segments(slim.filter("dirty"), max_chars, ["seg_index", "seg_id"]).groupBy("item_id").agg(F.count("*").alias("n_jobs"), (F.max("pack_no") + 1).alias("packs"))
    return _totals(routed, sent)


def plan(segments: DataFrame, max_chars: int = 1800, mode: str = "polish", skip_mode: str = "auto") -> DataFrame:
    """(item_id, paragraphs, dirty, skipped, n_jobs, packs), a row a chapter and one with ``is_total`` 1."""
    if mode == "translate":
        return plan_passages(segments, max_chars, skip_mode)
    # what both counts need of a segment: whether it is sent, and its spans' costs
    jobs = job_array(F.col("program"))
    slim = F.transform(jobs, lambda j: F.struct(j["span_index"].alias("span_index"), job_chars(j["text"], j["before"], j["after"]).alias("cost")))
    planned = checkpointed(with_programs(segments, mode, skip_mode, every=True).select("item_id", "seg_index", "seg_id", slim.alias("jobs")))
    routed = planned.groupBy("item_id").agg(F.count("*").alias("paragraphs"), F.count("jobs").alias("dirty"))
    order = ["seg_index", "span_index", "seg_id"]
    packed = greedy_packs(planned.select("item_id", "seg_index", "seg_id", F.explode("jobs").alias("j")).select("item_id", "seg_index", "seg_id", "j.*"), "item_id", order, "cost", max_chars)
    sent = packed.groupBy("item_id").agg(F.count("*").alias("n_jobs"), (F.max("pack_no") + 1).alias("packs"))
    return _totals(routed, sent)


def _totals(routed: DataFrame, sent: DataFrame) -> DataFrame:
    rows = routed.join(sent, "item_id", "left").na.fill(0, ["n_jobs", "packs"])
    return rows.rollup("item_id").agg(F.grouping("item_id").cast("int").alias("is_total"), *[F.sum(c).alias(c) for c in ("paragraphs", "dirty", "n_jobs", "packs")]).withColumn("skipped", F.col("paragraphs") - F.col("dirty"))
