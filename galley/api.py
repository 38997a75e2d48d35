"""The short way in: a table of paragraphs polished, a folder of documents planned and rewritten."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.functions import scripts
from galley.functions.rules import wants_polish
from galley.operators import samples
from galley.operators.packs import span_packs
from galley.operators.programs import job_table, with_programs
from galley.operators.rounds import Rewriter, rewrite, rule_based, stitch
from galley.plans.report import plan
from galley.plans.run import Options, run
from galley.session import checkpointed
from galley.sources.reader import read_files, read_folder, selectable
from galley.sources.sinks import write_document, write_files


def polish(df: DataFrame, key: str, text: str, rewriter: Rewriter = rule_based, max_chars: int = 1800, retries: int = 2, prefilter: bool = True) -> DataFrame:
    """``df``'s rows as (key, text, new_text): every paragraph a chapter of its own, its packs never shared.

    ``key`` is unique. With ``prefilter`` only paragraphs that look machine translated are
    sent; without it each that is no boilerplate sends at least one unit. Null, empty and
    unsent paragraphs keep their text.
    """
    rows = df.select(F.col(key).cast("string").alias("item_id"), F.col(key).alias("seg_id"), F.lit(0).alias("seg_index"), F.lit("p").alias("tag"), F.col(text).alias("text"))
    sent = rows.filter(wants_polish("text")) if prefilter else rows
    planned = checkpointed(with_programs(sent, skip_mode="auto" if prefilter else "off"))
    done = stitch(planned, rewrite(span_packs(job_table(planned), max_chars), rewriter, retries))
    out = rows.select("seg_id", "text").join(done.select("seg_id", "new_text"), "seg_id", "left")
    return out.select(F.col("seg_id").alias(key), "text", F.coalesce("new_text", "text").alias("new_text"))


def plan_folder(spark: SparkSession, path: str, max_chars: int = 1800, skip_mode: str = "auto") -> DataFrame:
    """What a run over the documents below ``path`` would send, by chapter and in all."""
    return plan(_keyed(selectable(read_folder(spark, path))), max_chars, skip_mode=skip_mode)


def rewrite_folder(spark: SparkSession, path: str, rewriter: Rewriter = rule_based, max_chars: int = 1800, retries: int = 2, skip_mode: str = "auto", mode: str = "polish", terms: DataFrame | None = None) -> DataFrame:
    """Segments of the documents below ``path``, with ``new_text``; ``terms`` (ord, source, target, kind, notes) hold for all."""
    return rewrite_segments(read_folder(spark, path), rewriter, max_chars, retries, skip_mode, mode, terms)


def rewrite_segments(segments: DataFrame, rewriter: Rewriter = rule_based, max_chars: int = 1800, retries: int = 2, skip_mode: str = "auto", mode: str = "polish", terms: DataFrame | None = None) -> DataFrame:
    """``segments`` as readers give them, with ``new_text``; those of skipped chapters keep their text. Mode `auto` is told for each document by its scripts."""
    rows = checkpointed(_keyed(segments))  # what is read once is asked about once
    if mode == "auto":
        foreign = detected_modes(rows).filter("mode = 'translate'").select("doc_id")
        how = {"polish": "left_anti", "translate": "left_semi"}
        return reduce(DataFrame.unionByName, [_rewritten(rows.join(foreign, "doc_id", h), rewriter, max_chars, retries, skip_mode, m, terms) for m, h in how.items()])
    return _rewritten(rows, rewriter, max_chars, retries, skip_mode, mode, terms)


def detected_modes(rows: DataFrame) -> DataFrame:
    """(doc_id, mode) of documents by the scripts of their beginnings; one without text has none."""
    text = samples.joined_parts(samples.sample_parts(rows, "doc_id", ["chapter_ord", "seg_index", "seg_id"]), "doc_id")
    return text.select("doc_id", scripts.mode("text").alias("mode"))


def _rewritten(rows: DataFrame, rewriter: Rewriter, max_chars: int, retries: int, skip_mode: str, mode: str, terms: DataFrame | None) -> DataFrame:
    sent = selectable(rows).select("seg_id", F.lit("").alias("book_id"), "item_id", "seg_index", "tag", "text")
    own = None if terms is None else terms.withColumn("book_id", F.lit(""))
    done = run(sent, rewriter, Options(mode=mode, skip_mode=skip_mode, max_chars=max_chars, retries=retries), own)["segments"]
    out = rows.join(done.select("seg_id", "new_text"), "seg_id", "left")
    return out.withColumn("new_text", F.coalesce("new_text", "text"))


def rewrite_documents(spark: SparkSession, path: str, out: str, fmt: str | None = None, **how) -> DataFrame:
    """The documents below ``path`` rewritten and written to the folder ``out``, each in its own format or in ``fmt``: (name, n_bytes)."""
    files = read_files(spark, path)
    done = rewrite_segments(read_folder(spark, path), **how)
    texts = done.withColumn("item_id", F.col("own_item")).withColumn("text", F.col("new_text"))
    return write_files(write_document(files, texts, fmt, how.get("mode", "polish")), out)


def _keyed(segments: DataFrame) -> DataFrame:
    """Segments with ids of their own and chapters that are unique over documents; ``own_item`` is the chapter's id in its document."""
    item = F.concat_ws("/", F.col("doc_id").cast("string"), "item_id")
    return segments.withColumn("own_item", F.col("item_id")).withColumn("item_id", item).withColumn("seg_id", F.xxhash64("item_id", "seg_index"))
