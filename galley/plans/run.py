"""A whole run over segments: prepare, plan, ask only what is not finished, stitch, log."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.functions.rules import needs_rewrite
from galley.operators import checkpoints, glossary
from galley.operators.packs import Budget, span_packs
from galley.operators.passages import assemble, passage_packs, rewrite_passages
from galley.operators.programs import job_table, with_programs
from galley.operators.prompts import PASSAGE_SYSTEM, SPAN_SYSTEM, SPAN_TASK, STYLE, span_system
from galley.operators.rounds import Rewriter, rewrite, stitch
from galley.session import checkpointed


@dataclass(frozen=True)
class Options:
    """What shapes a run. ``draft`` turns segments into segments before planning, as a first translation does."""

    mode: str = "polish"
    skip_mode: str = "auto"
    max_chars: int = 1800
    num_ctx: int = 4096
    retries: int = 2
    by_tokens: bool = False
    style: str = ""
    draft: Callable[[DataFrame], DataFrame] | None = None


def prepare(segments: DataFrame, terms: DataFrame | None, options: Options) -> tuple[DataFrame, DataFrame | None]:
    """Segments with their book's terms put in, then drafted; and how often each term was used, counted before."""
    hits = None
    if terms is not None:
        put = glossary.substitute(segments, terms, "seg_id")
        hits = glossary.hit_totals(put)
        segments = segments.drop("text").join(put.select("seg_id", "text"), "seg_id")
    return (options.draft(segments) if options.draft else segments), hits


def _budget(options: Options, terms: DataFrame | None) -> Budget:
    """The budget of the run's prompts; the longest of the books' glossaries counts for all."""
    block = ""
    if options.by_tokens and terms is not None:
        longest = glossary.stable_block(terms).orderBy(F.desc(F.length("block"))).limit(1).collect()
        block = longest[0]["block"] if longest else ""
    begins = [PASSAGE_SYSTEM["translate"]] if options.mode == "translate" else [SPAN_SYSTEM, STYLE, options.style, block, SPAN_TASK]
    return Budget.of(options.max_chars, options.num_ctx, options.by_tokens, "\n\n".join(x for x in begins if x))


def glossary_of(packs: DataFrame, segments: DataFrame, terms: DataFrame | None) -> DataFrame:
    """``packs`` with ``glossary``: the substitutions of their book, the same bytes for all of its packs."""
    if terms is None:
        return packs
    books = segments.select("item_id", "book_id").filter("item_id IS NOT NULL").groupBy("item_id").agg(F.min("book_id").alias("book_id"))  # a row a chapter
    blocks = books.join(glossary.stable_block(terms), "book_id").select("item_id", F.col("block").alias("glossary"))
    return packs.join(blocks, "item_id", "left")


def run(segments: DataFrame, rewriter: Rewriter, options: Options = Options(), terms: DataFrame | None = None, done: DataFrame | None = None, name: str = "") -> dict[str, DataFrame | None]:
    """``segments`` (seg_id unique, book_id, item_id, seg_index, tag, text) through the whole flow.

    Gives ``segments`` (seg_id, text, new_text), ``log`` (one row what was sent: seg_id,
    part, before, after, chunk_id) and ``hits``. Packs that ``done`` (fingerprint, chunk_id,
    texts, line_no) holds for the run ``name`` are not asked again.
    """
    ready, hits = prepare(segments, terms, options)
    wanted = None
    if terms is not None:  # what the texts still hold of the glossary makes them dirtier
        ready, wanted = glossary.with_wanted(ready, terms, "seg_id"), "wanted"
    hit = None if wanted is None else F.col(wanted).isNotNull()
    budget = _budget(options, terms)
    if options.mode == "translate":
        dirty = ready.filter(needs_rewrite("text", "tag", "translate", options.skip_mode, hit))
        packs = glossary_of(passage_packs(dirty, options.max_chars, ["seg_index", "seg_id"], mode="translate", num_ctx=options.num_ctx, budget=budget), ready, terms)
        known = None if done is None else checkpoints.finished(packs, done, name)
        out = rewrite_passages(packs, rewriter, "translate", options.retries, extra_style=options.style, known=known)
        new = assemble(out)
        log = dirty.join(new, "seg_id").select("seg_id", F.lit(0).alias("part"), F.col("text").alias("before"), F.col("new_text").alias("after"), F.col("item_id").alias("chunk_id"))
    else:
        planned = checkpointed(with_programs(ready, "polish", options.skip_mode, wanted=wanted))  # read by packing and by stitching
        packs = glossary_of(span_packs(job_table(planned), options.max_chars, options.num_ctx, budget=budget), planned, terms)
        if terms is not None or options.style:
            block = F.coalesce("glossary", F.lit("")) if terms is not None else F.lit("")
            packs = packs.withColumn("system", span_system(block, F.lit(options.style))).drop("glossary")
        asked = packs if done is None else checkpoints.pending(packs, done, name)
        final = rewrite(asked, rewriter, options.retries, options.num_ctx).select("seg_id", "span_index", "source", "final", "accepted", "chunk_id")
        if done is not None:
            old = checkpoints.finished(packs, done, name).select("chunk_id", F.explode(F.arrays_zip("jobs", "texts")).alias("x"))
            text = F.coalesce("x.texts", "x.jobs.text", F.lit(""))
            final = final.unionByName(old.select("x.jobs.seg_id", "x.jobs.span_index", F.coalesce("x.jobs.text", F.lit("")).alias("source"), text.alias("final"), F.lit(True).alias("accepted"), "chunk_id"))
        new = stitch(planned, final).select("seg_id", "new_text")
        log = final.select("seg_id", F.col("span_index").alias("part"), F.col("source").alias("before"), F.col("final").alias("after"), "chunk_id")
    texts = ready.select("seg_id", "text").join(new, "seg_id", "left").withColumn("new_text", F.coalesce("new_text", "text"))
    return {"segments": texts, "log": log, "hits": hits}
