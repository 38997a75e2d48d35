"""Asking the rewriter: rounds of attempts, halving of packs in which nothing passed, stitching.

The rewriter is the only opaque stage: a function from packs (chunk_id, prompt,
n_jobs, max_tokens, jobs, attempt) to answers (chunk_id, attempt, raw). Its answers
are written before anything reads them, so that a lost executor asks nothing again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.functions.cost import answer_tokens_for_spans
from galley.operators.answers import numbered_blocks, trim_echo, without_noise
from galley.operators.gate import rejection
from galley.operators.packs import span_prompt
from galley.operators.programs import stitched
from galley.operators.prompts import attempt, span_user
from galley.session import checkpointed

Rewriter = Callable[[DataFrame], DataFrame]


def decisions(packs: DataFrame, answers: DataFrame) -> DataFrame:
    """One row a job and answer: (chunk_id, attempt, job_pos, seg_id, span_index, source, candidate, reason, accepted)."""
    met = packs.select("chunk_id", "n_jobs", "jobs").join(answers.select("chunk_id", "attempt", "raw"), "chunk_id")
    met = met.withColumn("blocks", numbered_blocks(without_noise(F.col("raw")), F.col("n_jobs")))
    rows = met.select("chunk_id", "attempt", F.posexplode("jobs").alias("job_pos", "j"), "blocks").withColumn("block", F.try_element_at("blocks", F.col("job_pos") + 1))
    source = F.coalesce(F.col("j.text"), F.lit(""))
    context = lambda c: F.coalesce(F.col(f"j.{c}"), F.lit(""))
    candidate = trim_echo(F.col("block"), source, context("before"), context("after"))
    rows = rows.select("chunk_id", "attempt", "job_pos", F.col("j.seg_id").alias("seg_id"), F.col("j.span_index").alias("span_index"), source.alias("source"), F.when(F.col("block").isNotNull(), candidate).alias("candidate"))
    reason = F.when(F.col("candidate").isNull(), "unparsed").otherwise(rejection(F.col("source"), F.col("candidate")))
    return rows.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def _halves(packs: DataFrame, num_ctx: int) -> DataFrame:
    """Two packs for each, the first with half of the jobs rounded down."""
    half = F.floor(F.col("n_jobs") / 2).cast("int")
    parts = F.array(F.struct(F.lit(0).alias("k"), F.slice("jobs", F.lit(1), half).alias("jobs")), F.struct(F.lit(1).alias("k"), F.slice("jobs", half + 1, F.col("n_jobs")).alias("jobs")))
    out = packs.select("chunk_id", F.explode(parts).alias("p"), *_system(packs)).select(F.concat("chunk_id", F.lit("/"), F.col("p.k")).alias("chunk_id"), F.col("p.jobs").alias("jobs"), *_system(packs))
    n = F.size("jobs")
    empty = F.lit("")
    prompt = F.array_join(F.transform("jobs", lambda j, i: span_prompt(F.coalesce(j["text"], empty), F.coalesce(j["before"], empty), F.coalesce(j["after"], empty), i + 1)), "\n\n")
    chars = F.aggregate("jobs", F.lit(0), lambda a, j: a + F.coalesce(F.length(j["text"]), F.lit(0)))
    return out.select("chunk_id", n.alias("n_jobs"), prompt.alias("prompt"), answer_tokens_for_spans(n, chars, num_ctx).alias("max_tokens"), "jobs", *_system(packs))


def _system(packs: DataFrame) -> list[str]:
    return ["system"] if "system" in packs.columns else []


def rewrite(packs: DataFrame, rewriter: Rewriter, retries: int = 2, num_ctx: int = 4096) -> DataFrame:
    """Final decisions of every job of ``packs``: (seg_id, span_index, source, final, accepted, reason, chunk_id, attempt).

    A pack is settled by its first answer in which any job passes; the jobs that fail in
    it keep their source. A column ``system`` of ``packs`` goes to the rewriter with them. A pack in which no attempt settles anything is halved; a single
    job that never passes keeps its source. Halves are smaller, so that the rounds end
    when the largest pack has come down to single jobs.
    """
    cols = ["chunk_id", "n_jobs", "prompt", "max_tokens", "jobs", *_system(packs)]
    pending, settled = checkpointed(packs.select(*cols)), []
    while True:
        for k in range(retries + 1):
            asked = pending.withColumn("prompt", attempt(span_user(F.col("prompt")), k)).withColumn("attempt", F.lit(k))
            judged = checkpointed(decisions(pending, rewriter(asked)))
            good = judged.filter("accepted").select("chunk_id").distinct()
            settled.append(judged.join(good, "chunk_id", "left_semi"))
            pending = checkpointed(pending.join(good, "chunk_id", "left_anti"))
            if pending.isEmpty():
                break
        lone = pending.filter("n_jobs <= 1").select("chunk_id", F.explode("jobs").alias("j"))
        kept = lone.select("chunk_id", F.lit(retries).alias("attempt"), F.lit(0).alias("job_pos"), "j.seg_id", "j.span_index", F.coalesce("j.text", F.lit("")).alias("source"), F.lit(None).cast("string").alias("candidate"), F.lit("exhausted").alias("reason"), F.lit(False).alias("accepted"))
        settled.append(kept)
        pending = checkpointed(_halves(pending.filter("n_jobs > 1"), num_ctx))
        if pending.isEmpty():
            break
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out.select("seg_id", "span_index", "source", F.when(F.col("accepted"), F.col("candidate")).otherwise(F.col("source")).alias("final"), "accepted", "reason", "chunk_id", "attempt")


def replay(answers: DataFrame) -> Rewriter:
    """A rewriter that looks its answers up in a table (chunk_id, attempt, raw)."""
    return lambda packs: answers.join(packs.select("chunk_id", "attempt"), ["chunk_id", "attempt"], "left_semi")


# Replacements of the rule-based rewriter.
PLAIN = [("the the ", "the "), ("could not help but smile", "smiled"), ("very much so ", ""), ("sucked in a cold breath of air", "gasped"), ("In the next instant ", "Then "), ("suddenly discovered", "found"), ("already was", "was already"), ("did not expect that", "had not expected that")]


def plain_words(text: Column) -> Column:
    for old, new in PLAIN:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def rule_based(packs: DataFrame) -> DataFrame:
    """A rewriter without a model: stock phrases in plainer words, in spans and in passages."""
    blocks = F.transform("items" if "items" in packs.columns else "jobs", lambda j, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("]\n"), plain_words(F.coalesce(j["text"], F.lit("")))))
    return packs.select("chunk_id", "attempt", F.array_join(blocks, "\n\n").alias("raw"))


def stitch(programs: DataFrame, final: DataFrame, key: str = "seg_id", preserve_edges: bool = False) -> DataFrame:
    """``programs`` with ``new_text``: accepted rewrites in place of their spans.

    A rewrite has lost its outer white space and is set in as it is; ``preserve_edges``
    gives it the span's white space back.
    """
    ws = r"[\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{3000}]"
    text = F.col("final")
    if preserve_edges:
        text = F.when(F.col("accepted"), F.concat(F.regexp_extract("source", rf"^{ws}*", 0), F.col("final"), F.regexp_extract("source", rf"{ws}*\z", 0))).otherwise(F.col("final"))
    # at most one entry a span of the paragraph
    new = final.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("span_index", text.alias("t")))).alias("new"))
    joined = programs.join(new, key, "left")
    none = F.create_map().cast("map<int,string>")
    return joined.withColumn("new_text", stitched(F.col("program"), F.coalesce("new", none))).drop("new")
