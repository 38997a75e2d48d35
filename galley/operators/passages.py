"""Whole passages: packs of segments that are rewritten in order, each told the end of the one before.

Packs of one chapter depend on each other, packs of different chapters do not: one
round asks the k-th pack of all chapters, so the rounds are as many as the longest
chapter has packs and each is relational and written before the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.functions.cost import answer_tokens
from galley.operators.answers import numbered_blocks, without_noise
from galley.operators.gate import paragraph_fits
from galley.operators.packs import Budget, pack_segments
from galley.operators.prompts import attempt, numbered, passage_user
from galley.operators.rounds import Rewriter
from galley.session import checkpointed

CARRY = 500


def carried(texts: Column) -> Column:
    """What the next pack is told of these texts: the last of their signs."""
    return F.right(F.array_join(texts, "\n\n"), F.lit(CARRY))


def passage_packs(segments: DataFrame, max_chars: int, order: list[str], group: str = "item_id", mode: str = "translate", num_ctx: int = 4096, budget: Budget | None = None) -> DataFrame:
    """(group, pack_no, chunk_id, n_jobs, numbered, max_tokens, items) of whole segments under a budget of characters."""
    b = budget or Budget(max_chars)
    rows = pack_segments(segments, b.max_chars, order, group, b.max_prompt, b.prefix, b.count)
    items = F.array_sort(F.collect_list(F.struct(*order, "piece_no", "text")))
    packs = rows.groupBy(group, "pack_no").agg(items.alias("items"))  # a pack is bounded by its budget
    at = lambda k: F.element_at("items", k)["seg_index"]
    n = F.size("items")
    texts = F.transform("items", lambda x: x["text"])
    chunk = F.concat(F.coalesce(F.col(group), F.lit("")), F.lit(":p"), F.col("pack_no"), F.lit(":"), at(1), F.lit("-"), at(-1), F.lit(":"), n)
    chars = F.aggregate(texts, F.lit(0), lambda a, t: a + F.length(t))
    return packs.select(group, "pack_no", chunk.alias("chunk_id"), n.alias("n_jobs"), numbered(texts).alias("numbered"), answer_tokens(chars, mode, num_ctx).alias("max_tokens"), "items")


def rewrite_passages(packs: DataFrame, rewriter: Rewriter, mode: str = "translate", retries: int = 2, group: str = "item_id", glossary: str = "", extra_style: str = "", known: DataFrame | None = None) -> DataFrame:
    """``packs`` with ``texts`` (a text an item) and ``accepted`` (items that passed).

    The first answer in which any item passes the length gate settles a pack, the other
    items keep their text; a pack that no attempt settles keeps all. Packs that ``known``
    (chunk_id, texts) has are not asked again, but tell the next what came before.
    """
    packs = checkpointed(packs)
    rounds = (packs.agg(F.max("pack_no")).first()[0] or 0) + 1
    done: list[DataFrame] = []
    carry = None
    sources = F.transform("items", lambda x: x["text"])
    for k in range(rounds):
        now = packs.filter(F.col("pack_no") == k)
        now = now.join(carry, group, "left") if carry is not None else now.withColumn("previous", F.lit(None).cast("string"))
        prompt = passage_user(F.col("numbered"), F.coalesce("glossary", F.lit(glossary)) if "glossary" in packs.columns else F.lit(glossary), F.coalesce("previous", F.lit("")), F.lit(extra_style), mode)
        pending = checkpointed(now.withColumn("prompt", prompt))
        settled: list[DataFrame] = []
        if known is not None:
            old = pending.join(known.select("chunk_id", "texts"), "chunk_id")
            settled.append(checkpointed(old.select(group, "pack_no", "chunk_id", "items", "texts", F.size("texts").alias("accepted"))))
            pending = checkpointed(pending.join(known.select("chunk_id"), "chunk_id", "left_anti"))
        for a in range(retries + 1):
            asked = pending.select("chunk_id", "n_jobs", attempt(F.col("prompt"), a).alias("prompt"), "max_tokens", F.lit(a).alias("attempt"), "items")
            answers = rewriter(asked).select("chunk_id", "raw")
            judged = pending.join(answers, "chunk_id").withColumn("blocks", numbered_blocks(without_noise(F.col("raw")), F.col("n_jobs")))
            pairs = F.transform(F.arrays_zip(sources.alias("s"), F.col("blocks").alias("b")), lambda p: F.struct(F.coalesce(paragraph_fits(p["s"], F.coalesce(p["b"], F.lit("")), mode), F.lit(False)).alias("ok"), p["s"].alias("s"), p["b"].alias("b")))
            judged = judged.withColumn("p", pairs).withColumn("accepted", F.size(F.filter("p", lambda x: x["ok"])))
            good = checkpointed(judged.filter("accepted > 0").withColumn("texts", F.transform("p", lambda x: F.when(x["ok"], x["b"]).otherwise(x["s"]))).select(group, "pack_no", "chunk_id", "items", "texts", "accepted"))
            settled.append(good)
            pending = checkpointed(pending.join(good.select("chunk_id"), "chunk_id", "left_anti"))
            if pending.isEmpty():
                break
        settled.append(pending.select(group, "pack_no", "chunk_id", "items", sources.alias("texts"), F.lit(0).alias("accepted")))
        this = settled[0]
        for part in settled[1:]:
            this = this.unionByName(part)
        done.append(this)
        carry = this.select(group, carried(F.col("texts")).alias("previous"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def assemble(rewritten: DataFrame, key: str = "seg_id") -> DataFrame:
    """(key, new_text): the pieces of each segment joined by line ends."""
    rows = rewritten.select(F.explode(F.arrays_zip("items", "texts")).alias("x")).select(F.col(f"x.items.{key}").alias(key), F.col("x.items.piece_no").alias("piece_no"), F.col("x.texts").alias("t"))
    ordered = F.array_sort(F.collect_list(F.struct("piece_no", "t")))
    return rows.groupBy(key).agg(F.array_join(F.transform(ordered, lambda r: r["t"]), "\n").alias("new_text"))
