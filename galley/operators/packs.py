"""Packs: consecutive items of a chapter under a budget, and what is sent of them.

Packing is sequential by nature: an item opens a pack if it does not fit the one
before. The fold runs over sorted partitions and keeps one running size, so that a
chapter of any length is streamed and never gathered. Of each row the fold looks at key
and cost alone; other columns go through as the Arrow buffers they came in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from galley.functions.cost import answer_tokens_for_spans, estimated_tokens, job_chars, prompt_budget, tokens_of
from galley.functions.text import blank, let, strip


def greedy_packs(items: DataFrame, group: str, order: list[str], cost: str, budget: int, alone: str | None = None) -> DataFrame:
    """``items`` with ``pack_no``, from 0 within ``group`` in ``order``.

    An item whose ``cost`` exceeds the budget has a pack of its own; with ``alone``
    that flag decides instead. A null group is a group; ``order`` must be unique in it.
    """
    schema = to_arrow_schema(items.schema).append(pa.field("pack_no", pa.int64()))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pack, size, filled = object(), -1, 0, False
        for batch in batches:
            single = batch.column(alone).to_pylist() if alone else None
            out = []
            for i, (g, c) in enumerate(zip(batch.column(group).to_pylist(), batch.column(cost).to_pylist())):
                if g != key:
                    key, pack, size, filled = g, -1, 0, False
                if single[i] if single else c > budget:
                    pack, size, filled = pack + 1, 0, False
                else:
                    if not filled or size + c > budget:
                        pack, size, filled = pack + 1, 0, True
                    size += c
                out.append(pack)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], schema=schema)

    # nulls are kept apart from every value by sorting; equal groups share a partition
    return items.repartition(group).sortWithinPartitions(group, *order).mapInArrow(fold, from_arrow_schema(schema))


def span_prompt(text: Column, before: Column, after: Column, label: Column) -> Column:
    """One job as the rewriter reads it: its label, kept context, the span."""
    lines = [
        F.concat(F.lit("["), label.cast("string"), F.lit("]")),
        F.when(~blank(before), F.concat(F.lit("KEEP before (do not output):\n"), strip(before))),
        F.concat(F.lit("REPLACE:\n"), text),
        F.when(~blank(after), F.concat(F.lit("KEEP after (do not output):\n"), strip(after))),
    ]
    return F.concat_ws("\n", *lines)


def token_budget(max_prompt: int, prefix: int = 0) -> int:
    return max(32, max_prompt - max(0, prefix))


def job_costs(jobs: DataFrame, by_tokens: bool = False, count: Callable[[Column], Column] = estimated_tokens) -> DataFrame:
    """``jobs`` with ``cost``: characters, or tokens of the job as it is sent by ``count`` (an estimate, or a vectorised UDF)."""
    text, before, after = (F.coalesce(F.col(c), F.lit("")) for c in ("text", "before", "after"))
    if by_tokens:
        return jobs.withColumn("cost", count(span_prompt(text, before, after, F.lit(1))) + 2)
    return jobs.withColumn("cost", job_chars(text, before, after))


def pack_span_jobs(jobs: DataFrame, budget: int, order: list[str], group: str = "item_id", by_tokens: bool = False, count: Callable[[Column], Column] = estimated_tokens) -> DataFrame:
    """(group, order..., cost, pack_no) of ``jobs``."""
    return greedy_packs(job_costs(jobs, by_tokens, count).select(group, *order, "cost"), group, order, "cost", budget)


_SEPARATORS = ("\n\n", "\n", "。", "！", "？", ". ", "! ", "? ")


def split_oversized(text: Column, limit: int) -> Column:
    """Pieces of at most ``limit`` characters at the strongest separators, refilled greedily; white space around them is lost."""

    def refill(sign: str):
        def regroup(parts: Column) -> Column:
            glued = F.transform(parts, lambda p, i: F.when(i < F.size(parts) - 1, F.concat(p, F.lit(sign))).otherwise(p))
            start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buf"))

            def step(acc: Column, piece: Column) -> Column:
                over = (acc["buf"] != "") & (F.length(acc["buf"]) + F.length(piece) > limit)
                return F.struct(F.when(over, F.concat(acc["done"], F.array(acc["buf"]))).otherwise(acc["done"]).alias("done"), F.when(over, piece).otherwise(F.concat(acc["buf"], piece)).alias("buf"))

            return F.aggregate(glued, start, step, lambda acc: F.when(acc["buf"] != "", F.concat(acc["done"], F.array(acc["buf"]))).otherwise(acc["done"]))

        return lambda part: F.when(F.length(part) > limit, let(F.split(part, "\\Q" + sign + "\\E", -1), regroup)).otherwise(F.array(part))

    pieces = F.array(text)
    for sign in _SEPARATORS:
        pieces = F.flatten(F.transform(pieces, refill(sign)))
    cut = lambda p: F.when(F.length(p) > limit, F.transform(F.sequence(F.lit(1), F.length(p), F.lit(limit)), lambda i: F.substring(p, i, F.lit(limit)))).otherwise(F.array(p))
    pieces = F.filter(F.transform(F.flatten(F.transform(pieces, cut)), strip), lambda p: p != "")
    return F.when(F.length(text) > limit, pieces).otherwise(F.array(text))


def pack_segments(segments: DataFrame, max_chars: int, order: list[str], group: str = "item_id", max_prompt: int = 0, prefix: int = 0, count: Callable[[Column], Column] = estimated_tokens) -> DataFrame:
    """(group, order..., piece_no, text, pack_no): whole segments under the budget, each piece of an oversized one alone.

    The budget is in tokens by ``count`` where ``max_prompt`` is given, else in characters.
    """
    limit = max_chars if max_chars > 0 else 8000
    parts = segments.select(group, *order, split_oversized(F.coalesce("text", F.lit("")), limit).alias("parts"))
    rows = parts.select(group, *order, (F.size("parts") > 1).alias("alone"), F.posexplode("parts").alias("piece_no", "text"))
    budget = token_budget(max_prompt, prefix) if max_prompt else limit
    cost = count(F.concat(F.lit("[1]\n"), F.col("text"))) + 2 if max_prompt else F.length("text") + 8
    return greedy_packs(rows.withColumn("cost", cost.cast("int")), group, [*order, "piece_no"], "cost", budget, "alone")


@dataclass(frozen=True)
class Budget:
    """What a prompt may hold: characters, or tokens by ``count`` of which ``prefix`` go to what every prompt begins with."""

    max_chars: int = 1800
    max_prompt: int = 0
    prefix: int = 0
    count: Callable[[Column], Column] = estimated_tokens

    @classmethod
    def of(cls, max_chars: int, num_ctx: int, by_tokens: bool = False, begins: str = "", count: Callable[[Column], Column] = estimated_tokens, measure: Callable[[str], int] = tokens_of) -> Budget:
        """The budget of a run whose prompts begin with ``begins``; half of the context is left for answers."""
        return cls(max_chars, prompt_budget(num_ctx), measure(begins), count) if by_tokens else cls(max_chars)


def span_packs(jobs: DataFrame, max_chars: int = 1800, num_ctx: int = 4096, group: str = "item_id", budget: Budget | None = None) -> DataFrame:
    """One row a pack: (group, pack_no, chunk_id, n_jobs, prompt, max_tokens, jobs).

    A pack holds at most budget / 32 jobs, for each costs that much; its jobs are
    gathered in order and numbered from 1 in the prompt.
    """
    order = ["seg_index", "span_index", "seg_id"]
    b = budget or Budget(max_chars)
    costed = job_costs(jobs, b.max_prompt > 0, b.count).select(group, *order, "text", "before", "after", "cost")
    packed = greedy_packs(costed, group, order, "cost", token_budget(b.max_prompt, b.prefix) if b.max_prompt else b.max_chars)
    job = F.struct("seg_index", "span_index", "seg_id", "text", "before", "after")
    packs = packed.groupBy(group, "pack_no").agg(F.array_sort(F.collect_list(job)).alias("jobs"))
    first, last, n = F.element_at("jobs", 1), F.element_at("jobs", -1), F.size("jobs")
    chunk = F.concat(F.coalesce(F.col(group), F.lit("")), F.lit(":cd"), F.col("pack_no"), F.lit(":"), first["seg_index"], F.lit(":"), first["span_index"], F.lit("-"), last["seg_index"], F.lit(":"), last["span_index"], F.lit(":"), n)
    prompt = F.array_join(F.transform("jobs", lambda j, i: span_prompt(F.coalesce(j["text"], F.lit("")), F.coalesce(j["before"], F.lit("")), F.coalesce(j["after"], F.lit("")), i + 1)), "\n\n")
    chars = F.aggregate("jobs", F.lit(0), lambda a, j: a + F.coalesce(F.length(j["text"]), F.lit(0)))
    return packs.select(group, "pack_no", chunk.alias("chunk_id"), n.alias("n_jobs"), prompt.alias("prompt"), answer_tokens_for_spans(n, chars, num_ctx).alias("max_tokens"), "jobs")
