"""Sizes and budgets of prompts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from galley.functions.scripts import FOREIGN, foreign_count
from galley.functions.text import col


_FOREIGN = re.compile("[" + re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: chr(int(m[1], 16)), FOREIGN) + "]")


def estimated_tokens(text: Column | str) -> Column:
    """Tokens a chat model's vocabulary would take: about one a foreign sign, one per 2.6 others."""
    t = F.coalesce(col(text), F.lit(""))
    foreign = foreign_count(t)
    return F.when(F.length(t) == 0, 0).otherwise(F.greatest(F.lit(1), (foreign * F.lit(1.08).cast("double") + (F.length(t) - foreign) / F.lit(2.6).cast("double")).cast("int") + 1))


def tokens_of(text: str) -> int:
    """``estimated_tokens`` of a text at hand."""
    foreign = len(_FOREIGN.findall(text))
    return max(1, int(foreign * 1.08 + (len(text) - foreign) / 2.6) + 1) if text else 0


def prompt_budget(num_ctx: int) -> int:
    return max(256, num_ctx // 2)


def job_chars(text: Column | str, before: Column | str, after: Column | str) -> Column:
    n = lambda c: F.coalesce(F.length(col(c)), F.lit(0))
    return n(text) + n(before) + n(after) + 32


def answer_tokens(chars: Column, mode: str, num_ctx: int, tokens: Column | None = None) -> Column:
    """Room for the answer to a pack of passages."""
    far = mode == "translate"
    if tokens is not None:
        estimate = (tokens * F.lit(1.2 if far else 1.1)).cast("int") + 24
    else:
        estimate = (chars * F.lit(1.1 if far else 0.55)).cast("int") + 80
    return F.greatest(F.lit(96), F.least(estimate, F.lit(min(max(128, num_ctx // 2), 3072))))


def answer_tokens_for_spans(n_jobs: Column, chars: Column, num_ctx: int, tokens: Column | None = None) -> Column:
    """Room for the answer to a pack of span jobs; the floor of 48 a job wins over the cap."""
    n = F.greatest(F.lit(1), n_jobs)
    estimate = (tokens * F.lit(1.35)).cast("int") + n * 24 if tokens is not None else (chars * F.lit(0.85)).cast("int") + n * 32
    return F.greatest(n * 48, F.least(estimate, F.lit(min(max(128, num_ctx // 2), 2048))))
