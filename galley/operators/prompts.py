"""What is said to the rewriter around the packs; the wording is this library's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from galley.functions.text import blank

SPAN_SYSTEM = "You correct English that a machine translated. Rewrite the REPLACE parts only; names, meaning and tone stay. Answer with the numbered blocks and no other words."
SPAN_TASK = "Rewrite each REPLACE part. Give only its new wording, under its number. Leave out the KEEP parts."
PASSAGE_SYSTEM = {
    "polish": "You correct English that a machine translated. Names, meaning and tone stay. Answer with the numbered blocks and no other words.",
    "translate": "You translate into natural English. Names, meaning and tone stay. Answer with the numbered blocks and no other words.",
}
STYLE = "Stay within the vocabulary and register of the text."
NUDGE = "The last answer could not be used. Answer with every number once and the full wording under it."


def _sections(*parts: Column) -> Column:
    """The parts that are not blank, a blank line between them."""
    return F.concat_ws("\n\n", *[F.when(~blank(p), p) for p in parts])


def style(extra: Column) -> Column:
    return F.concat_ws("\n", F.lit(STYLE), F.when(~blank(extra), F.trim(extra)))


def span_system(glossary: Column, extra_style: Column) -> Column:
    """The same bytes for every pack of a run, so that a server can keep its prefix."""
    return _sections(F.lit(SPAN_SYSTEM), F.concat(F.lit("Style notes:\n"), style(extra_style)), glossary)


def span_user(formatted_jobs: Column) -> Column:
    return F.concat(F.lit(SPAN_TASK + "\n\nSpans:\n\n"), formatted_jobs)


def passage_user(numbered: Column, glossary: Column, previous: Column, extra_style: Column, mode: str) -> Column:
    """Glossary, style, the text before (context only), the task and the numbered passages."""
    before = F.when(~blank(previous), F.concat(F.lit("What was rewritten before, for context only:\n"), previous)).otherwise("")
    task = F.concat(F.lit(f"{'Polish' if mode == 'polish' else 'Translate'} these passages under their numbers:\n\n"), numbered)
    return _sections(glossary, F.concat(F.lit("Style notes:\n"), style(extra_style)), before, task)


def numbered(texts: Column) -> Column:
    """Passages as numbered blocks."""
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("]\n"), t)), "\n\n")


def attempt(prompt: Column, attempt_no: int) -> Column:
    return prompt if attempt_no == 0 else F.concat(prompt, F.lit("\n\n" + NUDGE))
