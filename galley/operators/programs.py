"""Edit programs: which spans of a paragraph are kept and which are rewritten.

Everything happens in the paragraph's own row on short arrays; a program is an
array of (kind, text) and its texts join to the paragraph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.functions.rules import HEADINGS, artefact_weight, dirt_of, needs_of, signals, threshold, wants
from galley.functions.text import col, joined, let, strip, stripped_at_least
from galley.operators.units import units

MIN_BRIDGE, MIN_KEEP, CONTEXT = 48, 0.22, 280


def span(kind: Column, text: Column) -> Column:
    return F.struct(kind.alias("kind"), text.alias("text"))


def whole(text: Column, kind: str = "REPLACE") -> Column:
    return F.array(span(F.lit(kind), text))


def coalesce(spans: Column) -> Column:
    """Neighbours of one kind joined."""

    def join(xs: Column) -> Column:
        first = F.filter(F.transform(xs, lambda x, i: F.when((i == 0) | (x["kind"] != F.coalesce(F.try_element_at(xs, i)["kind"], F.lit(""))), i + 1).otherwise(0)), lambda i: i > 0)
        texts = F.transform(xs, lambda x: x["text"])
        return let(first, lambda at: let(texts, lambda ts: F.transform(at, lambda s, k: span(xs[s - 1]["kind"], joined(F.slice(ts, s, F.coalesce(F.try_element_at(at, k + 2), F.size(xs) + 1) - s))))))

    return let(spans, join)


def absorb_bridges(spans: Column, least: int = MIN_BRIDGE) -> Column:
    """Short kept runs between two rewritten ones are rewritten too.

    After joining neighbours a kept run inside has rewritten runs on both sides, and
    flipping one never shortens another: a single pass is the fixpoint.
    """

    def flip(xs: Column) -> Column:
        inner = lambda i: (i > 0) & (i < F.size(xs) - 1)
        return F.transform(xs, lambda x, i: span(F.when(inner(i) & ~stripped_at_least(x["text"], least), F.lit("REPLACE")).otherwise(x["kind"]), x["text"]))

    return coalesce(let(coalesce(spans), flip))


def chars(spans: Column, kind: str) -> Column:
    return F.aggregate(spans, F.lit(0), lambda n, x: n + F.when(x["kind"] == kind, F.length(x["text"])).otherwise(0))


def keep_ratio(spans: Column) -> Column:
    """Kept characters against all; 1 for an empty program."""
    keep, replace = chars(spans, "KEEP"), chars(spans, "REPLACE")
    return F.when(keep + replace > 0, keep / (keep + replace)).otherwise(F.lit(1.0))


def edit_program(text: Column | str, tag: Column | str, mode: str = "polish", skip_mode: str = "auto", force_dirty: bool = False, wanted: Column | str | None = None, plain: Column | None = None) -> Column:
    """The program of a paragraph.

    An empty or null text is one empty kept span. A heading is one unit. With skipping
    off, or ``force_dirty`` and a single unit, a clean text is rewritten whole; with
    ``force_dirty`` and more units the first of the dirtiest is. A program that keeps
    less than 22 % is rewritten whole. A unit that holds one of the glossary sources
    ``wanted`` is dirtier by 2. ``plain`` tells of paragraphs that no rule applies to:
    no unit of theirs is looked through again.
    """
    text, tag = col(text), col(tag)
    least = max(1, threshold(skip_mode))
    parts = F.when(tag.isin(*HEADINGS), F.array(text)).otherwise(units(text))

    def score(u: Column) -> Column:
        weight = None if plain is None else F.when(plain, 0).otherwise(artefact_weight(u))
        hit = None if wanted is None else wants(u, wanted)
        return let(signals(u, mode == "translate", weight), lambda s: dirt_of(s, mode, tag, hit))

    scored = F.transform(parts, lambda u: F.struct(u.alias("text"), score(u).alias("score")))

    def label(xs: Column) -> Column:
        best = F.array_position(F.transform(xs, lambda x: x["score"]), F.array_max(F.transform(xs, lambda x: x["score"])))
        forced = ~F.exists(xs, lambda x: x["score"] >= least) & F.lit(force_dirty)
        spans = F.transform(xs, lambda x, i: span(F.when((x["score"] >= least) | forced & (i + 1 == best), F.lit("REPLACE")).otherwise(F.lit("KEEP")), x["text"]))
        clean = ~F.exists(xs, lambda x: x["score"] >= least)
        if threshold(skip_mode) <= 0:
            return F.when(clean, whole(text)).otherwise(absorb_bridges(spans))
        if force_dirty:
            return F.when(clean & (F.size(xs) <= 1), whole(text)).otherwise(absorb_bridges(spans))
        return absorb_bridges(spans)

    program = let(let(scored, label), lambda p: F.when((chars(p, "REPLACE") > 0) & (keep_ratio(p) < MIN_KEEP), whole(text)).otherwise(p))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, whole(F.lit(""), "KEEP")).otherwise(program)


def clip(text: Column, tail: bool, limit: int = CONTEXT) -> Column:
    """Context of at most ``limit`` characters, with an ellipsis on the side that was cut."""
    s = strip(text)
    short = F.concat(F.lit("…"), F.right(s, F.lit(limit))) if tail else F.concat(F.left(s, F.lit(limit)), F.lit("…"))
    return F.when(F.length(s) <= limit, s).otherwise(short)


def with_programs(segments: DataFrame, mode: str = "polish", skip_mode: str = "auto", force_dirty: bool = True, wanted: str | None = None, every: bool = False) -> DataFrame:
    """The segments that need the rewriter, each with its ``program``; with ``every`` all, the program of the others null.

    A paragraph is looked through once: what routes it also tells which of its units
    are worth another look. ``wanted`` names a column of glossary sources that occur in it.
    """

    def planned(w: Column) -> Column:
        hit = None if wanted is None else F.size(F.coalesce(F.col(wanted), F.array().cast("array<string>"))) > 0
        s = signals("text", mode == "translate", w)
        program = edit_program("text", "tag", mode, skip_mode, force_dirty, wanted, w == 0)
        return let(s, lambda x: F.when(F.col("text").isNotNull() & needs_of(x, "tag", mode, skip_mode, hit), program))

    # a generator keeps the optimiser from evaluating the program once more for a filter on it
    rows = segments.withColumn("program", F.explode(F.array(let(artefact_weight("text"), planned))))
    return rows if every else rows.filter("program IS NOT NULL")


def span_table(programs: DataFrame) -> DataFrame:
    """One row a span, numbered from 0 within its segment."""
    rest = [c for c in programs.columns if c not in ("program", "text", "kind", "span_index")]
    return programs.select(*rest, F.posexplode("program").alias("span_index", "s")).select(*rest, "span_index", "s.kind", "s.text")


def job_array(program: Column) -> Column:
    """The rewritten spans of a program as (span_index, kind, text, before, after), with the kept neighbours as clipped context ("" where there is none)."""

    def jobs(xs: Column) -> Column:
        near = lambda at, tail: F.coalesce(F.when(F.try_element_at(xs, at)["kind"] == "KEEP", clip(F.try_element_at(xs, at)["text"], tail)), F.lit(""))
        every = F.transform(xs, lambda x, i: F.struct(i.alias("span_index"), x["kind"].alias("kind"), x["text"].alias("text"), F.when(i > 0, near(F.greatest(i, F.lit(1)), True)).otherwise("").alias("before"), near(i + 2, False).alias("after")))
        return F.filter(every, lambda x: x["kind"] == "REPLACE")

    return F.when(program.isNotNull(), let(program, jobs))


def job_table(programs: DataFrame) -> DataFrame:
    """One row a rewritten span: ``job_array`` as rows."""
    rest = [c for c in programs.columns if c not in ("program", "text", "kind", "span_index", "before", "after")]
    out = programs.select(*rest, F.explode(job_array(F.col("program"))).alias("j"))
    return out.select(*rest, "j.span_index", "j.text", "j.before", "j.after")


def stitched(program: Column, replacements: Column) -> Column:
    """The text again, with ``replacements`` {span_index: text} in place of rewritten spans."""
    return joined(F.transform(program, lambda x, i: F.when(x["kind"] == "KEEP", x["text"]).otherwise(F.coalesce(replacements[i], x["text"]))))
