"""Reading what a rewriter answered: noise removed, numbered blocks, echoes trimmed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from galley.functions.text import WS, blank, let, lstrip, rstrip, strip

_LINES = r"\r\n|[\n\r\x{b}\x{c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
_HEAD = rf"(?i)^(?:REPLACE|KEEP(?: before| after)?)[{WS}]*:[{WS}]*"
_BARE_HEAD = rf"(?i)^(?:REPLACE|KEEP(?: before| after)?)[{WS}]*:?\z"
_BLOCK = rf"(?s)\[(\p{{Nd}}+)\][{WS}]*(.*?)(?=\n[{WS}]*\[\p{{Nd}}+\]|\z)"


def without_noise(raw: Column) -> Column:
    """Thinking blocks and code fences dropped."""
    t = F.regexp_replace(raw, r"(?is)<think(?:ing)?>.*?</think(?:ing)?>", "")
    return strip(F.regexp_replace(t, r"(?m)^```[^\n]*$\n?", ""))


def clean_block(block: Column) -> Column:
    """A block without headings, leaked instructions and labels inside."""
    lines = F.filter(F.transform(F.split(block, _LINES, -1), strip), lambda x: ~x.rlike(_BARE_HEAD))
    text = strip(F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, _HEAD, "")), "\n"))
    text = strip(F.regexp_replace(text, r"(?is)(?:\ndo not (?:add|remove|change|repeat)(?![\p{L}\p{N}_])|\(this is the correct format(?![\p{L}\p{N}_])).*\z", ""))
    return F.regexp_replace(strip(F.regexp_replace(text, rf"[{WS}]*\[\p{{Nd}}+\][{WS}]*", " ")), " +", " ")


def numbered_blocks(raw: Column, expected: Column) -> Column:
    """The ``expected`` blocks of an answer in the order of their labels, or null.

    The first block that is not empty counts for its label. One expected block may come
    without a label; more are taken by position only if no label fits at all.
    """

    def parse(text: Column) -> Column:
        pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(_BLOCK), F.lit(1)).alias("n"), F.regexp_extract_all(text, F.lit(_BLOCK), F.lit(2)).alias("body"))
        blocks = F.transform(pairs, lambda p: F.struct(p["n"].try_cast("int").alias("n"), clean_block(p["body"]).alias("body")))
        return let(F.filter(blocks, lambda b: (b["body"] != "") & (b["n"] >= 1) & (b["n"] <= expected)), lambda found: ladder(text, found))

    def ladder(text: Column, found: Column) -> Column:
        distinct = F.size(F.array_distinct(F.transform(found, lambda b: b["n"])))
        ordered = F.transform(F.sequence(F.lit(1), F.greatest(expected, F.lit(1))), lambda i: F.try_element_at(F.filter(found, lambda b: b["n"] == i), F.lit(1))["body"])
        lone = clean_block(F.regexp_replace(text, rf"^\[1\][{WS}]*", ""))
        by_place = F.filter(F.transform(F.split(text, rf"\n[{WS}]*\n", -1), clean_block), lambda b: b != "")
        return (
            F.when((expected == 1) & (F.size(found) > 0), F.array(F.element_at(found, 1)["body"]))
            .when((expected == 1) & (lone != ""), F.array(lone))
            .when((expected > 1) & (distinct == expected), ordered)
            .when((expected > 1) & (distinct == 0), let(by_place, lambda b: F.when(F.size(b) == expected, b)))
        )

    return let(F.regexp_replace(strip(raw), r"\*+\[(\p{Nd}+)\]\*+", "[$1]"), parse)


def trim_echo(output: Column, source: Column, before: Column, after: Column) -> Column:
    """The answer without the context it repeats; the source where it repeats the whole passage."""
    head = strip(F.regexp_replace(strip(before), r"^…+", ""))
    tail = strip(F.regexp_replace(strip(after), r"…+\z", ""))

    def trim(text: Column) -> Column:
        a = F.when((head != "") & F.startswith(text, head), lstrip(F.substring(text, F.length(head) + 1, F.length(text)))).otherwise(text)
        return let(a, lambda t: F.when((tail != "") & F.endswith(t, tail), rstrip(F.left(t, F.length(t) - F.length(tail)))).otherwise(t))

    def keep(text: Column) -> Column:
        whole = (strip(source) != "") & F.contains(text, strip(source)) & (F.length(text) > F.length(source) * 2.4)
        return F.when(whole, source).when(text != "", text).otherwise(strip(output))

    return let(let(strip(output), trim), keep)


def glossary_terms(raw: Column) -> Column:
    """Terms of a JSON answer (fences allowed) as an array; empty on any failure. Terms need source and target."""
    body = F.regexp_extract(F.regexp_replace(strip(raw), r"(?m)^```(?:json)?\s*|\s*```$", ""), r"(?s)\{.*\}", 0)
    parsed = F.from_json(body, "struct<terms:array<struct<source:string,target:string,type:string,notes:string>>>")["terms"]
    return F.coalesce(F.filter(parsed, lambda t: ~F.coalesce(blank(t["source"]), F.lit(True)) & ~F.coalesce(blank(t["target"]), F.lit(True))), F.array().cast("array<struct<source:string,target:string,type:string,notes:string>>"))
