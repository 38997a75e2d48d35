"""Text primitives as Column expressions: one definition of white space, letters and scripts for every operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode knows it, spelled out because Java's, DuckDB's and Python's classes differ.
WS = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: The same as a string of its signs, for trimming.
WS_SIGNS = "".join(map(chr, [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: A word's edge: no letter, digit or underscore on the other side.
EDGE_L, EDGE_R = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once even where lambdas use it many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(WS_SIGNS))


def lstrip(c: Column | str) -> Column:
    return F.ltrim(col(c), F.lit(WS_SIGNS))


def rstrip(c: Column | str) -> Column:
    return F.rtrim(col(c), F.lit(WS_SIGNS))


def squeeze(c: Column | str) -> Column:
    """Outer white space removed, inner runs one blank."""
    return F.regexp_replace(strip(c), rf"[{WS}]+", " ")


def count_in(c: Column | str, signs: str) -> Column:
    """How many characters of ``c`` are among ``signs`` (the inside of a character class)."""
    return F.length(F.regexp_replace(col(c), f"[^{signs}]+", ""))


def matches(c: Column | str, pattern: str) -> Column:
    return col(c).rlike(pattern)


def joined(parts: Column, sep: str = "") -> Column:
    return F.array_join(parts, sep)


def blank(c: Column | str) -> Column:
    return ~col(c).rlike(rf"[^{WS}]")


def stripped_at_least(c: Column | str, n: int) -> Column:
    """Whether ``c`` has ``n`` characters or more (n >= 2) without its outer white space."""
    return col(c).rlike(rf"(?s)[^{WS}].{{{n - 2},}}[^{WS}]")
