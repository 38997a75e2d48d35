"""Lossless sentence units of a paragraph, within its row: no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from galley.functions.text import WS, col, joined, let, stripped_at_least

MAX_UNIT, MIN_UNIT = 240, 12
_CLOSERS = "[\"'”’)]*"
_UNIT = rf"(?s).*?(?:\.{{3}}|…|(?<!\p{{Nd}})[.!?]|[。！？]){_CLOSERS}(?:[{WS}]+|\z)|.+\z"
#: Where an overlong unit may be divided, strongest first; the sign stays left.
_DIVIDERS = ("; ", " — ", " - ", ", ")


def sentence_units(text: Column | str) -> Column:
    """The text at its sentence ends; joined they are the text again. Empty for empty and null texts."""
    return F.coalesce(F.regexp_extract_all(col(text), F.lit(_UNIT), F.lit(0)), F.array().cast("array<string>"))


def _divider(sign: str):
    def kept(parts: Column) -> Column:
        return F.filter(F.transform(parts, lambda p, i: F.when(i < F.size(parts) - 1, F.concat(p, F.lit(sign))).otherwise(p)), lambda p: p != "")

    return lambda piece: F.when(F.length(piece) > MAX_UNIT, let(F.split(piece, "\\Q" + sign + "\\E", -1), kept)).otherwise(F.array(piece))


def _hard_cut(piece: Column) -> Column:
    cuts = F.transform(F.sequence(F.lit(1), F.length(piece), F.lit(MAX_UNIT)), lambda i: F.substring(piece, i, F.lit(MAX_UNIT)))
    return F.when(F.length(piece) > MAX_UNIT, cuts).otherwise(F.array(piece))


def split_long(units: Column) -> Column:
    """Units over 240 characters divided at weaker and weaker signs, at last by length."""
    for sign in _DIVIDERS:
        units = F.flatten(F.transform(units, _divider(sign)))
    return F.flatten(F.transform(units, _hard_cut))


def starts_unit(unit: Column) -> Column:
    """Whether a piece stands alone: long enough, or ended by a mark."""
    return stripped_at_least(unit, MIN_UNIT) | unit.rlike(rf"[.!?。！？]{_CLOSERS}[{WS}]*\z")


def runs(items: Column, starts: Column) -> Column:
    """``items`` joined into runs that begin at the 1-based positions ``starts``."""
    return let(items, lambda xs: let(starts, lambda at: F.transform(at, lambda s, k: joined(F.slice(xs, s, F.coalesce(F.try_element_at(at, k + 2), F.size(xs) + 1) - s)))))


def attach_short(units: Column) -> Column:
    """Short pieces without a final mark glued to the unit before; the first always stands."""

    def glue(xs: Column) -> Column:
        at = F.filter(F.transform(xs, lambda u, i: F.when((i == 0) | starts_unit(u), i + 1).otherwise(0)), lambda i: i > 0)
        return runs(xs, at)

    return let(units, glue)


def units(text: Column | str) -> Column:
    """The units of a paragraph: sentences, long ones divided, fragments attached."""
    return attach_short(split_long(sentence_units(text)))
