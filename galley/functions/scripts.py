"""Which scripts a text is written in, and what follows for mode and language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from galley.functions.text import col, count_in, let

# Code point ranges of the scripts told apart.
RANGES = {
    "han": r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}",
    "kana": r"\x{3040}-\x{30ff}",
    "hangul": r"\x{1100}-\x{11ff}\x{ac00}-\x{d7af}",
    "arabic": r"\x{600}-\x{6ff}",
    "cyrillic": r"\x{400}-\x{4ff}",
    "devanagari": r"\x{900}-\x{97f}",
    "thai": r"\x{e00}-\x{e7f}",
    "latin": "A-Za-z",
}
FOREIGN = "".join(v for k, v in RANGES.items() if k != "latin")
# Source languages by script, in the order in which ties are decided.
SOURCE_LANGUAGE = [("kana", "jpn_Jpan"), ("hangul", "kor_Hang"), ("han", "zho_Hans"), ("arabic", "arb_Arab"), ("cyrillic", "rus_Cyrl"), ("devanagari", "hin_Deva"), ("thai", "tha_Thai")]
TRANSLATE_SHARE = 0.28


def script_count(text: Column | str, script: str) -> Column:
    return count_in(text, RANGES[script])


def _share(part: Column, latin: Column) -> Column:
    """Part of both, each counted once."""
    return let(F.struct(part.alias("part"), latin.alias("latin")), lambda n: F.when(n["part"] + n["latin"] > 0, n["part"] / (n["part"] + n["latin"])).otherwise(F.lit(0.0)))


def han_share(text: Column | str) -> Column:
    return F.coalesce(_share(script_count(text, "han"), script_count(text, "latin")), F.lit(0.0))


def foreign_count(text: Column | str) -> Column:
    return count_in(text, FOREIGN)


def foreign_share(text: Column | str) -> Column:
    """Letters of other scripts against ASCII letters; accented Latin letters are neither.

    Most texts have none, which one look tells; only the others are counted.
    """
    share = _share(foreign_count(text), script_count(text, "latin"))
    return F.when(F.coalesce(col(text).rlike(f"[{FOREIGN}]"), F.lit(False)), share).otherwise(F.lit(0.0))


def mode(text: Column | str) -> Column:
    return F.when(foreign_share(text) >= TRANSLATE_SHARE, "translate").otherwise("polish")


def source_language(text: Column | str) -> Column:
    """The script with most characters; the first of equals; Chinese where there is none."""
    counts = F.array(*[F.coalesce(script_count(col(text), s), F.lit(0)) for s, _ in SOURCE_LANGUAGE])
    names = F.array(*[F.lit(n) for _, n in SOURCE_LANGUAGE])
    return let(counts, lambda n: F.when(F.array_max(n) > 0, F.element_at(names, F.array_position(n, F.array_max(n)).cast("int"))).otherwise("zho_Hans"))
