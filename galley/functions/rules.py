"""Signs of machine translation as a table of weighted phrases, and the scores built on it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from galley.functions.scripts import RANGES, foreign_share
from galley.functions.text import EDGE_L, EDGE_R, WS, col, let, strip

# A phrase in lower case that must occur, the expression it is part of, the weight, and whether it is whole words.
RULES = [
    ("eyes ", "eyes (flashed|gleamed|narrowed|shone)", 2, False),
    ("the corners of ", "the corners of (his|her|their) mouth", 2, False),
    ("could not help but", "could not help but", 2, False),
    ("cold air", "sucked in a (breath of )?cold air", 2, False),
    ("in the next moment", "in the next moment", 1, False),
    ("did not expect that", "did not expect that", 1, False),
    ("heaven-defying", "heaven-defying", 1, False),
    (" voice", "said (in a |with a )?(deep|cold|heavy) voice", 1, False),
    ("the youth", "the youth", 1, True),
    ("jindan", "jindan", 2, True),
    ("suddenly discovered", "suddenly discovered", 1, False),
    ("a look of ", r"a look of [^\n]{3,24}(flashed|appeared|crossed)", 1, False),
    ("this ", "this (one|daddy) will", 1, True),
    ("very much so", "very much so", 1, True),
    ("incontinently", "incontinently", 3, True),
    ("the the", "the the", 2, True),
    ("already was", "already was", 1, True),
    ("was very much", "was very much", 1, True),
]
#: Names of one trade that share a rule: any of them, once.
TRADE_NAMES = ("jindan", "yuan ying", "yuanying", "zhuji", "huashen", "lianqi")
PAGE_MARK = rf"(?iu)^[{WS}]*((page[{WS}]*)?\p{{Nd}}+([{WS}]*/[{WS}]*\p{{Nd}}+)?|copyright|contents|cover|title page)[{WS}]*\z"
LONE_SIGN = rf"(?s)^[{WS}]*.?[{WS}]*\z"
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
CODE_TAGS = ("pre", "code", "samp")
THRESHOLDS = {"off": 0, "none": 0, "auto": 1, "aggressive": 2}


def threshold(skip_mode: str) -> int:
    return THRESHOLDS.get(skip_mode, 1)


def is_boilerplate(text: Column | str) -> Column:
    """Page marks, titles of front matter, and whatever has no letter or a single sign; outer white space aside."""
    t = col(text)
    return ~t.rlike(r"\p{L}") | t.rlike(LONE_SIGN) | t.rlike(PAGE_MARK)


def _whole(phrase: str) -> str:
    return f"{EDGE_L}(?:{phrase}){EDGE_R}"


def artefact_weight(text: Column | str) -> Column:
    """The sum of the weights of the rules that occur; a fixed phrase is looked for before the expression."""

    def weigh(low: Column) -> Column:
        total = F.lit(0)
        for phrase, pattern, weight, whole in RULES:
            if phrase == "jindan":
                hit = reduce(lambda a, b: a | b, [F.contains(low, F.lit(n)) for n in TRADE_NAMES]) & low.rlike(_whole("|".join(TRADE_NAMES)))
            else:
                hit = F.contains(low, F.lit(phrase))
                hit = hit if phrase == pattern and not whole else hit & low.rlike(_whole(pattern) if whole else pattern)
            total = total + F.when(hit, weight).otherwise(0)
        return total

    return let(F.lower(col(text)), weigh)


def signals(text: Column | str, foreign: bool = False, artefacts: Column | None = None) -> Column:
    """What the scores of a text rest on, each told once: (boiler, weight, share).

    ``weight`` is that of Han signs and of the rules, 0 for boilerplate; ``share`` that of
    foreign letters where ``foreign`` is asked for. ``artefacts`` may stand for the rules' sum.
    """
    t = col(text)
    weight = F.when(t.rlike(f"[{RANGES['han']}]"), 3).otherwise(0) + (artefact_weight(t) if artefacts is None else artefacts)
    boiler = is_boilerplate(t)
    return F.struct(boiler.alias("boiler"), F.when(boiler, 0).otherwise(weight).alias("weight"), (foreign_share(t) if foreign else F.lit(0.0)).alias("share"))


def dirt_of(s: Column, mode: str = "polish", tag: Column | str | None = None, glossary_hit: Column | None = None) -> Column:
    """How much a text with the ``signals`` ``s`` looks machine translated: 0 for boilerplate, 10 for foreign text in translate mode."""
    score = s["weight"]
    if glossary_hit is not None:
        score = score + F.when(glossary_hit, 2).otherwise(0)
    if tag is not None:
        score = F.when(col(tag).isin(*HEADINGS), F.greatest(F.lit(0), score - 1)).otherwise(score)
    if mode == "translate":
        score = F.when(s["share"] >= 0.18, 10).otherwise(score)
    return F.when(s["boiler"], 0).otherwise(score)


def needs_of(s: Column, tag: Column | str, mode: str = "polish", skip_mode: str = "auto", glossary_hit: Column | None = None) -> Column:
    """Whether a segment with the ``signals`` ``s`` goes to the rewriter at all."""
    least = threshold(skip_mode)
    if least <= 0:
        wanted = F.lit(True)
    elif mode == "translate":
        wanted = (s["share"] >= 0.08) | (dirt_of(s, mode, tag, glossary_hit) >= 1)
    else:
        wanted = dirt_of(s, mode, tag, glossary_hit) >= least
    return F.coalesce(~col(tag).isin(*CODE_TAGS), F.lit(True)) & F.coalesce(~s["boiler"], F.lit(False)) & F.coalesce(wanted, F.lit(False))


def dirt(text: Column | str, mode: str = "polish", tag: Column | str | None = None, glossary_hit: Column | None = None) -> Column:
    """``dirt_of`` a text."""
    return let(signals(text, mode == "translate"), lambda s: dirt_of(s, mode, tag, glossary_hit))


def needs_rewrite(text: Column | str, tag: Column | str, mode: str = "polish", skip_mode: str = "auto", glossary_hit: Column | None = None) -> Column:
    """``needs_of`` a text. Null texts do not need the rewriter."""
    return let(signals(text, mode == "translate"), lambda s: needs_of(s, tag, mode, skip_mode, glossary_hit)) & col(text).isNotNull()


def wants(text: Column | str, wanted: Column | str) -> Column:
    """Whether ``text`` holds one of the folded glossary sources ``wanted`` (null for none)."""
    return let(F.lower(col(text)), lambda low: F.coalesce(F.exists(col(wanted), lambda w: F.contains(low, w)), F.lit(False)))


def wants_polish(text: Column | str, skip_mode: str = "auto") -> Column:
    """The caller's filter for single paragraphs: also leaves out a lone word under 80 characters."""
    t = strip(text)
    lone = ~t.rlike(r"[\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{3000}]") & (F.length(t) < 80)
    return F.coalesce((F.length(t) > 0) & ~is_boilerplate(text) & ~lone & (dirt(text) >= threshold(skip_mode)), F.lit(False))
