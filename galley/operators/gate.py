"""The acceptance gate: whether a rewrite is faithful and complete, and if not, why.

The tests are tried in order and the first that fails is the reason.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from galley.functions.text import EDGE_L, EDGE_R, WS, let, rstrip, squeeze, strip

# Function words.
STOPWORDS = """
a an and are as at be been but by did do does for from had has have he her him his if in into is it its just me my no not of on or
out said she so than that the their them then there these they this those to up us was we were what when which who with you your
""".split()
# Contractions that end no sentence.
DANGLING = ["i'll", "we'll", "he'd", "she'd", "it's"]

# What an answer lets slip of its instructions, names of several words, quoted Han, words.
_LEAK = (
    r"(?i)\[(?:\p{Nd}+|n)\]|KEEP (?:before|after)|(?:\A|\n)[" + WS + r"]*REPLACE[" + WS + r"]*:"
    rf"|{EDGE_L}do not (?:add|remove|change|repeat|invent){EDGE_R}|{EDGE_L}this is the correct format{EDGE_R}|{EDGE_L}only the replace text{EDGE_R}|{EDGE_L}keep the same \[n\]"
)
_NAME = rf"{EDGE_L}[A-Z][a-z]+(?:[{WS}]+[A-Z][a-z]+)+{EDGE_R}"
_QUOTED_HAN = r"[“”\"'「」『』]([\x{3400}-\x{9fff}]+)[“”\"'「」『』]"
_WORD = r"[A-Za-z]+(?:'[A-Za-z]+)?|[\x{3400}-\x{9fff}]"


def _size_where(parts: Column, keep) -> Column:
    return F.size(F.filter(parts, keep))


def sentence_count(text: Column) -> Column:
    parts = F.split(strip(text), rf"(?<=[.!?])[\"'”’)]*[{WS}]+", -1)
    return F.when(strip(text) == "", 0).otherwise(F.greatest(F.lit(1), _size_where(parts, lambda p: p.rlike(rf"[^{WS}]"))))


def length_fits(source: Column, output: Column, low: float = 0.45, high: float = 2.2) -> Column:
    """Not blank, and the lengths' ratio within bounds (the source's white space counts)."""
    ratio = F.length(output) / F.greatest(F.length(source), F.lit(1))
    return output.rlike(rf"[^{WS}]") & ratio.between(low, high)


def paragraph_fits(source: Column, output: Column, mode: str = "polish") -> Column:
    return length_fits(source, output, 0.35, 4.5 if mode == "translate" else 2.6)


def echoes(source: Column, output: Column) -> Column:
    return let(squeeze(source), lambda s: let(squeeze(output), lambda o: (s != "") & F.contains(o, s) & (F.length(o) >= F.length(s) + 24)))


def breaks_off(output: Column, source: Column) -> Column:
    finished = F.coalesce(F.right(rstrip(source), F.lit(1)), F.lit("")).isin("", *'.!?。"”’')

    def test(t: Column) -> Column:
        n = lambda sign: F.length(t) - F.length(F.replace(t, F.lit(sign), F.lit("")))
        last = F.lower(F.regexp_extract(F.right(t, F.lit(40)), r"[A-Za-z']+\z", 0))  # no listed word is longer
        return (t == "") | (n('"') % 2 == 1) | (n("“") != n("”")) | t.rlike(r"[,:;]\z") | last.isin(*STOPWORDS, *DANGLING) | finished & t.rlike(r"[A-Za-z\x{3400}-\x{9fff}]\z")

    return let(rstrip(output), test)


def _again(parts: Column, head: int) -> Column:
    """A later part begins like the first."""
    first = F.element_at(parts, 1)
    return F.when(F.size(parts) >= 2, (F.length(F.left(first, F.lit(head))) >= 20) & F.exists(F.slice(parts, 2, F.size(parts)), lambda p: F.startswith(p, F.left(first, F.lit(24))))).otherwise(False)


def repeats_itself(text: Column) -> Column:
    solid = lambda parts: F.filter(F.transform(parts, strip), lambda p: p != "")
    takes = solid(F.split(text, rf"[{WS}]*\[\p{{Nd}}+\][{WS}]*|\n\n+", -1))
    sentences = solid(F.split(strip(text), rf"(?<=[.!?])[{WS}]+", -1))
    return let(takes, lambda p: _again(p, 48)) | let(sentences, lambda p: _again(p, 1 << 30))


def keeps_anchors(source: Column, output: Column) -> Column:
    """Names of several words, and quoted Han, occur in the rewrite."""
    bare = lambda c: F.regexp_replace(c, rf"'s{EDGE_R}", "")
    names = F.regexp_extract_all(bare(source), F.lit(_NAME), F.lit(0))
    quoted = F.regexp_extract_all(source, F.lit(_QUOTED_HAN), F.lit(1))
    return let(F.lower(bare(output)), lambda hay: F.forall(names, lambda n: F.contains(hay, F.lower(n)))) & F.forall(quoted, lambda q: F.contains(output, q))


def content_words(text: Column) -> Column:
    words = F.transform(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), F.lower)
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOPWORDS))


def overlaps(source: Column, output: Column) -> Column:
    def related(a: Column, b: Column) -> Column:
        return (a == b) | (F.length(a) >= 4) & (F.length(b) >= 4) & (F.startswith(a, b) | F.startswith(b, a))

    return let(content_words(output), lambda out: let(content_words(source), lambda src: (F.size(src) < 4) | (_size_where(src, lambda a: F.exists(out, lambda b: related(a, b))) / F.size(src) >= 0.35)))


def rejection(source: Column, output: Column) -> Column:
    """The first test that ``output`` fails as a rewrite of ``source``, or null: it is accepted. A null is an empty text."""

    def tests(x: Column) -> Column:
        source, text = x["source"], x["text"]
        return (
            F.when(~length_fits(source, text), "length")
            .when(text.rlike(_LEAK), "leak")
            .when(echoes(source, text), "echo")
            .when(sentence_count(text) > sentence_count(source) + 1, "sentences")
            .when(breaks_off(text, source), "truncated")
            .when(repeats_itself(text), "duplicate")
            .when(~keeps_anchors(source, text), "anchors")
            .when(~overlaps(source, text), "overlap")
        )

    return let(F.struct(F.coalesce(source, F.lit("")).alias("source"), strip(F.coalesce(output, F.lit(""))).alias("text")), tests)
