"""Glossaries: merging, what is relevant to a text, and substitution in one pass.

A glossary belongs to a book: terms (book_id, ord, source, target, kind, notes).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from galley.functions.scripts import FOREIGN

CAP = 80
#: Signs of scripts whose terms need no word edges.
_FOREIGN = re.compile("[" + re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: chr(int(m[1], 16)), FOREIGN) + "]")


def folded(c: str | Column) -> Column:
    return F.lower(F.col(c) if isinstance(c, str) else c)


def merge(base: DataFrame, other: DataFrame, overwrite: bool = False, key: str = "book_id") -> DataFrame:
    """Both glossaries with one term a folded source, in the order of first appearance.

    The first term wins; with ``overwrite`` the last target does, and the last kind and
    notes that are not empty. Positions stay those of the first. Null sources are dropped.
    """
    both = base.withColumn("_g", F.lit(0)).unionByName(other.withColumn("_g", F.lit(1))).filter("source IS NOT NULL")
    place = F.struct("_g", "ord")
    full = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", place)
    pick = F.max_by if overwrite else F.min_by
    extra = (lambda c: F.coalesce(F.max_by(c, full(c)), F.min_by(c, place))) if overwrite else (lambda c: F.min_by(c, place))
    out = both.groupBy(key, folded("source").alias("_k")).agg(F.min(place).alias("_p"), F.min_by("source", place).alias("source"), pick("target", place).alias("target"), extra("kind").alias("kind"), extra("notes").alias("notes"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("_p"))
    return out.select(key, rank.alias("ord"), "source", "target", "kind", "notes")


#: A glossary table of up to so many terms goes to every task, which then reads a text once; a larger one is joined by book.
SHARED = 50_000
_TERM = ["ord", "source", "target", "kind", "notes"]


def small(text: str) -> str:
    """``text`` in small letters, position by position."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _automaton(terms: Iterable[tuple[str, object]]) -> ahocorasick.Automaton:
    """Finds all sources at once: each in small letters, with what came with it under that spelling in a list."""
    found: dict[str, list] = {}
    for source, item in terms:
        found.setdefault(small(source), []).append(item)
    auto = ahocorasick.Automaton()
    for source, items in found.items():
        auto.add_word(source, (len(source), items))
    auto.make_automaton()
    return auto


def _by_book(terms: DataFrame, key: str, shared: int) -> dict | None:
    """The terms of every book, or None where they are more than ``shared``."""
    t = terms.select(F.col(key).alias("_b"), *_TERM)
    if t.limit(shared + 1).count() > shared:
        return None
    out: dict = {}
    for r in sorted(t.collect(), key=lambda r: (r["ord"] is None, r["ord"] or 0)):
        out.setdefault(r["_b"], []).append(tuple(r)[1:])
    return out


class _Books:
    """What a task makes of each book's terms, made when the book first comes."""

    def __init__(self, terms: dict, make: Callable) -> None:
        self.terms, self.make, self.made = terms, make, {}

    def __getitem__(self, book):
        if book not in self.made:
            own = self.terms.get(book) if book is not None else None
            self.made[book] = self.make(own) if own else None
        return self.made[book]


def _appended(texts: DataFrame, key: str, terms: dict, make: Callable, use: Callable, name: str, kind: str) -> DataFrame:
    """``texts`` with a column ``name``: ``use`` of what ``make`` made of the book's terms, and the text; null without any."""
    schema = StructType([*texts.schema.fields, StructField(name, StructType.fromDDL(f"x {kind}")["x"].dataType)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = _Books(terms, make)
        for batch in batches:
            made = (books[b] for b in batch.column(key).to_pylist())
            out = [None if t is None or m is None else use(m, t) for m, t in zip(made, batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, arrow.field(name).type)], schema=arrow)

    return texts.mapInArrow(run, schema)


def _hits(auto: ahocorasick.Automaton, text: str) -> list[tuple]:
    """The terms that occur in ``text``, each once, longest first."""
    seen = {id(items): items for _, (_, items) in auto.iter(small(text))}
    return sorted((t for items in seen.values() for t in items), key=lambda t: (-len(t[1]), t[0]))


def relevant(texts: DataFrame, terms: DataFrame, id_col: str, key: str = "book_id", cap: int = CAP, shared: int = SHARED) -> DataFrame:
    """(id, ord, source, target, kind, notes, rank) of the terms whose folded source occurs in a text, longest first.

    The cap is on the longest ``cap`` hits of a text and is the feature itself. A text is
    read once, by an automaton of its book's terms, where it lies: no shuffle, and a hot
    book is as any. Glossaries of more than ``shared`` terms in all are joined by book.
    """
    terms = terms.filter(F.length("source") > 0)
    books = _by_book(terms, key, shared)
    if books is not None:
        types = dict(terms.dtypes)
        kind = "array<struct<" + ",".join(f"{c}:{types[c]}" for c in _TERM) + ">>"
        use = lambda auto, text: _hits(auto, text)[:cap]
        make = lambda own: _automaton((t[1], t) for t in own)
        found = _appended(texts.select(id_col, key, "text"), key, books, make, use, "_hits", kind)
        each = found.select(id_col, F.posexplode("_hits").alias("_r", "_h"))
        return each.select(id_col, "_h.*", (F.col("_r") + 1).alias("rank"))
    t = terms.select(F.col(key).alias("_b"), *_TERM)
    hits = texts.select(id_col, key, folded("text").alias("_t")).join(t, (F.col(key) == F.col("_b")) & F.contains(F.col("_t"), folded("source")))
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.length("source").desc(), "ord"))
    return hits.select(id_col, *_TERM, rank.alias("rank")).filter(F.col("rank") <= cap)


def with_wanted(texts: DataFrame, terms: DataFrame, id_col: str, key: str = "book_id", shared: int = SHARED) -> DataFrame:
    """``texts`` with ``wanted``: the folded sources in each that its glossary would change; null for none.

    What routing and scores ask for: a unit of the text has a hit if it holds one of them.
    """
    terms = terms.filter("length(source) > 0 AND source <> target")
    books = _by_book(terms, key, shared)
    if books is not None:
        use = lambda auto, text: sorted({small(t[1]) for t in _hits(auto, text)}) or None
        return _appended(texts, key, books, lambda own: _automaton((t[1], t) for t in own), use, "wanted", "array<string>")
    per = relevant(texts, terms, id_col, key, 1 << 30, shared).groupBy(id_col).agg(F.sort_array(F.collect_set(folded("source"))).alias("wanted"))
    return texts.join(per, id_col, "left")


def unapplied(hits: DataFrame) -> DataFrame:
    """Relevant terms that would change something; identities were counted by the cap."""
    return hits.filter("source <> target")


def line(source: Column, target: Column, notes: Column) -> Column:
    return F.concat(F.lit("- "), source, F.lit(" → "), target, F.when(F.coalesce(notes, F.lit("")) != "", F.concat(F.lit(" ("), notes, F.lit(")"))).otherwise(""))


def stable_block(terms: DataFrame, key: str = "book_id", cap: int = CAP) -> DataFrame:
    """(key, block): the substitutions of a glossary, longest first, each once, at most ``cap``."""
    subs = terms.filter("length(source) > 0 AND length(target) > 0 AND source <> target")
    once = subs.groupBy(key, folded("source").alias("_k"), "target").agg(F.min("ord").alias("ord"), F.min_by("source", "ord").alias("source"), F.min_by("notes", "ord").alias("notes"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.length("source").desc(), "_k", "ord"))
    top = once.withColumn("_r", rank).filter(F.col("_r") <= cap)
    lines = F.array_sort(F.collect_list(F.struct("_r", line(F.col("source"), F.col("target"), F.col("notes")).alias("l"))))
    return top.groupBy(key).agg(F.array_join(F.transform(lines, lambda x: x["l"]), "\n").alias("block"))


def _in_word(ch: str) -> bool:
    return ch.isalnum() or ch == "_"


def _edge(text: str, at: int) -> bool:
    """Whether a word begins or ends at ``at``."""
    return (at > 0 and _in_word(text[at - 1])) != (at < len(text) and _in_word(text[at]))


class Substitution:
    """A glossary's sources put in one pass, from left to right, the longest at each place.

    All occurrences are found by one automaton; a sweep over them leaves out those that
    stand within a word and those that overlap an earlier one, so that a target is
    never looked at again. A source in a script without blanks may stand within a word.
    Of sources with one spelling but for case, the first counts that is spelt as the
    text, or any where the text has it small; else the first of all.
    """

    def __init__(self, terms: list[tuple[str, str]]) -> None:
        used = [(s, t) for s, t in terms if s and t and s != t]
        self.auto = _automaton((s, (s, t, bool(_FOREIGN.search(s)))) for s, t in used) if used else None

    def places(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, source, target) of what is replaced in ``text``."""
        low, found = small(text), []
        for last, (n, items) in self.auto.iter(low):
            start, end = last + 1 - n, last + 1
            here = [(s, t) for s, t, free in items if free or _edge(text, start) and _edge(text, end)]
            if here:
                word = text[start:end]
                found.append((start, -end, *next((x for x in here if word in (x[0], small(x[0]))), here[0])))
        out, at = [], 0
        for start, end, s, t in sorted(found, key=lambda x: x[:2]):
            if start >= at:
                at = -end
                out.append((start, at, s, t))
        return out

    def apply(self, text: str | None) -> tuple[str | None, dict[str, int]]:
        """The text with its terms replaced, and how often each was."""
        counts: dict[str, int] = {}
        if not text or self.auto is None:
            return text, counts
        parts, at = [], 0
        for start, end, s, t in self.places(text):
            parts += (text[at:start], t)
            at = end
            counts[f"{s} → {t}"] = counts.get(f"{s} → {t}", 0) + 1
        return "".join(parts) + text[at:], counts


def substitute(texts: DataFrame, terms: DataFrame, id_col: str, key: str = "book_id", shared: int = SHARED) -> DataFrame:
    """(id, text, hits) of every row of ``texts``: terms of its book replaced in one pass, with counts by term.

    Texts are rewritten where they lie, without a shuffle, while all glossaries have
    ``shared`` terms at most. Beyond that only the terms that occur in a text travel
    with it, found by the join of ``relevant`` without its cap. Null texts stay null.
    """
    terms = terms.filter("length(source) > 0 AND length(target) > 0 AND source <> target")
    books = _by_book(terms, key, shared)
    put = "struct<text:string,hits:map<string,bigint>>"
    none = F.create_map().cast("map<string,bigint>")

    def use(s: Substitution, text: str) -> dict | None:
        new, hits = s.apply(text)
        return {"text": new, "hits": list(hits.items())} if hits else None

    if books is not None:
        out = _appended(texts.select(id_col, key, "text"), key, books, lambda own: Substitution([(t[1], t[2]) for t in own]), use, "_put", put)
    else:
        found = relevant(texts, terms, id_col, key, 1 << 30, shared)
        pack = F.array_sort(F.collect_list(F.struct("ord", "source", "target")))
        per_text = found.groupBy(id_col).agg(pack.alias("_terms"))  # a text's own terms: no more than its substrings
        joined = texts.select(id_col, "text").join(per_text, id_col, "left")

        def own_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[tuple, Substitution] = {}
            for batch in batches:
                new = []
                for text, own in zip(batch.column("text").to_pylist(), batch.column("_terms").to_pylist()):
                    pairs = tuple((x["source"], x["target"]) for x in own or ())
                    if len(known) > 10_000:
                        known.clear()
                    if pairs and pairs not in known:
                        known[pairs] = Substitution(list(pairs))
                    new.append(use(known[pairs], text) if pairs and text is not None else None)
                yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("text"), pa.array(new, arrow.field("_put").type)], schema=arrow)

        schema = StructType([*texts.select(id_col, "text").schema.fields, *StructType.fromDDL(f"_put {put}").fields])
        arrow = to_arrow_schema(schema)
        out = joined.mapInArrow(own_terms, schema)
    changed = F.col("_put").isNotNull()
    return out.select(id_col, F.when(changed, F.col("_put.text")).otherwise(F.col("text")).alias("text"), F.when(changed, F.col("_put.hits")).otherwise(none).alias("hits"))


def hit_totals(substituted: DataFrame) -> DataFrame:
    """(term, n) over all texts, summed by term."""
    return substituted.select(F.explode("hits").alias("term", "n")).groupBy("term").agg(F.sum("n").alias("n"))


def sources_of_json(raw: Column) -> Column:
    """Terms of a glossary file: an object with `terms`, a list of objects (aliases from/to, kind), or a plain object."""
    listed = "array<struct<source:string,from:string,target:string,to:string,type:string,kind:string,notes:string>>"
    inner = F.coalesce(F.from_json(raw, f"struct<terms:{listed}>")["terms"], F.from_json(raw, listed))
    term = lambda s, t, k, n: F.struct(s.alias("source"), t.alias("target"), k.alias("kind"), n.alias("notes"))
    empty = F.lit("")
    objects = F.transform(inner, lambda x: term(F.coalesce(x["source"], x["from"]), F.coalesce(x["target"], x["to"]), F.coalesce(x["type"], x["kind"], F.lit("other")), F.coalesce(x["notes"], empty)))
    objects = F.filter(objects, lambda x: (F.coalesce(x["source"], empty) != "") & (F.coalesce(x["target"], empty) != ""))
    plain = F.transform(F.map_entries(F.from_json(raw, "map<string,string>")), lambda e: term(e["key"], e["value"], F.lit("other"), empty))
    return F.when(inner.isNotNull() & (F.size(objects) > 0), objects).otherwise(F.when(raw.rlike(r"^\s*\{") & ~raw.rlike(r'^\s*\{\s*"terms"'), plain).otherwise(F.array().cast("array<struct<source:string,target:string,kind:string,notes:string>>")))


def load_glossary(spark: SparkSession, path: str) -> DataFrame:
    """(ord, source, target, kind, notes) of the glossary files below ``path``, merged in the order of their names."""
    files = spark.read.text(path, wholetext=True).select("_metadata.file_path", F.posexplode(sources_of_json(F.col("value"))).alias("place", "t"))
    rows = files.select(F.lit("").alias("book_id"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("file_path", "place")).alias("ord"), "t.*")
    return merge(rows, rows.limit(0)).drop("book_id")


def to_json(terms: DataFrame, key: str = "book_id") -> DataFrame:
    """(key, json): a glossary as one object, for a file a book."""
    term = F.struct(F.struct("ord").alias("o"), F.struct("source", "target", F.col("kind").alias("type"), "notes").alias("t"))
    listed = F.transform(F.array_sort(F.collect_list(term)), lambda x: x["t"])
    return terms.groupBy(key).agg(F.to_json(F.struct(listed.alias("terms"))).alias("json"))
