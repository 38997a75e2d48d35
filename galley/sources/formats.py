"""Formats of documents by name and by content, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats and their other names.
FORMATS = ("txt", "md", "html", "json", "jsonl", "epub", "docx", "pdf")
ALIASES = {"text": "txt", "markdown": "md", "htm": "html", "xhtml": "html"}
SUFFIX = {"txt": ".txt", "md": ".md", "html": ".html", "json": ".json", "jsonl": ".jsonl", "epub": ".epub", "docx": ".docx", "pdf": ".pdf"}


class FormatError(ValueError):
    """A format that is not known."""


def normal_format(name: Column, strict: bool = False) -> Column:
    """A format's one name: lower case, no leading dot, no alias; null (or an error) where unknown."""
    low = F.regexp_replace(F.lower(F.trim(name)), r"^\.", "")
    known = F.create_map(*[F.lit(x) for kv in {**{f: f for f in FORMATS}, **ALIASES}.items() for x in kv])
    out = F.try_element_at(known, low)
    return F.when(name.isNotNull() & out.isNull(), F.raise_error(F.concat(F.lit("unknown format: "), name))).otherwise(out) if strict else out


def suffix_of(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)


def detect_format(path: Column, content: Column) -> Column:
    """By suffix, else by the first bytes; an archive is an EPUB unless its name says otherwise."""
    head = F.substring(content, 1, 4)
    magic = F.when(F.hex(head) == "25504446", "pdf").when(F.hex(F.substring(content, 1, 2)) == "504B", F.when(F.lower(path).contains("docx"), "docx").otherwise("epub"))
    return F.coalesce(normal_format(suffix_of(path)), magic)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def output_path(path: Column, mode: Column, fmt: Column) -> Column:
    """Beside the input: `name.en.ext` for a translation, `name.polished.ext` otherwise."""
    ext = F.try_element_at(F.create_map(*[F.lit(x) for kv in SUFFIX.items() for x in kv]), fmt)
    mark = F.when(mode == "translate", ".en").otherwise(".polished")
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), mark, ext)
