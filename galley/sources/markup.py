"""Markdown, HTML and the XML packages built on them, parsed a document at a time by the standard library."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from itertools import groupby
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "doc_id bigint, chapter_ord int, item_id string, title string, is_skipped boolean, seg_index int, tag string, text string"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
# Elements that hold a paragraph, elements without content, names of navigation.
BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "td", "th", "dt", "dd", "div"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
NAVIGATION = ("nav", "toc", "ncx", "cover", "contents")
Chapter = tuple[str, str, bool, list[tuple[int, str, str]]]  # item_id, title, is_skipped, (seg_index, tag, text)


_FENCE = re.compile(r"^```.*$", re.M)
_HEADING = re.compile(r"(#{1,6})\s+(.*)")
_ITEM = re.compile(r"(?:[-*+]|\d+\.)\s+(.*)")


def _line_kind(line: str) -> str:
    """h, li, p, or nothing for a blank line."""
    if _HEADING.match(line):
        return "h"
    bare = line.strip()
    return "li" if _ITEM.match(bare) else "p" if bare else ""


def markdown_blocks(text: str) -> Iterator[tuple[str, str]]:
    """(tag, text) of the blocks: what stands between fences is code, a run of plain lines a paragraph."""
    lines = "\n".join(text.removeprefix("\ufeff").splitlines())
    parts = _FENCE.split(lines)
    for k, part in enumerate(parts):
        if k % 2:
            code = part.split("\n")[1:]
            yield "pre", "\n".join(code if k == len(parts) - 1 else code[:-1])
            continue
        for kind, run in groupby(part.split("\n"), _line_kind):
            if kind == "p":
                yield kind, " ".join(map(str.strip, run))
            elif kind == "li":
                yield from ((kind, _ITEM.match(x.strip())[1]) for x in run)
            elif kind == "h":
                yield from ((f"h{len(m[1])}", m[2].strip()) for m in map(_HEADING.match, run))


def markdown_chapters(text: str, stem: str) -> list[Chapter]:
    """Chapters of a Markdown text: each top heading opens one, and whatever stands before the first."""
    blocks = list(markdown_blocks(text))
    at = [i for i, (tag, _) in enumerate(blocks) if tag == "h1" or i == 0]
    out = []
    for k, (start, end) in enumerate(zip(at, [*at[1:], len(blocks)])):
        title = blocks[start][1] if blocks[start][0] == "h1" else stem
        out.append((f"md{k}", title, False, [(i, tag, t) for i, (tag, t) in enumerate(blocks[start:end]) if t.strip()]))
    return out


class _Leaves(HTMLParser):
    """Block elements that hold no other; unclosed elements end with their parent."""

    def __init__(self, text: str) -> None:
        super().__init__(convert_charrefs=True)
        self.line_at = [0, *(m.end() for m in re.finditer("\n", text))]
        self.length = len(text)
        self.open: list[dict] = []
        self.blocks: list[dict] = []
        self.heads: dict[str, str] = {}
        self.body: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            return
        node = {"tag": tag, "text": [], "leaf": tag in BLOCKS, "start": self.at() + len(self.get_starttag_text() or ""), "end": self.length}
        if tag in BLOCKS:
            for outer in self.open:
                outer["leaf"] = False
            self.blocks.append(node)
        self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k]["tag"] == tag:
                for node in self.open[k:]:
                    node["end"] = self.at()
                    self._close(node)
                del self.open[k:]
                return

    def at(self) -> int:
        """Where in the page the parser stands."""
        line, column = self.getpos()
        return self.line_at[line - 1] + column

    def _close(self, node: dict) -> None:
        if node["tag"] in ("title", "h1", "h2", "h3") and (t := squeezed(node["text"])):
            self.heads.setdefault(node["tag"], t)

    def handle_data(self, data: str) -> None:
        if any(n["tag"] in ("script", "style", "template") for n in self.open):
            return
        for node in self.open:
            node["text"].append(data)
        if not any(n["tag"] in ("head", "title") for n in self.open):
            self.body.append(data)

    def close(self) -> None:
        super().close()
        for node in self.open:
            self._close(node)


def squeezed(parts: list[str]) -> str:
    return " ".join(" ".join(parts).split())


def _parsed(text: str) -> tuple[_Leaves, list[dict]]:
    """The parser after ``text``, and its leaf blocks of two characters or more."""
    parser = _Leaves(text)
    parser.feed(text)
    parser.close()
    return parser, [n for n in parser.blocks if n["leaf"] and len(squeezed(n["text"])) >= 2]


def html_leaves(text: str) -> tuple[list[tuple[int, str, str]], dict[str, str], str]:
    """(seg_index, tag, text) of the leaf blocks, the first headings and the title, and the whole body's text.

    Blocks of less than two characters are left out and take no number.
    """
    parser, found = _parsed(text)
    return [(i, n["tag"], squeezed(n["text"])) for i, n in enumerate(found)], parser.heads, squeezed(parser.body)


def html_places(text: str) -> list[tuple[str, int, int]]:
    """(text, start, end) of the leaf blocks: what stands between their tags."""
    return [(squeezed(n["text"]), n["start"], n["end"]) for n in _parsed(text)[1]]


def html_chapters(text: str, stem: str) -> list[Chapter]:
    rows, heads, body = html_leaves(text)
    if not rows and body:
        rows = [(0, "p", body)]
    return [("html0", heads.get("title") or heads.get("h1") or heads.get("h2") or stem, False, rows)]


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def epub_documents(raw: bytes) -> list[tuple[str, str, bytes]]:
    """(item id, member, content) of the documents of an EPUB in the order of its manifest."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        container = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf = next(e.get("full-path") for e in container.iter() if _local(e) == "rootfile")
        base, names = posixpath.dirname(opf), set(z.namelist())
        out = []
        for e in ElementTree.fromstring(z.read(opf)).iter():
            if _local(e) == "item" and e.get("media-type") == "application/xhtml+xml":
                if member := archive_member(names, base, e.get("href", "")):
                    out.append((e.get("id", ""), member, z.read(member)))
        return out


def archive_member(names: set[str], base: str, href: str) -> str | None:
    """The member that a manifest means: by its path, escapes read or not, else the only one with it as suffix, else the only one of its name."""
    for wanted in (href, unquote(href)):
        if (member := posixpath.normpath(posixpath.join(base, wanted))) in names:
            return member
    tail = unquote(href).replace("\\", "/").lstrip("./")
    if not tail:
        return None
    for ends in ("/" + tail, "/" + posixpath.basename(tail)):
        if found := [n for n in names if f"/{n}".endswith(ends)]:
            return found[0] if len(found) == 1 else None
    return None


def epub_chapters(raw: bytes, stem: str) -> list[Chapter]:
    """A chapter a document; navigation with fewer than eight segments is marked to be skipped."""
    out = []
    for item, member, content in epub_documents(raw):
        rows, heads, _ = html_leaves(content.decode("utf-8", "replace"))
        title = heads.get("h1") or heads.get("h2") or heads.get("h3") or heads.get("title") or posixpath.basename(member)
        skip = any(x in member.lower() for x in NAVIGATION) and len(rows) < 8
        out.append((item, title, skip, rows))
    return out


def docx_paragraphs(raw: bytes) -> list[tuple[str, str]]:
    """(style name, text) of the paragraphs of the body, then of those in tables."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = next(e for e in ElementTree.fromstring(z.read("word/document.xml")) if _local(e) == "body")
        styles: dict[str, str] = {}
        if "word/styles.xml" in z.namelist():
            for e in ElementTree.fromstring(z.read("word/styles.xml")):
                if _local(e) == "style":
                    value = next((v for c in e if _local(c) == "name" for k, v in c.attrib.items() if k.endswith("val")), "")
                    styles[next((v for k, v in e.attrib.items() if k.endswith("styleId")), "")] = value

    def read(p: ElementTree.Element) -> tuple[str, str]:
        style = next((v for e in p.iter() if _local(e) == "pStyle" for k, v in e.attrib.items() if k.endswith("val")), "")
        sign = {"t": None, "tab": "\t", "br": "\n", "cr": "\n"}
        return styles.get(style, style), "".join(sign[_local(e)] or e.text or "" for e in p.iter() if _local(e) in sign)

    own = [read(e) for e in body if _local(e) == "p"]
    return own + [read(p) for t in body if _local(t) == "tbl" for p in t.iter() if _local(p) == "p"]


def heading_level(style: str) -> str | None:
    if not style.lower().startswith("heading"):
        return None
    digit = re.search(r"\d", style)
    return f"h{min(6, max(1, int(digit[0])))}" if digit else "h1"


def docx_chapters(raw: bytes, stem: str) -> list[Chapter]:
    """A top heading with content before it opens a chapter; segments keep their paragraph's number in the file."""
    chapters: list[Chapter] = []
    rows: list[tuple[int, str, str]] = []
    title = stem
    for i, (style, text) in enumerate(docx_paragraphs(raw)):
        if not (text := text.strip()):
            continue
        tag = heading_level(style) or "p"
        if tag == "h1" and rows:
            chapters.append((f"d{len(chapters)}", title, False, rows))
            rows, title = [], text[:80]
        rows.append((i, tag, text))
    if rows:
        chapters.append((f"d{len(chapters)}", title, False, rows))
    return chapters


PARSERS: dict[str, tuple[Callable, bool]] = {"md": (markdown_chapters, False), "html": (html_chapters, False), "epub": (epub_chapters, True), "docx": (docx_chapters, True)}


def read_markup(docs: DataFrame, fmt: str) -> DataFrame:
    """Segments of documents (doc_id, stem, text or raw) of one format; blank ones are dropped, their numbers kept.

    A document that cannot be parsed fails the task: it would otherwise be lost unseen.
    A null or empty text has no segments.
    """
    parse, binary = PARSERS[fmt]
    column = "raw" if binary else "text"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, stem, content in zip(pdf["doc_id"], pdf["stem"], pdf[column]):
                if content is None or not len(content):
                    continue
                for k, (item, title, skip, segments) in enumerate(parse(content, stem)):
                    rows += [(doc, k, item, title, skip, i, tag, t) for i, tag, t in segments if t.strip()]
            yield pd.DataFrame(rows, columns=_NAMES)

    return docs.select("doc_id", "stem", column).mapInPandas(run, SCHEMA)
