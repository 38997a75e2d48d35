"""Writing segments back: as text, Markdown, HTML, JSON, or into the package they came from."""

from __future__ import annotations

import io
import os
import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator
from functools import reduce
from html import escape
from itertools import groupby
from xml.etree import ElementTree

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galley.functions.text import blank, rstrip
from galley.session import checkpointed
from galley.sources.formats import FormatError, output_path
from galley.sources.markup import epub_documents, html_places

_ORDER = ("chapter_ord", "seg_index", "tag", "text")


def _documents(segments: DataFrame, body) -> DataFrame:
    """(doc_id, content): ``body`` of each document's ordered segments.

    A document is one value in the end, so its segments meet in one row.
    """
    rows = segments.filter(~F.coalesce("is_skipped", F.lit(False)) & ~blank("text"))
    ordered = F.array_sort(F.collect_list(F.struct(*_ORDER)))
    return rows.groupBy("doc_id").agg(ordered.alias("s")).select("doc_id", body(F.col("s")).alias("content"))


def as_txt(segments: DataFrame) -> DataFrame:
    return _documents(segments, lambda s: F.concat(rstrip(F.array_join(F.transform(s, lambda x: x["text"]), "\n\n")), F.lit("\n")))


def as_markdown(segments: DataFrame) -> DataFrame:
    """Code fenced, headings marked, list items one a line, anything else a paragraph."""

    def block(x: Column, i: Column, s: Column) -> Column:
        t, tag = rstrip(x["text"]), x["tag"]
        following = F.try_element_at(s, i + 2)
        gap = F.when((tag == "li") & (F.coalesce(following["tag"], F.lit("li")) == "li") & (F.coalesce(following["chapter_ord"], x["chapter_ord"]) == x["chapter_ord"]), "\n").when((tag == "li") & (following["chapter_ord"] == x["chapter_ord"]), "\n").otherwise("\n\n")
        text = F.when(tag == "pre", F.concat(F.lit("```\n"), t, F.lit("\n```"))).when(tag.rlike("^h[1-6]$"), F.concat(F.repeat(F.lit("#"), F.substring(tag, 2, 1).cast("int")), F.lit(" "), t)).when(tag == "li", F.concat(F.lit("- "), t)).otherwise(t)
        return F.concat(text, gap)

    return _documents(segments, lambda s: F.concat(rstrip(F.array_join(F.transform(s, lambda x, i: block(x, i, s)), "")), F.lit("\n")))


def as_html(segments: DataFrame) -> DataFrame:
    """A fresh page; tags outside the known ones become paragraphs."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    tag = lambda x: F.when(x["tag"].isin("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre"), x["tag"]).otherwise("p")
    line = lambda x: F.concat(F.lit("<"), tag(x), F.lit(">"), F.replace(esc(x["text"]), F.lit("\n"), F.lit("<br/>")), F.lit("</"), tag(x), F.lit(">"))
    return _documents(segments, lambda s: F.concat(F.lit("<!DOCTYPE html>\n<html><body>\n"), F.array_join(F.transform(s, line), "\n"), F.lit("\n</body></html>\n")))


def as_json(segments: DataFrame, lines: bool = False) -> DataFrame:
    """Records {chapter, tag, text}, one a line or as one list."""
    rows = segments.filter(~F.coalesce("is_skipped", F.lit(False)) & ~blank("text"))
    rec = F.struct("chapter_ord", "seg_index", F.struct(F.col("title").alias("chapter"), "tag", "text").alias("r"))
    recs = F.transform(F.array_sort(F.collect_list(rec)), lambda x: F.to_json(x["r"]))
    body = F.concat(F.array_join(recs, "\n"), F.lit("\n")) if lines else F.concat(F.lit("[\n"), F.array_join(recs, ",\n"), F.lit("\n]\n"))
    return rows.groupBy("doc_id").agg(body.alias("content"))


def set_html_texts(page: str, texts: dict[int, str]) -> str:
    """``page`` with the texts of its leaf blocks (by number) replaced between their tags; all other markup stays as it is."""
    out, at = [], 0
    for i, (old, start, end) in enumerate(html_places(page)):
        if i in texts and texts[i] != old:
            out += (page[at:start], escape(texts[i], quote=False).replace("\n", "<br/>"))
            at = end
    return "".join(out) + page[at:]


def rewrite_epub(raw: bytes, texts: dict[tuple[str, int], str]) -> bytes:
    """The EPUB with segments (item id, number) replaced; untouched members keep their bytes and order, mimetype first and stored."""
    changed = {}
    for item, member, content in epub_documents(raw):
        own = {i: t for (k, i), t in texts.items() if k == item}
        page = content.decode("utf-8", "replace")
        if own and (new := set_html_texts(page, own)) != page:
            changed[member] = new.encode()
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(raw)) as src, zipfile.ZipFile(out, "w") as dst:
        infos = sorted(src.infolist(), key=lambda i: i.filename != "mimetype")
        for info in infos:
            kind = zipfile.ZIP_STORED if info.filename == "mimetype" else info.compress_type
            dst.writestr(info, changed.get(info.filename, src.read(info.filename)), compress_type=kind)
    return out.getvalue()


def rewrite_docx(raw: bytes, texts: dict[int, str]) -> bytes:
    """The DOCX with paragraphs (by number in the file) replaced: the first run takes the text, the others are emptied."""
    with zipfile.ZipFile(io.BytesIO(raw)) as src:
        xml = src.read("word/document.xml")
        for prefix, uri in {k: v for _, (k, v) in ElementTree.iterparse(io.BytesIO(xml), events=("start-ns",))}.items():
            ElementTree.register_namespace(prefix, uri)
        root = ElementTree.fromstring(xml)
        body = next(e for e in root if e.tag.endswith("}body"))
        paras = [e for e in body if e.tag.endswith("}p")] + [p for t in body if t.tag.endswith("}tbl") for p in t.iter() if p.tag.endswith("}p")]
        for i, new in texts.items():
            runs = [t for t in paras[i].iter() if t.tag.endswith("}t")]
            if runs and "".join(t.text or "" for t in runs).strip() != new:
                for k, t in enumerate(runs):
                    t.text = new if k == 0 else ""
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as dst:
            for info in src.infolist():
                dst.writestr(info, ElementTree.tostring(root, "utf-8", xml_declaration=True) if info.filename == "word/document.xml" else src.read(info.filename))
    return out.getvalue()


def _set_in(fmt: str, raw: bytes, own: list) -> bytes:
    if fmt == "epub":
        return rewrite_epub(raw, {(x["item_id"], x["seg_index"]): x["text"] for x in own})
    texts = {x["seg_index"]: x["text"] for x in own}
    return rewrite_docx(raw, texts) if fmt == "docx" else set_html_texts(raw.decode("utf-8-sig", "replace"), texts).encode()


def rewrite_packages(files: DataFrame, segments: DataFrame, fmt: str) -> DataFrame:
    """(doc_id, content binary): files (doc_id, raw) of one format (epub, docx, html) with their segments' texts set in."""
    per = segments.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "seg_index", "text")).alias("texts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [_set_in(fmt, bytes(raw), [] if own is None else own) for raw, own in zip(pdf["raw"], pdf["texts"])]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "content": out})

    return files.select("doc_id", "raw").join(per, "doc_id", "left").mapInPandas(run, "doc_id bigint, content binary")


_PAGE = '<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml"><head><title>{}</title></head><body>\n{}\n</body></html>\n'


def new_epub(name: str, rows: list[tuple[int, str, str, str]]) -> bytes:
    """An EPUB of (chapter_ord, title, tag, text): a page a chapter, contents in both of its forms."""
    chapters = [(k, list(run)) for k, run in groupby(rows, key=lambda r: r[0])]
    line = lambda tag, t: f"<{tag}>{escape(t, quote=False).replace(chr(10), '<br/>')}</{tag}>"
    files = [f"c{k}.xhtml" for k, _ in chapters]
    titles = [escape(run[0][1] or name, quote=False) for _, run in chapters]
    pages = [_PAGE.format(t, "\n".join(line("p" if tag in ("div", None) else tag, text) for _, _, tag, text in run)) for t, (_, run) in zip(titles, chapters)]
    links = "".join(f'<li><a href="{f}">{t}</a></li>' for f, t in zip(files, titles))
    points = "".join(f'<navPoint id="n{i}" playOrder="{i + 1}"><navLabel><text>{t}</text></navLabel><content src="{f}"/></navPoint>' for i, (f, t) in enumerate(zip(files, titles)))
    items = "".join(f'<item id="i{i}" href="{f}" media-type="application/xhtml+xml"/>' for i, f in enumerate(files))
    spine = "".join(f'<itemref idref="i{i}"/>' for i in range(len(files)))
    book = escape(name, quote=False)
    members = {
        "META-INF/container.xml": '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>',
        "OEBPS/content.opf": f'<?xml version="1.0" encoding="utf-8"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{book}</dc:identifier><dc:title>{book}</dc:title><dc:language>en</dc:language></metadata>'
        f'<manifest>{items}<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine toc="ncx">{spine}</spine></package>',
        "OEBPS/nav.xhtml": f'<?xml version="1.0" encoding="utf-8"?><html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{book}</title></head><body><nav epub:type="toc"><ol>{links}</ol></nav></body></html>',
        "OEBPS/toc.ncx": f'<?xml version="1.0" encoding="utf-8"?><ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><head/><docTitle><text>{book}</text></docTitle><navMap>{points}</navMap></ncx>',
        **{f"OEBPS/{f}": page for f, page in zip(files, pages)},
    }
    return _zipped({"mimetype": "application/epub+zip"} | members, stored="mimetype")


def new_docx(rows: list[tuple[int, str, str, str]]) -> bytes:
    """A DOCX of (chapter_ord, title, tag, text): headings in their styles, anything else a paragraph."""
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"

    def para(tag: str | None, text: str) -> str:
        style = f'<w:pPr><w:pStyle w:val="Heading{tag[1]}"/></w:pPr>' if tag and re.fullmatch("h[1-6]", tag) else ""
        runs = "<w:br/>".join(f'<w:t xml:space="preserve">{escape(x, quote=False)}</w:t>' for x in text.split("\n"))
        return f"<w:p>{style}<w:r>{runs}</w:r></w:p>"

    styles = "".join(f'<w:style w:type="paragraph" w:styleId="Heading{k}"><w:name w:val="heading {k}"/></w:style>' for k in range(1, 7))
    office = "application/vnd.openxmlformats-officedocument.wordprocessingml"
    relation = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    return _zipped(
        {
            "[Content_Types].xml": f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="{office}.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="{office}.styles+xml"/></Types>',
            "_rels/.rels": f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{relation}/officeDocument" Target="word/document.xml"/></Relationships>',
            "word/_rels/document.xml.rels": f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{relation}/styles" Target="styles.xml"/></Relationships>',
            "word/styles.xml": f'<?xml version="1.0" encoding="UTF-8"?><w:styles xmlns:w="{w}">{styles}</w:styles>',
            "word/document.xml": f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{w}"><w:body>{"".join(para(tag, text) for _, _, tag, text in rows)}</w:body></w:document>',
        }
    )


def _zipped(members: dict[str, str], stored: str = "") -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():  # a fixed date: equal contents are equal files
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text, zipfile.ZIP_STORED if name == stored else zipfile.ZIP_DEFLATED)
    return out.getvalue()


def as_packages(segments: DataFrame, fmt: str) -> DataFrame:
    """(doc_id, content binary): a fresh EPUB or DOCX of each document's ordered segments."""
    rows = segments.filter(~F.coalesce("is_skipped", F.lit(False)) & ~blank("text"))
    per = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chapter_ord", "seg_index", "title", "tag", "text"))).alias("s"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = []
            for doc, s in zip(pdf["doc_id"], pdf["s"]):
                own = [(x["chapter_ord"], x["title"], x["tag"], x["text"]) for x in s]
                made.append(new_epub(own[0][1] or str(doc), own) if fmt == "epub" else new_docx(own))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "content": made})

    return per.mapInPandas(run, "doc_id bigint, content binary")


def _encoded(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.encode("content", "UTF-8").alias("content"))


FRESH = {"txt": as_txt, "md": as_markdown, "html": as_html, "json": as_json, "jsonl": lambda s: as_json(s, lines=True)}


def as_format(segments: DataFrame, fmt: str) -> DataFrame:
    """(doc_id, content binary): every document written anew in ``fmt``."""
    if fmt in FRESH:
        return _encoded(FRESH[fmt](segments))
    if fmt in ("epub", "docx"):
        return as_packages(segments, fmt)
    raise FormatError(f"cannot write {fmt}")


def write_document(files: DataFrame, segments: DataFrame, fmt: str | None = None, mode: str = "polish") -> DataFrame:
    """(name, content binary): the documents of ``files`` (doc_id, path, fmt, raw) with the texts of ``segments``.

    In the format asked for, else each in its own: EPUB, DOCX and HTML are changed in
    place, so that all that is no text stays; other formats are written anew.
    """
    parts = []
    for own in [fmt] if fmt else ["txt", "md", "html", "json", "jsonl", "epub", "docx"]:
        some = files if fmt else files.filter(F.col("fmt") == own)
        mine = segments.join(some.select("doc_id"), "doc_id", "left_semi")
        made = rewrite_packages(some, mine, own) if not fmt and own in ("epub", "docx", "html") else as_format(mine, own)
        parts.append(made.join(some.select("doc_id", "path"), "doc_id").select(F.element_at(F.split(output_path(F.col("path"), F.lit(mode), F.lit(own)), "/"), -1).alias("name"), "doc_id", "content"))
    out = reduce(DataFrame.unionByName, parts)
    # files of one name from several folders are told apart
    same = F.count("*").over(Window.partitionBy("name")) > 1
    return out.select(F.when(same, F.concat(F.hex("doc_id"), F.lit("-"), F.col("name"))).otherwise(F.col("name")).alias("name"), "content")


def write_files(contents: DataFrame, folder: str) -> DataFrame:
    """Writes (name, content) of all rows below a shared ``folder``, each whole or not at all; then gives (name, n_bytes).

    ``folder`` is a URI that every executor reaches (hdfs://, s3://, a mounted file://), or
    a path on one machine. A file is written beside its place and moved there, so a task
    that runs again replaces it with the same bytes. The writing is done when this returns.
    """
    spark = contents.sparkSession
    if "://" not in folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("on a cluster the folder must be a URI that all executors reach")
        folder = f"file://{os.path.abspath(folder)}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        for pdf in batches:
            sizes = []
            for name, content in zip(pdf["name"], pdf["content"]):
                data = content.encode() if isinstance(content, str) else bytes(content)
                place = f"{root}/{posixpath.basename(name)}"
                part = f"{place}.{uuid.uuid4().hex}.tmp"
                with fs.open_output_stream(part) as f:
                    f.write(data)
                fs.move(part, place)
                sizes.append(len(data))
            yield pd.DataFrame({"name": pdf["name"], "n_bytes": sizes})

    return checkpointed(contents.select("name", "content").mapInPandas(run, "name string, n_bytes bigint"))
