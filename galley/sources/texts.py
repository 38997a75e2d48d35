"""Plain text, extracted pages and JSON records as segments, without Python.

Every reader gives (doc_id, chapter_ord, item_id, title, seg_index, tag, text) and
takes whole documents (doc_id, stem, text). Blank blocks keep their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galley.functions.text import WS, blank, strip

COLUMNS = ["doc_id", "chapter_ord", "item_id", "title", "seg_index", "tag", "text"]


def plain_text(c: Column) -> Column:
    """Without byte order mark, line ends as \\n."""
    return F.regexp_replace(F.regexp_replace(c, r"^\x{FEFF}", ""), r"\r\n?", "\n")


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines, the lines of each stripped and joined by a blank."""
    lines = lambda chunk: F.array_join(F.filter(F.transform(F.split(chunk, "\n", -1), strip), lambda x: x != ""), " ")
    return F.filter(F.transform(F.split(strip(plain_text(text)), rf"\n[{WS}]*\n", -1), lines), lambda p: p != "")


def read_txt(docs: DataFrame) -> DataFrame:
    """Sections between form feeds; an empty section keeps its ordinal and has no rows."""
    sections = docs.select("doc_id", "stem", F.posexplode(F.split(F.regexp_replace("text", r"^\x{FEFF}", ""), "\f", -1)).alias("chapter_ord", "section"))
    title = F.when(F.col("chapter_ord") == 0, F.col("stem")).otherwise(F.concat(F.lit("Section "), F.col("chapter_ord") + 1))
    rows = sections.select("doc_id", "chapter_ord", F.concat(F.lit("p"), F.col("chapter_ord")).alias("item_id"), title.alias("title"), F.posexplode(paragraphs(F.col("section"))).alias("seg_index", "text"))
    return rows.select("doc_id", "chapter_ord", "item_id", "title", "seg_index", F.lit("p").alias("tag"), "text")


def page_paragraphs(text: Column) -> Column:
    """Lines of a page joined until one ends in a final mark; words broken at a hyphen are joined."""
    clean = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", "$1$2")
    chunks = F.split(strip(clean), rf"\n[{WS}]*\n", -1)

    def join(chunk: Column) -> Column:
        lines = F.filter(F.transform(F.split(chunk, "\n", -1), strip), lambda x: x != "")
        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buf"))

        def step(acc: Column, line: Column) -> Column:
            full = acc["buf"].rlike(r"[.!?。！？:;\"”’]\z")
            return F.struct(F.when(full, F.concat(acc["done"], F.array(acc["buf"]))).otherwise(acc["done"]).alias("done"), F.when(full | (acc["buf"] == ""), line).otherwise(F.concat(acc["buf"], F.lit(" "), line)).alias("buf"))

        return F.aggregate(lines, start, step, lambda acc: F.when(acc["buf"] != "", F.concat(acc["done"], F.array(acc["buf"]))).otherwise(acc["done"]))

    return F.flatten(F.transform(chunks, join))


def read_pages(pages: DataFrame) -> DataFrame:
    """Extracted pages (doc_id, page from 0, text): a chapter a page, empty pages dropped."""
    rows = pages.select("doc_id", F.col("page").alias("chapter_ord"), F.posexplode(page_paragraphs(F.col("text"))).alias("seg_index", "text"))
    name = F.col("chapter_ord") + 1
    return rows.select("doc_id", "chapter_ord", F.concat(F.lit("page"), name).alias("item_id"), F.concat(F.lit("Page "), name).alias("title"), "seg_index", F.lit("p").alias("tag"), "text")


def _field(raw: Column, *names: str) -> Column:
    values = [F.get_json_object(raw, f"$.{n}") for n in names]
    return F.coalesce(*[F.when(v != "", v) for v in values], F.lit(""))


def read_records(records: DataFrame) -> DataFrame:
    """Records (doc_id, stem, ord, raw JSON) as segments, a chapter a chapter name in order of first appearance.

    A record is a string or an object with text (or paragraph, content), tag and chapter
    (or title); anything else is its own text. Blank texts are dropped.
    """
    raw = F.trim("raw")
    text = F.when(F.startswith(raw, F.lit("{")), _field(raw, "text", "paragraph", "content")).when(F.startswith(raw, F.lit('"')), F.from_json(F.concat(F.lit('{"v":'), raw, F.lit("}")), "v string")["v"]).otherwise(raw)
    rows = records.select("doc_id", "stem", "ord", text.alias("text"), F.coalesce(F.get_json_object(raw, "$.tag"), F.lit("p")).alias("tag"), _field(raw, "chapter", "title").alias("chapter")).filter(~blank("text"))
    rows = rows.withColumn("title", F.when(F.col("chapter") == "", F.col("stem")).otherwise(F.col("chapter")))
    # chapters are ranked on their own table, a row each, and joined back
    chapters = rows.groupBy("doc_id", "title").agg(F.min("ord").alias("first")).withColumn("chapter_ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("first")) - 1)
    seg = F.row_number().over(Window.partitionBy("doc_id", "title").orderBy("ord")) - 1
    out = rows.withColumn("seg_index", seg).join(chapters.select("doc_id", "title", "chapter_ord"), ["doc_id", "title"])
    return out.select("doc_id", "chapter_ord", F.concat(F.lit("j"), F.col("chapter_ord")).alias("item_id"), "title", "seg_index", "tag", "text")


def json_records(docs: DataFrame, lines: bool) -> DataFrame:
    """(doc_id, stem, ord, raw) of documents: one a line, or the elements of a list (alone or under `paragraphs`)."""
    text = strip(F.regexp_replace("text", r"^\x{FEFF}", ""))
    if lines:
        items = F.filter(F.split(text, r"\r\n|\n|\r", -1), lambda x: ~blank(x))
    else:
        inner = lambda t: F.when(F.startswith(t, F.lit("{")), F.get_json_object(t, "$.paragraphs")).otherwise(t)
        items = F.from_json(inner(text), "array<string>")  # read once; an element that is an object stays its text
        items = F.filter(items, lambda x: x.isNotNull())
    rows = docs.select("doc_id", "stem", F.posexplode(items).alias("ord", "raw"))
    # a bare string of a list comes without its quotes; what looks like an object stays one
    return rows if lines else rows.withColumn("raw", F.when(F.col("raw").rlike(r"^\s*[{]"), F.col("raw")).otherwise(F.to_json(F.struct(F.col("raw").alias("text")))))
