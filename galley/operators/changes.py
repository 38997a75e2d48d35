"""The change log: what was sent, what came back the same, what was edited."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galley.functions.text import squeeze


def unchanged(before: Column, after: Column) -> Column:
    """Whether nothing but white space differs; a null is an empty text."""
    return squeeze(F.coalesce(before, F.lit(""))) == squeeze(F.coalesce(after, F.lit("")))


def edits(log: DataFrame) -> DataFrame:
    return log.filter(~unchanged(F.col("before"), F.col("after")))


def href_number(href: Column) -> Column:
    """The last number of a reference, 0 without one."""
    return F.coalesce(F.try_element_at(F.regexp_extract_all(href, F.lit(r"(\p{Nd}+)"), F.lit(1)), F.lit(-1)).try_cast("bigint"), F.lit(0))


def summary(log: DataFrame, by: str | None = None) -> DataFrame:
    """Sent, unchanged, edited and chapters edited; in all, or for each ``by``."""
    same = unchanged(F.col("before"), F.col("after"))
    grouped = log.groupBy(by) if by else log.groupBy()
    return grouped.agg(F.count("*").alias("sent"), F.sum(same.cast("bigint")).alias("unchanged"), F.sum((~same).cast("bigint")).alias("edits"), F.count_distinct(F.when(~same, F.col("chapter_id"))).alias("chapters_edited"))


def fence(text: Column) -> Column:
    """A code fence longer than any run of backticks inside."""
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit("(`+)"), F.lit(1)), F.length)), F.lit(0))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), longest + 1).cast("int"))


def markdown_entries(log: DataFrame) -> DataFrame:
    """(edit_id, href, chapter_title, chapter_id, para, entry): each edit as a section of a report."""
    body = F.concat_ws("\n\n", "before", "after")
    f = fence(body)
    block = lambda name, c: F.concat(F.lit(f"{name}:\n\n"), f, F.lit("\n"), F.coalesce(F.col(c), F.lit("")), F.lit("\n"), f)
    entry = F.concat(F.lit("### Paragraph "), F.col("para"), F.lit("\n\n"), block("Before", "before"), F.lit("\n\n"), block("After", "after"))
    return edits(log).select("edit_id", "href", "chapter_title", "chapter_id", "para", entry.alias("entry"))


def _placed(log: DataFrame, by: str) -> DataFrame:
    """Edits with their ``place`` in a report of ``by``: chapters in the order in which a reader meets them, their edits together."""
    order = [href_number(F.col("href")), "href", "para", "kind", "edit_id"]
    rows = edits(log).withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    chapter = Window.partitionBy(by, "href", "chapter_title", "chapter_id")
    return rows.withColumn("_first", F.min("_n").over(chapter)).withColumn("_many", F.count("*").over(chapter)).withColumn("place", F.struct("_first", "_n"))


def _listed_terms(totals: DataFrame, by: str, k: int) -> DataFrame:
    """(by, lines): the ``k`` most used terms of ``totals`` (by, term, n) and how many more there are."""
    ranked = totals.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "term")))
    line = F.when(F.col("_r") <= k, F.struct("_r", F.concat(F.lit("  - "), "term", F.lit(": "), F.col("n").cast("string")).alias("l")))
    listed = F.transform(F.array_sort(F.collect_list(line)), lambda x: x["l"])
    more = F.when(F.max("_r") > k, F.array(F.concat(F.lit("  - … "), (F.max("_r") - k).cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    return ranked.groupBy(by).agg(F.array_join(F.concat(F.array(F.lit("- Terms put in:")), listed, more), "\n").alias("lines"))


def report_markdown(log: DataFrame, by: str, totals: DataFrame | None = None, k: int = 40) -> DataFrame:
    """(by, content): a report a document: counts, the most used terms of ``totals`` (by, term, n), every edit under its chapter."""
    rows = _placed(log, by)
    f = fence(F.concat_ws("\n\n", "before", "after"))
    shown = lambda name, c: F.concat(F.lit(f"{name}:\n\n"), f, F.lit("\n"), F.coalesce(F.col(c), F.lit("")), F.lit("\n"), f)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    head = F.when(F.col("_n") == F.col("_first"), F.concat(F.lit("## "), text("chapter_title"), F.lit("\n*"), text("href"), F.lit(" · "), F.col("_many"), F.lit("*\n\n"))).otherwise("")
    entry = F.concat(head, F.lit("### Paragraph "), text("para"), F.lit(" ("), text("kind"), F.lit(")\n\n"), shown("Before", "before"), F.lit("\n\n"), shown("After", "after"))
    # a report is one value in the end, so its edits meet in one row
    bodies = rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", entry.alias("e")))), lambda x: x["e"]), "\n\n").alias("body"))
    out = summary(log, by).join(bodies, by, "left")
    terms = F.lit("")
    if totals is not None:
        out = out.join(_listed_terms(totals, by, k), by, "left")
        terms = F.coalesce(F.concat("lines", F.lit("\n")), F.lit(""))
    counts = F.concat(F.lit("# Change log\n\n- Sent: "), "sent", F.lit("\n- Rewritten: "), "edits", F.lit(" (left as they were: "), "unchanged", F.lit(")\n- Chapters with edits: "), "chapters_edited", F.lit("\n"), terms)
    return out.select(by, F.concat(counts, F.lit("\n"), F.coalesce("body", F.lit("Nothing was rewritten.")), F.lit("\n")).alias("content"))


def report_json(log: DataFrame, by: str, totals: DataFrame | None = None) -> DataFrame:
    """(by, content): the same as one JSON object, with what was sent and left unchanged."""
    entry = lambda *c: F.struct("chapter_id", F.col("chapter_title").alias("chapter"), "href", "para", "kind", "before", *c)
    place = F.struct(href_number(F.col("href")).alias("n"), "href", "para", "kind", "edit_id")
    same = unchanged(F.col("before"), F.col("after"))
    listed = lambda keep, e: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct(place.alias("p"), e.alias("e"))))), lambda x: x["e"])
    lists = log.groupBy(by).agg(listed(~same, entry("after")).alias("edits_"), listed(same, entry()).alias("unchanged_"))
    out = summary(log, by).join(lists, by)
    terms = []
    if totals is not None:
        per = totals.groupBy(by).agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("r"), "term", "n"))), lambda x: F.struct(x["term"], x["n"]))).alias("terms"))
        out, terms = out.join(per, by, "left"), ["terms"]
    return out.select(by, F.to_json(F.struct("sent", F.col("unchanged").alias("left"), F.col("edits").alias("rewritten"), "chapters_edited", *terms, F.col("edits_").alias("edits"), F.col("unchanged_").alias("unchanged"))).alias("content"))
