"""Reading a folder of mixed documents into one table of segments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galley.sources.formats import ALIASES, FORMATS, detect_format, stem
from galley.sources.markup import read_markup
from galley.sources.texts import COLUMNS, json_records, read_records, read_txt


# Names of each format; a suffix in small, capital or titled letters is found without opening the file.
_OTHERS = {f: [f, *(a for a, of in ALIASES.items() if of == f)] for f in FORMATS}


def _glob(fmt: str) -> str:
    """A glob of the file names of a format."""
    names = sorted({form for x in _OTHERS[fmt] for form in (x, x.upper(), x.title())})
    return "*.{" + ",".join(names) + "}"


def read_files(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """(doc_id, path, fmt, stem, raw, text) of the files under ``path``; doc_id is a hash of the path.

    With ``fmt`` only files named so are opened.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return _described((reader.option("pathGlobFilter", _glob(fmt)) if fmt else reader).load(path))


def _described(files: DataFrame) -> DataFrame:
    fmt = detect_format(F.col("path"), F.col("content"))
    text = F.when(fmt.isin("txt", "md", "html", "json", "jsonl"), F.decode("content", "UTF-8"))
    return files.select(F.xxhash64("path").alias("doc_id"), "path", fmt.alias("fmt"), stem(F.col("path")).alias("stem"), F.col("content").alias("raw"), text.alias("text"))


def read_one(files: DataFrame, fmt: str) -> DataFrame:
    """Segments of files of one format."""
    if fmt in ("txt", "json", "jsonl"):
        native = read_txt(files) if fmt == "txt" else read_records(json_records(files, fmt == "jsonl"))
        return native.select("doc_id", "chapter_ord", "item_id", "title", F.lit(False).alias("is_skipped"), "seg_index", "tag", "text")
    return read_markup(files, fmt)


READABLE = ("txt", "json", "jsonl", "md", "html", "epub", "docx")


def read_segments(files: DataFrame) -> DataFrame:
    """Segments of every readable format, with ``is_skipped``; files of unknown format have none."""
    return reduce(DataFrame.unionByName, [read_one(files.filter(F.col("fmt") == f), f) for f in READABLE])


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """``read_segments`` of the files under ``path``, each opened once.

    Files are told apart by name before they are opened; only where some have a name of
    no format, and so may tell their format by their first bytes, is the folder read again.
    """
    parts = [read_one(read_files(spark, path, f), f) for f in READABLE]
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    unnamed = reduce(lambda a, b: a & b, [~F.col("path").rlike(r"\.(?:" + "|".join(x for n in _OTHERS[f] for x in (n, n.upper(), n.title())) + r")$") for f in FORMATS])
    if not names.select("path").filter(unnamed).isEmpty():
        parts.append(read_segments(_described(names.filter(unnamed))))
    return reduce(DataFrame.unionByName, parts)


def selectable(segments: DataFrame) -> DataFrame:
    """Segments of chapters that are not skipped (a chapter without segments has no row)."""
    return segments.filter(~F.coalesce("is_skipped", F.lit(False)))


def chapter_range(segments: DataFrame, first: int, last: int) -> DataFrame:
    """Segments of the chapters first..last, counted from 1 over the selectable ones of each document."""
    chosen = selectable(segments)
    chapters = chosen.select("doc_id", "chapter_ord").distinct().withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("chapter_ord")))
    return chosen.join(chapters.filter(F.col("n").between(first, last)), ["doc_id", "chapter_ord"], "left_semi")


__all__ = ["COLUMNS", "chapter_range", "read_files", "read_folder", "read_segments", "selectable"]
