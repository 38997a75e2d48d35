"""Problem 4: repetition within an answer, and lines that many answers repeat.

The share is measured within one text, which counts of lines over documents cannot
give; so this follows stretches of words (characters in Chinese and Japanese)
through a table of hashed n-grams of the same text instead. The line frequencies
over the documents of a host stand beside it: ``without_frequent_lines``.
"""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.functions.text import WS
from galley.llm.batches import map_columns
from galley.session import checkpointed, table

WORDS, CHARS, SHARE = 6, 12, 0.35
#: A line that more documents of its host have is removed; a document that keeps less than this share of its signs is rejected.
LINE_DOCS, KEPT = 3, 0.5

_BULLET = regex.compile(r"^[ \t]*(?:[-*•–—·>]+[ \t]+|[#]+[ \t]+|[(\[]?\p{N}{1,4}[.)\]:、．][ \t]*(?!\p{N})|[(\[]?\p{L}[)\]][ \t]+)+", regex.M)
_IGNORED = regex.compile(r"[\u00ad\u200b-\u200f\u2060-\u2064\ufeff'\u2019]")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_EAST = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー々]")
_LETTER = regex.compile(r"\p{L}")
_SIGN = regex.compile(r"[\p{L}\p{M}\p{N}]")


def units(text: str) -> tuple[list[str], int]:
    """The words or characters of ``text`` that count, and the length of a stretch."""
    plain = _IGNORED.sub("", _BULLET.sub("", text)).casefold()
    east = len(_EAST.findall(plain))
    if east * 2 > len(_LETTER.findall(plain)):
        return _SIGN.findall(plain), CHARS
    return _WORD.findall(plain), WORDS


def repeated_share(text: str | None) -> float:
    """Share of ``text`` within stretches that already began earlier; 0.0 for none.

    Null, empty and blank texts and texts shorter than a stretch have 0.0. Time and
    memory grow with the length of the text, not with its square.
    """
    if not text:
        return 0.0
    seq, n = units(text)
    seen: set = set()
    covered = upto = 0
    for i in range(len(seq) - n + 1):
        gram = tuple(seq[i : i + n])
        if gram in seen:
            covered += i + n - max(i, upto)
            upto = i + n
        else:
            seen.add(gram)
    return covered / len(seq) if seq else 0.0


def with_repeated_share(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, share) of every row of ``df``; nothing is shuffled."""
    arrow = pa.schema([("id", pa.int64()), ("share", pa.float64())])
    make = lambda: lambda c: {"id": c["id"], "share": [repeated_share(t) for t in c["text"]]}
    return map_columns(df.select(F.col(key).alias("id"), F.col(text).alias("text")), make, "id bigint, share double", arrow).withColumnRenamed("id", key)


def without_frequent_lines(df: DataFrame, key: str, host: str, text: str, limit: int = LINE_DOCS, kept: float = KEPT) -> DataFrame:
    """(key, n_lines, n_removed, kept_share, rejected) of every row of ``df``: cross-document line frequency.

    Lines are compared in small letters, without bullets and with single blanks, by
    hash. A line is removed if more than ``limit`` documents of its host have it; a
    row is rejected if lines remain to less than ``kept`` of its signs. Blank lines
    count for nothing; a text without lines (null, empty, blank) keeps 1.0 of them.
    Documents of a null host have a host in common; ``key`` is unique. A hot host is
    spread by its lines, a hot line summed before it is shuffled.
    """
    plain = F.lower(F.regexp_replace(F.regexp_replace("line", rf"^[{WS}]*(?:[-*•–—·>#]+[ \t]+|[0-9]{{1,4}}[.)][ \t]+)?", ""), rf"[{WS}]+", " "))
    each = df.select(F.col(key).alias("id"), F.col(host).alias("host"), F.explode(F.split(F.regexp_replace(F.col(text), r"\r\n?", "\n"), "\n")).alias("line"))
    each = each.select("id", "host", F.trim(plain).alias("line")).filter("line <> ''").select("id", "host", F.xxhash64("line").alias("h"), F.length("line").alias("n"))
    lines = checkpointed(each.groupBy("id", "host", "h").agg(F.count("*").alias("times"), F.sum("n").alias("signs")))
    frequent = lines.groupBy("host", "h").count().filter(F.col("count") > limit).select(F.col("host").alias("fhost"), F.col("h").alias("fh"))
    met = lines.join(frequent, F.col("host").eqNullSafe(F.col("fhost")) & (F.col("h") == F.col("fh")), "left")
    gone = F.col("fh").isNotNull()
    sums = met.groupBy("id").agg(F.sum("times").alias("n_lines"), F.sum(F.when(gone, F.col("times")).otherwise(0)).alias("n_removed"), F.sum("signs").alias("signs"), F.sum(F.when(gone, 0).otherwise(F.col("signs"))).alias("left"))
    out = df.select(F.col(key).alias("id")).join(sums, "id", "left")
    none = F.lit(0).cast("bigint")
    share = F.coalesce(F.col("left") / F.col("signs"), F.lit(1.0))
    return out.select(F.col("id").alias(key), F.coalesce("n_lines", none).alias("n_lines"), F.coalesce("n_removed", none).alias("n_removed"), share.alias("kept_share"), (share < kept).alias("rejected"))


def p4_found(spark, sf_dir: str) -> DataFrame:
    return with_repeated_share(table(spark, sf_dir, "edits"), "edit_id", "after").filter(F.col("share") >= SHARE).select("edit_id")


def p4_shares(spark, sf_dir: str) -> DataFrame:
    return with_repeated_share(table(spark, sf_dir, "edits"), "edit_id", "after")


def p4_lines(spark, sf_dir: str) -> DataFrame:
    return without_frequent_lines(table(spark, sf_dir, "edits"), "edit_id", "book_id", "after")


QUERIES = {"p4_found": p4_found, "p4_shares": p4_shares, "p4_lines": p4_lines}

_BLANKS = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# Units as rows, the first place of each stretch, and a window over the stretches that reach a unit.
_SHARES = r"""WITH t AS (SELECT edit_id, lower(regexp_replace(regexp_replace(coalesce(after, ''), '(?m)^[ \t]*(?:[-*•–—·>]+[ \t]+|#+[ \t]+|[(\[]?\pN{1,4}[.)\]:、．](?:[ \t]+|([^\pN \t]))|[(\[]?\pL[)\]][ \t]+)+', '\1', 'g'), '[\x{00AD}\x{200B}-\x{200F}\x{2060}-\x{2064}\x{FEFF}''\x{2019}]', '', 'g')) AS s FROM edits),
k AS (SELECT edit_id, s, 2 * len(regexp_extract_all(s, '[\p{Han}\p{Hiragana}\p{Katakana}ー々]')) > len(regexp_extract_all(s, '\pL')) AS east FROM t),
w AS (SELECT edit_id, CASE WHEN east THEN 12 ELSE 6 END AS n, CASE WHEN east THEN regexp_extract_all(s, '[\pL\pM\pN]') ELSE regexp_extract_all(s, '[\pL\pM\pN]+') END AS u FROM k),
g AS (SELECT edit_id, n, len(u) AS total, i, CASE WHEN i + n - 1 <= len(u) THEN array_to_string(u[i : i + n - 1], ' ') END AS gram FROM (SELECT *, unnest(range(1, len(u) + 1)) AS i FROM w)),
r AS (SELECT edit_id, n, total, i, CASE WHEN gram IS NOT NULL AND i > min(i) OVER (PARTITION BY edit_id, gram) THEN i END AS again FROM g),
c AS (SELECT edit_id, total, i - max(again) OVER (PARTITION BY edit_id ORDER BY i) < n AS covered FROM r),
shares AS (SELECT edits.edit_id, coalesce(s, 0.0) AS share FROM edits LEFT JOIN (SELECT edit_id, count(*) FILTER (covered) / max(total) AS s FROM c GROUP BY edit_id) USING (edit_id))"""
SQL: dict[str, str] = {
    "p4_shares": _SHARES + " SELECT edit_id, share FROM shares",
    "p4_found": _SHARES + " SELECT edit_id FROM shares WHERE share >= 0.35",
    "p4_lines": rf"""WITH l AS (SELECT edit_id, book_id, trim(lower(regexp_replace(regexp_replace(line, '^[{_BLANKS}]*(?:[-*•–—·>#]+[ \t]+|[0-9]{{1,4}}[.)][ \t]+)?', ''), '[{_BLANKS}]+', ' ', 'g'))) AS line
FROM (SELECT edit_id, book_id, unnest(string_split(regexp_replace(after, '\r\n?', chr(10), 'g'), chr(10))) AS line FROM edits)),
d AS (SELECT * FROM l WHERE line <> ''),
f AS (SELECT book_id, line FROM d GROUP BY book_id, line HAVING count(DISTINCT edit_id) > 3),
s AS (SELECT edit_id, count(*) AS n_lines, count(f.line) AS n_removed, sum(length(d.line)) AS signs, sum(CASE WHEN f.line IS NULL THEN length(d.line) ELSE 0 END) AS kept FROM d LEFT JOIN f ON d.book_id IS NOT DISTINCT FROM f.book_id AND d.line = f.line GROUP BY edit_id)
SELECT edit_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(kept / signs, 1.0) AS kept_share, coalesce(kept / signs, 1.0) < 0.5 AS rejected FROM edits LEFT JOIN s USING (edit_id)""",
}
