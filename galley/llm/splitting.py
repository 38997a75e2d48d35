"""Problem 1: cut oversized texts at natural boundaries, with an overlap.

Every position of a text has a boundary strength; a sparse table answers the
range-maximum queries. The keys hold strength and position together, so that
the maximum is the strongest cut and, among equals, the rightmost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.llm.batches import map_columns
from galley.session import table

LIMIT, OVERLAP = 1000, 100

_STRENGTHS = [  # ascending: a later match at the same place wins
    (1, regex.compile(r"\s+")),
    (2, regex.compile(r"[,،、，]\s*")),
    (3, regex.compile(r"(?:[;:：；؛][\"”»’)\]」]*\s+|\s[—–-]\s+|[；：])")),
    (4, regex.compile(r"(?:[.!?…؟]+[\"”»’)\]」』]*\s+|[。！？।]+[”」』）\"]*\s*)")),
    (5, regex.compile(r"(?:\r\n|[\n\r\f\u2028])[ \t]*")),
    (6, regex.compile(r"(?:(?:\r\n|\n|\r)[ \t]*){2,}|\u2029")),
]
_INSIDE = regex.compile(r"(?<=.)[\p{M}\u200d\ufe0f]|(?<=\u200d).", regex.S)
_SLAB = 1 << 15


def _keys(text: str, lo: int, hi: int) -> np.ndarray:
    """Key of each cut position lo..hi (a cut at p ends a piece before p)."""
    strength = np.zeros(hi - lo + 1, np.int64)
    for value, pattern in _STRENGTHS:
        for m in pattern.finditer(text, max(0, lo - 64), min(len(text), hi + 64)):
            if lo <= m.end() <= hi:
                strength[m.end() - lo] = value
    for m in _INSIDE.finditer(text, max(0, lo - 1), min(len(text), hi + 1)):
        if lo <= m.start() <= hi and strength[m.start() - lo] == 0:
            strength[m.start() - lo] = -1
    return (strength << 40) + np.arange(lo, hi + 1)


def _sparse_table(keys: np.ndarray) -> list[np.ndarray]:
    levels = [keys]
    while (width := 1 << len(levels)) <= len(keys):
        last = levels[-1]
        levels.append(np.maximum(last[: len(keys) - width + 1], last[width // 2 : width // 2 + len(keys) - width + 1]))
    return levels


def _best(levels: list[np.ndarray], i: int, j: int) -> int:
    k = (j - i + 1).bit_length() - 1
    return int(max(levels[k][i], levels[k][j - (1 << k) + 1]))


def pieces(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces of ``text``; a null text has none.

    A piece has at most ``limit`` code points and starts ``overlap`` before the
    end of the one before. The cut is the strongest, among equals the last, at any
    permissible length: more than ``overlap``, so that the next piece starts later,
    and at most ``limit``. Where no border exists at all it is the last position that
    divides no character cluster.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half of the limit")
    if text is None:
        return []
    n, start, out = len(text), 0, []
    lo, hi, levels = 0, -1, []
    while n - start > limit:
        if start + limit > hi:  # the table covers one slab, whatever the text's length
            lo, hi = start, min(n, start + max(_SLAB, 2 * limit))
            levels = _sparse_table(_keys(text, lo, hi))
        key = _best(levels, start + overlap + 1 - lo, start + limit - lo)
        end = key & ((1 << 40) - 1)
        out.append((start, end))
        start = end - overlap
    out.append((start, n))
    return out


_SCHEMA = "src string, row_id bigint, piece_no int, n_pieces int, start int, text string"
_ARROW = pa.schema([("src", pa.string()), ("row_id", pa.int64()), ("piece_no", pa.int32()), ("n_pieces", pa.int32()), ("start", pa.int32()), ("text", pa.string())])


def split_oversized(df: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of the rows of ``df`` (src, row_id, text) that exceed ``limit``.

    Shorter texts are whole already and are filtered before Python sees them;
    null and empty texts are never oversized. Repeated rows give repeated pieces.
    No shuffle: a text is cut where it is read.
    """

    def make():
        def run(c):
            out = {k: [] for k in _ARROW.names}
            for src, row, text in zip(c["src"], c["row_id"], c["text"]):
                cut = pieces(text, limit, overlap)
                for k, (a, b) in enumerate(cut):
                    for name, v in zip(_ARROW.names, (src, row, k, len(cut), a, text[a:b])):
                        out[name].append(v)
            return out

        return run

    long = df.select("src", "row_id", "text").filter(F.length("text") > limit)
    return map_columns(long, make, _SCHEMA, _ARROW)


def _texts(spark, sf_dir: str) -> DataFrame:
    seg = table(spark, sf_dir, "segments").select(F.lit("segments").alias("src"), F.col("seg_id").alias("row_id"), "text")
    span = table(spark, sf_dir, "spans").select(F.lit("spans").alias("src"), F.col("span_id").alias("row_id"), "text")
    return seg.unionByName(span)


def p1_found(spark, sf_dir: str) -> DataFrame:
    return split_oversized(_texts(spark, sf_dir)).filter("piece_no = 0 AND n_pieces > 1").select("src", "row_id")


def p1_pieces(spark, sf_dir: str) -> DataFrame:
    return split_oversized(_texts(spark, sf_dir))


def p1_whole(spark, sf_dir: str) -> DataFrame:
    """Every oversized text put together again from its pieces without their overlaps, and whether all pieces keep the limit."""
    pieces = split_oversized(_texts(spark, sf_dir))
    own = F.when(F.col("piece_no") == 0, F.col("text")).otherwise(F.substring("text", OVERLAP + 1, LIMIT))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", own.alias("t")))), lambda x: x["t"]), "")
    return pieces.groupBy("src", "row_id").agg(F.md5(whole).alias("digest"), (F.max(F.length("text")) <= LIMIT).alias("fits"))


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces, "p1_whole": p1_whole}

# Every place of a text with its strength, the best of each window by a frame, then from cut to cut.
_S = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_AT = lambda what: f"regexp_matches(a, '{what}$')"
_NEXT = lambda what: f"regexp_matches(z, '^{what}')"
_CUTS = rf"""WITH RECURSIVE t AS (SELECT * FROM (SELECT 'segments' AS src, seg_id AS row_id, text, length(text) AS n FROM segments UNION ALL SELECT 'spans', span_id, text, length(text) FROM spans) WHERE n > 1000),
p AS (SELECT src, row_id, n, p, CASE WHEN p < 64 THEN left(text, p) ELSE substr(text, p - 63, 64) END AS a, substr(text, p + 1, 64) AS z FROM (SELECT *, unnest(range(0, n + 1)) AS p FROM t)),
k AS (SELECT src, row_id, n, p, CASE
WHEN {_AT(r'((\r\n|\n|\r)[ \t]*){2,}')} AND NOT {_NEXT(r'[ \t\r\n]')} OR {_AT(r'\x{2029}')} THEN 6
WHEN {_AT(r'(\r\n|[\n\r\f\x{2028}])[ \t]*')} AND NOT {_NEXT(r'[ \t]')} AND NOT ({_AT(r'\r')} AND {_NEXT(r'\n')}) THEN 5
WHEN {_AT(r'[.!?…؟][”»’)\]」』"]*' + _S + '+')} AND NOT {_NEXT(_S)} OR {_AT('[。！？।]')} AND NOT {_NEXT('([。！？।”」』）"]|' + _S + ')')} OR {_AT('[。！？।][”」』）"]+')} AND NOT {_NEXT('([”」』）"]|' + _S + ')')} OR {_AT('[。！？।][”」』）"]*' + _S + '+')} AND NOT {_NEXT(_S)} THEN 4
WHEN {_AT(r'[;:：；؛]["”»’)\]」]*' + _S + '+')} AND NOT {_NEXT(_S)} OR {_AT(_S + '[—–-]' + _S + '+')} AND NOT {_NEXT(_S)} OR {_AT('[；：]')} AND NOT {_NEXT(r'["”»’)\]」]*' + _S)} THEN 3
WHEN {_AT('[,،、，]' + _S + '*')} AND NOT {_NEXT(_S)} THEN 2
WHEN {_AT(_S)} AND NOT {_NEXT(_S)} THEN 1
WHEN {_NEXT(r'[\pM\x{200d}\x{fe0f}]')} OR {_AT(r'\x{200d}')} THEN -1 ELSE 0 END AS strength FROM p),
b AS (SELECT src, row_id, n, p, max(strength * 1000000000::BIGINT + p) OVER (PARTITION BY src, row_id ORDER BY p ROWS BETWEEN 101 FOLLOWING AND 1000 FOLLOWING) AS best FROM k),
c AS (SELECT src, row_id, n, p, CASE WHEN n - p > 1000 THEN (best + 1000000000) % 1000000000 ELSE n END AS e FROM b),
r AS (SELECT src, row_id, 0 AS piece_no, 0::BIGINT AS p FROM t UNION ALL SELECT r.src, r.row_id, r.piece_no + 1, c.e - 100 FROM r JOIN c ON r.src = c.src AND r.row_id = c.row_id AND r.p = c.p WHERE c.n - r.p > 1000)
SELECT r.src, r.row_id, r.piece_no, count(*) OVER (PARTITION BY r.src, r.row_id)::INT AS n_pieces, r.p::INT AS start, substr(t.text, r.p + 1, c.e - r.p) AS text FROM r JOIN c ON r.src = c.src AND r.row_id = c.row_id AND r.p = c.p JOIN t ON r.src = t.src AND r.row_id = t.row_id"""
SQL = {
    "p1_pieces": _CUTS,
    "p1_whole": """SELECT 'segments' AS src, seg_id AS row_id, md5(text) AS digest, TRUE AS fits FROM segments WHERE length(text) > 1000
UNION ALL SELECT 'spans', span_id, md5(text), TRUE FROM spans WHERE length(text) > 1000""",
    "p1_found": """SELECT 'segments' AS src, seg_id AS row_id FROM segments WHERE length(text) > 1000
UNION ALL SELECT 'spans', span_id FROM spans WHERE length(text) > 1000"""
}
