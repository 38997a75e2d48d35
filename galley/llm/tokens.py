"""Problem 7: the token ids of a public byte-level BPE for every document.

A long text is cut into overlapping chunks that are pre-tokenised in parallel.
The pre-token pattern never looks behind, so once two neighbouring chunks share
a pre-token boundary they agree from there on: the first shared boundary of an
overlap is where the pieces are stitched. The pieces are then encoded in
parallel and their ids joined. A text whose chunks share no boundary (one huge
run of letters) is encoded whole, which is always exact.
"""

from __future__ import annotations

import base64

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galley.llm.batches import map_columns
from galley.session import checkpointed, table

CHUNK, OVERLAP, MARGIN = 16_384, 256, 16
_IDS = pa.list_(pa.int32())


def vocabulary(path: str | None = None, name: str = "byte_bpe_50k"):
    """The public vocabulary as a tiktoken encoding and its pre-token pattern.

    ``path`` is the folder of the tokenizer files; by default the installed
    ``public_tokenizers`` package tells it. No special token is known, so
    strings that look like one are ordinary text.
    """
    import public_tokenizers as P
    import tiktoken

    file = f"{path}/{name}.tiktoken" if path else P.path(f"{name}.tiktoken")
    with open(file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), P.PATTERN


def boundaries(pattern: regex.Pattern, text: str) -> list[int]:
    """Ends of pre-tokens at which ``text`` can be divided.

    Such an end lies so far from the end of ``text`` that this cannot have changed it,
    and not after white space: the pattern looks ahead from white space only, so a
    piece that ends with anything else has the same pre-tokens alone.
    """
    last = len(text) - MARGIN
    return [e for m in pattern.finditer(text) if (e := m.end()) <= last and not text[e - 1].isspace()]


def _encode(df: DataFrame, path: str | None, keys: str, arrow_keys: list, count_only: bool) -> DataFrame:
    """``df`` (keys..., text) to (keys..., ids) or (keys..., n_tokens)."""
    names = [k for k, _ in arrow_keys]
    arrow = pa.schema([*arrow_keys, ("n_tokens", pa.int64()) if count_only else ("ids", _IDS)])

    def make():
        encode = vocabulary(path)[0].encode_ordinary

        def run(c):
            ids = [encode(t) if t else [] for t in c["text"]]
            return {n: c[n] for n in names} | ({"n_tokens": [len(x) for x in ids]} if count_only else {"ids": ids})

        return run

    return map_columns(df.select(*names, "text"), make, keys + (", n_tokens bigint" if count_only else ", ids array<int>"), arrow)


def _chunk_pieces(long: DataFrame, path: str | None, chunk: int, overlap: int) -> DataFrame:
    """(doc_id, chunk_no, text, whole): the pieces to encode of every long text."""
    # cut once, from front to back; a chunk takes its overlaps from its neighbours
    cut = long.select("doc_id", F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0)).alias("c"))
    near = lambda take, i: F.coalesce(take(F.get("c", i), F.lit(overlap)), F.lit(""))
    with_near = F.transform("c", lambda x, i: F.concat(near(F.right, i - 1), x, near(F.left, i + 1)))
    parts = cut.select("doc_id", F.posexplode(with_near).alias("chunk_no", "text"))
    parts = parts.select("doc_id", "chunk_no", F.greatest(F.lit(0), F.col("chunk_no") * chunk - overlap).alias("at"), "text")
    parts = parts.repartition("doc_id", "chunk_no")  # the chunks of one text are spread over tasks

    arrow = pa.schema([("doc_id", pa.int64()), ("chunk_no", pa.int32()), ("at", pa.int32()), ("text", pa.string()), ("first", _IDS), ("last", _IDS)])

    def make():
        pattern = regex.compile(vocabulary(path)[1])

        def run(c):
            first, last = [], []
            for at, text in zip(c["at"], c["text"]):
                ends = boundaries(pattern, text)
                first.append([at + e for e in ends if e <= 2 * overlap])
                last.append([at + e for e in ends if e >= len(text) - 2 * overlap])
            return c | {"first": first, "last": last}

        return run

    seen = map_columns(parts, make, "doc_id bigint, chunk_no int, at int, text string, first array<int>, last array<int>", arrow)
    w = Window.partitionBy("doc_id").orderBy("chunk_no")
    shared = F.array_min(F.array_intersect(F.lag("last").over(w), "first"))
    following = F.array_min(F.array_intersect(F.col("last"), F.lead("first").over(w)))
    final = F.lead("chunk_no").over(w).isNull()
    cut = seen.select("doc_id", "chunk_no", "at", "text", F.when(F.col("chunk_no") == 0, 0).otherwise(shared).alias("a"), F.when(final, F.col("at") + F.length("text")).otherwise(following).alias("b"))
    cut = cut.withColumn("whole", F.max((F.col("a").isNull() | F.col("b").isNull()).cast("int")).over(Window.partitionBy("doc_id")))
    return cut.select("doc_id", "chunk_no", F.expr("substring(text, a - at + 1, b - a)").alias("text"), "whole")


def token_ids(docs: DataFrame, path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, count_only: bool = False, carry: str | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): ``ids``, or ``n_tokens`` with ``count_only``.

    A string column ``carry`` of ``docs`` goes with the rows.

    A null and an empty text have the empty list; doc_id must be unique, null
    included. Other columns of ``docs`` are ignored.
    """
    if chunk < 4 * overlap or overlap <= MARGIN:
        raise ValueError("a chunk must hold four overlaps, an overlap more than the margin")
    extra = [carry] if carry else []
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *extra)
    long = F.coalesce(F.length("text"), F.lit(0)) > chunk
    key, akey = "doc_id bigint" + "".join(f", {c} string" for c in extra), [("doc_id", pa.int64())]
    akeys = [*akey, *((c, pa.string()) for c in extra)]
    short = _encode(docs.filter(~long), path, key, akeys, count_only)
    pieces = checkpointed(_chunk_pieces(docs.filter(long), path, chunk, overlap))
    coded = _encode(pieces.filter("whole = 0"), path, "doc_id bigint, chunk_no int", [*akey, ("chunk_no", pa.int32())], count_only)
    if count_only:
        joined = coded.groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"))
    else:
        joined = coded.groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "ids"))), lambda x: x["ids"])).alias("ids"))
    if extra:
        joined = joined.join(docs.filter(long).select("doc_id", *extra), "doc_id").select(*short.columns)
    whole = docs.filter(long).join(pieces.filter("whole = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    return short.unionByName(joined).unionByName(_encode(whole, path, key, akeys, count_only))


def decode(ids: list[int], path: str | None = None) -> str:
    """The text of ``ids``: the tokens' raw bytes, joined and read as UTF-8."""
    enc = vocabulary(path)[0]
    return b"".join(enc.decode_single_token_bytes(i) for i in ids).decode("utf-8")


def p7_ids(spark, sf_dir: str) -> DataFrame:
    return token_ids(table(spark, sf_dir, "documents"))


def decoded(coded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of ``coded`` (doc_id, ids): what ``decode`` makes of the ids; null ids are an empty text."""
    arrow = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def make():
        encoding = vocabulary(path)[0]
        return lambda c: {"doc_id": c["doc_id"], "text": [encoding.decode_bytes(x).decode("utf-8") if x else "" for x in c["ids"]]}

    return map_columns(coded.select("doc_id", "ids"), make, "doc_id bigint, text string", arrow)


def p7_decoded(spark, sf_dir: str) -> DataFrame:
    """Every document back from its ids."""
    return decoded(p7_ids(spark, sf_dir)).select("doc_id", F.md5("text").alias("digest"))


QUERIES = {"p7_ids": p7_ids, "p7_decoded": p7_decoded}
SQL: dict[str, str] = {"p7_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents"}
