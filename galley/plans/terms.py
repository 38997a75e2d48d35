"""Glossaries built for a run: a file's terms first, then those a rewriter finds in excerpts of each book."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.operators.answers import glossary_terms, without_noise
from galley.operators.glossary import merge
from galley.operators.rounds import Rewriter
from galley.operators.samples import excerpts
from galley.session import checkpointed

SYSTEM = "You list the names and terms of a document with their English forms. Answer with one JSON object: {\"terms\": [{\"source\": \"\", \"target\": \"\", \"type\": \"\", \"notes\": \"\"}]} and no other words."
TASK = "List the terms of this sample of a document:\n\n"
MAX_TOKENS = 1200


def extract_terms(segments: DataFrame, rewriter: Rewriter, order: list[str], key: str = "book_id") -> DataFrame:
    """(key, ord, source, target, kind, notes) that ``rewriter`` finds in excerpts of each document's segments.

    One question a document; what cannot be read as terms gives none, and a document
    without text is not asked about.
    """
    asked = excerpts(segments, key, order).filter("length(text) > 0")
    packs = asked.select(F.col(key).alias("chunk_id"), F.lit(1).alias("n_jobs"), F.concat(F.lit(TASK), "text").alias("prompt"), F.lit(MAX_TOKENS).alias("max_tokens"), F.lit(0).alias("attempt"), F.lit(SYSTEM).alias("system"))
    answers = checkpointed(rewriter(packs).select("chunk_id", "raw"))
    rows = answers.select(F.col("chunk_id").alias(key), F.posexplode(glossary_terms(without_noise(F.col("raw")))).alias("ord", "t"))
    return rows.select(key, "ord", "t.source", "t.target", F.col("t.type").alias("kind"), "t.notes")


def build_glossary(given: DataFrame | None, extracted: DataFrame | None, key: str = "book_id") -> DataFrame:
    """The terms of a run: those given, each with its last target, and of those extracted the ones that are new."""
    if given is None and extracted is None:
        raise ValueError("a glossary needs given or extracted terms")
    own = None if given is None else merge(given.limit(0), given, overwrite=True, key=key)
    if extracted is None:
        return own
    return merge(extracted.limit(0) if own is None else own, extracted, key=key)
