"""Problem 8: mix sources to target shares of the total size in tokens.

Documents are counted by exact length in tokens. A source first takes whole
passes over its documents, then the same part of every length, and a bounded
knapsack (subset sums as a bitset) spends what is left of its budget to the
token. Which documents of a length are taken is decided by a seeded hash.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galley.llm.tokens import token_ids
from galley.session import checkpointed, table

SEED = 17
_WINDOW = 1 << 16  # tokens that the knapsack may have to fit
_RANK_BLOCK = 50_000


def fit(counts: dict[int, int], budget: int, seed: int = SEED) -> dict[int, int]:
    """How many items of each length to take so that they fill ``budget`` as far as possible.

    ``counts`` {length > 0: items}. Proportional to the counts first, so that no
    length is preferred; then the longest that still fit, down to a window that the
    knapsack fills exactly where any combination can. The same counts and seed give the
    same choice.
    """
    total = sum(s * n for s, n in counts.items())
    if budget >= total:
        return dict(counts)
    part = max(0, budget - _WINDOW)
    take = {s: n * part // total for s, n in counts.items()}
    left = budget - sum(s * n for s, n in take.items())
    for s in sorted(counts, reverse=True):
        if left <= _WINDOW:
            break
        more = min(counts[s] - take[s], (left - _WINDOW + s - 1) // s, left // s)
        take[s] += more
        left -= more * s
    rest = sorted(s for s in counts if s <= left and counts[s] > take[s])  # in one order, whatever that of the counts
    random.Random(seed).shuffle(rest)
    mask, reach, steps = (1 << (left + 1)) - 1, 1, []
    for s in rest:
        n, k = min(counts[s] - take[s], left // s), 1
        while n > 0 and not reach >> left & 1:
            k = min(k, n)
            steps.append((s, k, reach))
            reach |= (reach << (s * k)) & mask
            n, k = n - k, k * 2
        if reach >> left & 1:
            break
    goal = reach.bit_length() - 1
    for s, k, before in reversed(steps):
        if not before >> goal & 1:
            take[s] += k
            goal -= s * k
    return take


def _sized(docs: DataFrame, targets: DataFrame, path: str | None) -> tuple[DataFrame, DataFrame]:
    key = lambda c: F.lower(F.trim(c))
    wanted = targets.filter("weight > 0 AND max_repeats > 0 AND source IS NOT NULL").groupBy(key(F.col("source")).alias("source")).agg(F.sum("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    listed = docs.select("doc_id", "text", key(F.col("source")).alias("source")).join(wanted.select("source"), "source", "left_semi")
    # sizes of the listed documents with their sources; the texts are gone by now
    return wanted, checkpointed(token_ids(listed, path, count_only=True, carry="source"))


def mix(docs: DataFrame, targets: DataFrame, path: str | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The mixture (doc_id, source, n_tokens, repeats, target_share, actual_share) and its report.

    ``docs`` (doc_id unique, text, source), ``targets`` (source, weight, max_repeats).
    The total is the largest at which no source with documents lacks any. Sources are
    compared without case and outer blanks; documents of other or null sources and
    those without tokens (null, empty) stay out. A wanted source without documents is
    reported with 0 tokens; targets listed twice are added up. An empty table gives an
    empty mixture.
    """
    spark = docs.sparkSession
    wanted, sized = _sized(docs, targets, path)
    hist = checkpointed(sized.filter("n_tokens > 0").groupBy("source", "n_tokens").count())
    have = {r["source"]: r["size"] for r in hist.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("count")).alias("size")).collect()}  # a row a target
    goals = {r["source"]: (r["weight"], r["max_repeats"]) for r in wanted.collect()}
    weights = sum(w for w, _ in goals.values())
    total = min((have[s] * m * weights / w for s, (w, m) in goals.items() if s in have), default=0)
    budget = {s: min(int(total * w / weights), have.get(s, 0) * m) for s, (w, m) in goals.items()}
    plan_of = {s: (budget[s] // have[s], budget[s] % have[s]) for s in have}

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        # one row a length: no more than the square root of twice the source's tokens
        source = group["source"].iloc[0]
        passes, rest = plan_of[source]
        counts = dict(zip(group["n_tokens"].tolist(), group["count"].tolist()))
        take = fit(counts, rest, seed)
        return pd.DataFrame({"source": source, "n_tokens": list(counts), "n": list(counts.values()), "passes": passes, "extra": [take[s] for s in counts]})

    plan = checkpointed(hist.groupBy("source").applyInPandas(choose, "source string, n_tokens bigint, n bigint, passes bigint, extra bigint"))
    used = plan.groupBy("source").agg(F.sum(F.col("n_tokens") * (F.col("n") * F.col("passes") + F.col("extra"))).alias("tokens"))
    reached = {r["source"]: r["tokens"] for r in used.collect()}
    whole = sum(reached.values())
    rows = [(s, w / weights, budget[s], reached.get(s, 0), reached.get(s, 0) / whole if whole else 0.0) for s, (w, _) in sorted(goals.items())]
    report = spark.createDataFrame(rows, "source string, target_share double, budget_tokens bigint, tokens bigint, actual_share double")

    # which documents of a length: ranks by a seeded hash, in blocks so that a hot length is spread
    keyed = sized.filter("n_tokens > 0").join(plan, ["source", "n_tokens"]).filter("passes > 0 OR extra > 0")
    some = (F.col("extra") > 0) & (F.col("extra") < F.col("n"))
    h = F.xxhash64(F.lit(seed), "doc_id")
    ranked = keyed.filter(some).withColumn("h", h).withColumn("block", F.pmod("h", F.greatest(F.lit(1), F.ceil(F.col("n") / _RANK_BLOCK))))
    sums = ranked.groupBy("source", "n_tokens", "block").count()
    sums = sums.withColumn("offset", F.sum("count").over(Window.partitionBy("source", "n_tokens").orderBy("block")) - F.col("count")).drop("count")
    r = F.row_number().over(Window.partitionBy("source", "n_tokens", "block").orderBy("h", "doc_id"))
    ranked = ranked.withColumn("r", r).join(sums, ["source", "n_tokens", "block"])
    chosen = (F.col("r") + F.col("offset") <= F.col("extra")).cast("bigint")
    cols = ["doc_id", "source", "n_tokens"]
    out = keyed.filter(~some).select(*cols, (F.col("passes") + (F.col("extra") > 0).cast("bigint")).alias("repeats")).unionByName(ranked.select(*cols, (F.col("passes") + chosen).alias("repeats")))
    shares = report.select("source", "target_share", "actual_share")
    return out.filter("repeats > 0").withColumn("repeats", F.col("repeats").cast("int")).join(shares, "source"), report


def p8_mix(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0].select("doc_id", "source", "n_tokens", "repeats", "target_share", "actual_share")


def p8_shares(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


QUERIES = {"p8_mix": p8_mix, "p8_shares": p8_shares}
SQL: dict[str, str] = {}
