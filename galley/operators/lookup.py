"""Small lookups by rank: members of archives, models, device tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def match_members(wanted: DataFrame, members: DataFrame) -> DataFrame:
    """(doc_id, file_name, member): the archive member a reference means, null where none or several could be.

    Exact name first, then the only member with it as path suffix, then the only one with
    its base name. ``wanted`` (doc_id, file_name), ``members`` (doc_id, member).
    """
    key = F.regexp_replace(F.replace("file_name", F.lit("\\"), F.lit("/")), r"^[./]+", "")
    name = F.replace("member", F.lit("\\"), F.lit("/"))
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    w = wanted.select("doc_id", "file_name", key.alias("k"))
    m = members.select("doc_id", "member", name.alias("m"), base(name).alias("b"))
    met = w.join(m, ["doc_id"]).filter((F.col("k") != "") & (F.col("b") == base(F.col("k"))))
    rank = F.when(F.col("member") == F.col("k"), 1).when((F.col("m") == F.col("k")) | F.endswith("m", F.concat(F.lit("/"), F.col("k"))), 2).otherwise(3)
    best = met.select("doc_id", "file_name", "member", rank.alias("r")).groupBy("doc_id", "file_name").agg(
        F.min(F.when(F.col("r") == 1, F.col("member"))).alias("exact"), F.sum((F.col("r") <= 2).cast("int")).alias("n2"), F.min(F.when(F.col("r") <= 2, F.col("member"))).alias("suffix"), F.count("*").alias("n3"), F.min("member").alias("base")
    )
    chosen = F.coalesce("exact", F.when(F.col("n2") == 1, F.col("suffix")), F.when(F.col("n3") == 1, F.col("base")))
    return wanted.select("doc_id", "file_name").join(best.select("doc_id", "file_name", chosen.alias("member")), ["doc_id", "file_name"], "left")


def billions(model: Column) -> Column:
    """Parameters in billions told by a model's name, or null."""
    low = F.lower(model)
    told = F.regexp_extract(low, r"(\d+(?:\.\d+)?)\s*b(?![\p{L}\p{N}_])", 1)
    return F.when(told != "", told.cast("double")).when(low.rlike("e4b|e2b"), 4.0).when(low.rlike("e1b"), 1.0)


def is_reasoning(model: Column) -> Column:
    return F.lower(model).rlike("deepseek-r1|qwq|thinking|:r1|reasoner")


def pick_model(models: DataFrame, cap: float, key: str) -> DataFrame:
    """(key, model): the largest sized model within the cap, else the first other, else the first reasoning one."""
    size = billions(F.col("model"))
    kind = F.when(is_reasoning(F.col("model")), 2).when(size <= cap + 0.2, 0).otherwise(1)
    ranked = models.select(key, "ord", "model", kind.alias("kind"), size.alias("size"))
    place = F.struct("kind", F.when(F.col("kind") == 0, -F.col("size")).alias("s"))
    order = Window.partitionBy(key).orderBy(place, F.when(F.col("kind") == 0, F.col("model")).desc(), "ord")
    return ranked.withColumn("r", F.row_number().over(order)).filter("r = 1").select(key, "model")


# Usable video memory in MB and what it carries.
TIERS = [(20000, 32.0, 8192, 2400, 1, "auto"), (10500, 14.0, 4096, 1800, 2, "auto"), (7000, 8.0, 4096, 1400, 1, "auto"), (4500, 7.0, 2048, 1000, 1, "aggressive"), (0, 3.0, 2048, 800, 1, "aggressive")]


def device_tier(vram_mb: Column) -> Column:
    """What a graphics card carries: (max_params_b, num_ctx, max_chars, workers, skip_mode)."""
    usable = F.greatest(vram_mb - 900, F.lit(2048))
    tier = lambda t: F.struct(F.lit(t[1]).alias("max_params_b"), F.lit(t[2]).alias("num_ctx"), F.lit(t[3]).alias("max_chars"), F.lit(t[4]).alias("workers"), F.lit(t[5]).alias("skip_mode"))
    out = F.when(usable >= TIERS[0][0], tier(TIERS[0]))
    for t in TIERS[1:]:
        out = out.when(usable >= t[0], tier(t))
    return out


def clamped(tier: Column, model: Column, backend: Column, vram_mb: Column) -> Column:
    """A tier fitted to the model that will run on it; the first rule that holds, then that for reasoning models."""
    size, gpu = billions(model), backend.isin("cuda", "vulkan")
    big = size > tier["max_params_b"] + 0.1
    snug = (size >= 12) & gpu & (vram_mb < 16000)
    roomy = (size <= 8) & gpu & (vram_mb >= 10500)
    workers = F.when(size.isNull() | big | snug, 1).when(roomy, F.greatest(tier["workers"], F.lit(2))).otherwise(tier["workers"])
    ctx = F.when(big, F.least(tier["num_ctx"], F.lit(2048))).when(snug, F.least(tier["num_ctx"], F.lit(4096))).otherwise(tier["num_ctx"])
    chars = F.when(big, F.least(tier["max_chars"], F.lit(900))).when(snug, F.least(tier["max_chars"], F.lit(1800))).otherwise(tier["max_chars"])
    skip = F.when(big | is_reasoning(model), "aggressive").otherwise(tier["skip_mode"])
    return F.struct(tier["max_params_b"].alias("max_params_b"), ctx.alias("num_ctx"), chars.alias("max_chars"), F.when(is_reasoning(model), 1).otherwise(workers).alias("workers"), skip.alias("skip_mode"))


def weights_billions(max_params_b: Column) -> Column:
    """Size of the largest weights, of 14, 7 and 3 billion parameters, that a tier carries."""
    return F.when(max_params_b >= 12, 14).when(max_params_b >= 7, 7).otherwise(3)
