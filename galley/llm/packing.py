"""Problem 5: fill prompts of fixed capacity with as little unused room as possible.

Minimum bin slack per group: for each bin, a bitset subset-sum over the lengths
still there finds the fullest feasible combination, which is removed and taken
again as often as its lengths allow. Only the histogram of lengths of a group
goes through Python: at most one entry per length up to the capacity, whatever
the number of items. The items then take their places by rank within their length.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galley.llm.batches import map_columns
from galley.session import checkpointed, table

CAPACITY, OVERHEAD = 1200, 32
_RANK_BLOCK = 50_000


def fill_bins(sizes: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(combination {size: count}, times) of the bins for ``sizes`` {size: count}.

    Sizes must lie in 1..capacity. Of equally full combinations, one with the
    larger items is taken, so that small ones stay to fill later gaps.
    """
    left = {s: n for s, n in sorted(sizes.items(), reverse=True) if n > 0}
    if any(not 0 < s <= capacity for s in left):
        raise ValueError("sizes must lie between 1 and the capacity")
    mask, bins = (1 << (capacity + 1)) - 1, []
    while left:
        # small items first, so that tracing back from the end uses the large ones first
        reach, steps = 1, []
        for size in sorted(left):
            n, take = min(left[size], capacity // size), 1
            while n > 0:
                take = min(take, n)
                steps.append((size, take, reach))
                reach |= (reach << (size * take)) & mask
                n, take = n - take, take * 2
        full, combo = reach.bit_length() - 1, {}
        for size, take, before in reversed(steps):
            if full >= size * take and before >> (full - size * take) & 1:
                combo[size] = combo.get(size, 0) + take
                full -= size * take
        times = min(left[s] // n for s, n in combo.items())
        bins.append((combo, times))
        for s, n in combo.items():
            left[s] -= n * times
            if not left[s]:
                del left[s]
    return bins


def _places(sizes: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(size, first rank, items per bin, first bin, bins) of each share of each length."""
    out, given, bin_no = [], dict.fromkeys(sizes, 0), 0
    for combo, times in fill_bins(sizes, capacity):
        for size, n in combo.items():
            out.append((size, given[size], n, bin_no, times))
            given[size] += n * times
        bin_no += times
    return out


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``items`` (grp, id, size) into bins: (grp, id, piece_no, n_pieces, piece_size, pack_no).

    Items of a group (a null group is one too) share bins of ``capacity``. An item
    larger than that is divided into pieces that fill a bin each and a rest that
    shares one; ``size`` includes OVERHEAD, which every piece pays again. ``id`` is
    unique. An empty table gives no bins; equal sizes are placed in order of id.
    """
    room = capacity - OVERHEAD
    payload = F.col("size") - OVERHEAD
    n = F.when(F.col("size") > capacity, F.ceil(payload / room)).otherwise(1).cast("int")
    sized = items.select("grp", "id", "size", n.alias("n_pieces"))
    pieces = sized.select("grp", "id", "n_pieces", F.explode(F.expr("sequence(0, n_pieces - 1)")).alias("piece_no"), "size").select(
        "grp", "id", "n_pieces", "piece_no", F.when(F.col("piece_no") < F.col("n_pieces") - 1, capacity).otherwise(F.col("size") - room * (F.col("n_pieces") - 1)).cast("int").alias("piece_size")
    )
    # ranks within a length in blocks of hashed ids: one hot length never meets in one task
    counts = pieces.groupBy("grp", "piece_size").agg(F.count("*").alias("n"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / _RANK_BLOCK)).cast("int")
    hist = checkpointed(counts.withColumn("blocks", blocks))

    arrow = pa.schema([("gk", pa.int64()), ("piece_size", pa.int32()), ("starts", pa.list_(pa.int64())), ("per_bin", pa.list_(pa.int64())), ("first_bin", pa.list_(pa.int64()))])

    def make():
        def run(c):
            out = {k: [] for k in arrow.names}
            for gk, sizes in zip(c["gk"], c["sizes"]):
                by = {}
                for size, start, per, first, _ in _places({x["piece_size"]: x["n"] for x in sizes}, capacity):
                    for at, v in zip(by.setdefault(size, ([], [], [])), (start, per, first)):
                        at.append(v)
                for size, (starts, per, first) in by.items():
                    for name, v in zip(arrow.names, (gk, size, starts, per, first)):
                        out[name].append(v)
            return out

        return run

    keyed = hist.groupBy("grp").agg(F.collect_list(F.struct("piece_size", "n")).alias("sizes"))  # at most ``capacity`` entries
    keyed = checkpointed(keyed.withColumn("gk", F.monotonically_increasing_id()))
    # filling costs much more than its rows weigh: spread by number, not by size
    spread = keyed.select("gk", "sizes").repartition(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), "gk")
    places = map_columns(spread, make, "gk bigint, piece_size int, starts array<bigint>, per_bin array<bigint>, first_bin array<bigint>", arrow)
    places = places.join(keyed.select("gk", "grp"), "gk").drop("gk").withColumnRenamed("grp", "pgrp").withColumnRenamed("piece_size", "psize")

    same = lambda a, b, x, y: F.col(a).eqNullSafe(F.col(b)) & (F.col(x) == F.col(y))
    h = hist.select(F.col("grp").alias("hgrp"), F.col("piece_size").alias("hsize"), "blocks")
    ranked = pieces.join(h, same("grp", "hgrp", "piece_size", "hsize")).withColumn("block", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("id", "piece_no"), F.col("blocks"))).otherwise(0))
    sums = ranked.filter("blocks > 1").groupBy("grp", "piece_size", "block").count()
    before = F.sum("count").over(Window.partitionBy("grp", "piece_size").orderBy("block")) - F.col("count")
    sums = sums.select(F.col("grp").alias("bgrp"), F.col("piece_size").alias("bsize"), F.col("block").alias("bblock"), before.alias("offset"))
    w = Window.partitionBy("grp", "piece_size", "block").orderBy("id", "piece_no")
    ranked = ranked.withColumn("r", F.row_number().over(w) - 1)
    ranked = ranked.join(sums, same("grp", "bgrp", "piece_size", "bsize") & (F.col("block") == F.col("bblock")), "left")
    ranked = ranked.withColumn("r", F.col("r") + F.coalesce("offset", F.lit(0)))
    placed = ranked.join(places, same("grp", "pgrp", "piece_size", "psize"))
    # the last share that starts at or before the rank
    share = F.size(F.filter("starts", lambda s: s <= F.col("r")))
    at = lambda c: F.element_at(c, share)
    pack_no = at("first_bin") + F.floor((F.col("r") - at("starts")) / at("per_bin"))
    return placed.select("grp", "id", "piece_no", "n_pieces", "piece_size", pack_no.cast("bigint").alias("pack_no"))


def place_of(rank: int, starts: list[int], per_bin: list[int], first_bin: list[int]) -> int:
    """The bin of the item with ``rank`` among those of its length (for tests)."""
    k = bisect_right(starts, rank) - 1
    return first_bin[k] + (rank - starts[k]) // per_bin[k]


def job_packs(jobs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Packs of span jobs by chapter: (item_id, pack_no, job_id, piece_no, n_pieces, piece_size)."""
    length = lambda c: F.coalesce(F.length(c), F.lit(0))
    size = length("text") + length("before") + length("after") + OVERHEAD
    out = pack(jobs.select(F.col("item_id").alias("grp"), F.col("job_id").alias("id"), size.alias("size")), capacity)
    return out.select(F.col("grp").alias("item_id"), "pack_no", F.col("id").alias("job_id"), "piece_no", "n_pieces", "piece_size")


def p5_found(spark, sf_dir: str) -> DataFrame:
    return job_packs(table(spark, sf_dir, "span_jobs")).filter("n_pieces > 1 AND piece_no = 0").select("job_id")


def p5_packs(spark, sf_dir: str) -> DataFrame:
    return job_packs(table(spark, sf_dir, "span_jobs"))


def p5_totals(spark, sf_dir: str) -> DataFrame:
    """What the packs of each chapter hold: every job once, all of its size, no pack too full."""
    packs = job_packs(table(spark, sf_dir, "span_jobs")).groupBy("item_id", "pack_no").agg(F.count("*").alias("pieces"), F.sum(F.when(F.col("piece_no") == 0, 1).otherwise(0)).alias("jobs"), F.sum("piece_size").alias("size"))
    return packs.groupBy("item_id").agg(F.sum("jobs").alias("n_jobs"), F.sum("pieces").alias("n_pieces"), F.sum("size").alias("size"), (F.max("size") <= CAPACITY).alias("fits"))


QUERIES = {"p5_found": p5_found, "p5_packs": p5_packs, "p5_totals": p5_totals}
SQL = {
    "p5_totals": """SELECT item_id, count(*) AS n_jobs, sum(k)::BIGINT AS n_pieces, sum(s + 32 * (k - 1))::BIGINT AS size, TRUE AS fits FROM (SELECT *, CASE WHEN s > 1200 THEN ceil((s - 32) / 1168.0)::BIGINT ELSE 1 END AS k
FROM (SELECT item_id, coalesce(length(text), 0) + coalesce(length(before), 0) + coalesce(length(after), 0) + 32 AS s FROM span_jobs)) GROUP BY item_id""",
    "p5_found": "SELECT job_id FROM span_jobs WHERE coalesce(length(text), 0) + coalesce(length(before), 0) + coalesce(length(after), 0) + 32 > 1200"}
