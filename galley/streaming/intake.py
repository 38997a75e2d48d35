"""Documents as they arrive: the stateless stages run on a stream, each batch is planned and written once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from galley.operators.programs import job_table, with_programs


def stream_segments(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of segment files (parquet) as they appear under ``path``."""
    return spark.readStream.schema(schema).parquet(path)


def stream_jobs(segments: DataFrame, mode: str = "polish", skip_mode: str = "auto") -> DataFrame:
    """Rewrite jobs of a stream of segments: routing, units, programs and context need no state."""
    return job_table(with_programs(segments, mode, skip_mode))


def start(jobs: DataFrame, out: str, checkpoint: str, plan: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Writes every batch under its number, so that a batch that runs again replaces itself.

    Packing is per chapter, so ``plan`` may pack a batch if chapters arrive whole.
    """

    def write(batch: DataFrame, number: int) -> None:
        (plan(batch) if plan else batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return jobs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
