"""Arrow batches through Python: the one way this subpackage leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

ROWS = 1000


def map_columns(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str, arrow: pa.Schema) -> DataFrame:
    """Apply a function on columns (name -> list) to every Arrow batch of ``df``.

    ``make`` runs once in each task and returns that function, so compiled
    patterns and vocabularies are built per task and not per batch.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in it:
            for at in range(0, batch.num_rows, ROWS):  # Python objects of a slice at a time
                part = batch.slice(at, ROWS)
                out = f({n: c.to_pylist() for n, c in zip(part.schema.names, part.columns)})
                yield pa.RecordBatch.from_arrays([pa.array(out[x.name], x.type) for x in arrow], schema=arrow)

    return df.mapInArrow(run, schema)
