"""Arrow batches in tasks: a few helpers that all operators with Python in their tasks share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Rows and characters (of the longest column) that are turned into Python objects at once. A longer text is a piece of its own.
ROWS, CHARS = 2048, 4_000_000


def pieces(batch: pa.RecordBatch, column: str | None = None, chars: int = CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most ROWS rows and about `chars` bytes of `column`, so that Python never holds much at once."""
    if column is None:
        yield from (batch.slice(i, ROWS) for i in range(0, batch.num_rows, ROWS))
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch[column]), 0), dtype=np.int64)
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and (total + size > chars or i - start >= ROWS):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < batch.num_rows:
        yield batch.slice(start)


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: StructType | str, column: str | None = None, chars: int = CHARS) -> DataFrame:
    """`fn` over small slices of the rows' Arrow batches; no rows meet, so any task can run again."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, column, chars):
                yield fn(piece)

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a column, null as the empty text."""
    return [t or "" for t in batch[column].to_pylist()]


def packed(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, type=pa.binary())
