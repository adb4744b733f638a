"""What the operators of this folder share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.storage import discard, fresh_path, materialize, shared_dir  # noqa: F401

_WORKER: dict = {}


def one(df: DataFrame, *cols: str) -> DataFrame:
    """Only the named columns, by exact name, so that extra columns of the input cannot clash with ours."""
    return df.select(*[F.col(f"`{c}`") for c in cols])


def null_key(c: Column) -> Column:
    """A value to group or join by in which null equals null and nothing else."""
    return F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), c.cast("string")))


def byte_slices(batch: pa.RecordBatch, column: int, limit: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts have about `limit` bytes at most, or one row."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes, dtype=np.int64) // limit
    edges = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def worker_state() -> dict:
    """A dict that lives as long as the Python worker. To be reached through this function: a task's closure would carry a copy."""
    return _WORKER
