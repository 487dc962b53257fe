"""Arrow plumbing for the operators that run Python code."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most ``rows`` rows, so that what is made from a piece stays small."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def give_back() -> None:
    """Return the memory that freed arrays leave with the allocators; a driver would keep it for all later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim is not None:
        trim(0)


def map_columns(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str | StructType, rows: int = 512) -> DataFrame:
    """Apply ``fn``, which makes a column dictionary of a small Arrow batch, to every batch of ``df``."""
    kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    assert isinstance(kind, StructType)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, rows):
                made = fn(piece)
                if made is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, kind)
