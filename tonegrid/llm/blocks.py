"""Row-wise text operators: one Arrow pass that appends columns to a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Texts are handed to an operator in blocks of about so many bytes, so that what Python holds does
#: not depend on how many rows Spark puts into an Arrow batch.
BLOCK_CHARS = 3_000_000


def without(df: DataFrame, names: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """``df`` without the columns that clash (in either case) with ``names``."""
    clash = {n.lower() for n in names} - {k.lower() for k in keep}
    return df.select([df[f"`{c}`"] for c in df.columns if c.lower() not in clash])


def set_aside(df: DataFrame, names: list[str]) -> dict[str, str]:
    """New names for the columns of ``df`` that clash (in either case) with ``names``."""
    clash = {n.lower() for n in names}
    return {c: f"own_column_{i}" for i, c in enumerate(df.columns) if c.lower() in clash}


def blocks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches with the values of ``column``, each of about BLOCK_CHARS bytes or one value."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        # Sizes come from the Arrow offsets: only the texts of one slice at a time become Python strings.
        size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start = np.cumsum(size), 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            end = min(max(int(np.searchsorted(ends, before + BLOCK_CHARS)), start) + 1, len(ends))
            yield batch.slice(start, end - start), texts.slice(start, end - start).to_pylist()
            start = end


def append_columns(df: DataFrame, column: str, fields: list[T.StructField], compute: Callable[[], Callable]) -> DataFrame:
    """``df`` with ``fields`` appended, computed from whole values of ``column`` block by block.

    ``compute()`` runs once per task and returns a function from (values, slice) to one list per
    field.  Columns of ``df`` that clash with a new one are replaced.  Narrow: no shuffle, no
    state, so that a lost task is simply run again.
    """
    df = without(df, [f.name for f in fields], keep=(column,))
    types = [to_arrow_type(f.dataType) for f in fields]
    names = df.columns + [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = compute()
        for part, values in blocks(batches, column):
            new = fn(values, part)
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x, t) for x, t in zip(new, types, strict=True))], names=names)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *fields]))
