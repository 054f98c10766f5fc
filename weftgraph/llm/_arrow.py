"""Small helpers for Arrow-batched kernels."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text bytes that a kernel takes at once; numpy temporaries are about 40 times this.
SLICE_BYTES = 1 << 20


def run(df: DataFrame, kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply ``kernel`` to the partitions of ``df`` as Arrow batches."""
    return df.mapInArrow(kernel, schema)


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just an id and a text column, under fixed names, whatever else ``df`` has."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def slices(texts: list, weight: Callable = len, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``most`` characters; a longer text stands alone."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        size = weight(text) if text is not None else 0
        if held and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(texts):
        yield start, len(texts)


def columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def batch_of(schema: pa.Schema, cols: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
