"""Streams of rows sorted by key, cut into tables of whole keys."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The last column of `together`.
PLACE = "__place"


def together(df: DataFrame, key: str, order: str) -> DataFrame:
    """df with the rows of a key in one task, one after another in order, and PLACE, which counts them.

    A window asks for that. `repartition(key)` does not do it after a union: where
    its parts are dealt by key already the exchange is left out, and adaptive
    coalescing may then put a key of each part into different tasks.
    """
    return df.withColumn(PLACE, F.row_number().over(Window.partitionBy(key).orderBy(order)))


def whole_keys(batches: Iterator[pa.RecordBatch], key: int, rows: int) -> Iterator[pa.Table]:
    """Tables of about `rows` rows, or of one longer key; column number `key` is the one that rows are sorted by."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            table = pa.Table.from_batches(held)
            whole = _before_last(table.column(key))
            if whole:
                yield table.slice(0, whole)
                held = table.slice(whole).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _before_last(keys: pa.ChunkedArray) -> int:
    """How many rows come before the last key, which may go on in the next batch."""
    same = pc.fill_null(pc.equal(keys, keys[-1]), False) if keys[-1].is_valid else pc.is_null(keys)
    return pc.index(same, True).as_py()


def changes(keys: pa.ChunkedArray | pa.Array) -> list[int]:
    """Where each run of equal keys begins."""
    keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
    if len(keys) < 2:
        return [0] * len(keys)
    a, b = keys.slice(1), keys.slice(0, len(keys) - 1)
    differ = pc.if_else(pc.or_(pc.is_null(a), pc.is_null(b)), pc.not_equal(pc.is_null(a), pc.is_null(b)), pc.not_equal(a, b))
    return [0, *(x + 1 for x in pc.indices_nonzero(differ).to_pylist())]
