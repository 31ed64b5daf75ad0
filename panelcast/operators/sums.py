"""Sums of arrays over tasks: each task adds up its own, few of them reach the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Row

#: Tasks beyond which what they add up is added up once more before the driver.
TASKS = 64


def array_sum(rows: DataFrame, size: int, of: Callable[[Row], np.ndarray]) -> np.ndarray:
    """The sum of of(row), an array of `size` numbers, over all rows.

    Rows are packed and so are long. They reach the workers pickled, in batches
    of a few megabytes: Arrow batches have up to 10,000 rows, or 64 MB, which the
    executor holds several times for each task, outside its heap.
    """

    def run(part: Iterator[Row]) -> Iterator[np.ndarray]:
        total = np.zeros(size)
        for row in part:
            total += of(row)
        yield total

    parts = rows.rdd.mapPartitions(run)
    n = parts.getNumPartitions()
    if not n:
        return np.zeros(size)
    return parts.treeReduce(np.add) if n > TASKS else parts.reduce(np.add)
