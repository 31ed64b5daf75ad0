"""Permutation importance: how much worse forecasts get when a group of inputs is dealt to other rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.sources.sinks import shared_folder

Predict = Callable[[DataFrame], DataFrame]
NUMBER = "__n"


def numbered(df: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """df with NUMBER, 0, 1, ... in the given order, and how many rows there are.

    The table is sorted by ranges and written; numbers count on from range to
    range, so no task sees all rows. The order tells all rows apart. The starts of
    the ranges are broadcast, one row a task; Spark does not know how small a table
    from the driver is, and would rather send the compressed rows.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    marked = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    marked.write.parquet(path)
    stored = spark.read.schema(marked.schema).parquet(path)
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r["part"], r["n"]) for r in stored.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # one row a task
    total, starts = 0, []
    for p, n in sizes:
        starts.append((p, total))
        total += n
    offsets = spark.createDataFrame(starts, "__part long, __start long")
    out = stored.withColumn("__part", part.cast("long")).join(F.broadcast(offsets), "__part").withColumn(NUMBER, F.col("__start") + place)
    return out.drop("__id", "__part", "__start"), total


def stride(n: int, seed: int) -> tuple[int, int]:
    """Numbers a and b so that i -> (a i + b) mod n deals n rows anew: a near the golden section of n, without a common divisor."""
    a = max(1, round(n * 0.6180339887) + seed)
    while math.gcd(a, max(1, n)) != 1:
        a += 1
    return a, (seed * 7919 + n // 3) % max(1, n)


def permuted(rows: DataFrame, n: int, columns: list[str], seed: int = 0) -> DataFrame:
    """Numbered rows with `columns` of row (a i + b) mod n: one join by number, each row used once, the columns together.

    Both sides have all rows, so the join merges sorted ones: by the size of its
    compressed file one side could look small enough to be sent to every task.
    """
    a, b = stride(n, seed)
    source = rows.select(F.col(NUMBER).alias("__from"), *[F.col(c).alias(f"__new_{c}") for c in columns])
    product = F.col(NUMBER).cast("decimal(38,0)") * F.lit(a).cast("decimal(19,0)") + F.lit(b)
    dealt = rows.withColumn("__from", F.pmod(product, F.lit(max(1, n)).cast("decimal(38,0)")).cast("long")).join(source.hint("merge"), "__from")
    return dealt.withColumns({c: F.col(f"__new_{c}") for c in columns}).drop("__from", *[f"__new_{c}" for c in columns])


def permutation_losses(rows: DataFrame, n: int, groups: dict[str, list[str]], predict: Predict, loss: Column | None = None, seed: int = 0) -> DataFrame:
    """(group, loss, increase): the mean loss with each group of inputs permuted, and with none of them (`none`).

    predict takes rows with inputs and y and gives y and prediction; the loss
    is the absolute error unless another is given.
    """
    loss = F.abs(F.col("prediction") - F.col("y")) if loss is None else loss
    cases = {"none": rows} | {g: permuted(rows, n, cols, seed) for g, cols in groups.items()}
    parts = [predict(df).agg(F.avg(loss).alias("loss")).select(F.lit(g).alias("group"), "loss") for g, df in cases.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    base = F.max(F.when(F.col("group") == "none", F.col("loss"))).over(Window.partitionBy())  # one row a group
    return out.withColumn("increase", F.col("loss") - base)
