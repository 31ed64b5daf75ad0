"""As-of joins by key: each row of one table with the last row of another at or before its time."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a bucket of time; a key's rows are sorted bucket by bucket.
BUCKET = 86_400


def _bucket(ts: str, seconds: int) -> Column:
    return F.expr(f"timestampdiff(SECOND, cast('1970-01-01' AS timestamp_ntz), cast({ts} AS timestamp_ntz)) div {seconds}")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], ts: str, right_ts: str, columns: list[str], tolerance: timedelta | None = None, tie_break: list[str] = (), bucket: int = BUCKET) -> DataFrame:
    """All rows of left with right_ts and `columns` of the last row of right of the same keys whose right_ts is not after ts.

    Null beyond the tolerance and where there is none. Of right rows with the
    same keys and time the one that comes last by tie_break, then by `columns`
    counts. Rows of left with a null key or time are kept without a match, such
    rows of right have none; rows of left that repeat stay. Columns of left
    that bear the names of the new ones are replaced.

    In two levels, so that no task sorts a whole key: rows of both tables are
    united and the last right row is carried on inside a key's buckets of time;
    what enters a bucket comes from a table with one row a key and bucket.
    """
    new = [right_ts, *columns]
    usable = lambda df, t: df.filter(F.lit(True) if not by else ~F.coalesce(*[F.when(F.col(k).isNull(), True) for k in [*by, t]], F.lit(False)))
    match = F.struct(F.col(right_ts).alias("__at"), *[F.col(c).alias(f"__c{i}") for i, c in enumerate(columns)])
    order = F.struct(*[F.col(c) for c in tie_break], *[F.col(c) for c in columns], F.lit(0))
    # one row a key and time, combined before it is shuffled
    last = usable(right, right_ts).groupBy(*by, right_ts).agg(F.max_by(match, order).alias("__match"))
    keys = [f"__k{i}" for i in range(len(by))]
    seen = last.select(*[F.col(k).alias(n) for k, n in zip(by, keys, strict=True)], F.col(right_ts).cast("timestamp_ntz").alias("__ts"), F.lit(0).alias("__side"), "__match")
    rows = usable(left, ts).select(*[F.col(k).alias(n) for k, n in zip(by, keys, strict=True)], F.col(ts).cast("timestamp_ntz").alias("__ts"), F.lit(1).alias("__side"), F.struct(*[F.col(c) for c in left.columns]).alias("__row"))
    both = rows.unionByName(seen, allowMissingColumns=True).withColumn("__bucket", _bucket("__ts", bucket))

    ends = both.groupBy(*keys, "__bucket").agg(F.max_by(F.when(F.col("__side") == 0, F.col("__match")), F.when(F.col("__side") == 0, F.col("__ts"))).alias("__end"))
    across = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "__bucket", F.last("__end", ignorenulls=True).over(across).alias("__in"))
    within = Window.partitionBy(*keys, "__bucket").orderBy("__ts", "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__last", F.last("__match", ignorenulls=True).over(within)).filter("__side = 1").join(carried, [*keys, "__bucket"], "left")
    match = F.coalesce("__last", "__in")
    if tolerance is not None:
        match = F.when(F.col("__ts") - match["__at"].cast("timestamp_ntz") <= F.lit(tolerance), match)
    picked = found.withColumn("__found", match).select(*[F.col(f"__row.`{c}`").alias(c) for c in left.columns if c not in new], F.col("__found.__at").alias(right_ts), *[F.col(f"__found.__c{i}").alias(c) for i, c in enumerate(columns)])
    odd = left.filter(F.coalesce(*[F.when(F.col(k).isNull(), True) for k in [*by, ts]], F.lit(False)))
    kinds = {f.name: f.dataType for f in picked.schema}
    alone = odd.select(*[c for c in left.columns if c not in new], *[F.lit(None).cast(kinds[c]).alias(c) for c in new])
    return picked.unionByName(alone)
