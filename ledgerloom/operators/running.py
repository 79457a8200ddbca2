"""Running minima and maxima whose keys may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], value: Column, how: str, name: str, descending: bool = False) -> DataFrame:
    """``df`` plus ``name``: the least or greatest value so far, the row's own included, in the order within the keys.

    ``bucket`` must grow with the order (or fall, with ``descending``). Each bucket of a key is a window of its own; what the buckets
    before it hold comes from a window over one row a bucket, so a key with most of the rows is spread over its buckets."""
    pick = F.min if how == "min" else F.max
    both = F.least if how == "min" else F.greatest
    df = df.withColumns({"_bucket": bucket, "_value": value})
    of_bucket = df.groupBy(*keys, "_bucket").agg(pick("_value").alias("_of"))
    turn = F.desc("_bucket") if descending else F.asc("_bucket")
    before = Window.partitionBy(*keys).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    carried = of_bucket.select(*keys, "_bucket", pick("_of").over(before).alias("_carried"))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_bucket").eqNullSafe(F.col("_b"))]
    carried = carried.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bucket").alias("_b"), "_carried")
    within = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("_here", pick("_value").over(within)).join(carried, same, "left")
    return out.withColumn(name, both("_here", "_carried")).drop("_bucket", "_value", "_here", "_b", "_carried", *[f"_k_{k}" for k in keys])
