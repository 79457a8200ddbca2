"""Set operations and structural comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often, with the side."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def flatten_json(df: DataFrame, key: str, col: str) -> DataFrame:
    """(key, path, value) of all leaves of a JSON column, level by level."""
    level = df.select(key, F.lit("$").alias("path"), F.parse_json(col).alias("v"))
    kind = F.schema_of_variant("v")
    out = None
    for _ in range(32):
        nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        leaves = level.where(~nested).select(key, "path", F.col("v").cast("string").alias("value"))
        out = leaves if out is None else out.unionByName(leaves)
        level = level.where(nested)
        raw = level.where(kind.startswith("OBJECT")).select(key, "path", F.explode(F.from_json(F.to_json("v"), "map<string,variant>")).alias("_k", "_v")).select(key, F.concat("path", F.lit("."), "_k").alias("path"), F.col("_v").alias("v"))
        items = level.where(kind.startswith("ARRAY")).select(key, "path", F.posexplode(F.from_json(F.to_json("v"), "array<variant>")).alias("_i", "_v")).select(key, F.concat("path", F.lit("["), F.col("_i").cast("string"), F.lit("]")).alias("path"), F.col("_v").alias("v"))
        level = raw.unionByName(items).persist()
        if level.isEmpty():
            break
    return out


def structural_diff(a: DataFrame, b: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Paths only in one side and paths whose values differ: only_a, only_b or differs."""
    j = a.select(*keys, F.col(value).alias("a"), F.lit(1).alias("_a")).join(b.select(*keys, F.col(value).alias("b"), F.lit(1).alias("_b")), keys, "full")
    state = F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b").when(~F.col("a").eqNullSafe(F.col("b")), "differs")
    return j.withColumn("state", state).where("state is not null").drop("_a", "_b")


def sets_agree(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)
