"""Joins of points with the intervals that hold them, as equi-joins on blocks.

An interval belongs to a level by its length and lies in two blocks of that level's width at most; a point lies in one
block of each level. Both sides meet on level and block (and further keys), so Spark may hash or sort, and what a block
holds grows with its neighbourhood, not with the table: no nested loop, and no key with all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Block widths are powers of this many bits: an interval is longer than a quarter of its level's blocks.
BITS = 2


def level(length: Column) -> Column:
    """The least level whose blocks are as wide as so many whole numbers."""
    return F.when(length <= 1, 0).otherwise(F.ceil(F.length(F.bin(length - 1)) / BITS)).cast("int")


def moments(col: Column) -> Column:
    """A date or a time without a zone as whole microseconds, which sort alike whatever the session's zone."""
    c = col.cast("timestamp_ntz")
    seconds = F.unix_date(c.cast("date")).cast("long") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")


def hold(points: DataFrame, intervals: DataFrame, point: str, low: str, high: str, keys: list[str] = (), how: str = "inner") -> DataFrame:
    """Each point with each interval that holds it (both ends included) and shares the keys, once.

    ``point``, ``low`` and ``high`` are columns of whole numbers; the tables share no other names than the keys. An interval without a low
    or high end is open there. Rows with a null point or key meet none. ``how`` is inner, left_semi or left_anti, for
    points. The levels in use are asked for once (at most 33 numbers); points are copied that many times.
    """
    keys = list(keys)
    least, most = points.agg(F.min(point), F.max(point)).first()
    if least is None:
        least, most = 0, 0
    a, b = F.greatest(F.coalesce(F.col(low), F.lit(least)), F.lit(least)), F.least(F.coalesce(F.col(high), F.lit(most)), F.lit(most))
    clipped = intervals.withColumns({"_low": a.cast("long"), "_high": b.cast("long")}).where("_low <= _high")
    clipped = clipped.withColumn("_level", level(F.col("_high") - F.col("_low") + 1))
    levels = sorted(r[0] for r in clipped.select("_level").distinct().collect())
    block = lambda x, lv: F.shiftright(x, lv * BITS)
    by_level = lambda x: F.coalesce(*[F.when(F.col("_level") == n, block(x, n)) for n in levels])
    if not levels:
        clipped, copied = clipped.withColumn("_block", F.lit(0).cast("long")), points.withColumns({"_level": F.lit(0), "_block": F.lit(0).cast("long")}).limit(0)
    else:
        clipped = clipped.withColumn("_block", F.explode(F.sequence(by_level(F.col("_low")), by_level(F.col("_high")))))
        places = F.array(*[F.struct(F.lit(n).alias("_level"), block(F.col(point), n).alias("_block")) for n in levels])
        copied = points.withColumn("_place", F.explode(places)).withColumns({"_level": F.col("_place._level"), "_block": F.col("_place._block")}).drop("_place")
    within = (F.col(point) >= F.col("_low")) & (F.col(point) <= F.col("_high"))
    if how == "inner":
        return copied.join(clipped, [*keys, "_level", "_block"]).where(within).drop("_level", "_block", "_low", "_high")
    if how not in ("left_semi", "left_anti"):
        raise ValueError(f"a join of points can't be {how}")
    return _marked(points, copied, clipped, point, keys, how)


def _marked(points: DataFrame, copied: DataFrame, clipped: DataFrame, point: str, keys: list[str], how: str) -> DataFrame:
    """Points with or without an interval: the distinct points that are held, joined back once."""
    own = copied.select(*keys, point, "_level", "_block").distinct()
    ends = clipped.select(*keys, "_level", "_block", "_low", "_high").distinct()
    held = own.join(ends, [*keys, "_level", "_block"]).where((F.col(point) >= F.col("_low")) & (F.col(point) <= F.col("_high"))).select(*keys, point).distinct()
    return points.join(held, [*keys, point], how)
