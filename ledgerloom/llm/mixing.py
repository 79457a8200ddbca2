"""Mixing sources to target weights with DataFrame functions only.

Tokens per source are summed, targets are filled up to a cap, the ratio of target and size is each source's
repetition rate, and every document is emitted floor(rate) times plus once more with the rest as probability,
decided by a hash of the seed and its id.

Defined cases: a null text counts no words; a null source is a source of its own that sorts last; a null id draws
like any other value; rows with the same id draw alike; an empty table gives an empty result; an extra column is
carried through, under its own name even if that is a name used here. Sources without words get a rate of zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, set_aside, unit_hash

WORD = r"[^\x20\x09-\x0D]+"
CAP = 3.0
SEED = 20


def word_count(col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(col), F.lit(WORD)), F.lit(0)).cast("long")


def cycling_weight(rank: Column) -> Column:
    """1, 2, 3, 1, 2, 3, ... by the source's place in code-point order."""
    return ((rank - 1) % 3 + 1).cast("double")


def source_targets(sizes: DataFrame, cap: float = CAP, weight=cycling_weight) -> DataFrame:
    """Targets of ``sizes`` (source, source_size): shares of the total by weight, none above ``cap`` times its size.

    Giving the excess of capped sources to the others by weight, again and again, ends at target = level * weight
    for all uncapped ones. Sources sorted by cap / weight are capped in that order, so the level follows from
    running sums: it is the largest one that the source it is reckoned for can take. One row per source.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    by_room = Window.partitionBy(F.lit(0)).orderBy("room", F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    weighed = sizes.withColumn("weight", weight(F.row_number().over(order))).withColumn("cap", F.lit(cap) * F.col("source_size")).withColumn("room", F.col("cap") / F.col("weight"))
    running = (
        weighed.withColumn("total", F.sum("source_size").over(whole).cast("double"))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("open_weight"))
    )
    level = F.max(F.when(F.col("room") >= F.col("level"), F.col("level"))).over(whole)
    target = F.least(F.col("cap"), F.col("weight") * F.coalesce(level, F.max("room").over(whole)))
    return running.select("source", "source_size", target.alias("target"))


def with_copies(docs: DataFrame, seed: int = SEED, cap: float = CAP, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", few_sources: int = 100_000) -> DataFrame:
    """``docs`` plus mix_size, mix_source_size, mix_target and mix_copies (named by ``free_name`` where the table has such)."""
    docs, put_back = set_aside(docs, ["mix_size", "mix_source_size", "mix_target", "mix_copies", "mix_key"])
    return put_back(_planned(docs, seed, cap, id_col, source_col, text_col, few_sources))


def _planned(docs: DataFrame, seed: int, cap: float, id_col: str, source_col: str, text_col: str, few_sources: int = 100_000) -> DataFrame:
    sized = docs.withColumn("mix_size", word_count(text_col))
    targets = source_targets(sized.groupBy(F.col(source_col).alias("source")).agg(F.sum("mix_size").alias("source_size")), cap)
    targets = targets.select(F.col("source").alias("mix_key"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"))
    rows = docs.select(F.col(source_col)).distinct().count()
    joined = sized.join(F.broadcast(targets) if rows <= few_sources else targets, sized[source_col].eqNullSafe(F.col("mix_key")), "left").drop("mix_key")
    rate = F.when(F.col("mix_source_size") > 0, F.least(F.lit(cap), F.col("mix_target") / F.col("mix_source_size"))).otherwise(F.lit(0.0))
    extra = (unit_hash(seed, id_col) < rate - F.floor(rate)).cast("int")
    return joined.withColumn("mix_copies", (F.floor(rate).cast("int") + extra).cast("int"))


def mix(docs: DataFrame, seed: int = SEED, cap: float = CAP, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix itself: each document as many times as its copies say, with the columns of ``docs``."""
    names, (docs, put_back) = docs.columns, set_aside(docs, ["mix_size", "mix_source_size", "mix_target", "mix_copies", "mix_key", "mix_copy"])
    planned = _planned(docs, seed, cap, id_col, source_col, text_col).where("mix_copies > 0")
    out = planned.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))).select(*columns(docs.columns))
    return put_back(out).select(*columns(names))
