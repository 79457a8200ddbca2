"""Tables of an iteration, and the ranking of linked lists by pointer doubling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rounds:
    """Keeps an iteration's tables: each is computed once, in the checkpoint folder where there is one, else with the executors. Both
    cut the plan: a table that is named three times by the next one would otherwise stand in the plan three times as often each round.
    Without a folder a lost executor ends the job; what is no longer named is let go by Spark's cleaner."""

    def keep(self, df: DataFrame) -> DataFrame:
        return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() is not None else df.localCheckpoint()

    last = keep


def list_ranks(links: DataFrame, weights: list[str], rounds: Rounds | None = None) -> DataFrame:
    """Sums of weights from each element to the end of its list, the element itself included.

    ``links`` holds (id, next, weights); ids are unique, a null next or one that isn't there ends a list. Each round an
    element skips to where its next one points and adds what lies between, so a list of n takes log2(n) rounds, however many
    lists there are. Returns (id, last, cyclic, weights): the last element of the list, and whether it never ends; then the
    sums mean nothing, and last is some element of the circle, each of which is the last one of some id.
    """
    rounds = rounds or Rounds()
    there = links.select(F.col("id").alias("next"), F.lit(True).alias("_there"))
    own = links.join(there, "next", "left").select("id", F.when(F.col("_there"), F.col("next")).alias("next"), *weights)
    now = rounds.keep(own.withColumn("last", F.when(F.col("next").isNull(), F.col("id"))))
    left, n = now.where("next is not null").count(), now.count()
    most = max(n, 1).bit_length() + 1
    for _ in range(most):
        if not left:
            break
        to = now.select(F.col("id").alias("_id"), F.col("next").alias("_next"), F.col("last").alias("_last"), *[F.col(w).alias(f"_{w}") for w in weights])
        going = now.where("next is not null").join(to, F.col("next") == F.col("_id"))
        sums: list[Column] = [(F.col(w) + F.col(f"_{w}")).alias(w) for w in weights]
        moved = going.select("id", F.col("_next").alias("next"), *sums, F.col("_last").alias("last"))
        now = rounds.keep(now.where("next is null").unionByName(moved))
        left = now.where("next is not null").count()
    return now.select("id", F.coalesce("next", "last").alias("last"), F.col("next").isNotNull().alias("cyclic"), *weights)


def followers(links: DataFrame, starts: DataFrame, keys: list[str], rounds: Rounds | None = None) -> DataFrame:
    """What follows each start in its list, by doubling: (keys, start, place, id), place from 1.

    ``links`` holds (keys, id, next), ``starts`` (keys, id). Each round knows for every element the one twice as far on, and for
    every start twice as many of its followers, so a list of n takes log2(n) rounds. Lists may run together; one that comes
    back to itself is followed once around.
    """
    rounds = rounds or Rounds()
    jump = rounds.keep(links.groupBy(*keys, "id").agg(F.min("next").alias("next")))
    most = jump.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    found = rounds.keep(starts.select(*keys, F.col("id").alias("start"), "id").distinct().join(jump, [*keys, "id"]).select(*keys, "start", F.lit(1).cast("long").alias("place"), F.col("next").alias("id")))
    far = 1
    while far < most + 1 and not jump.isEmpty():
        # Who follows a start at some place has the element ``far`` on at the place ``far`` more.
        more = found.join(jump, [*keys, "id"]).select(*keys, "start", (F.col("place") + far).alias("place"), F.col("next").alias("id"))
        found = rounds.keep(found.unionByName(more).groupBy(*keys, "start", "id").agg(F.min("place").alias("place")))
        to = jump.select(*keys, F.col("id").alias("next"), F.col("next").alias("_next"))
        jump = rounds.keep(jump.join(to, [*keys, "next"]).select(*keys, "id", F.col("_next").alias("next")))
        far *= 2
    return found.select(*keys, "start", "place", "id")
