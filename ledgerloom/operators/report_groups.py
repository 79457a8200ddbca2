"""Sections of a report by dimensions, and columns that are merged or left out where they say nothing.

A section holds the facts of one combination of members; sections stand in the order of their dimensions' and members' names, the one without dimensions
first. In a section only nodes with facts and those above them stay. Columns are compacted by aggregates over cells: columns with the same cells become one; columns
of one period become one if no row has two values in them. Cells of a fact without a node are left out; empty inputs give
empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hierarchies


def section_key(dims: Column) -> Column:
    """The members of a fact as one text, sorted by dimension: d=m;e=n. Empty without dimensions."""
    entries = F.array_sort(F.map_entries(F.coalesce(dims, F.create_map().cast("map<string,string>"))))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


def sections(facts: DataFrame, dimensions: list[str] | None = None) -> DataFrame:
    """``facts`` with section, made of these dimensions (all)."""
    dims = F.col("dims") if dimensions is None else F.map_filter("dims", lambda k, _: k.isin(dimensions))
    return facts.withColumn("section", section_key(dims))


def placed(trees: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows of each section in document order: the trees' places that hold one of its facts or stand above such a place, with
    (section, role, root, first, depth, concept, facts)."""
    held = facts.groupBy("section", "concept").agg(F.count(F.lit(1)).alias("facts"))
    at = trees.join(held, "concept").select("section", "role", "root", "node", "first", "facts")
    up = hierarchies.above(trees, facts.select(F.col("concept").alias("point")), itself=True)
    up = up.select("role", "root", "node", "point", "first", "depth", "concept").distinct()
    pairs = held.select("section", F.col("concept").alias("point")).join(up, "point").select("section", "role", "root", "node", "first", "depth", "concept").distinct()
    return pairs.join(at.select("section", "role", "root", "node", "facts"), ["section", "role", "root", "node"], "left").withColumn("facts", F.coalesce("facts", F.lit(0)).cast("long"))


def compacted(cells: DataFrame) -> DataFrame:
    """``cells`` (section, row, column, period, value) with column replaced by ``shown``, the least name of those it stands for,
    and each cell once.

    Of a section's columns those with the same rows and values are one. Of what is left, a period's columns are one where no row
    has different values in them. A column without any value has no cells, so it is gone."""
    cells = cells.where("value is not null").select("section", "row", "column", "period", "value").distinct()
    set_of = F.sort_array(F.collect_set(F.xxhash64("row", "value")))
    looks = cells.groupBy("section", "period", "column").agg(F.sha2(set_of.cast("string"), 256).alias("look"), F.count(F.lit(1)).alias("n"))
    same = looks.groupBy("section", "period", "look", "n").agg(F.min("column").alias("kept"), F.collect_set("column").alias("columns"))
    first = cells.join(same.select("section", "period", "kept", F.explode("columns").alias("column")), ["section", "period", "column"])
    first = first.select("section", "row", "period", F.col("kept").alias("column"), "value").distinct()
    clash = first.groupBy("section", "period", "row").agg(F.count_distinct("value").alias("values")).groupBy("section", "period").agg((F.max("values") == 1).alias("fits"))
    least = first.groupBy("section", "period").agg(F.min("column").alias("least"))
    out = first.join(clash, ["section", "period"]).join(least, ["section", "period"])
    return out.select("section", "row", F.when(F.col("fits"), F.col("least")).otherwise(F.col("column")).alias("shown"), "period", "value").distinct()
