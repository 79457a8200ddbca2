"""Aspects of facts: keys that make matching an equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sorted_entries(col: Column) -> Column:
    """A map as JSON of its sorted entries: comparable, groupable and null-safe."""
    return F.when(F.coalesce(F.size(col), F.lit(0)) <= 0, F.lit("[]")).otherwise(F.to_json(F.sort_array(F.map_entries(col))))


def dims_key(dims: Column, typed: Column, covered: list[str] = ()) -> Column:
    """One string for all dimensions that are not covered."""
    def left(c: Column) -> Column:
        return F.map_filter(c, lambda k, _: ~k.isin(list(covered))) if covered else c

    return F.concat_ws("|", sorted_entries(left(dims)), sorted_entries(left(typed)))


def without_defaults(dims: Column, defaults: dict[str, str]) -> Column:
    """Drop members that equal their dimension's default, so absent and default compare equal."""
    if not defaults:
        return dims
    table = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv])
    return F.map_filter(dims, lambda k, v: ~F.coalesce(F.try_element_at(table, k) == v, F.lit(False)))


def unit_key(numerator: Column, denominator: Column) -> Column:
    """Measures in any order, as one string."""
    part = lambda c: F.array_join(F.array_sort(F.coalesce(c, F.array().cast("array<string>"))), "*")
    return F.concat_ws("/", part(numerator), F.when(F.size(F.coalesce(denominator, F.array().cast("array<string>"))) > 0, part(denominator)))


def period_key(period_type: Column, start: Column, end: Column) -> Column:
    return F.concat_ws("|", period_type, F.coalesce(start.cast("string"), F.lit("")), F.coalesce(end.cast("string"), F.lit("")))


def period_end(lexical: Column) -> Column:
    """A date without a time ends at the end of its day."""
    dated = F.try_to_timestamp(F.substring(lexical, 1, 10), F.lit("yyyy-MM-dd"))
    timed = F.try_to_timestamp(F.regexp_replace(F.substring(lexical, 1, 19), "T24:00:00", "T00:00:00"), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    next_day = F.expr("interval 1 day")
    midnight = lexical.contains("T24:00:00")
    out = F.when(~lexical.contains("T"), dated + next_day).otherwise(F.when(midnight, timed + next_day).otherwise(timed))
    return out.cast("timestamp_ntz")


def period_start(lexical: Column) -> Column:
    """A date without a time starts at the beginning of its day."""
    dated = F.try_to_timestamp(F.substring(lexical, 1, 10), F.lit("yyyy-MM-dd"))
    timed = F.try_to_timestamp(F.substring(lexical, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    return F.when(~lexical.contains("T"), dated).otherwise(timed).cast("timestamp_ntz")


def wide(facts: DataFrame, contexts: DataFrame, units: DataFrame, concepts: DataFrame, defaults: dict[str, str] | None = None) -> DataFrame:
    """Facts with all their aspects. Concepts are a dictionary-sized table; the others join on the document too."""
    c = contexts.select("doc_id", F.col("context_id").alias("context_ref"), "scheme", "entity", "period_type", "start", "end", without_defaults(F.col("dims"), defaults or {}).alias("dims"), "typed_dims", "non_dim", "scenario", *[x for x in ("scenario_dims",) if x in contexts.columns])
    u = units.select("doc_id", F.col("unit_id").alias("unit_ref"), "numerator", "denominator", unit_key(F.col("numerator"), F.col("denominator")).alias("unit_key"))
    k = concepts.select("concept", "base_types", "subst_group", "subst_groups", F.col("period_type").alias("concept_period_type"), "balance", "attrs", "abstract", "nillable")
    out = facts.join(c, ["doc_id", "context_ref"], "left").join(u, ["doc_id", "unit_ref"], "left").join(k, "concept", "left")
    return out.withColumns({
        "dims_key": dims_key(F.col("dims"), F.col("typed_dims")),
        "period_key": period_key(F.col("period_type"), F.col("start"), F.col("end")),
        "entity_key": F.concat_ws("|", "scheme", "entity"),
    })
