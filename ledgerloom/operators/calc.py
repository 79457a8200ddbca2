"""Roll-ups and the joins between concepts that a taxonomy asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import inferred_decimals, presented
from .networks import edges

SCOPE = ["doc_id", "parent_id", "entity_key", "period_key", "dims_key", "unit_key"]


def _scoped(wide: DataFrame) -> DataFrame:
    """Items with a count of duplicates in their scope; null parts of the scope become comparable."""
    keys = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in SCOPE]
    own = wide.where("context_ref is not null and not coalesce(is_nil, false)").select(*keys, "fact_id", "concept", "num", "value", "decimals", "precision")
    w = Window.partitionBy(*SCOPE, "concept")
    return own.withColumn("copies", F.count(F.lit(1)).over(w))


def calculation(wide: DataFrame, arcs: DataFrame, arcrole: str) -> DataFrame:
    """Parents against the weighted sum of their children in the same tuple, context and unit.

    Children are summed at the parent's decimals, half-even. A duplicate among parent or children voids the
    comparison; nil facts take no part; a parent without any child is not compared.
    """
    arcs = edges(arcs, arcrole=arcrole).select("role", F.col("from").alias("parent"), F.col("to").alias("child"), "weight")
    facts = _scoped(wide)
    kids = facts.join(arcs, facts["concept"] == arcs["child"]).select(*SCOPE, "role", "parent", F.col("copies").alias("child_copies"), (F.col("weight").cast("decimal(18,6)") * F.col("num")).cast("decimal(38,6)").alias("part"))
    sums = kids.groupBy(*SCOPE, "role", "parent").agg(F.sum("part").alias("total"), F.count(F.lit(1)).alias("children"), F.max("child_copies").alias("most"))
    heads = facts.select(*SCOPE, "fact_id", F.col("concept").alias("parent"), "num", "decimals", "precision", "copies")
    both = heads.join(sums, [*SCOPE, "parent"])
    d = inferred_decimals(F.col("num"), F.col("decimals"), F.col("precision"))
    out = both.where("copies = 1 and most = 1").withColumns({"reported": presented(F.col("num"), d), "calculated": presented(F.col("total"), d)})
    return out.select("doc_id", "role", "parent", "fact_id", "children", "reported", "calculated", (F.col("reported") == F.col("calculated")).alias("consistent"))


def sign_conflicts(arcs: DataFrame, concepts: DataFrame, arcrole: str) -> DataFrame:
    """Arcs whose weight contradicts the balances: equal balances add, opposite ones subtract."""
    b = concepts.select("concept", "balance").where("balance is not null")
    own = edges(arcs, arcrole=arcrole)
    both = own.join(b.select(F.col("concept").alias("from"), F.col("balance").alias("b1")), "from").join(b.select(F.col("concept").alias("to"), F.col("balance").alias("b2")), "to")
    return both.where(F.when(F.col("b1") == F.col("b2"), F.col("weight") < 0).otherwise(F.col("weight") > 0)).select("role", "from", "to", "weight", "b1", "b2")


def essence_alias(wide: DataFrame, arcs: DataFrame, arcrole: str) -> DataFrame:
    """Alias facts whose value differs from the essence fact of the same scope, at the coarser decimals."""
    a = edges(arcs, arcrole=arcrole).select("role", F.col("from").alias("essence"), F.col("to").alias("alias"))
    facts = _scoped(wide)
    one = facts.join(a, facts["concept"] == a["essence"]).select(*SCOPE, "role", "essence", "alias", F.col("fact_id").alias("essence_fact"), F.col("num").alias("n1"), F.col("value").alias("v1"), inferred_decimals(F.col("num"), F.col("decimals"), F.col("precision")).alias("d1"))
    two = facts.select(*SCOPE, F.col("concept").alias("alias"), F.col("fact_id").alias("alias_fact"), F.col("num").alias("n2"), F.col("value").alias("v2"), inferred_decimals(F.col("num"), F.col("decimals"), F.col("precision")).alias("d2"))
    d = F.when(F.col("d1") == "INF", F.col("d2")).when(F.col("d2") == "INF", F.col("d1")).otherwise(F.least(F.col("d1").cast("int"), F.col("d2").cast("int")).cast("string"))
    same = F.when(F.col("n1").isNotNull() & F.col("n2").isNotNull(), presented(F.col("n1"), d) == presented(F.col("n2"), d)).otherwise(F.col("v1").eqNullSafe(F.col("v2")))
    return one.join(two, [*SCOPE, "alias"]).where(~same).select("doc_id", "role", "essence", "alias", "essence_fact", "alias_fact")


def inferred_essence(wide: DataFrame, arcs: DataFrame, arcrole: str) -> DataFrame:
    """Values for essence concepts that are not reported where all their aliases in the scope agree."""
    a = edges(arcs, arcrole=arcrole).select(F.col("from").alias("essence"), F.col("to").alias("alias"))
    facts = _scoped(wide)
    kids = facts.join(a, facts["concept"] == a["alias"])
    agreed = kids.groupBy(*SCOPE, "essence").agg(F.count_distinct("value").alias("values"), F.min("value").alias("value")).where("values = 1")
    return agreed.join(facts.select(*SCOPE, F.col("concept").alias("essence")), [*SCOPE, "essence"], "left_anti").select("doc_id", F.col("essence").alias("concept"), "period_key", "unit_key", "value")


def requires_element(facts: DataFrame, arcs: DataFrame, arcrole: str) -> DataFrame:
    """Documents that report a source concept without the concept it requires."""
    a = edges(arcs, arcrole=arcrole).select(F.col("from").alias("concept"), F.col("to").alias("required"))
    there = facts.select("doc_id", "concept").distinct()
    need = there.join(a, "concept")
    return need.join(there.withColumnRenamed("concept", "required"), ["doc_id", "required"], "left_anti")


def across_dimension(wide: DataFrame, dimension: str, members: DataFrame, weighted_by: str | None = None) -> DataFrame:
    """Sum (or average weighted by another concept's fact) over the children of a member, everything else equal.

    ``members``: (parent, member).
    """
    rest = F.to_json(F.array_sort(F.map_entries(F.map_filter("dims", lambda k, _: k != dimension))))
    f = wide.where("num is not null").select("doc_id", "concept", "entity_key", "period_key", "unit_key", rest.alias("rest"), F.try_element_at("dims", F.lit(dimension)).alias("member"), F.col("num"))
    kids = f.join(members, "member")
    keys = ["doc_id", "concept", "entity_key", "period_key", "unit_key", "rest", "parent"]
    if weighted_by is None:
        return kids.groupBy(*keys).agg(F.sum("num").alias("total"))
    weights = f.where(F.col("concept") == weighted_by).select("doc_id", "entity_key", "period_key", "rest", "member", F.col("num").cast("double").alias("w"))
    joined = kids.where(F.col("concept") != weighted_by).join(weights, ["doc_id", "entity_key", "period_key", "rest", "member"])
    return joined.groupBy(*keys).agg((F.sum(F.col("num").cast("double") * F.col("w")) / F.sum("w")).alias("total"))
