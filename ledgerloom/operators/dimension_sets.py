"""Dimensional relationship sets: which members a primary item may take, followed over link roles.

A relationship is consecutive to another if it leaves the node where that one arrives, in the role that one targets
(its own role where it names none). So a traversal goes over states (role, node), not over nodes. A set starts at a
primary item that has a hypercube (or must not have it), whose domain-member descendants inherit it; from the hypercube
it goes to dimensions, to their domains and down to members. A member may be used if a relationship of the set that
arrives at it says so; members of a set that excludes are taken from those of the sets of the same base role.

States are met once a set, so cycles end; networks of any depth are followed. Arcs that are prohibited or overridden are
not followed. Empty networks give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import ARCROLES
from .networks import edges, reach

HAS = {"all": ARCROLES["all"], "notAll": ARCROLES["notAll"]}
BAR = "\x1f"


def steps(arcs: DataFrame) -> DataFrame:
    """Arcs in force as steps between states: (arcrole, role, from, to_role, to, usable, closed, context_element).

    ``arcs`` has attrs with targetRole, usable, closed and contextElement, under these local names."""
    own = edges(arcs)
    attr = lambda n: F.try_element_at("attrs", F.lit(n))
    says = lambda n, default: F.coalesce(attr(n).isin("true", "1"), F.lit(default))
    usable = F.when(attr("usable").isNull(), F.lit(True)).otherwise(says("usable", True))
    return own.select("arcrole", "role", "from", F.coalesce(attr("targetRole"), F.col("role")).alias("to_role"), "to", usable.alias("usable"), says("closed", False).alias("closed"), attr("contextElement").alias("context_element"))


def _of(all_steps: DataFrame, name: str) -> DataFrame:
    return all_steps.where(F.col("arcrole") == ARCROLES[name])


def _state(role: Column | str, node: Column | str) -> Column:
    return F.concat(role if isinstance(role, Column) else F.col(role), F.lit(BAR), node if isinstance(node, Column) else F.col(node))


def _reached(domain: DataFrame, starts: DataFrame) -> DataFrame:
    """(source, node) states met from states over domain-member steps."""
    pairs = domain.select(_state("role", "from").alias("parent"), _state("to_role", "to").alias("child"))
    return reach(pairs, starts.select("source").distinct()).select("source", "node")


def _node(state: str) -> Column:
    return F.substring_index(state, BAR, -1)


def hypercubes(arcs: DataFrame) -> DataFrame:
    """(base_role, kind, primary_item, inherited, hypercube, cube_role, closed, context_element): hypercubes that primary items
    have or inherit, kind all or notAll. cube_role is where the hypercube's dimensions are looked up."""
    s = steps(arcs)
    has = s.where(F.col("arcrole").isin(*HAS.values())).select(
        F.col("role").alias("base_role"), F.when(F.col("arcrole") == HAS["all"], "all").otherwise("notAll").alias("kind"), F.col("from").alias("head"), F.col("to").alias("hypercube"), F.col("to_role").alias("cube_role"), "closed", "context_element",
    ).withColumn("source", _state("base_role", "head"))
    heirs = _reached(_of(s, "domain-member"), has).select("source", _node("node").alias("primary_item")).distinct()
    cols = ["base_role", "kind", "primary_item", "inherited", "hypercube", "cube_role", "closed", "context_element"]
    own = has.select("base_role", "kind", F.col("head").alias("primary_item"), F.lit(False).alias("inherited"), "hypercube", "cube_role", "closed", "context_element")
    heired = has.join(heirs, "source").where("primary_item <> head").withColumn("inherited", F.lit(True)).select(*cols)
    return own.unionByName(heired).distinct()


def members(arcs: DataFrame, hypercube_states: DataFrame | None = None) -> DataFrame:
    """(hypercube, cube_role, dimension, dimension_role, member, parent, usable): members that are consecutively related to
    each hypercube, the parent null for a domain's head. Of several relationships that arrive at a member it is usable if one says so.

    Every member relationship of the set is a row, so children of a member can be selected."""
    s = steps(arcs)
    cubes = _of(s, "hypercube-dimension").select(F.col("from").alias("hypercube"), F.col("role").alias("cube_role"), F.col("to").alias("dimension"), F.col("to_role").alias("dimension_role"))
    if hypercube_states is not None:
        cubes = cubes.join(hypercube_states.select("hypercube", "cube_role").distinct(), ["hypercube", "cube_role"], "left_semi")
    heads = _of(s, "dimension-domain").select(F.col("from").alias("dimension"), F.col("role").alias("dimension_role"), F.col("to").alias("member"), F.col("to_role").alias("_role"), "usable")
    dims = cubes.select("dimension", "dimension_role").distinct().join(heads, ["dimension", "dimension_role"])
    starts = dims.select("dimension", "dimension_role", _state("_role", "member").alias("source")).distinct()
    domain = _of(s, "domain-member")
    states = _reached(domain, starts).unionByName(starts.select("source", F.col("source").alias("node"))).distinct()
    arriving = domain.select(_state("role", "from").alias("node"), F.col("from").alias("parent"), F.col("to").alias("member"), "usable")
    inner = starts.join(states, "source").join(arriving, "node").select("dimension", "dimension_role", "member", "parent", "usable")
    top = dims.select("dimension", "dimension_role", "member", F.lit(None).cast("string").alias("parent"), "usable")
    every = top.unionByName(inner).groupBy("dimension", "dimension_role", "member", "parent").agg(F.max("usable").alias("usable"))
    return cubes.join(every, ["dimension", "dimension_role"]).select("hypercube", "cube_role", "dimension", "dimension_role", "member", "parent", "usable")


def valid_members(arcs: DataFrame) -> DataFrame:
    """(base_role, primary_item, dimension, member) that may be used: usable members of the sets with hypercubes that a primary
    item has, without those of the sets with hypercubes that it must not have, in the same base role."""
    have = hypercubes(arcs)
    found = members(arcs, have).where("usable").select("hypercube", "cube_role", "dimension", "member").distinct()
    cols = ["base_role", "primary_item", "dimension", "member"]
    of = lambda kind: have.where(F.col("kind") == kind).select("base_role", "primary_item", "hypercube", "cube_role").distinct().join(found, ["hypercube", "cube_role"]).select(*cols).distinct()
    return of("all").join(of("notAll"), cols, "left_anti")


def select_members(arcs: DataFrame, wanted: DataFrame, axis: str = "DRS-descendant") -> DataFrame:
    """Members on an axis (DRS-child or DRS-descendant) from a member in the sets of a primary item.

    ``wanted`` holds (primary_item, dimension, from_member, base_role), base_role null for all base roles; the result these and
    member. Only usable members count, and a member isn't its own descendant unless a relationship arrives at it."""
    if axis not in ("DRS-child", "DRS-descendant"):
        raise ValueError(f"unknown axis {axis}")
    have = hypercubes(arcs).where("kind = 'all'").select(F.col("base_role").alias("_base"), "primary_item", "hypercube", "cube_role").distinct()
    asked = wanted.distinct().join(have, "primary_item").where(F.col("base_role").isNull() | (F.col("base_role") == F.col("_base")))
    found = members(arcs, have).drop("dimension_role")
    usable = found.where("usable").select("hypercube", "cube_role", "dimension", "member").distinct()
    pairs = found.where("parent is not null")
    place = F.concat_ws(BAR, "hypercube", "cube_role", "dimension")
    links = pairs.select(F.concat(place, F.lit(BAR), "parent").alias("parent"), F.concat(place, F.lit(BAR), "member").alias("child"))
    start = asked.withColumn("source", F.concat(place, F.lit(BAR), "from_member"))
    met = reach(links, start.select("source").distinct(), 1 if axis == "DRS-child" else 0).select("source", _node("node").alias("member"))
    back = pairs.where("parent = member").select(F.concat(place, F.lit(BAR), "parent").alias("source"), "member")
    out = start.join(met.unionByName(back), "source").join(usable, ["hypercube", "cube_role", "dimension", "member"], "left_semi")
    return out.select("primary_item", "dimension", "from_member", "base_role", "member").distinct()
