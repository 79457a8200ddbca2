"""Traversal of concept networks: joins repeated over a shrinking frontier, and what is built on them."""

from __future__ import annotations

from graphlib import CycleError, TopologicalSorter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rounds import Rounds

AXES = ("descendant", "child", "ancestor", "parent", "sibling", "sibling-or-descendant", "descendant-or-self", "child-or-self", "ancestor-or-self", "parent-or-self")


def edges(arcs: DataFrame, role: str | None = None, arcrole: str | None = None, link_name: str | None = None, arc_name: str | None = None) -> DataFrame:
    """Arcs in force: of arcs between the same two concepts that of highest priority, and none if it prohibits."""
    for col, value in (("role", role), ("arcrole", arcrole), ("link_name", link_name), ("arc_name", arc_name)):
        if value is not None:
            arcs = arcs.where(F.col(col) == value)
    w = Window.partitionBy("role", "arcrole", "from", "to", "ord").orderBy(F.desc("priority"), F.when(F.col("use") == "prohibited", 0).otherwise(1))
    return arcs.withColumn("_n", F.row_number().over(w)).where("_n = 1 and coalesce(`use`, 'optional') <> 'prohibited'").drop("_n")


def reach(pairs: DataFrame, sources: DataFrame, generations: int = 0) -> DataFrame:
    """(source, node, depth) for all nodes met from ``sources`` (a column ``source``) over (parent, child), at least depth.

    Each round joins the frontier with the pairs and drops what its source has met already, so cycles end, a node with
    many ways to it is entered once, and the rounds go on until nothing new is met.
    """
    rounds = Rounds()
    pairs = rounds.keep(pairs.select(F.col("parent").alias("_p"), F.col("child").alias("_c")).distinct())
    frontier = sources.select("source", F.col("source").alias("node")).distinct()
    met, found, n = frontier, None, 0
    while not generations or n < generations:
        n += 1
        step = frontier.join(pairs, F.col("node") == F.col("_p")).select("source", F.col("_c").alias("node")).distinct()
        frontier = step.join(met, ["source", "node"], "left_anti")
        if not generations:
            frontier = rounds.keep(frontier)
            if frontier.isEmpty():
                break
        level = frontier.withColumn("depth", F.lit(n))
        met, found = met.unionByName(frontier), level if found is None else found.unionByName(level)
    if found is None:
        return frontier.withColumn("depth", F.lit(n)).limit(0)
    return found if generations else rounds.last(found)


def concept_relationships(arcs: DataFrame, source: str | DataFrame, axis: str, role: str | None = None, arcrole: str | None = None, generations: int = 0, link_name: str | None = None, arc_name: str | None = None) -> DataFrame:
    """(source, concept, depth) of the concepts on an axis from the source; one generation for child and parent."""
    if axis not in AXES:
        raise ValueError(f"unknown axis {axis}")
    spark = arcs.sparkSession
    own = edges(arcs, role, arcrole, link_name, arc_name)
    down = own.select(F.col("from").alias("parent"), F.col("to").alias("child"))
    up = own.select(F.col("to").alias("parent"), F.col("from").alias("child"))
    start = source if isinstance(source, DataFrame) else spark.createDataFrame([(source,)], "source string")
    base = axis.removesuffix("-or-self")
    one = lambda d: d.select("source", F.col("node").alias("concept"), "depth")
    if base in ("child", "descendant"):
        out = one(reach(down, start, 1 if base == "child" else generations))
    elif base in ("parent", "ancestor"):
        out = one(reach(up, start, 1 if base == "parent" else generations))
    else:
        above = one(reach(up, start, 1)).select("source", F.col("concept").alias("_p"))
        out = above.join(down.withColumnRenamed("parent", "_p"), "_p").where("child <> source").select("source", F.col("child").alias("concept"), F.lit(0).alias("depth"))
        roots = own.select(F.col("from").alias("concept")).distinct().join(own.select(F.col("to").alias("concept")).distinct(), "concept", "left_anti")
        at_root = start.join(roots.select(F.col("concept").alias("source")), "source", "left_semi")  # roots are siblings of each other
        out = out.unionByName(at_root.join(roots, F.col("source") != F.col("concept")).select("source", "concept", F.lit(0).alias("depth")))
        if base == "sibling-or-descendant":
            out = out.unionByName(one(reach(down, start, generations)))
    if axis.endswith("-or-self"):
        out = out.unionByName(start.select("source", F.col("source").alias("concept"), F.lit(0).alias("depth")))
    return out.distinct()


def _sortable(n: Column) -> Column:
    """A number as text that sorts like it: six digits, and a letter that grows with the length before longer ones."""
    text = n.cast("string")
    return F.when(F.length(text) <= 6, F.lpad(text, 6, "0")).otherwise(F.concat(F.char(F.length(text) + 58), text))


def walk(arcs: DataFrame, root: str, role: str | None = None, arcrole: str | None = None) -> DataFrame:
    """The tree below a root in document order: concept, parent, depth, ord, and a sortable path."""
    spark = arcs.sparkSession
    own = edges(arcs, role, arcrole)
    place = Window.partitionBy("from").orderBy("ord", "priority", "to")
    own = own.withColumn("_n", _sortable(F.row_number().over(place))).select(F.col("from").alias("_p"), F.col("to").alias("_c"), F.col("ord").alias("_o"), "_n", F.col("preferred_label").alias("_l"))
    rounds = Rounds()
    own = rounds.keep(own)
    level = spark.createDataFrame([(root, None, 0, None, None, "", [root])], "concept string, parent string, depth int, ord double, preferred_label string, sort string, path array<string>")
    out = level
    depth = 0
    while True:  # a path ends before it meets a concept again, so the walk does too
        depth += 1
        step = level.join(own, F.col("concept") == F.col("_p")).where(~F.array_contains("path", F.col("_c")))
        level = step.select(F.col("_c").alias("concept"), F.col("concept").alias("parent"), F.lit(depth).alias("depth"), F.col("_o").alias("ord"), F.col("_l").alias("preferred_label"), F.concat("sort", F.lit("/"), "_n").alias("sort"), F.concat("path", F.array("_c")).alias("path"))
        level = rounds.keep(level)
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return rounds.last(out.drop("path")).orderBy("sort")


def keep_related(facts: DataFrame, arcs: DataFrame, source: str, axis: str, test: Column | None = None, **link) -> DataFrame:
    """Facts whose concept is on an axis from the source concept."""
    near = concept_relationships(arcs, source, axis, **link).select("concept")
    return (facts.where(test) if test is not None else facts).join(near, "concept", "left_semi")


def member_network(dim_members: DataFrame, dimension: str, role: str, arcrole: str, start: str, axis: str) -> DataFrame:
    """Members met from a member of a dimension over one arc role in one link role."""
    own = dim_members.where((F.col("dimension") == dimension) & (F.col("role") == role) & (F.col("arcrole") == arcrole))
    arcs = own.select("role", "arcrole", F.col("parent").alias("from"), F.col("member").alias("to"), F.lit(1.0).alias("ord"), F.lit(0).alias("priority"), F.lit("optional").alias("use"), F.lit("").alias("link_name"), F.lit("").alias("arc_name"))
    return concept_relationships(arcs, start, axis)


def valid_members(hypercubes: DataFrame, hypercube_dims: DataFrame, dim_members: DataFrame, primary_item: str, dimension: str) -> DataFrame:
    """Usable members of a dimension in the hypercubes of a primary item."""
    cubes = hypercubes.where(F.col("primary_item") == primary_item).select("hypercube", "role")
    dims = hypercube_dims.where(F.col("dimension") == dimension).join(cubes, ["hypercube", "role"], "left_semi").select("dimension", "role")
    return dim_members.join(dims, ["dimension", "role"], "left_semi").where("usable").select("member").distinct()


def concrete_parents(arcs: DataFrame, concepts: DataFrame, role: str | None = None, arcrole: str | None = None) -> DataFrame:
    """Concepts that are not abstract and have children that are not."""
    real = concepts.where("not abstract").select("concept")
    own = edges(arcs, role, arcrole)
    kids = own.join(real.select(F.col("concept").alias("to")), "to", "left_semi")
    return kids.select(F.col("from").alias("concept")).distinct().join(real, "concept", "left_semi")


def directed_cycles(arcs: DataFrame, role: str | None = None, arcrole: str | None = None) -> DataFrame:
    """Concepts on a directed cycle.

    Concepts without parents or without children are pruned until none is left to prune. Of what stays each concept learns the least
    name that reaches it; what reaches that name back among those with the same one lies on cycles with it, and is taken out. All
    arcs between different least names go too, as no cycle has them. A concept stands in each table once, so tables are no larger than
    the network; rounds grow with the longest way, and with how many cycles stand behind each other."""
    rounds = Rounds()
    own = edges(arcs, role, arcrole).select(F.col("from").alias("parent"), F.col("to").alias("child")).distinct()
    own = rounds.keep(own)
    out = own.where("parent = child").select(F.col("parent").alias("concept"))
    own = rounds.keep(own.where("parent <> child"))
    while True:
        own = _without_ends(own, rounds)
        if own.isEmpty():
            return rounds.last(out.distinct())
        marked = _least_above(own, rounds)
        mark = lambda side: marked.select(F.col("node").alias(side), F.col("least").alias(f"_{side}"))  # noqa: E731, B023
        own = rounds.keep(own.join(mark("parent"), "parent").join(mark("child"), "child").where("_parent = _child").select("parent", "child"))
        starts = marked.where("node = least").select(F.col("node").alias("source"))
        back = reach(own.select(F.col("child").alias("parent"), F.col("parent").alias("child")), starts)
        back = rounds.keep(back.select("source", "node"))
        out = out.unionByName(back.select(F.col("node").alias("concept"))).unionByName(back.select(F.col("source").alias("concept")))
        done = starts.select(F.col("source").alias("node")).unionByName(back.select("node")).distinct()
        own = rounds.keep(own.join(done.withColumnRenamed("node", "parent"), "parent", "left_anti").join(done.withColumnRenamed("node", "child"), "child", "left_anti").select("parent", "child"))


def _without_ends(own: DataFrame, rounds: Rounds) -> DataFrame:
    """Pairs (parent, child) whose parent has a parent and whose child has a child, to the end."""
    n = own.count()
    while n:
        kept = own.join(own.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi")
        own = rounds.keep(kept.join(kept.select(F.col("parent").alias("child")).distinct(), "child", "left_semi").select("parent", "child"))
        m = own.count()
        if m == n:
            break
        n = m
    return own


def _least_above(own: DataFrame, rounds: Rounds) -> DataFrame:
    """(node, least): the least name of those that reach a node, its own included; only nodes whose least name fell tell others."""
    nodes = own.select(F.col("parent").alias("node")).unionByName(own.select(F.col("child").alias("node"))).distinct()
    marked = rounds.keep(nodes.select("node", F.col("node").alias("least"), F.lit(True).alias("_new")))
    while not marked.where("_new").isEmpty():
        told = marked.where("_new").join(own, F.col("node") == F.col("parent")).groupBy(F.col("child").alias("node")).agg(F.min("least").alias("_told"))
        fell = F.coalesce(F.col("_told") < F.col("least"), F.lit(False))
        marked = rounds.keep(marked.join(told, "node", "left").select("node", F.least("least", "_told").alias("least"), fell.alias("_new")))
    return marked.select("node", "least")


def undirected_cycles(arcs: DataFrame, role: str | None = None, arcrole: str | None = None) -> DataFrame:
    """Concepts with two ways to them from one ancestor.

    Concepts with a single neighbour are pruned until none is left. Where two ways part, they leave an ancestor by two
    children, so it is enough to follow what is left from each child of an ancestor with several.
    """
    rounds = Rounds()
    own = rounds.keep(edges(arcs, role, arcrole).select(F.col("from").alias("parent"), F.col("to").alias("child")).distinct())
    n = own.count()
    while n:
        ends = own.select(F.col("parent").alias("c")).unionByName(own.select(F.col("child").alias("c"))).groupBy("c").count()
        single = ends.where("count = 1").select("c")
        own = rounds.keep(own.join(single.withColumnRenamed("c", "parent"), "parent", "left_anti").join(single.withColumnRenamed("c", "child"), "child", "left_anti").select("parent", "child"))
        m = own.count()
        if m == n:
            break
        n = m
    parting = own.join(own.groupBy("parent").count().where("count > 1").select("parent"), "parent", "left_semi")
    starts = rounds.keep(parting.select(F.col("parent").alias("ancestor"), F.col("child").alias("source")))
    below = reach(own, starts.select("source").distinct()).select("source", "node")
    met = starts.select("ancestor", F.col("source").alias("via"), F.col("source").alias("node"))
    met = met.unionByName(starts.join(below, "source").select("ancestor", F.col("source").alias("via"), "node"))
    return met.groupBy("ancestor", "node").agg(F.count_distinct("via").alias("ways")).where("ways > 1").select(F.col("node").alias("concept")).distinct()


def dependency_order(needs: dict[str, set[str]]) -> list[str]:
    """Names after what they need; a cycle is an error. For rules and parameters, which are few."""
    try:
        return list(TopologicalSorter(needs).static_order())
    except CycleError as e:
        raise ValueError(f"circular definition: {' -> '.join(map(str, e.args[1]))}") from e


def ancestors_of_facts(facts: DataFrame) -> DataFrame:
    """(doc_id, fact_id, ancestor_id, depth) over tuples, by repeated self-join until nothing new is met."""
    rounds = Rounds()
    up = rounds.keep(facts.where("parent_id is not null").select("doc_id", "fact_id", F.col("parent_id").alias("ancestor_id")))
    above = up.select(F.col("doc_id").alias("_d"), F.col("fact_id").alias("_f"), F.col("ancestor_id").alias("_a"))
    level, out, depth = up, up.withColumn("depth", F.lit(1)), 1
    while True:
        depth += 1
        step = level.join(above, (F.col("doc_id") == F.col("_d")) & (F.col("ancestor_id") == F.col("_f"))).select("doc_id", "fact_id", F.col("_a").alias("ancestor_id")).distinct()
        level = rounds.keep(step.join(out.select("doc_id", "fact_id", "ancestor_id"), ["doc_id", "fact_id", "ancestor_id"], "left_anti"))
        if level.isEmpty():
            return rounds.last(out)
        out = out.unionByName(level.withColumn("depth", F.lit(depth)))


def with_places(facts: DataFrame, levels: int) -> DataFrame:
    """``facts`` with the tuples around each fact as columns up_2, up_3, ... (up_1 is parent_id)."""
    above = facts.where("parent_id is not null").select(F.col("doc_id").alias("_d"), F.col("fact_id").alias("_f"), F.col("parent_id").alias("_p"))
    at = F.col("parent_id")
    for n in range(2, levels + 1):
        facts = facts.join(above, (F.col("doc_id") == F.col("_d")) & (at == F.col("_f")), "left").drop("_d", "_f").withColumnRenamed("_p", f"up_{n}")
        at = F.col(f"up_{n}")
    return facts
