"""Networks as trees whose nodes carry intervals, so that below, above and prune are range predicates.

``occurrences`` names each place of a concept in its role's trees: where every concept has one parent these are
the concepts, without any rounds; where some have several, their trees are unfolded level by level. ``labelled`` walks
around all trees at once: entering and leaving a node that has others below it are elements of a list, whose ranks (by pointer
doubling, in a number of rounds that grows with the logarithm of such nodes, not with the depth) give each node's place in document
order, the last place below it, and its depth; leaves are counted by windows. Saved trees are sorted by place, so ranges skip row groups.

Cycles: a node that is met again on its own path ends the path; concepts only reached from a cycle have no root and stand in
no tree. Empty networks give empty tables. Concepts may stand at many places; roots are sorted by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import intervals
from .networks import edges
from .rounds import Rounds, list_ranks

COLUMNS = ["role", "root", "node", "parent_node", "concept", "parent", "depth", "ord", "preferred_label", "first", "last"]
MARK = "\x1f"


def occurrences(arcs: DataFrame, arcrole: str | None = None, role: str | None = None) -> DataFrame:
    """(role, node, parent_node, concept, parent, n, ord, preferred_label): each place of each concept; n is its place among
    its siblings. Roots have no parent."""
    rounds = Rounds()
    place = Window.partitionBy("role", "from").orderBy("ord", "priority", "to")
    own = edges(arcs, role, arcrole).select("role", "from", "to", "ord", "preferred_label", F.row_number().over(place).alias("n"))
    own = rounds.keep(own.select("role", F.col("from").alias("parent"), F.col("to").alias("concept"), "ord", "preferred_label", "n"))
    shared = own.groupBy("role", "concept").count().where("count > 1").select("role").distinct()
    roots = own.select("role", F.col("parent").alias("concept")).distinct().join(own.select("role", "concept"), ["role", "concept"], "left_anti")
    none, zero = F.lit(None).cast("string"), F.lit(None).cast("double")
    root = roots.select("role", F.col("concept").alias("node"), none.alias("parent_node"), "concept", none.alias("parent"), F.row_number().over(Window.partitionBy("role").orderBy("concept")).alias("n"), zero.alias("ord"), none.alias("preferred_label"))
    plain = own.join(shared, "role", "left_anti").select("role", F.col("concept").alias("node"), F.col("parent").alias("parent_node"), "concept", "parent", "n", "ord", "preferred_label")
    out = root.unionByName(plain)
    level = root.join(shared, "role", "left_semi").select("role", "node", "concept", F.array("concept").alias("path"))
    level = rounds.keep(level)
    below = own.join(shared, "role", "left_semi").select(F.col("role").alias("_r"), F.col("parent").alias("_p"), F.col("concept").alias("_c"), F.col("n").alias("_n"), F.col("ord").alias("_o"), F.col("preferred_label").alias("_l"))
    while not level.isEmpty():
        step = level.join(below, (F.col("role") == F.col("_r")) & (F.col("concept") == F.col("_p"))).where(~F.array_contains("path", F.col("_c")))
        step = rounds.keep(step.select("role", F.concat_ws(MARK, "node", F.col("_n").cast("string")).alias("node"), F.col("node").alias("parent_node"), F.col("_c").alias("concept"), F.col("concept").alias("parent"), F.col("_n").alias("n"), F.col("_o").alias("ord"), F.col("_l").alias("preferred_label"), F.concat("path", F.array("_c")).alias("path")))
        out = out.unionByName(step.drop("path"))
        level = step.select("role", "node", "concept", "path")
    return out


def labelled(places: DataFrame) -> DataFrame:
    """``COLUMNS`` of places: first is a node's place in its tree (from 0), last that of the last one below it.

    Only nodes with something below them, and roots, enter the list that is ranked: entering one counts the leaves up to its first
    such child, leaving one those up to its next such sibling. A leaf is counted on from the sibling or parent before it."""
    rounds = Rounds()
    places = rounds.keep(places)
    key = lambda sign, node: F.concat(F.lit(sign), "role", F.lit(MARK), node)
    parents = places.where("parent_node is not null").groupBy("role", F.col("parent_node").alias("node")).agg(F.lit(True).alias("_inner"))
    own = places.join(parents, ["role", "node"], "left").withColumn("_inner", F.coalesce("_inner", F.col("parent_node").isNull()))
    siblings = Window.partitionBy("role", "parent_node").orderBy("n", "node")
    before = siblings.rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumns({"_leaves": F.coalesce(F.count_if(~F.col("_inner")).over(before), F.lit(0)), "_near": F.last(F.when(F.col("_inner"), F.col("node")), True).over(before)})
    own = rounds.keep(own.withColumn("_passed", F.coalesce(F.last(F.when(F.col("_inner"), F.col("_leaves")), True).over(before), F.lit(0))))

    inner = own.where("_inner")
    of_parent = own.where("parent_node is not null").groupBy("role", F.col("parent_node").alias("node")).agg(
        F.min_by("node", F.when(F.col("_inner"), F.struct("n", "node"))).alias("child"), F.min(F.when(F.col("_inner"), F.col("_leaves"))).alias("_first"), F.count_if(~F.col("_inner")).alias("_all"))
    turn = F.when(F.col("parent_node").isNotNull(), F.lead(F.struct("node", "_leaves")).over(siblings))
    inner = inner.withColumn("_turn", turn).join(of_parent.select("role", "node", "child", "_first", F.col("_all").alias("_own")), ["role", "node"], "left")
    inner = inner.join(of_parent.select("role", F.col("node").alias("parent_node"), "_all"), ["role", "parent_node"], "left")
    into = 1 + F.coalesce("_first", "_own", F.lit(0))
    past = F.coalesce(F.col("_turn")["_leaves"], F.col("_all"), F.col("_leaves")) - F.col("_leaves")
    enter = F.struct(key("+", F.col("node")).alias("id"), F.coalesce(key("+", F.col("child")), key("-", F.col("node"))).alias("next"), into.cast("long").alias("places"), F.lit(1).cast("long").alias("up"))
    leave = F.struct(key("-", F.col("node")).alias("id"), F.coalesce(key("+", F.col("_turn")["node"]), key("-", F.col("parent_node"))).alias("next"), past.cast("long").alias("places"), F.lit(-1).cast("long").alias("up"))
    ranks = list_ranks(inner.select(F.explode(F.array(enter, leave)).alias("e")).select("e.*"), ["places", "up"], rounds).where("not cyclic")
    entering = ranks.where("id like '+%'").select(F.substring("id", 2, 1 << 30).alias("_id"), F.substring("last", 2, 1 << 30).alias("_root"), F.col("places").alias("_here"), F.col("up").alias("_up"))
    leaving = ranks.where("id like '-%'").select(F.substring("id", 2, 1 << 30).alias("_id"), F.col("places").alias("_after"))
    both = entering.join(leaving, "_id")
    total = both.where("_id = _root").select("_root", F.col("_here").alias("_total"))
    both = both.join(total, "_root").select("_id", F.substring_index("_root", MARK, -1).alias("root"), (F.col("_total") - F.col("_here")).alias("first"), (F.col("_total") - F.col("_after") - 1).alias("last"), (-F.col("_up")).cast("int").alias("depth"))
    both = rounds.keep(both)
    out = own.where("_inner").withColumn("_id", F.concat("role", F.lit(MARK), "node")).join(both, "_id").select(*COLUMNS)

    leaf = own.where("not _inner").withColumn("_id", F.concat("role", F.lit(MARK), F.coalesce("_near", "parent_node"))).join(both.withColumnsRenamed({"first": "_f", "last": "_l", "depth": "_d"}), "_id")
    here = F.when(F.col("_near").isNull(), F.col("_f")).otherwise(F.col("_l")) + 1 + F.col("_leaves") - F.col("_passed")
    leaf = leaf.withColumns({"first": here, "last": here, "depth": F.when(F.col("_near").isNull(), F.col("_d") + 1).otherwise(F.col("_d"))})
    return out.unionByName(leaf.select(*COLUMNS))


def tree(arcs: DataFrame, arcrole: str | None = None, role: str | None = None) -> DataFrame:
    """The labelled trees of all roles of a network."""
    return labelled(occurrences(arcs, arcrole, role))


def save(trees: DataFrame, path: str) -> None:
    trees.repartitionByRange("role", "root", "first").sortWithinPartitions("role", "root", "first").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*COLUMNS)


def below(trees: DataFrame, anchors: DataFrame, itself: bool = False, generations: int | None = None) -> DataFrame:
    """Places below those of the anchors (a column ``anchor`` of concepts): the trees' columns with the anchor, and away, the
    generations between them."""
    at = trees.join(anchors.select(F.col("anchor").alias("concept")).distinct(), "concept")
    at = at.select("role", "root", F.col("concept").alias("anchor"), F.col("depth").alias("_depth"), (F.col("first") + (0 if itself else 1)).alias("_from"), F.col("last").alias("_to"))
    out = intervals.hold(trees, at, "first", "_from", "_to", ["role", "root"]).withColumn("away", F.col("depth") - F.col("_depth")).drop("_depth", "_from", "_to")
    return out if generations is None else out.where(F.col("away") <= generations)


def above(trees: DataFrame, points: DataFrame, itself: bool = False) -> DataFrame:
    """Places above those of the points (a column ``point`` of concepts), with the point and away."""
    at = trees.join(points.select(F.col("point").alias("concept")).distinct(), "concept")
    at = at.select("role", "root", F.col("concept").alias("point"), F.col("depth").alias("_depth"), F.col("first").alias("_at"))
    out = intervals.hold(at, trees, "_at", "first", "last", ["role", "root"]).withColumn("away", F.col("_depth") - F.col("depth")).drop("_depth", "_at")
    return out if itself else out.where("away > 0")


def pruned(trees: DataFrame, kept: DataFrame) -> DataFrame:
    """The trees without the places that have none of the kept concepts (a column ``concept``) at or below them; numbered anew,
    so that intervals fit what is left."""
    at = trees.join(kept.select("concept").distinct(), "concept", "left_semi").select("role", "root", F.col("first").alias("_at"))
    points = at.distinct()
    above = trees.where("last > first").select("role", "root", "node", "first", "last")
    stay = intervals.hold(points, above, "_at", "first", "last", ["role", "root"]).select("role", "root", "node")
    stay = stay.unionByName(trees.join(kept.select("concept").distinct(), "concept", "left_semi").select("role", "root", "node")).distinct()
    left = trees.join(stay, ["role", "root", "node"], "left_semi")
    places = left.select("role", "node", "parent_node", "concept", "parent", F.col("first").alias("n"), "ord", "preferred_label")
    return labelled(places)


def to_depth(trees: DataFrame, most: int) -> DataFrame:
    """The upper levels of the trees; intervals still count what is cut off."""
    return trees.where(F.col("depth") <= most)


def flattened(trees: DataFrame) -> DataFrame:
    """Places in document order, the concepts indented by their depth."""
    return trees.select("role", "root", "first", "depth", "concept", F.concat(F.repeat(F.lit("  "), F.col("depth")), "concept").alias("line"), (F.col("last") == F.col("first")).alias("leaf")).orderBy("role", "root", "first")
