"""Presentation reports: facts on a tree of concepts, as a matrix of entities and years."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START_LABEL = "http://www.xbrl.org/2003/role/periodStartLabel"


def _last_day():
    return F.date_sub(F.col("end").cast("date"), 1)


def combine(instances: list[DataFrame], years: list[int] | None = None) -> DataFrame:
    """Facts of several instances, equal ones of an entity once, with the year of their end."""
    out = instances[0]
    for df in instances[1:]:
        out = out.unionByName(df)
    out = out.dropDuplicates(["concept", "entity_key", "period_key", "dims_key", "unit_key", "value"]).withColumn("year", F.year(_last_day()))
    return out.where(F.col("year").isin(years)) if years else out


def latest_in_year(wide: DataFrame) -> DataFrame:
    """Of an entity's facts for a concept, dimensions and unit in a year the last; of equal ends the shortest period."""
    w = Window.partitionBy("entity_key", "concept", "dims_key", "unit_key", "year").orderBy(F.desc("end"), F.desc(F.coalesce("start", "end")), "doc_id", "fact_id")
    return wide.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def place(tree: DataFrame, wide: DataFrame) -> DataFrame:
    """Tree nodes with their facts; nodes without stay as headings."""
    return tree.join(wide, "concept", "left")


def with_opening(placed: DataFrame) -> DataFrame:
    """Nodes labelled as period starts show the value of the period before, blank where there is none."""
    w = Window.partitionBy("sort", "entity_key", "dims_key", "unit_key").orderBy("end", "fact_id")
    opening = F.lag("num").over(w)
    return placed.withColumn("shown", F.when(F.col("preferred_label") == START_LABEL, opening).otherwise(F.col("num")))


def prune(tree: DataFrame, facts: DataFrame) -> DataFrame:
    """Nodes that have facts, or have such nodes below them: by prefixes of the sort path, without recursion."""
    used = tree.join(facts.select("concept").distinct(), "concept", "left_semi").select("sort")
    depth = F.size(F.split("sort", "/"))
    ups = used.select(F.explode(F.sequence(F.lit(1), depth)).alias("n"), "sort").select(F.array_join(F.slice(F.split("sort", "/"), F.lit(1), F.col("n")), "/").alias("sort")).distinct()
    return tree.join(ups, "sort", "left_semi")


def matrix(placed: DataFrame, years: list[int], value: str = "num") -> DataFrame:
    """Rows by node, entity and dimensions; one column a year. The years are given, so no extra pass finds them."""
    cells = [F.max_by(value, F.struct("end", "fact_id")).alias("v")]
    return placed.groupBy("sort", "depth", "concept", "entity_key", "dims_key").pivot("year", years).agg(*cells).orderBy("sort", "entity_key", "dims_key")


def compare(a: DataFrame, b: DataFrame, years: list[int]) -> DataFrame:
    """Two matrices side by side with differences."""
    keys = ["sort", "concept", "entity_key", "dims_key"]
    one = a.select(*keys, *[F.col(f"`{y}`").alias(f"a_{y}") for y in years])
    two = b.select(*keys, *[F.col(f"`{y}`").alias(f"b_{y}") for y in years])
    j = one.join(two, keys, "full")
    return j.withColumns({f"diff_{y}": F.coalesce(f"b_{y}", F.lit(0)) - F.coalesce(f"a_{y}", F.lit(0)) for y in years})


def classify(concepts: DataFrame) -> DataFrame:
    """What a node is, by its substitution group and whether it is abstract."""
    group = F.lower("subst_group")
    kind = F.when(group.endswith("hypercubeitem"), "table").when(group.endswith("dimensionitem"), "axis").when(group.endswith("tuple"), "tuple").when(F.col("abstract"), "heading").otherwise("line")
    return concepts.withColumn("node_kind", kind)


def to_html(rows: DataFrame, years: list[int]) -> DataFrame:
    """One HTML row a line; formatted by Spark, so any writer can store it."""
    cell = lambda y: F.concat(F.lit("<td>"), F.coalesce(F.format_number(F.col(f"`{y}`").cast("double"), 0), F.lit("")), F.lit("</td>"))
    name = F.concat(F.lit('<td style="padding-left:'), F.col("depth").cast("string"), F.lit('em">'), F.replace(F.replace("concept", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</td>"))
    return rows.select("sort", F.concat(F.lit("<tr>"), name, *map(cell, years), F.lit("</tr>")).alias("html"))


def to_json(rows: DataFrame) -> DataFrame:
    return rows.select("sort", F.to_json(F.struct(*rows.columns)).alias("json"))


# --- balances over time -----------------------------------------------------------------------------------------


def opening_closing(balances: DataFrame, by: list[str], value: str = "num", when: str = "end") -> DataFrame:
    """Each balance with the one before it."""
    w = Window.partitionBy(*by).orderBy(when)
    return balances.withColumn("opening", F.lag(value).over(w)).withColumnRenamed(value, "closing")


def roll_forward(balances: DataFrame, changes: DataFrame, by: list[str], radius: float = 1.0) -> DataFrame:
    """Opening plus the changes of a period against closing. Instants equal the durations' ends and starts."""
    sums = changes.groupBy(*by, "start", "end").agg(F.sum("num").alias("change"))
    opening = balances.select(*by, F.col("end").alias("start"), F.col("num").alias("opening"))
    closing = balances.select(*by, "end", F.col("num").alias("closing"))
    j = sums.join(opening, [*by, "start"]).join(closing, [*by, "end"])
    gap = F.col("opening") + F.col("change") - F.col("closing")
    return j.withColumns({"gap": gap, "satisfied": F.abs(gap) <= radius})
