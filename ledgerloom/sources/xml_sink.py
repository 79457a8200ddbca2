"""Facts as XML documents of any size, tuples around what they hold.

A document is rows of text in order: its head, contexts, units, the tags and values of facts, its foot. Where a tuple's closing
tag stands follows from the tuples' intervals (see ``operators.hierarchies``), so nesting needs no stack and no
document is ever one value: Spark sorts the rows within partitions and its text writer streams them, one file a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hierarchies
from .instance import xml_head, xml_pieces

ORDER = ["part", "at", "root", "inner", "closes", "turn"]


def lines(facts: DataFrame, contexts: DataFrame, units: DataFrame, schema_ref: str) -> DataFrame:
    """(doc_id, ORDER, line): rows of documents that read as XML in their order. A fact whose tuple isn't there stands alone;
    tuples in a circle, which no root holds, are left out."""
    cx, ux, fx = xml_pieces(facts, contexts, units)
    blank = lambda df, part, at: df.select("doc_id", F.lit(part).alias("part"), at.cast("string").alias("at"), F.lit("").alias("root"), F.lit(0).cast("long").alias("inner"), F.lit(0).alias("closes"), F.lit(0).alias("turn"), F.col("x").alias("line"))
    docs = facts.select("doc_id").distinct()
    head, foot = docs.withColumn("x", F.lit(xml_head(schema_ref))), docs.withColumn("x", F.lit("</xbrl>"))
    tuples = fx.select("doc_id", F.col("parent_id").alias("fact_id")).where("fact_id is not null").distinct()
    holders = fx.select("doc_id", "fact_id").join(tuples, ["doc_id", "fact_id"], "left_semi").withColumn("_holds", F.lit(True))
    above = holders.select("doc_id", F.col("fact_id").alias("parent_id"), F.lit(True).alias("_in"))
    own = fx.join(holders, ["doc_id", "fact_id"], "left").join(above, ["doc_id", "parent_id"], "left")
    place = F.format_string("%010d", "ordinal")
    alone = own.where("_holds is null and _in is null")
    nested = own.where("_holds or _in")
    none = F.lit(None).cast("string")
    places = nested.select(F.col("doc_id").alias("role"), F.col("fact_id").alias("node"), F.when(F.col("_in"), F.col("parent_id")).alias("parent_node"), none.alias("concept"), none.alias("parent"), F.col("ordinal").alias("n"), F.lit(0.0).alias("ord"), none.alias("preferred_label"))
    tree = hierarchies.labelled(places).select(F.col("role").alias("doc_id"), F.col("node").alias("fact_id"), "root", "first", "last", "depth")
    roots = nested.select("doc_id", F.col("fact_id").alias("root"), place.alias("at"))
    inside = nested.join(tree, ["doc_id", "fact_id"]).join(roots, ["doc_id", "root"])
    row = lambda line, inner, closes, turn: F.struct(inner.cast("long").alias("inner"), F.lit(closes).alias("closes"), turn.cast("int").alias("turn"), line.alias("line"))
    opens = row(F.when(F.col("_holds"), F.col("opening")).otherwise(F.col("x")), F.col("first"), 0, F.lit(0))
    closes = row(F.col("closing"), F.col("last"), 1, -F.col("depth"))
    tagged = inside.withColumn("e", F.explode(F.when(F.col("_holds"), F.array(opens, closes)).otherwise(F.array(opens))))
    tagged = tagged.select("doc_id", F.lit(3).alias("part"), "at", "root", "e.*")
    return reduce_union([blank(head, 0, F.lit("")), blank(cx, 1, F.col("k")), blank(ux, 2, F.col("k")), blank(alone, 3, place).withColumn("root", F.lit("")), tagged, blank(foot, 4, F.lit(""))])


def reduce_union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for df in tables[1:]:
        out = out.unionByName(df)
    return out


def write(facts: DataFrame, contexts: DataFrame, units: DataFrame, schema_ref: str, path: str) -> None:
    """Documents under ``path``, a folder doc_id=... with one file each. A task streams its sorted rows; it holds none back."""
    rows = lines(facts, contexts, units, schema_ref).repartition("doc_id").sortWithinPartitions("doc_id", *ORDER)
    rows.select("doc_id", "line").write.partitionBy("doc_id").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of written documents."""
    return spark.read.option("basePath", path).text(f"{path}/doc_id=*", wholetext=True).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("value").alias("text"))
