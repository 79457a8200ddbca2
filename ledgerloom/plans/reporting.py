"""Harness tables seen as a report: lines as facts, keys as dimensions, dates as periods, suppliers as entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.aspects import dims_key, period_key, unit_key

NUMBERS = {"quantity": "pure", "extendedprice": "iso4217:USD", "discount": "pure", "tax": "pure"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(value: str | None = None) -> Column:
    return F.lit(value).cast("string")


def as_facts(rows: DataFrame, concept: Column, number: Column, entity: Column, day: Column, dims: dict[str, Column], measure: Column, key: Column) -> DataFrame:
    """Wide facts with an instant at the end of a day."""
    members = F.create_map(*[x for k, v in dims.items() for x in (F.lit(k), v.cast("string"))]) if dims else F.create_map().cast("map<string,string>")
    empty = F.create_map().cast("map<string,string>")
    end = (day.cast("timestamp_ntz") + F.expr("interval 1 day")).cast("timestamp_ntz")
    none = F.lit(None).cast("timestamp_ntz")
    out = rows.select(
        _text("harness").alias("doc_id"), key.cast("string").alias("fact_id"), _text().alias("parent_id"), concept.alias("concept"), _text("urn:harness").alias("ns"), _text("decimalItemType").alias("item_type"),
        number.cast("string").alias("value"), number.cast("decimal(38,6)").alias("num"), F.lit(False).alias("is_nil"), _text().alias("decimals"), _text().alias("precision"), key.cast("string").alias("context_ref"), measure.alias("unit_ref"), F.lit(0).alias("ordinal"),
        _text("urn:entity").alias("scheme"), entity.cast("string").alias("entity"), _text("instant").alias("period_type"), none.alias("start"), end.alias("end"), members.alias("dims"), empty.alias("typed_dims"), _text().alias("non_dim"), _text().alias("scenario"),
        F.array(measure).alias("numerator"), F.array().cast("array<string>").alias("denominator"),
    )
    return out.withColumns({
        "dims_key": dims_key(F.col("dims"), F.col("typed_dims")),
        "period_key": period_key(F.col("period_type"), F.col("start"), F.col("end")),
        "entity_key": F.concat_ws("|", "scheme", "entity"),
        "unit_key": unit_key(F.col("numerator"), F.col("denominator")),
    })


def line_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four facts a line; a line is named by its keys, its number and its dates."""
    lines, out = table(spark, sf_dir, "lineitem"), None
    for name, measure in NUMBERS.items():  # one projection a concept: a filter on concepts leaves the others' columns unread
        key = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.date_format("l_shipdate", "yyyyMMdd"), F.lit(name))
        facts = as_facts(lines, F.lit(name), F.col(f"l_{name}"), F.col("l_suppkey"), F.col("l_shipdate"), {"order": F.col("l_orderkey"), "part": F.col("l_partkey")}, F.lit(measure), key)
        out = facts if out is None else out.unionByName(facts)
    return out


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return as_facts(orders, _text("totalprice"), F.col("o_totalprice"), F.col("o_custkey"), F.col("o_orderdate"), {"order": F.col("o_orderkey")}, _text("iso4217:USD"), F.concat(F.lit("o-"), "o_orderkey"))


def place_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The network region, nation, customer as arcs."""
    region, nation, customer = (table(spark, sf_dir, n) for n in ("region", "nation", "customer"))
    n = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("from"), F.col("n_name").alias("to"), F.col("n_nationkey").cast("double").alias("ord"))
    c = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("from"), F.col("c_name").alias("to"), F.col("c_custkey").cast("double").alias("ord"))
    return n.unionByName(c).select(F.lit("place").alias("role"), F.lit("parent-child").alias("arcrole"), "from", "to", "ord", F.lit(1.0).alias("weight"), F.lit(0).alias("priority"), F.lit("optional").alias("use"), F.lit(None).cast("string").alias("preferred_label"), F.lit("link").alias("link_name"), F.lit("arc").alias("arc_name"))
