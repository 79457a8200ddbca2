"""Queries of the engine over the harness tables, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import equality, registry, transforms
from ..functions.numbers import format_number
from ..functions.rounding import inferred_decimals, inferred_precision, order_of, round_even
from ..operators import calc, contexts, filters, networks, report, rules, sets
from ..operators.facts import duplicates, with_default_units
from .reporting import as_facts, line_facts, order_facts, place_arcs, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# --- facts and contexts -----------------------------------------------------------------------------------------


@query("""
    SELECT concept, CAST(count(*) AS BIGINT) AS facts, round(sum(v), 2) AS total FROM (
      SELECT 'quantity' AS concept, l_quantity AS v FROM lineitem UNION ALL SELECT 'extendedprice', l_extendedprice FROM lineitem
      UNION ALL SELECT 'discount', l_discount FROM lineitem UNION ALL SELECT 'tax', l_tax FROM lineitem) GROUP BY concept""")
def fact_melt(spark: SparkSession, d: str) -> DataFrame:
    return line_facts(spark, d).groupBy("concept").agg(F.count(F.lit(1)).alias("facts"), F.round(F.sum(F.col("num").cast("double")), 2).alias("total"))


@query("SELECT o_orderkey AS order_key, o_totalprice AS price FROM orders WHERE o_orderdate = TIMESTAMP '1997-03-15'")
def period_instant(spark: SparkSession, d: str) -> DataFrame:
    f = order_facts(spark, d).where(filters.period_instant_is("1997-03-15").column())
    return f.select(f["dims"]["order"].cast("long").alias("order_key"), F.col("num").cast("double").alias("price"))


@query("SELECT o_orderkey AS order_key FROM orders WHERE year(o_orderdate) = 1996")
def period_year(spark: SparkSession, d: str) -> DataFrame:
    return contexts.Contexts(order_facts(spark, d)).for_year(1996).df.select(F.col("dims")["order"].cast("long").alias("order_key"))


@query("SELECT o_orderkey AS order_key FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1995-06-30'")
def period_contains(spark: SparkSession, d: str) -> DataFrame:
    """Periods of 181 days from the order's day that contain a date."""
    f = order_facts(spark, d).withColumns({"period_type": F.lit("duration"), "start": F.col("end") - F.expr("interval 1 day")})
    f = f.withColumn("end", F.col("start") + F.expr("interval 181 day"))
    return contexts.Contexts(f).containing_date("1995-06-30").df.select(F.col("dims")["order"].cast("long").alias("order_key"))


@query("SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS year FROM orders ORDER BY year")
def discrete_years(spark: SparkSession, d: str) -> DataFrame:
    return contexts.Contexts(order_facts(spark, d)).years()


@query("SELECT 'urn:entity' AS scheme, CAST(o_custkey AS VARCHAR) AS entity FROM orders GROUP BY o_custkey")
def all_entities(spark: SparkSession, d: str) -> DataFrame:
    return contexts.Contexts(order_facts(spark, d)).entities()


@query("SELECT 'order' AS dimension, CAST(count(*) AS BIGINT) AS contexts FROM lineitem UNION ALL SELECT 'part', count(*) FROM lineitem")
def explicit_dimensions(spark: SparkSession, d: str) -> DataFrame:
    f = line_facts(spark, d).where("concept = 'quantity'").withColumn("context_id", F.col("context_ref"))
    return contexts.Contexts(f).explicit_dimensions(listed=False)


@query("SELECT l_orderkey AS order_key, l_partkey AS part_key, l_quantity AS quantity FROM lineitem WHERE l_partkey = 17")
def segment_filter(spark: SparkSession, d: str) -> DataFrame:
    f = contexts.Contexts(line_facts(spark, d).where("concept = 'quantity'")).with_segment("PART", "17").df
    return f.select(F.col("dims")["order"].cast("long").alias("order_key"), F.col("dims")["part"].cast("long").alias("part_key"), F.col("num").cast("double").alias("quantity"))


@query("SELECT min(o_orderdate) AS start, max(o_orderdate) + INTERVAL 1 DAY AS \"end\" FROM orders")
def context_duration(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderdate").alias("start"), (F.col("o_orderdate") + F.expr("interval 1 day")).alias("end"))
    return contexts.Contexts(o).duration()


@query("SELECT strftime(min(o_orderdate), '%Y-%m-%d') || ' - ' || strftime(max(o_orderdate), '%Y-%m-%d') AS label FROM orders")
def period_label(spark: SparkSession, d: str) -> DataFrame:
    return contexts.Contexts(order_facts(spark, d)).period_label()


@query("SELECT CAST(l_orderkey AS BIGINT) AS order_key, l_linenumber AS line, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_facts(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    f = as_facts(lines, F.lit("line"), F.col("l_quantity"), F.lit("e"), F.lit("2000-01-01").cast("date"), {"order": F.col("l_orderkey"), "line": F.col("l_linenumber")}, F.lit("pure"), F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey"))
    got = duplicates(f).groupBy(F.col("dims")["order"].cast("long").alias("order_key"), F.col("dims")["line"].cast("int").alias("line"))
    return got.agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag AS flag, l_linestatus AS status, min(l_orderkey) AS order_key FROM lineitem GROUP BY ALL")
def first_occurrence(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_returnflag", "l_linestatus").orderBy("l_orderkey", "l_partkey", "l_suppkey")
    first = table(spark, d, "lineitem").withColumn("n", F.row_number().over(w)).where("n = 1")
    return first.select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_orderkey").alias("order_key"))


# --- rules ------------------------------------------------------------------------------------------------------


def _number(name: str, concept: str, *more, **named) -> rules.FactVariable:
    return rules.FactVariable(name, [filters.concept_name(concept), filters.aspect_cover("unit"), *more], **named)


@query("""
    SELECT l_orderkey AS order_key, l_partkey AS part_key, l_suppkey AS supplier, l_quantity AS quantity, l_extendedprice AS price,
           l_extendedprice / l_quantity AS unit_price FROM lineitem""")
def implicit_join(spark: SparkSession, d: str) -> DataFrame:
    rule = rules.VariableSet([_number("q", "quantity"), _number("p", "extendedprice")])
    e = rules.evaluate(rule, line_facts(spark, d))
    return e.select(e["q__dims"]["order"].cast("long").alias("order_key"), e["q__dims"]["part"].cast("long").alias("part_key"), F.col("q__entity").cast("long").alias("supplier"), F.col("q").alias("quantity"), F.col("p").alias("price"), (F.col("p") / F.col("q")).alias("unit_price"))


@query("SELECT l_orderkey AS order_key, CAST(count(*) AS BIGINT) AS n, round(sum(l_extendedprice), 2) AS total, max(l_extendedprice) AS most FROM lineitem GROUP BY l_orderkey")
def sequence_sum(spark: SparkSession, d: str) -> DataFrame:
    v = _number("p", "extendedprice", filters.aspect_cover("part", "entity", "period"), bind_as_sequence=True, matches=True, aggregates=("sum", "max"))
    e = rules.evaluate(rules.VariableSet([v], dimensions=["order", "part"]), line_facts(spark, d))
    return e.select(F.col("p__key_order").cast("long").alias("order_key"), F.col("p").alias("n"), F.round("p__sum", 2).alias("total"), F.col("p__max").alias("most"))


@query("SELECT l_orderkey AS order_key, CAST(count(*) AS INT) AS n, round(sum(l_discount), 4) AS total FROM lineitem GROUP BY l_orderkey")
def sequence_items(spark: SparkSession, d: str) -> DataFrame:
    """A sequence with its items, for rules that need each of them."""
    v = _number("p", "discount", filters.aspect_cover("part", "entity", "period"), bind_as_sequence=True, matches=True)
    e = rules.evaluate(rules.VariableSet([v], dimensions=["order", "part"]), line_facts(spark, d))
    total = F.aggregate("p", F.lit(0.0), lambda a, x: a + x)
    return e.select(F.col("p__key_order").cast("long").alias("order_key"), F.size("p").alias("n"), F.round(total, 4).alias("total"))


@query("""
    SELECT o_orderkey AS order_key, coalesce(x.n, 0.0) AS lines_total FROM orders
    LEFT JOIN (SELECT l_orderkey, round(sum(l_quantity), 2) AS n FROM lineitem GROUP BY 1) x ON x.l_orderkey = o_orderkey""")
def fallback_outer(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"))
    sums = as_facts(lines, F.lit("quantity"), F.col("q"), F.lit("e"), F.lit("2000-01-01").cast("date"), {"order": F.col("l_orderkey")}, F.lit("pure"), F.concat(F.lit("l-"), "l_orderkey"))
    cover = filters.aspect_cover("unit", "entity", "period")
    rule = rules.VariableSet([rules.FactVariable("t", [filters.concept_name("totalprice"), cover]), rules.FactVariable("q", [filters.concept_name("quantity"), cover], fallback="0")])
    e = rules.evaluate(rule, order_facts(spark, d).unionByName(sums))
    return e.select(e["t__dims"]["order"].cast("long").alias("order_key"), F.round(F.col("q"), 2).alias("lines_total"))


@query("SELECT l_orderkey AS order_key, l_partkey AS part_key, l_quantity * 2 AS doubled FROM lineitem WHERE l_quantity > 45 AND l_discount < 0.03")
def precondition(spark: SparkSession, d: str) -> DataFrame:
    rule = rules.VariableSet([_number("q", "quantity"), _number("dc", "discount")], parameters=[rules.Parameter("least", "45"), rules.Parameter("most", "0.03")], preconditions=["$q > $least and $dc < $most"])
    e = rules.evaluate(rule, line_facts(spark, d))
    return e.select(e["q__dims"]["order"].cast("long").alias("order_key"), e["q__dims"]["part"].cast("long").alias("part_key"), (F.col("q") * 2).alias("doubled"))


@query("SELECT 'discount' AS assertion, CAST(count(*) FILTER (l_discount <= 0.05) AS BIGINT) AS satisfied, CAST(count(*) FILTER (l_discount > 0.05) AS BIGINT) AS unsatisfied FROM lineitem")
def value_assertion_counts(spark: SparkSession, d: str) -> DataFrame:
    rule = rules.VariableSet([_number("x", "discount")], parameters=[rules.Parameter("most", "0.05")])
    return rules.ValueAssertion("discount", rule, "$x <= $most").counts(line_facts(spark, d))


@query("SELECT l_orderkey AS order_key, l_partkey AS part_key, 'tax ' || CAST(l_tax AS VARCHAR) || ' is above {limit}' AS message FROM lineitem WHERE l_tax > 0.07")
def assertion_messages(spark: SparkSession, d: str) -> DataFrame:
    a = rules.ValueAssertion("tax", rules.VariableSet([_number("x", "tax")]), "$x <= 0.07", unsatisfied_message="tax {$x} is above {{limit}}")
    bad = a.run(line_facts(spark, d)).where("not satisfied")
    return bad.select(bad["x__dims"]["order"].cast("long").alias("order_key"), bad["x__dims"]["part"].cast("long").alias("part_key"), "message")


@query("SELECT 'none' AS assertion, CAST(count(*) AS BIGINT) AS count, count(*) = 0 AS satisfied FROM events WHERE event_type = 'refund'")
def existence_assertion(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    f = as_facts(ev, F.col("event_type"), F.col("value"), F.col("user_id"), F.col("ts").cast("date"), {"event": F.col("event_id")}, F.lit("pure"), F.col("event_id"))
    return rules.ExistenceAssertion("none", rules.VariableSet([rules.FactVariable("x", [filters.concept_name("refund")])]), "$count = 0").run(f).select("assertion", "count", "satisfied")


@query("SELECT 'some' AS assertion, CAST(count(*) AS BIGINT) AS count, count(*) > 0 AS satisfied FROM events WHERE event_type = 'purchase'")
def existence_some(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    f = as_facts(ev, F.col("event_type"), F.coalesce("value", F.lit(0.0)), F.col("user_id"), F.col("ts").cast("date"), {"event": F.col("event_id")}, F.lit("pure"), F.col("event_id"))
    return rules.ExistenceAssertion("some", rules.VariableSet([rules.FactVariable("x", [filters.concept_name("purchase")])])).run(f).select("assertion", "count", "satisfied")


@query("""
    SELECT CAST(user_id AS VARCHAR) AS doc_id, CAST(count(*) FILTER (event_type = 'purchase') AS BIGINT) AS count, count(*) FILTER (event_type = 'purchase') > 0 AS satisfied
    FROM events GROUP BY user_id""")
def existence_by_document(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events are a document; those without a purchase are counted with zero."""
    ev = table(spark, d, "events")
    f = as_facts(ev, F.col("event_type"), F.coalesce("value", F.lit(0.0)), F.col("user_id"), F.col("ts").cast("date"), {"event": F.col("event_id")}, F.lit("pure"), F.col("event_id"))
    f = f.withColumn("doc_id", F.col("entity"))
    return rules.ExistenceAssertion("some", rules.VariableSet([rules.FactVariable("x", [filters.concept_name("purchase")])])).run(f).select("doc_id", "count", "satisfied")


def _charges(spark: SparkSession, d: str) -> DataFrame:
    """Orders' charges from their lines and their totals as facts on the order alone."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("c"))
    orders = table(spark, d, "orders")
    fact = lambda df, name, value, key: as_facts(df, F.lit(name), value, F.lit("e"), F.lit("2000-01-01").cast("date"), {"order": F.col(key)}, F.lit("iso4217:USD"), F.concat(F.lit(name), F.col(key)))
    return fact(lines, "charge", F.round("c", 2), "l_orderkey").unionByName(fact(orders, "total", F.col("o_totalprice"), "o_orderkey"))


_CHARGES = "SELECT o_orderkey, o_totalprice AS reported, CAST(round(c, 2) AS DOUBLE) AS derived FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS c FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"


def _consistency(spark: SparkSession, d: str, **radius) -> DataFrame:
    f = rules.Formula("charge", rules.VariableSet([rules.FactVariable("c", [filters.concept_name("charge")])]), "$c", concept="'total'")
    got = rules.ConsistencyAssertion("charge", f, **radius).run(_charges(spark, d))
    return rules.count_outcomes(got)


@query(f"SELECT 'charge' AS assertion, CAST(count(*) FILTER (abs(derived - reported) <= 5000) AS BIGINT) AS satisfied, CAST(count(*) FILTER (abs(derived - reported) > 5000) AS BIGINT) AS unsatisfied FROM ({_CHARGES})")
def consistency_absolute(spark: SparkSession, d: str) -> DataFrame:
    return _consistency(spark, d, absolute=5000.0)


@query(f"SELECT 'charge' AS assertion, CAST(count(*) FILTER (abs(derived - reported) <= abs(reported) * 0.01) AS BIGINT) AS satisfied, CAST(count(*) FILTER (abs(derived - reported) > abs(reported) * 0.01) AS BIGINT) AS unsatisfied FROM ({_CHARGES})")
def consistency_proportional(spark: SparkSession, d: str) -> DataFrame:
    return _consistency(spark, d, proportional=0.01)


@query("""
    SELECT o_orderkey AS order_key, o_totalprice / n AS average, 'iso4217:USD/pure' AS unit FROM orders
    JOIN (SELECT l_orderkey, sum(l_quantity) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def derived_facts(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"))
    sums = as_facts(lines, F.lit("quantity"), F.col("q"), F.lit("e"), F.lit("2000-01-01").cast("date"), {"order": F.col("l_orderkey")}, F.lit("pure"), F.concat(F.lit("l-"), "l_orderkey"))
    cover = filters.aspect_cover("unit", "entity", "period")
    rule = rules.VariableSet([rules.FactVariable("t", [filters.concept_name("totalprice"), cover]), rules.FactVariable("q", [filters.concept_name("quantity"), cover])], unique_facts=True, functions=[rules.Function("ratio", ["a", "b"], "$top / $b", [("top", "$a")])])
    f = rules.Formula("average", rule, "ratio($t, $q)", concept="'average'", source="t", divide_by=["q"])
    got = f.run(order_facts(spark, d).unionByName(sums))
    return got.select(got["dims"]["order"].cast("long").alias("order_key"), F.col("derived").alias("average"), F.col("unit_key").alias("unit"))


@query("""
    WITH a AS (SELECT n_regionkey, round(sum(c_acctbal), 2) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
    b AS (SELECT n_regionkey, round(sum(s_acctbal), 2) AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
    SELECT r_name AS region, CAST(2 AS BIGINT) AS children, round_even(a.v, 0) AS reported, round_even(a.v - b.v, 0) AS calculated,
           round_even(a.v, 0) = round_even(a.v - b.v, 0) AS consistent
    FROM region JOIN a ON a.n_regionkey = r_regionkey JOIN b ON b.n_regionkey = r_regionkey""")
def calc_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Customers' balances less suppliers' as the parts of a region's total, which is reported as the customers'."""
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    def part(name: str, key: str, concept: str) -> DataFrame:
        rows = table(spark, d, name).join(nation, F.col(key) == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        sums = rows.groupBy("r_name").agg(F.round(F.sum(f"{name[0]}_acctbal"), 2).alias("v"))
        return as_facts(sums, F.lit(concept), F.col("v"), F.col("r_name"), F.lit("2000-01-01").cast("date"), {}, F.lit("iso4217:USD"), F.concat(F.lit(concept), "r_name"))
    total = part("customer", "c_nationkey", "total").withColumn("decimals", F.lit("0"))
    facts = total.unionByName(part("customer", "c_nationkey", "customers")).unionByName(part("supplier", "s_nationkey", "suppliers"))
    arcs = spark.createDataFrame([("r", "sum", "total", "customers", 1.0, 1.0, 0, "optional"), ("r", "sum", "total", "suppliers", 2.0, -1.0, 0, "optional")], "role string, arcrole string, from string, to string, ord double, weight double, priority int, use string")
    got = calc.calculation(facts, arcs, "sum")
    return got.select(F.regexp_replace("fact_id", "^total", "").alias("region"), "children", "reported", "calculated", "consistent")


@query("SELECT n_regionkey AS region, round(sum(c_acctbal * n) / sum(n), 4) AS average FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey GROUP BY 1")
def weighted_average(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation")
    c = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    rows = c.join(n, F.col("o_custkey") == F.col("c_custkey"))
    fact = lambda name, value: as_facts(rows, F.lit(name), value, F.lit("e"), F.lit("2000-01-01").cast("date"), {"who": F.col("c_custkey")}, F.lit("pure"), F.concat(F.lit(name), "c_custkey"))
    members = rows.select(F.col("n_regionkey").cast("string").alias("parent"), F.col("c_custkey").cast("string").alias("member"))
    got = calc.across_dimension(fact("balance", F.col("c_acctbal")).unionByName(fact("orders", F.col("n"))), "who", members, "orders")
    return got.select(F.col("parent").cast("int").alias("region"), F.round("total", 4).alias("average"))


@query("SELECT o_orderkey AS order_key FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def requires_element(spark: SparkSession, d: str) -> DataFrame:
    """Orders are documents that report an order, and lines if they have some."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("doc_id"), F.lit("order").alias("concept"))
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("doc_id"), F.lit("line").alias("concept"))
    arcs = spark.createDataFrame([("r", "requires", "order", "line", 1.0, 0, "optional")], "role string, arcrole string, from string, to string, ord double, priority int, use string")
    return calc.requires_element(o.unionByName(line), arcs, "requires").select(F.col("doc_id").cast("long").alias("order_key"))


@query("SELECT c_custkey AS customer FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))")
def referential_gap(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select(F.col("c_custkey").alias("customer"))


@query("SELECT l_orderkey AS order_key, l_partkey AS part_key FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate = o_orderdate + INTERVAL 30 DAY")
def instant_duration_join(spark: SparkSession, d: str) -> DataFrame:
    """Lines at the end of a thirty-day duration of their order: an equi-join on normalised moments."""
    o = order_facts(spark, d).withColumns({"start": F.col("end") - F.expr("interval 1 day"), "end": F.col("end") + F.expr("interval 30 day"), "period_type": F.lit("duration")})
    cover = filters.aspect_cover("unit", "entity", "period")
    rule = rules.VariableSet([rules.FactVariable("o", [filters.concept_name("totalprice"), cover]), rules.FactVariable("l", [filters.concept_name("quantity"), cover, filters.aspect_cover("part"), filters.instant_duration("o", "end")])], dimensions=["order", "part"])
    lines = line_facts(spark, d)
    e = rules.evaluate(rule, o.unionByName(lines))
    return e.select(e["l__dims"]["order"].cast("long").alias("order_key"), e["l__dims"]["part"].cast("long").alias("part_key"))


# --- networks ---------------------------------------------------------------------------------------------------


@query("""
    SELECT r_name AS source, n_name AS concept, CAST(1 AS INT) AS depth FROM region JOIN nation ON n_regionkey = r_regionkey
    UNION ALL SELECT r_name, c_name, 2 FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey""")
def network_descendants(spark: SparkSession, d: str) -> DataFrame:
    roots = table(spark, d, "region").select(F.col("r_name").alias("source"))
    return networks.concept_relationships(place_arcs(spark, d), roots, "descendant")


@query("""
    SELECT c_name AS source, n_name AS concept, CAST(1 AS INT) AS depth FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT c_name, r_name, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def network_ancestors(spark: SparkSession, d: str) -> DataFrame:
    leaves = table(spark, d, "customer").select(F.col("c_name").alias("source"))
    return networks.concept_relationships(place_arcs(spark, d), leaves, "ancestor")


@query("SELECT a.n_name AS source, b.n_name AS concept, CAST(0 AS INT) AS depth FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")
def network_siblings(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation").select(F.col("n_name").alias("source"))
    return networks.concept_relationships(place_arcs(spark, d), nations, "sibling")


@query("""
    WITH t AS (SELECT r_name, n_name, n_nationkey, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) AS k FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')
    SELECT 'ASIA' AS concept, CAST(0 AS INT) AS depth, '' AS sort UNION ALL SELECT n_name, 1, '/' || lpad(CAST(k AS VARCHAR), 6, '0') FROM t
    UNION ALL SELECT c_name, 2, '/' || lpad(CAST(k AS VARCHAR), 6, '0') || '/' || lpad(CAST(row_number() OVER (PARTITION BY n_name ORDER BY c_custkey) AS VARCHAR), 6, '0') FROM t JOIN customer ON c_nationkey = n_nationkey""")
def presentation_walk(spark: SparkSession, d: str) -> DataFrame:
    return networks.walk(place_arcs(spark, d), "ASIA").select("concept", "depth", "sort")


@query("SELECT n_name AS concept FROM nation WHERE false")
def network_cycles(spark: SparkSession, d: str) -> DataFrame:
    return networks.directed_cycles(place_arcs(spark, d))


@query("""
    WITH back AS (SELECT c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey % 100 = 7)
    SELECT c_name AS concept FROM back UNION SELECT n_name FROM back UNION SELECT r_name FROM back""")
def network_back_arcs(spark: SparkSession, d: str) -> DataFrame:
    """Arcs from some customers back to their region close cycles through their nation."""
    c = table(spark, d, "customer").where("c_custkey % 100 = 7").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    arcs = place_arcs(spark, d)
    own = {"from": F.col("c_name"), "to": F.col("r_name"), "role": F.lit("place"), "arcrole": F.lit("parent-child"), "ord": F.lit(1.0), "weight": F.lit(1.0), "priority": F.lit(0), "use": F.lit("optional"), "link_name": F.lit("link"), "arc_name": F.lit("arc")}
    back = c.select(*[own.get(n, F.lit(None).cast(kind)).alias(n) for n, kind in arcs.dtypes])
    return networks.directed_cycles(arcs.unionByName(back))


@query("SELECT c_name AS concept FROM customer WHERE c_custkey % 50 = 3 AND c_nationkey <> 5")
def network_two_ways(spark: SparkSession, d: str) -> DataFrame:
    """Some customers stand in a second nation too, under one root of all nations: two ways lead to them."""
    nation = table(spark, d, "nation")
    c = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    other = nation.where("n_nationkey = 5").select(F.col("n_name").alias("second"))
    pairs = nation.select(F.lit("world").alias("from"), F.col("n_name").alias("to")).unionByName(c.select(F.col("n_name").alias("from"), F.col("c_name").alias("to")))
    pairs = pairs.unionByName(c.where("c_custkey % 50 = 3").join(F.broadcast(other)).select(F.col("second").alias("from"), F.col("c_name").alias("to")))
    arcs = pairs.withColumns({"role": F.lit("place"), "arcrole": F.lit("parent-child"), "ord": F.lit(1.0), "priority": F.lit(0), "use": F.lit("optional")})
    return networks.undirected_cycles(arcs)


@query("""
    SELECT l_orderkey AS order_key, l_partkey AS part_key FROM lineitem
    WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 45) OR (l_discount > 0.08 AND NOT l_suppkey % 7 = 3)""")
def combined_filters(spark: SparkSession, d: str) -> DataFrame:
    """A network of members or a test, with a complement inside: combinations whose parts need a join."""
    members = table(spark, d, "part").where("p_size > 45").select(F.col("p_partkey").cast("string").alias("member"))
    either = filters.or_filter(filters.explicit_dimension("part", network=members), filters.and_filter(filters.general("num > 0.08"), ~filters.identifier_test("cast(entity as bigint) % 7 = 3")))
    e = rules.evaluate(rules.VariableSet([rules.FactVariable("x", [filters.concept_name("discount"), either])]), line_facts(spark, d))
    return e.select(e["x__dims"]["order"].cast("long").alias("order_key"), e["x__dims"]["part"].cast("long").alias("part_key"))


@query("""
    SELECT a.l_orderkey AS order_key, a.l_linenumber AS line, b.l_linenumber AS other FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND (a.l_suppkey = b.l_suppkey OR b.l_quantity > 49)
    WHERE a.l_quantity < 2""")
def match_or_test(spark: SparkSession, d: str) -> DataFrame:
    """A second variable in the same order with the same supplier, or with a large number."""
    lines = table(spark, d, "lineitem")
    f = as_facts(lines, F.lit("q"), F.col("l_quantity"), F.col("l_suppkey"), F.lit("2000-01-01").cast("date"), {"order": F.col("l_orderkey")}, F.lit("pure"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).withColumn("line", F.lit(None))
    either = filters.or_filter(filters.match("entity", "a"), filters.general("num > 49"))
    rule = rules.VariableSet([rules.FactVariable("a", [filters.concept_name("q"), filters.general("num < 2")]), rules.FactVariable("b", [filters.concept_name("q"), either])])
    e = rules.evaluate(rule, f.drop("line"))
    line = lambda v: F.split_part(F.col(f"{v}__fact_id"), F.lit("-"), F.lit(2)).cast("int")
    return e.select(e["a__dims"]["order"].cast("long").alias("order_key"), line("a").alias("line"), line("b").alias("other"))


@query("""
    SELECT l_orderkey AS order_key, l_partkey AS part_key, CAST(l_quantity AS DOUBLE) AS quantity, CAST(p_retailprice AS DOUBLE) AS price FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 40""")
def two_instances(spark: SparkSession, d: str) -> DataFrame:
    """Lines of one report with prices from another document, by the aspects they share."""
    prices = as_facts(table(spark, d, "part"), F.lit("price"), F.col("p_retailprice"), F.lit("e"), F.lit("2000-01-01").cast("date"), {"part": F.col("p_partkey")}, F.lit("iso4217:USD"), F.col("p_partkey")).withColumn("doc_id", F.lit("prices"))
    cover = filters.aspect_cover("unit", "entity", "period", "order")
    rule = rules.VariableSet([rules.FactVariable("q", [filters.concept_name("quantity"), filters.general("num > 40"), cover]), rules.FactVariable("p", [filters.concept_name("price"), cover], instance="prices")], dimensions=["order", "part"])
    e = rules.evaluate(rule, line_facts(spark, d), instances={"prices": prices})
    return e.select(e["q__dims"]["order"].cast("long").alias("order_key"), e["q__dims"]["part"].cast("long").alias("part_key"), F.col("q").alias("quantity"), F.col("p").alias("price"))


@query("""
    SELECT o_orderkey AS order_key, 'total' AS concept, o_totalprice AS derived FROM orders WHERE o_totalprice > 300000
    UNION ALL SELECT o_orderkey, 'tenth', o_totalprice / 10 FROM orders WHERE o_totalprice > 300000""")
def derived_tuples(spark: SparkSession, d: str) -> DataFrame:
    """A tuple for each large order with two facts in it; every fact must find its tuple."""
    rule = rules.VariableSet([rules.FactVariable("t", [filters.concept_name("totalprice"), filters.general("num > 300000")])])
    parts = [rules.Formula("a", rule, "$t", concept="'total'"), rules.Formula("b", rule, "$t / 10", concept="'tenth'")]
    tuples, facts = rules.TupleFormula("large", "largeOrder", rule, parts).run(order_facts(spark, d))
    both = facts.join(tuples.select("doc_id", F.col("fact_id").alias("parent_id")), ["doc_id", "parent_id"], "left_semi")
    return both.select(both["dims"]["order"].cast("long").alias("order_key"), "concept", "derived")


@query("""
    SELECT a.s_suppkey AS supplier, b.s_suppkey AS other FROM supplier a JOIN supplier b ON abs(a.s_nationkey - b.s_nationkey) <= 1 WHERE a.s_suppkey <= 20 AND b.s_suppkey > 20""")
def equality_definition(spark: SparkSession, d: str) -> DataFrame:
    """A typed dimension whose members count as equal if they are at most one apart, by the rule's own test."""
    s = table(spark, d, "supplier")
    f = as_facts(s, F.when(F.col("s_suppkey") <= 20, "few").otherwise("many"), F.col("s_acctbal"), F.lit("e"), F.lit("2000-01-01").cast("date"), {}, F.lit("pure"), F.col("s_suppkey"))
    f = f.withColumn("typed_dims", F.create_map(F.lit("place"), F.lit(None).cast("string")))
    places = s.select(F.col("s_suppkey").cast("string").alias("fact_id"), F.create_map(F.lit("place"), F.col("s_nationkey").cast("string")).alias("typed_dims"))
    f = f.drop("typed_dims").join(places, "fact_id")
    rule = rules.VariableSet([rules.FactVariable("a", [filters.concept_name("few")]), rules.FactVariable("b", [filters.concept_name("many")])], equalities={"place": "abs(cast(a as int) - cast(b as int)) <= 1"})
    rule.variables[0].filters.append(filters.aspect_cover("concept"))
    e = rules.evaluate(rule, f)
    return e.select(F.col("a__fact_id").cast("long").alias("supplier"), F.col("b__fact_id").cast("long").alias("other"))


@query("SELECT a.c_custkey AS customer, b.n_nationkey AS nation FROM customer a JOIN nation n ON a.c_nationkey = n.n_nationkey JOIN nation b ON b.n_regionkey = n.n_regionkey WHERE a.c_custkey <= 300")
def place_above(spark: SparkSession, d: str) -> DataFrame:
    """Customers stand in their nation's tuple, nations' facts in their region's: facts two levels above a customer's place."""
    nation, customer = table(spark, d, "nation"), table(spark, d, "customer").where("c_custkey <= 300")
    def made(df: DataFrame, concept: str, number, key, parent) -> DataFrame:
        f = as_facts(df, F.lit(concept), number, F.lit("e"), F.lit("2000-01-01").cast("date"), {"in": parent}, F.lit("pure"), key).withColumn("parent_id", F.col("dims")["in"])
        return f.withColumns({"dims": F.create_map().cast("map<string,string>"), "dims_key": F.lit("")})

    facts = made(customer, "balance", F.col("c_acctbal"), F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"))
    facts = facts.unionByName(made(nation, "nation", F.col("n_nationkey"), F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey")))
    rule = rules.VariableSet([rules.FactVariable("c", [filters.concept_name("balance")]), rules.FactVariable("n", [filters.concept_name("nation"), filters.location_filter("c", 2)])])
    e = rules.evaluate(rule, networks.with_places(facts, 2))
    return e.select(F.substring("c__fact_id", 2, 20).cast("long").alias("customer"), F.substring("n__fact_id", 2, 20).cast("int").alias("nation"))


@query("SELECT l_orderkey AS order_key, l_linenumber AS line, CASE l_linenumber % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'shares' WHEN 2 THEN 'given' END AS unit FROM lineitem")
def default_units(spark: SparkSession, d: str) -> DataFrame:
    """Units by type where none is given: money, shares, a unit that is there, and a text that has none."""
    n = F.col("l_linenumber") % 4
    kind = F.when(n == 0, "xbrli:monetaryItemType").when(n == 1, "sharesItemType").when(n == 2, "monetaryItemType").otherwise("stringItemType")
    f = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", kind.alias("item_type"), F.when(n == 2, F.lit("given")).alias("unit_ref"))
    return with_default_units(f).select(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"), F.col("unit_ref").alias("unit"))


# --- windows and reports ----------------------------------------------------------------------------------------


@query("""
    SELECT n_name AS nation, round(coalesce(sum(o_totalprice) FILTER (year(o_orderdate) = 1995), 0), 2) AS y1995, round(coalesce(sum(o_totalprice) FILTER (year(o_orderdate) = 1996), 0), 2) AS y1996,
           round(coalesce(sum(o_totalprice) FILTER (year(o_orderdate) = 1997), 0), 2) AS y1997 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def pivot_entity_year(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    o = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).withColumn("y", F.year("o_orderdate"))
    p = o.groupBy(F.col("n_name").alias("nation")).pivot("y", [1995, 1996, 1997]).agg(F.sum("o_totalprice"))
    return p.select("nation", *[F.round(F.coalesce(f"{y}", F.lit(0.0)), 2).alias(f"y{y}") for y in (1995, 1996, 1997)])


@query("""
    WITH m AS (SELECT o_custkey AS customer, date_trunc('year', o_orderdate) AS y, max(o_totalprice) AS v FROM orders GROUP BY 1, 2)
    SELECT customer, CAST(year(y) AS INT) AS year, lag(v) OVER (PARTITION BY customer ORDER BY y) AS opening, v AS closing FROM m""")
def opening_closing(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("customer"), F.year("o_orderdate").alias("year")).agg(F.max("o_totalprice").alias("num"))
    return report.opening_closing(m, ["customer"], when="year").select("customer", "year", "opening", "closing")


@query("""
    WITH e AS (SELECT user_id, date_trunc('day', ts) AS day, round(sum(value), 4) AS change FROM events WHERE value IS NOT NULL GROUP BY ALL),
    r AS (SELECT *, sum(change) OVER (PARTITION BY user_id ORDER BY day) AS closing FROM e)
    SELECT user_id, CAST(count(*) AS BIGINT) AS days, CAST(count(*) FILTER (abs(closing - change - coalesce((closing - change), 0)) <= 1) AS BIGINT) AS satisfied, round(max(closing), 2) AS most FROM r GROUP BY user_id""")
def roll_forward(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("value is not null").groupBy("user_id", F.date_trunc("day", "ts").alias("start")).agg(F.round(F.sum("value"), 4).alias("num"))
    w = Window.partitionBy("user_id").orderBy("start")
    running = e.withColumn("closing", F.sum("num").over(w)).withColumn("end", F.col("start") + F.expr("interval 1 day"))
    closing = running.select("user_id", "end", F.col("closing").alias("num"))
    opening = running.select("user_id", F.col("start").alias("end"), (F.col("closing") - F.col("num")).alias("num"))
    balances = closing.unionByName(opening.join(closing.select("user_id", "end"), ["user_id", "end"], "left_anti"))
    changes = running.select("user_id", "start", "end", "num")
    got = report.roll_forward(balances, changes, ["user_id"])
    return got.groupBy("user_id").agg(F.count(F.lit(1)).alias("days"), F.count_if("satisfied").alias("satisfied"), F.round(F.max("closing"), 2).alias("most"))


@query("""
    SELECT o_custkey AS customer, CAST(year(o_orderdate) AS INT) AS year, o_orderkey AS order_key FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate DESC, o_orderkey) = 1""")
def latest_in_year(spark: SparkSession, d: str) -> DataFrame:
    f = order_facts(spark, d).withColumns({"year": F.year(F.date_sub(F.col("end").cast("date"), 1)), "order_key": F.col("dims")["order"].cast("long"), "dims_key": F.lit(""), "fact_id": F.lpad(F.col("dims")["order"], 12, "0")})
    return report.latest_in_year(f).select(F.col("entity").cast("long").alias("customer"), "year", "order_key")


@query("SELECT o_orderkey AS order_key, o_totalprice AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("order_key"), F.col("o_totalprice").alias("price")).orderBy(F.desc("price"), "order_key").limit(25)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n")


@query("SELECT n_regionkey AS region, c_mktsegment AS segment, CAST(count(*) AS BIGINT) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, c_mktsegment)")
def dimension_subtotals(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.rollup(F.col("n_regionkey").alias("region"), F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"))


# --- sets -------------------------------------------------------------------------------------------------------


@query("""
    SELECT 'both' AS part, CAST(count(*) AS BIGINT) AS n FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')
    UNION ALL SELECT 'only', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')
    UNION ALL SELECT 'any', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' UNION SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')""")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    r, a = (lines.where(F.col("l_returnflag") == x).select("l_partkey").distinct() for x in "RA")
    count = lambda df, name: df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"))
    return count(r.join(a, "l_partkey", "left_semi"), "both").unionByName(count(r.join(a, "l_partkey", "left_anti"), "only")).unionByName(count(r.unionByName(a).distinct(), "any"))


@query("""
    WITH a AS (SELECT l_partkey AS part, max(l_extendedprice) AS v FROM lineitem WHERE year(l_shipdate) = 1995 GROUP BY 1),
    b AS (SELECT l_partkey AS part, max(l_extendedprice) AS v FROM lineitem WHERE year(l_shipdate) = 1996 GROUP BY 1)
    SELECT coalesce(a.part, b.part) AS part, a.v AS a, b.v AS b, CASE WHEN b.part IS NULL THEN 'only_a' WHEN a.part IS NULL THEN 'only_b' ELSE 'differs' END AS state
    FROM a FULL JOIN b ON a.part = b.part WHERE a.v IS DISTINCT FROM b.v""")
def structural_diff(spark: SparkSession, d: str) -> DataFrame:
    year = lambda y: table(spark, d, "lineitem").where(F.year("l_shipdate") == y).groupBy(F.col("l_partkey").alias("part")).agg(F.max("l_extendedprice").alias("value"))
    return sets.structural_diff(year(1995), year(1996), ["part"])


@query("""
    WITH s AS (SELECT l_suppkey, list_sort(list_distinct(list(l_partkey % 5))) AS p FROM lineitem GROUP BY 1)
    SELECT l_suppkey AS supplier, p = [0, 1, 2, 3, 4] AS complete FROM s""")
def set_equality(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.collect_set(F.col("l_partkey") % 5).alias("p"))
    every = F.array(*[F.lit(i).cast("long") for i in range(5)])
    return s.select(F.col("l_suppkey").alias("supplier"), equality.set_equal(F.col("p"), every).alias("complete"))


# --- scalar functions -------------------------------------------------------------------------------------------


@query("""
    SELECT o_orderkey AS order_key, regexp_replace(printf('%.2f', o_totalprice), '[^0-9.]', '', 'g') AS us, regexp_replace(printf('%.2f', o_totalprice), '[^0-9.]', '', 'g') AS eu,
           CAST(o_orderkey % 100 AS VARCHAR) || '.' || lpad(CAST(o_orderkey % 7 AS VARCHAR), 2, '0') AS unit FROM orders""")
def transform_numbers(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    us = F.format_number("o_totalprice", 2)
    eu = F.translate(us, ",.", ".,")
    cents = F.concat((F.col("o_orderkey") % 100).cast("string"), F.lit(" dollars "), (F.col("o_orderkey") % 7).cast("string"), F.lit(" cents"))
    t = transforms.transform
    return o.select(F.col("o_orderkey").alias("order_key"), t(us, "num-dot-decimal").alias("us"), t(eu, "num-comma-decimal").alias("eu"), t(cents, "num-unit-decimal").alias("unit"))


@query("""
    SELECT o_orderkey AS order_key, strftime(o_orderdate, '%Y-%m-%d') AS us, strftime(o_orderdate, '%Y-%m-%d') AS eu, strftime(o_orderdate, '%Y-%m-%d') AS name,
           strftime(o_orderdate, '%Y-%m') AS ym, '--' || strftime(o_orderdate, '%m-%d') AS md, CAST(NULL AS VARCHAR) AS bad FROM orders""")
def transform_dates(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    day = lambda p: F.date_format("o_orderdate", p)
    t = transforms.transform
    return o.select(
        F.col("o_orderkey").alias("order_key"), t(day("M/d/yyyy"), "dateslashus", transforms.TR1).alias("us"), t(day("dd.MM.yyyy"), "datedoteu", transforms.TR1).alias("eu"),
        t(day("MMMM d, yyyy"), "date-monthname-day-year-en").alias("name"), t(day("MMM yyyy"), "date-monthname-year-en").alias("ym"), t(day("d MMM"), "date-day-monthname-en").alias("md"), t(day("'31 February' yyyy"), "date-day-monthname-year-en").alias("bad"),
    )


@query("""
    SELECT o_orderkey AS order_key, round_even(o_totalprice, 0) AS whole, round_even(o_totalprice, -3) AS thousands, CAST(floor(log10(o_totalprice) + 1e-12) AS INT) AS first_digit,
           CAST(greatest(0, floor(log10(o_totalprice) + 1e-12) + 1 - 2) AS INT) AS digits, CAST(5 - floor(log10(o_totalprice) + 1e-12) - 1 AS INT) AS decimals FROM orders""")
def precision_inference(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("o_totalprice")
    none = F.lit(None).cast("string")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("order_key"), round_even(v, F.lit(0)).alias("whole"), round_even(v, F.lit(-3)).alias("thousands"), order_of(v).alias("first_digit"),
        inferred_precision(v, F.lit("-2"), none).cast("int").alias("digits"), inferred_decimals(v, none, F.lit("5")).cast("int").alias("decimals"),
    )


@query("SELECT o_orderkey AS order_key, regexp_replace(format('{:,.2f}', round_even(o_totalprice, 2)), '^', '$') AS shown, lpad(CAST(o_orderkey % 1000 AS VARCHAR), 5, '0') AS padded FROM orders")
def number_pictures(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("order_key"), format_number(F.col("o_totalprice"), "$#,##0.00").alias("shown"), format_number(F.col("o_orderkey") % 1000, "00000").alias("padded"))


@query("""
    SELECT p_partkey AS part, round(pow(p_size, 2), 6) AS pow, round(exp(p_size / 10.0), 6) AS exp, round(ln(p_size), 6) AS log, round(log10(p_size), 6) AS log10, round(sqrt(p_size), 6) AS sqrt, round(sin(p_size), 6) AS sin,
           round(cos(p_size), 6) AS cos, round(atan(p_size), 6) AS atan, round(atan2(p_size, 2), 6) AS atan2, round(asin(1.0 / p_size), 6) AS asin, round(acos(1.0 / p_size), 6) AS acos, round(tan(p_size), 6) AS tan, round(pi(), 6) AS pi, round(pow(10, p_size / 10.0), 6) AS exp10 FROM part""")
def math_functions(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("p_size").cast("double")
    call = registry.call
    cols = {"pow": call("xfm:pow", x, F.lit(2.0)), "exp": call("xfm:exp", x / 10), "log": call("xfm:log", x), "log10": call("xfm:log10", x), "sqrt": call("xfm:sqrt", x), "sin": call("xfm:sin", x), "cos": call("xfm:cos", x), "atan": call("xfm:atan", x), "atan2": call("xfm:atan2", x, F.lit(2.0)), "asin": call("xfm:asin", 1 / x), "acos": call("xfm:acos", 1 / x), "tan": call("xfm:tan", x), "pi": call("xfm:pi"), "exp10": call("xfm:exp10", x / 10)}
    return table(spark, d, "part").select(F.col("p_partkey").alias("part"), *[F.round(c, 6).alias(n) for n, c in cols.items()])


@query("""
    SELECT p_partkey AS part, CASE WHEN p_size % 2 = 0 THEN 'USD' ELSE 'USD*shares' END AS top, CASE WHEN p_size % 2 = 0 THEN 'shares' ELSE 'pure' END AS bottom FROM part""")
def unit_algebra(spark: SparkSession, d: str) -> DataFrame:
    even = F.col("p_size") % 2 == 0
    arr = lambda *m: F.array(*map(F.lit, m))
    a, b = arr("USD", "pure"), F.when(even, arr("shares")).otherwise(arr("pure", "pure"))
    c, e = F.when(even, arr("shares")).otherwise(arr("shares")), F.when(even, arr("pure", "shares")).otherwise(F.array().cast("array<string>"))
    top, bottom = rules.multiply_units(a, b, c, e)
    return table(spark, d, "part").select(F.col("p_partkey").alias("part"), F.array_join(top, "*").alias("top"), F.array_join(bottom, "*").alias("bottom"))


@query("""
    SELECT page_id, CAST(len(regexp_extract_all(html, '<a ')) AS BIGINT) AS links, CAST(len(regexp_extract_all(html, '<p[ >]')) AS BIGINT) AS paragraphs, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages""")
def inline_extract(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    return p.select("page_id", F.regexp_count("html", F.lit("<a ")).cast("long").alias("links"), F.regexp_count("html", F.lit("<p[ >]")).cast("long").alias("paragraphs"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def props_json(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("dims", F.from_json("props", "map<string,string>"))
    return e.groupBy(F.col("dims")["k"].cast("long").alias("k"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey AS customer, c_name AS name FROM customer WHERE regexp_matches(c_name, '0[0-9]5$')")
def identifier_regex(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").withColumn("entity", F.col("c_name")).where(filters.regexp_identifier("0[0-9]5$").column())
    return c.select(F.col("c_custkey").alias("customer"), F.col("c_name").alias("name"))


@query("SELECT s_suppkey AS supplier, '{urn:s}' || s_name AS clark, s_name AS local FROM supplier")
def qualified_names(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").withColumn("clark", equality.clark(F.concat(F.lit("s:"), "s_name"), {"s": "urn:s"}))
    return s.select(F.col("s_suppkey").alias("supplier"), "clark", equality.local_name(F.col("clark")).alias("local"))


@query("""
    SELECT l_orderkey AS order_key, l_partkey AS part_key, l_discount = l_tax AS same, l_quantity = CAST(l_linenumber AS DOUBLE) AS line FROM lineitem""")
def typed_equality(spark: SparkSession, d: str) -> DataFrame:
    s = lambda c: F.col(c).cast("string")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("order_key"), F.col("l_partkey").alias("part_key"), equality.x_equal(s("l_discount"), s("l_tax")).alias("same"), equality.x_equal(s("l_quantity"), s("l_linenumber")).alias("line"))


@query("""
    SELECT l_orderkey AS order_key, l_partkey AS part_key, l_discount = l_tax AS numbers, CAST(l_discount AS VARCHAR) || '0' = CAST(l_discount AS VARCHAR) AS texts, true AS zeros, false AS close
    FROM lineitem""")
def declared_equality(spark: SparkSession, d: str) -> DataFrame:
    """Numbers by their digits whatever zeros they carry, texts as written, and digits beyond a double's."""
    x, y = F.col("l_discount").cast("string"), F.col("l_tax").cast("string")
    number, text = F.lit("decimalItemType"), F.lit("stringItemType")
    longer = F.concat(x, F.lit("0"))
    far = F.concat(x, F.lit("00000000000000000001"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("order_key"), F.col("l_partkey").alias("part_key"), equality.x_equal(x, y, number, number).alias("numbers"), equality.x_equal(longer, x, text, text).alias("texts"), equality.x_equal(F.concat(F.lit("0"), longer), x, number, number).alias("zeros"), equality.x_equal(far, x, number, number).alias("close"))


@query("SELECT page_id, to_base64(unhex(sha256(html)))[-16:] AS hash FROM pages")
def signing_hashes(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.packages import file_hashes

    p = table(spark, d, "pages").select("page_id", F.lit("pages").alias("package"), F.col("page_id").cast("string").alias("path"), F.col("html").cast("binary").alias("content"))
    return file_hashes(p).select(F.col("path").cast("long").alias("page_id"), "hash")


@query("SELECT o_orderkey AS order_key, strftime(o_orderdate, '%Y-%m-%d') AS start, strftime(o_orderdate - INTERVAL 1 DAY, '%Y-%m-%d') AS \"end\" FROM orders")
def minimized_dates(spark: SparkSession, d: str) -> DataFrame:
    call = registry.call
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("order_key"), call("ext:minimized-date-string", F.col("o_orderdate")).alias("start"), call("ext:minimized-date-string", F.col("o_orderdate"), True).alias("end"))
