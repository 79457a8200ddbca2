"""More queries over the harness tables: filters, tuples, dimensions, validation and sources."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import equality, registry, transforms
from ..functions.rounding import presented
from ..operators import calc, contexts, filters, networks, report, rules, sets, validation
from ..operators.facts import Facts, concept_labels
from ..sources import inline, instance
from .harness import query
from .reporting import as_facts, line_facts, order_facts, place_arcs, table

DAY = "2000-01-01"
USD = "iso4217:USD"


def simple(rows: DataFrame, concept, number, key, entity="e", dims: dict | None = None, measure: str = "pure") -> DataFrame:
    """Facts of one day; names and entities may be columns or texts."""
    col = lambda x: F.lit(x) if isinstance(x, str) else x
    return as_facts(rows, col(concept), number, col(entity), F.lit(DAY).cast("date"), dims or {}, F.lit(measure), key)


# --- filters ----------------------------------------------------------------------------------------------------


@query("SELECT n_name AS nation, CAST(count(*) AS BIGINT) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1")
def concept_relation_filter(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    f = simple(c, F.col("n_name"), F.col("c_acctbal"), F.col("c_custkey"), dims={"who": F.col("c_custkey")})
    near = networks.concept_relationships(place_arcs(spark, d), "ASIA", "child")
    e = rules.evaluate(rules.VariableSet([rules.FactVariable("x", [filters.concept_relation(near)])]), f)
    return e.groupBy(F.col("x__concept").alias("nation")).agg(F.count(F.lit(1)).alias("customers"))


@query("SELECT CAST(count(*) AS BIGINT) AS lines, round(sum(l_quantity), 2) AS total FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size <= 10")
def dimension_network_filter(spark: SparkSession, d: str) -> DataFrame:
    members = table(spark, d, "part").where("p_size <= 10").select(F.col("p_partkey").cast("string").alias("member"))
    rule = rules.VariableSet([rules.FactVariable("q", [filters.concept_name("quantity"), filters.explicit_dimension("part", network=members)])])
    return rules.evaluate(rule, line_facts(spark, d)).agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum("q"), 2).alias("total"))


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) BETWEEN 10 AND 19 AND value IS NOT NULL GROUP BY 1")
def typed_dimension_filter(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").where("value is not null")
    f = as_facts(ev.withColumn("k", F.get_json_object("props", "$.k")), F.col("event_type"), F.col("value"), F.col("user_id"), F.col("ts").cast("date"), {"k": F.col("k"), "event": F.col("event_id")}, F.lit("pure"), F.col("event_id"))
    f = f.withColumns({"typed_dims": F.map_filter("dims", lambda k, _: k == "k"), "dims": F.map_filter("dims", lambda k, _: k != "k")})
    rule = rules.VariableSet([rules.FactVariable("x", [filters.typed_dimension("k", "cast(member as int) between 10 and 19")])])
    return rules.evaluate(rule, f).groupBy(F.col("x__concept").alias("event_type")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM orders WHERE (o_totalprice > 400000 AND o_orderdate < TIMESTAMP '1996-01-01') OR NOT (o_custkey % 2 = 0)")
def and_or_not_filters(spark: SparkSession, d: str) -> DataFrame:
    rich = filters.and_filter(filters.general("num > 400000"), filters.period_test("end <= timestamp_ntz '1996-01-01 00:00:00'"))
    even = filters.identifier_test("cast(entity as bigint) % 2 = 0")
    rule = rules.VariableSet([rules.FactVariable("x", [filters.or_filter(rich, ~even)])])
    return rules.evaluate(rule, order_facts(spark, d)).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM orders WHERE floor(log10(o_totalprice) + 1e-12) + 1 - 2 >= 4")
def precision_filter(spark: SparkSession, d: str) -> DataFrame:
    f = order_facts(spark, d).withColumn("decimals", F.lit("-2"))
    return f.where(filters.precision_at_least(4).column()).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey AS customer, CAST(count(*) AS BIGINT) AS orders, round(sum(o_totalprice - c_acctbal), 2) AS gap FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def match_entity(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    balances = simple(c, "balance", F.col("c_acctbal"), F.concat(F.lit("c"), "c_custkey"), F.col("c_custkey"), measure=USD)
    rule = rules.VariableSet([rules.FactVariable("b", [filters.concept_name("balance")]), rules.FactVariable("o", [filters.concept_name("totalprice"), filters.match("entity", "b"), filters.aspect_cover("period", "dims")])])
    e = rules.evaluate(rule, balances.unionByName(order_facts(spark, d)))
    return e.groupBy(F.col("b__entity").cast("long").alias("customer")).agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum(F.col("o") - F.col("b")), 2).alias("gap"))


@query("SELECT CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity * l_tax), 4) AS total FROM lineitem")
def relative_filter(spark: SparkSession, d: str) -> DataFrame:
    rule = rules.VariableSet([rules.FactVariable("q", [filters.concept_name("quantity")]), rules.FactVariable("t", [filters.concept_name("tax"), filters.relative_filter("q")])], implicit_filtering=False)
    return rules.evaluate(rule, line_facts(spark, d)).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("q") * F.col("t")), 4).alias("total"))


def _tuples(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders as tuples named by their status, lines as the items in them."""
    lines = line_facts(spark, d).where("concept in ('quantity', 'discount')").withColumn("parent_id", F.concat(F.lit("t"), F.col("dims")["order"]))
    o = table(spark, d, "orders").select(F.lit("harness").alias("doc_id"), F.concat(F.lit("t"), "o_orderkey").alias("fact_id"), F.col("o_orderstatus").alias("concept"), F.lit(None).cast("string").alias("parent_id"))
    return lines, o


@query("SELECT a.l_orderkey AS order_key, CAST(count(*) AS BIGINT) AS pairs, round(sum(a.l_quantity * b.l_discount), 4) AS total FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey GROUP BY 1")
def sibling_filter(spark: SparkSession, d: str) -> DataFrame:
    lines, _ = _tuples(spark, d)
    cover = filters.aspect_cover("dims", "entity", "period", "unit")
    rule = rules.VariableSet([rules.FactVariable("q", [filters.concept_name("quantity"), cover]), rules.FactVariable("x", [filters.concept_name("discount"), filters.sibling_filter("q"), cover])])
    e = rules.evaluate(rule, lines)
    return e.groupBy(e["q__dims"]["order"].cast("long").alias("order_key")).agg(F.count(F.lit(1)).alias("pairs"), F.round(F.sum(F.col("q") * F.col("x")), 4).alias("total"))


@query("SELECT CAST(count(*) AS BIGINT) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def parent_filter(spark: SparkSession, d: str) -> DataFrame:
    lines, tuples = _tuples(spark, d)
    rule = rules.VariableSet([rules.FactVariable("q", [filters.concept_name("quantity"), filters.parent_filter(tuples, "F")])])
    return rules.evaluate(rule, lines).agg(F.count(F.lit(1)).alias("lines"))


@query("SELECT o_orderstatus AS status, CAST(count(*) AS BIGINT) AS items FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def tuple_ancestors(spark: SparkSession, d: str) -> DataFrame:
    lines, tuples = _tuples(spark, d)
    every = lines.where("concept = 'quantity'").select("doc_id", "fact_id", "concept", "parent_id").unionByName(tuples)
    up = networks.ancestors_of_facts(every)
    named = tuples.select("doc_id", F.col("fact_id").alias("ancestor_id"), F.col("concept").alias("status"))
    return up.join(named, ["doc_id", "ancestor_id"]).groupBy("status").agg(F.count(F.lit(1)).alias("items"))


# --- rules ------------------------------------------------------------------------------------------------------


@query("SELECT o_custkey AS customer, round(sum(c), 2) AS total FROM orders JOIN (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS c FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1")
def rule_chaining(spark: SparkSession, d: str) -> DataFrame:
    """Totals of orders as derived facts, then sums of those by customer."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    f = simple(lines, "price", F.col("l_extendedprice"), F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey"), F.col("o_custkey"), {"order": F.col("l_orderkey"), "line": F.concat_ws("-", "l_partkey", "l_suppkey")}, USD)
    first = rules.VariableSet([rules.FactVariable("p", [filters.concept_name("price"), filters.aspect_cover("line")], bind_as_sequence=True, matches=True)], dimensions=["order", "line"])
    totals = rules.evaluate(first, f).select("doc_id", F.col("p__entity").alias("who"), F.col("p__key_order").alias("order"), F.round(F.aggregate("p", F.lit(0.0), lambda a, x: a + x), 2).alias("v"))
    g = simple(totals, "total", F.col("v"), F.col("order"), F.col("who"), {"order": F.col("order")}, USD)
    second = rules.VariableSet([rules.FactVariable("t", [filters.concept_name("total"), filters.aspect_cover("order")], bind_as_sequence=True)], dimensions=["order"])
    second.variables[0].matches = True
    e = rules.evaluate(second, g)
    return e.select(F.col("t__entity").cast("long").alias("customer"), F.round(F.aggregate("t", F.lit(0.0), lambda a, x: a + x), 2).alias("total"))


@query("SELECT 'lines' AS assertion_set, CAST(count(*) FILTER (l_tax <= 0.04) + count(*) FILTER (l_discount <= 0.04) AS BIGINT) AS satisfied, CAST(count(*) FILTER (l_tax > 0.04) + count(*) FILTER (l_discount > 0.04) AS BIGINT) AS unsatisfied FROM lineitem")
def assertion_sets(spark: SparkSession, d: str) -> DataFrame:
    f = line_facts(spark, d)
    one = lambda c: rules.ValueAssertion(c, rules.VariableSet([rules.FactVariable("x", [filters.concept_name(c)])]), "$x <= 0.04").run(f)
    got = rules.assertion_set("lines", [one("tax"), one("discount")])
    return got.groupBy("assertion_set").agg(F.count_if("satisfied").alias("satisfied"), F.count_if(~F.col("satisfied")).alias("unsatisfied"))


@query("SELECT CAST(count(*) AS BIGINT) AS unused FROM lineitem WHERE l_quantity <= 45")
def unused_facts(spark: SparkSession, d: str) -> DataFrame:
    f = line_facts(spark, d).where("concept = 'quantity'")
    used = rules.evaluate(rules.VariableSet([rules.FactVariable("q", [filters.general("num > 45")])]), f)
    return rules.not_used(f, used, "q").agg(F.count(F.lit(1)).alias("unused"))


@query("SELECT CAST(o_orderkey AS BIGINT) AS order_key, presented FROM (SELECT o_orderkey, round_even(o_totalprice, -2) AS presented FROM orders)")
def numeric_presentation(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("order_key"), presented(F.col("o_totalprice"), F.lit("-2")).alias("presented"))


# --- concepts, dimensions and validation ------------------------------------------------------------------------


@query("""
    WITH l AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS c FROM lineitem GROUP BY 1)
    SELECT o_orderkey AS order_key FROM orders JOIN l ON l_orderkey = o_orderkey WHERE round_even(o_totalprice, -4) <> round_even(round(c, 2), -4)""")
def essence_alias(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("c"))
    one = simple(table(spark, d, "orders"), "total", F.col("o_totalprice"), F.concat(F.lit("o"), "o_orderkey"), F.col("o_orderkey"))
    two = simple(lines, "charge", F.round("c", 2), F.concat(F.lit("l"), "l_orderkey"), F.col("l_orderkey"))
    arcs = spark.createDataFrame([("r", "ea", "total", "charge", 1.0, 0, "optional")], "role string, arcrole string, from string, to string, ord double, priority int, use string")
    got = calc.essence_alias(one.unionByName(two).withColumn("decimals", F.lit("-4")), arcs, "ea")
    return got.select(F.substring("essence_fact", 2, 20).cast("long").alias("order_key"))


@query("SELECT c_custkey AS customer FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def hypercube_validity(spark: SparkSession, d: str) -> DataFrame:
    f = simple(table(spark, d, "customer"), "balance", F.col("c_acctbal"), F.col("c_custkey"), dims={"segment": F.col("c_mktsegment")})
    cubes = spark.createDataFrame([("h", "r", "balance", True, "segment")], "hypercube string, role string, primary_item string, closed boolean, context_element string")
    dims = spark.createDataFrame([("h", "r", "segment", "explicit", None)], "hypercube string, role string, dimension string, kind string, default_member string")
    members = spark.createDataFrame([("segment", "r", "BUILDING", True), ("segment", "r", "MACHINERY", True), ("segment", "r", "FURNITURE", False)], "dimension string, role string, member string, usable boolean")
    return validation.hypercubes(f, cubes, dims, members).select(F.col("object_id").cast("long").alias("customer"))


@query("SELECT p_type AS member, CAST(count(*) AS BIGINT) AS n FROM part WHERE p_size > 25 GROUP BY 1")
def valid_members(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    cubes = spark.createDataFrame([("h", "r", "item")], "hypercube string, role string, primary_item string")
    dims = spark.createDataFrame([("h", "r", "kind")], "hypercube string, role string, dimension string")
    members = p.where("p_size > 25").select(F.lit("kind").alias("dimension"), F.lit("r").alias("role"), F.col("p_type").alias("member"), F.lit(True).alias("usable"))
    ok = networks.valid_members(cubes, dims, members, "item", "kind")
    return p.where("p_size > 25").withColumnRenamed("p_type", "member").join(ok, "member", "left_semi").groupBy("member").agg(F.count(F.lit(1)).alias("n"))


@query("""
    SELECT 'accuracy-none' AS rule, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_discount = 0 UNION ALL SELECT 'accuracy-both', count(*) FROM lineitem WHERE l_tax = 0 AND l_discount <> 0
    UNION ALL SELECT 'unit-missing', count(*) FROM lineitem WHERE l_quantity > 49 UNION ALL SELECT 'context-ref', count(*) FROM lineitem WHERE l_returnflag = 'R'""")
def fact_rules(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    f = lines.select(
        F.lit("d").alias("doc_id"), F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey").alias("fact_id"), F.lit("q").alias("concept"), F.lit("decimalItemType").alias("item_type"), F.col("l_quantity").cast("string").alias("value"), F.lit(False).alias("is_nil"),
        F.when(F.col("l_discount") != 0, F.lit("2")).alias("decimals"), F.when((F.col("l_tax") == 0) & (F.col("l_discount") != 0), F.lit("4")).alias("precision"), F.when(F.col("l_returnflag") == "R", "gone").otherwise(F.lit("c")).alias("context_ref"), F.when(F.col("l_quantity") <= 49, F.lit("u")).alias("unit_ref"),
    )
    ctx = spark.createDataFrame([("d", "c", "instant")], "doc_id string, context_id string, period_type string")
    units = spark.createDataFrame([("d", "u", ["xbrli:pure"], [])], "doc_id string, unit_id string, numerator array<string>, denominator array<string>")
    concepts = spark.createDataFrame([("q", "instant", [], "item", True)], "concept string, period_type string, base_types array<string>, subst_group string, nillable boolean")
    return validation.facts(f, ctx, units, concepts).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(l_orderkey AS BIGINT) AS order_key, CAST(count(*) AS BIGINT) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate + INTERVAL 60 DAY GROUP BY 1")
def context_rules(spark: SparkSession, d: str) -> DataFrame:
    """Periods from shipping to sixty days after the order, which must start before they end."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    ctx = lines.select(F.col("l_orderkey").cast("string").alias("doc_id"), F.concat_ws("-", "l_partkey", "l_suppkey", "l_linenumber", F.date_format("l_shipdate", "yyyyMMdd")).alias("context_id"), F.lit("duration").alias("period_type"), F.col("l_shipdate").alias("start"), (F.col("o_orderdate") + F.expr("interval 60 day")).alias("end"), F.lit("e").alias("entity"), F.lit("s").alias("scheme"))
    bad = validation.contexts(ctx)
    return bad.groupBy(F.col("doc_id").cast("long").alias("order_key")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderpriority AS priority, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') GROUP BY 1")
def enumeration_values(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    f = o.select(F.lit("d").alias("doc_id"), F.concat_ws("|", "o_orderkey", "o_orderpriority").alias("fact_id"), F.lit("p").alias("concept"), F.lit("enumerationItemType").alias("item_type"), F.regexp_replace("o_orderpriority", " ", "_").alias("value"), F.lit(False).alias("is_nil"))
    allowed = spark.createDataFrame([("p", ["1-URGENT", "2-HIGH"])], "concept string, members array<string>")
    return validation.enumerations(f, allowed).groupBy(F.regexp_extract("object_id", r"\|(.*)$", 1).alias("priority")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'divide-overlap' AS rule, CAST(count(*) AS BIGINT) AS n FROM part WHERE p_size % 3 = 0 UNION ALL SELECT 'currency', count(*) FROM part WHERE p_size % 5 = 0")
def unit_rules(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    u = p.select(F.lit("d").alias("doc_id"), F.col("p_partkey").cast("string").alias("unit_id"), F.array(F.when(F.col("p_size") % 5 == 0, "iso4217:usd").otherwise("iso4217:USD"), F.lit("u:x")).alias("numerator"), F.when(F.col("p_size") % 3 == 0, F.array(F.lit("u:x"))).alias("denominator"))
    return validation.units(u).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey AS customer FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def footnote_facts(spark: SparkSession, d: str) -> DataFrame:
    notes = table(spark, d, "customer").select(F.lit("d").alias("doc_id"), F.col("c_custkey").cast("string").alias("fact_id"))
    f = table(spark, d, "orders").select(F.lit("d").alias("doc_id"), F.col("o_custkey").cast("string").alias("fact_id")).distinct()
    return validation.footnotes(notes, f).select(F.col("object_id").cast("long").alias("customer"))


@query("SELECT n_name AS concept, CASE WHEN n_nationkey % 2 = 0 THEN 'de ' ELSE 'en ' END || n_name AS label FROM nation")
def label_lookup(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    std = "http://www.xbrl.org/2003/role/label"
    one = lambda lang, df: df.select(F.col("n_name").alias("concept"), F.lit(std).alias("role"), F.lit(lang).alias("lang"), F.concat(F.lit(f"{lang} "), "n_name").alias("text"))
    return concept_labels(one("en", n).unionByName(one("de", n.where("n_nationkey % 2 = 0"))), "de")


@query("SELECT l_returnflag AS flag, l_linestatus AS status, CAST(count(DISTINCT l_quantity) AS BIGINT) AS values FROM lineitem GROUP BY ALL")
def unique_entries(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "lineitem").select(F.lit("d").alias("doc_id"), F.lit("q").alias("concept"), F.concat("l_returnflag", "l_linestatus").alias("context_ref"), F.col("l_quantity").alias("value"), F.col("l_orderkey").alias("ordinal"), F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey").alias("fact_id"))
    got = Facts(f).unique().df
    return got.groupBy(F.substring("context_ref", 1, 1).alias("flag"), F.substring("context_ref", 2, 1).alias("status")).agg(F.count(F.lit(1)).alias("values"))


@query("SELECT o_custkey AS customer, CAST(year(o_orderdate) AS INT) AS year, CAST(count(*) AS BIGINT) AS contexts FROM orders GROUP BY ALL")
def discrete_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Orders' days fall into the range of their year, which is reported too."""
    o = table(spark, d, "orders")
    day = o.select(F.col("o_custkey").cast("string").alias("doc_id"), F.col("o_orderkey").cast("string").alias("context_id"), F.col("o_orderdate").alias("start"), (F.col("o_orderdate") + F.expr("interval 1 day")).alias("end"))
    first = F.date_trunc("year", "o_orderdate").cast("timestamp_ntz")
    year = o.select(F.col("o_custkey").cast("string").alias("doc_id"), F.lit("year").alias("context_id"), first.alias("start"), (first + F.expr("interval 1 year")).alias("end")).distinct()
    got = contexts.Contexts(day.unionByName(year)).discrete_ranges().where("context_id <> 'year'")
    return got.groupBy(F.col("doc_id").cast("long").alias("customer"), F.year("range_start").alias("year")).agg(F.count(F.lit(1)).alias("contexts"))


@query("SELECT r_name AS concept FROM region UNION SELECT n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)")
def concrete_parents(spark: SparkSession, d: str) -> DataFrame:
    arcs = place_arcs(spark, d)
    concepts = arcs.select(F.col("from").alias("concept")).unionByName(arcs.select(F.col("to").alias("concept"))).distinct().withColumn("abstract", F.lit(False))
    return networks.concrete_parents(arcs, concepts)


# --- documents --------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS order_key, round(o_totalprice * 1000, 2) AS value, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def inline_documents(spark: SparkSession, d: str) -> DataFrame:
    """Inline documents written from orders, and their facts read back."""
    o = table(spark, d, "orders")
    ref = F.concat(F.lit('contextRef="c" '))
    html = F.concat(F.lit('<p><ix:nonFraction id="v" name="e:total" unitRef="u" '), ref, F.lit('scale="3" format="ixt:num-dot-decimal">'), F.format_number("o_totalprice", 2), F.lit('<ix:exclude>!</ix:exclude></ix:nonFraction> on <ix:nonNumeric id="d" name="e:day" '), ref, F.lit('continuedAt="m" format="ixt:date-day-monthname-year-en">'), F.date_format("o_orderdate", "d MMMM"), F.lit('</ix:nonNumeric><ix:continuation id="m">'), F.date_format("o_orderdate", " yyyy"), F.lit("</ix:continuation></p>"))
    rows = inline.elements(o.select(F.col("o_orderkey").cast("string").alias("doc_id"), html.alias("text")))
    f = inline.facts(rows, formats=["num-dot-decimal", "date-day-monthname-year-en"])
    return f.groupBy(F.col("doc_id").cast("long").alias("order_key")).agg(F.round(F.max(F.when(F.col("concept") == "total", F.col("num").cast("double"))), 2).alias("value"), F.max(F.when(F.col("concept") == "day", F.col("value"))).alias("day"))


@query("SELECT o_custkey AS customer, CAST(count(*) AS BIGINT) AS facts, round(sum(o_totalprice), 2) AS total, min(o_orderdate) + INTERVAL 1 DAY AS first FROM orders GROUP BY 1")
def instance_documents(spark: SparkSession, d: str) -> DataFrame:
    """Instance documents written from customers' orders, parsed, and joined with their contexts."""
    o = table(spark, d, "orders")
    doc = F.col("o_custkey").cast("string").alias("doc_id")
    ref = F.concat(F.lit("c"), "o_orderkey")
    end = (F.col("o_orderdate") + F.expr("interval 1 day")).alias("end")
    none = F.lit(None)
    facts = o.select(doc, F.concat(F.lit("f"), "o_orderkey").alias("fact_id"), F.lit("total").alias("concept"), F.lit("urn:e").alias("ns"), F.col("o_totalprice").cast("string").alias("value"), ref.alias("context_ref"), F.lit("u").alias("unit_ref"), F.lit("2").alias("decimals"), none.cast("string").alias("precision"), F.lit(False).alias("is_nil"), F.lit(0).alias("ordinal"))
    ctx = o.select(doc, ref.alias("context_id"), F.lit("urn:s").alias("scheme"), F.col("o_custkey").cast("string").alias("entity"), F.lit("instant").alias("period_type"), none.cast("timestamp_ntz").alias("start"), end, F.create_map(F.lit("e:status"), "o_orderstatus").alias("dims"))
    units = o.select(doc, F.lit("u").alias("unit_id"), F.array(F.lit(USD)).alias("numerator"), F.array().cast("array<string>").alias("denominator")).distinct()
    raw = instance.parse(instance.to_xml(facts, ctx, units, "e.xsd")).persist(StorageLevel.DISK_ONLY)  # facts and contexts both read it
    t = instance.tables(raw)
    j = t["facts"].join(t["contexts"].withColumnRenamed("context_id", "context_ref"), ["doc_id", "context_ref"])
    return j.groupBy(F.col("doc_id").cast("long").alias("customer")).agg(F.count(F.lit(1)).alias("facts"), F.round(F.sum(F.col("num").cast("double")), 2).alias("total"), F.min("end").alias("first"))


@query("SELECT '$.k' AS path, json_extract_string(props, '$.k') AS value, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def flattened_json(spark: SparkSession, d: str) -> DataFrame:
    return sets.flatten_json(table(spark, d, "events"), "event_id", "props").groupBy("path", "value").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey AS part, p_size % 2 = 0 AS same, p_size < 25 AS corresponds FROM part")
def set_and_node_equality(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    a = F.array(F.col("p_partkey"), F.col("p_partkey") + 1)
    b = F.when(F.col("p_size") % 2 == 0, F.array(F.col("p_partkey") + 1, F.col("p_partkey"))).otherwise(F.array(F.col("p_partkey")))
    x, y = F.concat(F.lit("<a>"), "p_name", F.lit("</a>")), F.concat(F.lit("<a>"), "p_name", F.when(F.col("p_size") < 25, F.lit("</a> ")).otherwise(F.lit("</b>")))
    return p.select(F.col("p_partkey").alias("part"), registry.call("xfi:s-equal-set", a, b).alias("same"), equality.nodes_correspond(x, y).alias("corresponds"))


@query("SELECT n_name AS concept, CAST(count(*) AS BIGINT) AS facts, round(max(c_acctbal), 2) AS most FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def presentation_join(spark: SparkSession, d: str) -> DataFrame:
    """Facts placed on the tree of places, nodes without facts pruned."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    f = simple(c, F.col("n_name"), F.col("c_acctbal"), F.col("c_custkey"), F.col("c_custkey"))
    arcs = place_arcs(spark, d)
    regions = [r[0] for r in table(spark, d, "region").select("r_name").collect()]  # roots of the tree, a handful
    trees = None
    for r in regions:
        t = networks.walk(arcs, r).withColumn("sort", F.concat(F.lit(r), "sort"))
        trees = t if trees is None else trees.unionByName(t)
    placed = report.place(report.prune(trees, f), f).where("fact_id is not null")
    return placed.groupBy("concept").agg(F.count(F.lit(1)).alias("facts"), F.round(F.max(F.col("num").cast("double")), 2).alias("most"))




# --- the function registry --------------------------------------------------------------------------------------


@query("""
    SELECT o_orderkey AS order_key, CAST(o_custkey AS VARCHAR) AS identifier, 'urn:entity' AS scheme, true AS is_instant, false AS is_duration, true AS is_numeric, false AS is_fraction, 'INF' AS decimals, 'INF' AS precision,
           o_orderdate + INTERVAL 1 DAY AS instant, CAST(o_orderkey AS VARCHAR) AS member, true AS has_dimension, false AS has_typed, 'order' AS dimensions, 'iso4217:USD' AS measure FROM orders""")
def fact_functions(spark: SparkSession, d: str) -> DataFrame:
    f = order_facts(spark, d).withColumn("base_types", F.array().cast("array<string>"))
    call = registry.call
    return f.select(
        F.col("dims")["order"].cast("long").alias("order_key"), call("xfi:fact-identifier-value").alias("identifier"), call("xfi:identifier-scheme").alias("scheme"), call("xfi:is-instant-period").alias("is_instant"), call("xfi:is-duration-period").alias("is_duration"),
        call("xfi:is-numeric").alias("is_numeric"), call("xfi:is-fraction").alias("is_fraction"), call("xfi:decimals").alias("decimals"), call("xfi:precision").alias("precision"), call("xfi:period-instant").alias("instant"), call("xfi:fact-explicit-dimension-value", "order").alias("member"),
        call("xfi:fact-has-explicit-dimension", "order").alias("has_dimension"), call("xfi:fact-has-typed-dimension", "order").alias("has_typed"), F.array_join(call("xfi:fact-dimensions"), ",").alias("dimensions"), call("xfi:measure-name", call("xfi:unit-numerator")).alias("measure"),
    )


@query("""
    SELECT l_orderkey AS order_key, l_partkey AS part_key, l_suppkey AS supplier, false AS same_unit, true AS same_period, true AS same_entity, l_quantity = l_extendedprice AS same_value, false AS identical FROM lineitem""")
def pair_functions(spark: SparkSession, d: str) -> DataFrame:
    v = lambda n, c: rules.FactVariable(n, [filters.concept_name(c), filters.aspect_cover("unit")])
    e = rules.evaluate(rules.VariableSet([v("a", "quantity"), v("b", "extendedprice")]), line_facts(spark, d))
    call = registry.call
    return e.select(
        e["a__dims"]["order"].cast("long").alias("order_key"), e["a__dims"]["part"].cast("long").alias("part_key"), F.col("a__entity").cast("long").alias("supplier"), call("xfi:u-equal", "a", "b").alias("same_unit"), call("ext:aspectMatch", "a", "b", "period").alias("same_period"),
        call("ext:aspectMatch", "a", "b", "entity-identifier").alias("same_entity"), call("xfi:x-equal", F.col("a").cast("string"), F.col("b").cast("string")).alias("same_value"), call("xfi:identical-nodes", "a", "b").alias("identical"),
    )


@query("""
    SELECT o_orderstatus AS status, CAST(count(DISTINCT o_custkey) AS INT) AS identifiers, count(DISTINCT o_custkey) = 1 AS single, CAST(count(DISTINCT o_orderdate) AS INT) AS dates, min(o_orderdate) + INTERVAL 1 DAY AS first_date FROM orders GROUP BY 1""")
def instance_functions(spark: SparkSession, d: str) -> DataFrame:
    """Aggregates over instances; document order is the order of dates here."""
    o = table(spark, d, "orders")
    f = as_facts(o, F.col("o_orderstatus"), F.col("o_totalprice"), F.col("o_custkey"), F.col("o_orderdate"), {}, F.lit("pure"), F.col("o_orderkey")).withColumn("ordinal", F.unix_seconds(F.col("end").cast("timestamp")))
    call = registry.call
    return f.groupBy(F.col("concept").alias("status")).agg(F.size(call("xfi:unique-identifiers")).alias("identifiers"), call("xfi:single-unique-identifier").alias("single"), F.size(call("xfi:unique-instant-dates")).alias("dates"), call("xfi:any-instant-date").alias("first_date"))


#: Month names as they stand in dates, January to December.
_WRITTEN = {
    "bg": "януари февруари март април май юни юли август септември октомври ноември декември",
    "cs": "ledna února března dubna května června července srpna září října listopadu prosince",
    "da": "januar februar marts april maj juni juli august september oktober november december",
    "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember",
    "dk": "jan. feb. mar. apr. maj jun. jul. aug. sep. okt. nov. dec.",
    "el": "Ιανουαρίου Φεβρουαρίου Μαρτίου Απριλίου Μαΐου Ιουνίου Ιουλίου Αυγούστου Σεπτεμβρίου Οκτωβρίου Νοεμβρίου Δεκεμβρίου",
    "en": "January February March April May June July August September October November December",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "et": "jaanuar veebruar märts aprill mai juuni juuli august september oktoober november detsember",
    "fi": "tammikuuta helmikuuta maaliskuuta huhtikuuta toukokuuta kesäkuuta heinäkuuta elokuuta syyskuuta lokakuuta marraskuuta joulukuuta",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "hi": "जनवरी फरवरी मार्च अप्रैल मई जून जुलाई अगस्त सितंबर अक्टूबर नवंबर दिसंबर",
    "hr": "siječnja veljače ožujka travnja svibnja lipnja srpnja kolovoza rujna listopada studenoga prosinca",
    "it": "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre",
    "nl": "januari februari maart april mei juni juli augustus september oktober november december",
    "no": "januar februar mars april mai juni juli august september oktober november desember",
    "pl": "stycznia lutego marca kwietnia maja czerwca lipca sierpnia września października listopada grudnia",
    "pt": "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro",
    "ro": "ianuarie februarie martie aprilie mai iunie iulie august septembrie octombrie noiembrie decembrie",
    "se": "januari februari mars april maj juni juli augusti september oktober november december",
    "sk": "januára februára marca apríla mája júna júla augusta septembra októbra novembra decembra",
    "sl": "januarja februarja marca aprila maja junija julija avgusta septembra oktobra novembra decembra",
}


@query("SELECT o_orderkey AS order_key, " + ", ".join(f"strftime(o_orderdate, '%Y-%m-%d') AS {n}_, strftime(o_orderdate, '%Y-%m') AS {n}_month" for n in _WRITTEN) + ", CAST(NULL AS VARCHAR) AS no_czech FROM orders")
def transform_languages(spark: SparkSession, d: str) -> DataFrame:
    """Dates and months written with the month names of every language, and read back; a Czech name with letters after it isn't one."""
    o = table(spark, d, "orders")
    made = {}
    day, year = F.dayofmonth("o_orderdate").cast("string"), F.year("o_orderdate").cast("string")
    for n, names in _WRITTEN.items():
        month = F.element_at(F.array(*map(F.lit, names.split())), F.month("o_orderdate"))
        made[f"{n}_"] = transforms.transform(F.concat(day, F.lit(". "), month, F.lit(" "), year), f"date-day-monthname-year-{n}")
        made[f"{n}_month"] = transforms.transform(F.concat(month, F.lit(" "), year), f"date-monthname-year-{n}")
    made["no_czech"] = transforms.transform(F.concat(day, F.lit(" ledxyz "), year), "date-day-monthname-year-cs")
    return transforms.once_each(o.select("o_orderkey", "o_orderdate"), "o_orderdate", made).select(F.col("o_orderkey").alias("order_key"), *made)
