"""Queries over the harness tables for structures: hierarchies, dimension sets, ranges, chained rules."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ARCROLES
from ..operators import dimension_sets, filters, hierarchies, intervals, report_groups, rules
from .harness import query
from .reporting import as_facts, line_facts, place_arcs, table

# --- hierarchies ------------------------------------------------------------------------------------------------


@query("""
    WITH RECURSIVE a AS (SELECT r_name AS p, n_name AS c FROM nation JOIN region ON n_regionkey = r_regionkey
               UNION ALL SELECT n_name, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
    w AS (SELECT p AS anchor, c AS node, 1 AS away FROM a UNION ALL SELECT anchor, a.c, away + 1 FROM w JOIN a ON a.p = node)
    SELECT anchor, CAST(away AS INT) AS away, CAST(count(*) AS BIGINT) AS places FROM w GROUP BY ALL""")
def hierarchy_below(spark: SparkSession, d: str) -> DataFrame:
    """All places below each region and nation, by the generations between them, as ranges of places."""
    trees = hierarchies.tree(place_arcs(spark, d))
    anchors = place_arcs(spark, d).select(F.col("from").alias("anchor"))
    return hierarchies.below(trees, anchors).groupBy("anchor", "away").agg(F.count(F.lit(1)).alias("places"))


@query("""
    SELECT depth, CAST(count(DISTINCT x) AS BIGINT) AS places FROM (
      SELECT 0 AS depth, r_name AS x FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 9000
      UNION ALL SELECT 1, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9000
      UNION ALL SELECT 2, c_name FROM customer WHERE c_acctbal > 9000) GROUP BY 1""")
def hierarchy_pruned(spark: SparkSession, d: str) -> DataFrame:
    """The network without what holds no rich customer; depths are worked out anew."""
    rich = table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_name").alias("concept"))
    left = hierarchies.pruned(hierarchies.tree(place_arcs(spark, d)), rich)
    return left.groupBy("depth").agg(F.count(F.lit(1)).alias("places"))


@query("""
    SELECT r_name AS root, n_name AS concept, CAST(count(c_custkey) AS BIGINT) AS below,
           CAST(sum(count(c_custkey) + 1) OVER (PARTITION BY r_name ORDER BY n_nationkey) - count(c_custkey) AS BIGINT) AS first
    FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name, n_name, n_nationkey""")
def hierarchy_places(spark: SparkSession, d: str) -> DataFrame:
    """Places of nations in document order, and how much lies below them, from the intervals alone."""
    trees = hierarchies.tree(place_arcs(spark, d)).where("depth = 1")
    return trees.select("root", "concept", (F.col("last") - F.col("first")).alias("below"), "first")


# --- dimension sets ---------------------------------------------------------------------------------------------


def _cube_arcs(spark: SparkSession, d: str) -> DataFrame:
    """A primary item with nations and customers as members over three roles; poor customers are excluded by another hypercube,
    customers of one segment can't be used."""
    nation, customer = table(spark, d, "nation"), table(spark, d, "customer")
    customer = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    none = F.create_map().cast("map<string,string>")
    target = lambda role: F.create_map(F.lit("targetRole"), role if not isinstance(role, str) else F.lit(role))

    def arc(rows: DataFrame, role, arcrole: str, start, to, attrs=none) -> DataFrame:
        col = lambda x: F.lit(x) if isinstance(x, str) else x
        return rows.select(col(role).alias("role"), F.lit(ARCROLES[arcrole]).alias("arcrole"), col(start).alias("from"), col(to).alias("to"), F.lit(1.0).alias("ord"), F.lit(0).alias("priority"), F.lit("optional").alias("use"), attrs.alias("attrs"))

    one, role = spark.range(1), F.concat(F.lit("role-"), "n_name")
    usable = F.create_map(F.lit("usable"), (F.col("c_mktsegment") != "BUILDING").cast("string"))
    parts = [
        arc(one, "base", "all", "sales", "cube", target("cube")), arc(one, "base", "notAll", "sales", "poor", target("poor")),
        arc(one, "base", "domain-member", "sales", "net sales"), arc(one, "base", "domain-member", "net sales", "home sales"),
        arc(one, "cube", "hypercube-dimension", "cube", "who", target("who")), arc(one, "poor", "hypercube-dimension", "poor", "who"),
        arc(nation, "who", "dimension-domain", "who", F.col("n_name"), target(role)), arc(customer, role, "domain-member", F.col("n_name"), F.col("c_name"), usable),
        arc(one, "poor", "dimension-domain", "who", "the poor"), arc(customer.where("c_acctbal < 0"), "poor", "domain-member", "the poor", F.col("c_name")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("""
    WITH m AS (SELECT n_name AS member FROM nation UNION ALL SELECT c_name FROM customer WHERE c_mktsegment <> 'BUILDING' AND NOT c_acctbal < 0)
    SELECT p AS primary_item, CAST(count(*) AS BIGINT) AS members, min(member) AS least, max(member) AS most
    FROM m, (VALUES ('sales'), ('net sales'), ('home sales')) AS x(p) GROUP BY 1""")
def dimension_set_members(spark: SparkSession, d: str) -> DataFrame:
    """Members over target roles, inherited by two generations of primary items, the excluded ones taken out."""
    got = dimension_sets.valid_members(_cube_arcs(spark, d))
    return got.groupBy("primary_item").agg(F.count(F.lit(1)).alias("members"), F.min("member").alias("least"), F.max("member").alias("most"))


@query("SELECT n_name AS nation, CAST(count(*) AS BIGINT) AS members FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment <> 'BUILDING' GROUP BY 1")
def dimension_set_selection(spark: SparkSession, d: str) -> DataFrame:
    """Usable members below each nation in the sets of an heir of the primary item."""
    wanted = table(spark, d, "nation").select(F.lit("home sales").alias("primary_item"), F.lit("who").alias("dimension"), F.col("n_name").alias("from_member"), F.lit(None).cast("string").alias("base_role"))
    got = dimension_sets.select_members(_cube_arcs(spark, d), wanted)
    return got.groupBy(F.col("from_member").alias("nation")).agg(F.count(F.lit(1)).alias("members"))


# --- ranges -----------------------------------------------------------------------------------------------------


@query("""
    SELECT p_partkey AS part, CAST(count(*) AS BIGINT) AS events FROM part JOIN events
      ON epoch_us(ts) BETWEEN epoch_us(TIMESTAMP '2024-01-01') + p_partkey * 600000000 AND epoch_us(TIMESTAMP '2024-01-01') + p_partkey * 600000000 + p_size * 3600000000 GROUP BY 1""")
def interval_join(spark: SparkSession, d: str) -> DataFrame:
    """Events within windows of one to fifty hours, one window a part: points meet intervals on blocks."""
    start = F.lit(1704067200000000) + F.col("p_partkey") * 600_000_000
    windows = table(spark, d, "part").select(F.col("p_partkey").alias("part"), start.alias("low"), (start + F.col("p_size") * F.lit(3_600_000_000)).alias("high"))
    points = table(spark, d, "events").select("event_id", intervals.moments(F.col("ts")).alias("at"))
    return intervals.hold(points, windows, "at", "low", "high").groupBy("part").agg(F.count(F.lit(1)).alias("events"))


# --- rules ------------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey AS order_key, CAST(count(*) AS BIGINT) AS n, round(sum(l_extendedprice * l_discount), 4) AS reduction FROM lineitem WHERE l_quantity > 10 AND l_discount > 0.02 GROUP BY 1")
def scoped_rule(spark: SparkSession, d: str) -> DataFrame:
    """A rule over the evaluations of another one: its variable meets theirs on all aspects, one row a line."""
    f = line_facts(spark, d)
    first = rules.VariableSet([rules.FactVariable("q", [filters.concept_name("quantity"), filters.aspect_cover("unit")]), rules.FactVariable("p", [filters.concept_name("extendedprice"), filters.aspect_cover("unit")])], preconditions=["$q > 10"])
    second = rules.VariableSet([rules.FactVariable("r", [filters.concept_name("discount"), filters.aspect_cover("unit")])], preconditions=["$r > 0.02"])
    e = rules.evaluate(second, f, scope=rules.Scope(first, rules.evaluate(first, f)))
    return e.groupBy(e["q__dims"]["order"].cast("long").alias("order_key")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("p") * F.col("r")), 4).alias("reduction"))


@query("SELECT 'discount' AS assertion, CAST(count(*) FILTER (l_discount * 100 <= l_tax * 100 + 3.5) AS BIGINT) AS satisfied, CAST(count(*) FILTER (l_discount * 100 > l_tax * 100 + 3.5) AS BIGINT) AS unsatisfied FROM lineitem WHERE l_quantity > 40")
def scoped_assertion(spark: SparkSession, d: str) -> DataFrame:
    """An assertion in the scope of a formula's variables that names other dimensions than the assertion does."""
    f = line_facts(spark, d)
    first = rules.VariableSet([rules.FactVariable("q", [filters.concept_name("quantity"), filters.general("num > 40")]), rules.FactVariable("t", [filters.concept_name("tax")])])
    second = rules.VariableSet([rules.FactVariable("r", [filters.concept_name("discount")])], dimensions=["order", "part"])
    a = rules.ValueAssertion("discount", second, "$r * 100 <= $t * 100 + 3.5")
    return rules.count_outcomes(a.run(f, scope=rules.Scope(first, rules.evaluate(first, f))))


@query("""
    SELECT CAST(count(*) AS BIGINT) AS pairs FROM (SELECT l_orderkey, l_partkey FROM lineitem) a
    JOIN orders ON o_orderkey = l_orderkey WHERE l_partkey % 10 <> 0""")
def equality_with_literals(spark: SparkSession, d: str) -> DataFrame:
    """A dimension's own equality, whose literals hold the names of the two members: orders written a-1 and b-1 are the same."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate")
    day = F.lit("2000-01-01").cast("date")
    named = F.when(F.col("l_partkey") % 10 == 0, F.concat(F.lit("c-"), "l_orderkey")).otherwise(F.concat(F.lit("b-"), "l_orderkey"))
    x = as_facts(lines, F.lit("line"), F.col("l_linenumber"), F.lit("e"), day, {"order": named}, F.lit("pure"), F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"))
    y = as_facts(table(spark, d, "orders"), F.lit("head"), F.col("o_totalprice"), F.lit("e"), day, {"order": F.concat(F.lit("a-"), "o_orderkey")}, F.lit("pure"), F.concat(F.lit("o-"), "o_orderkey"))
    same = "regexp_replace(a, '^(a|b)-', 'a b ') = regexp_replace(b, '^(a|b)-', 'a b ')"
    rule = rules.VariableSet([rules.FactVariable("h", [filters.concept_name("head")]), rules.FactVariable("l", [filters.concept_name("line")])], equalities={"order": same})
    return rules.evaluate(rule, x.unionByName(y)).agg(F.count(F.lit(1)).alias("pairs"))


@query("""
    SELECT l_returnflag AS flag, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT))::HUGEINT * 100000000000000000 + sum(l_orderkey)::HUGEINT AS VARCHAR) AS total FROM lineitem GROUP BY 1""")
def exact_totals(spark: SparkSession, d: str) -> DataFrame:
    """Sums of numbers of some 25 digits, to the last one."""
    lines = table(spark, d, "lineitem")
    cents = F.concat(F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"), F.lpad(F.col("l_orderkey").cast("string"), 17, "0"))
    f = line_facts_of(lines, cents.cast("decimal(38,6)"))
    rule = rules.VariableSet([rules.FactVariable("x", [filters.aspect_cover("line", "entity", "period", "concept")], bind_as_sequence=True, matches=True, aggregates=("sum",))], dimensions=["line"], exact=True)
    e = rules.evaluate(rule, f)
    return e.select(F.col("x__key_unit").alias("flag"), F.col("x__sum").cast("decimal(38,0)").cast("string").alias("total"))


def line_facts_of(lines: DataFrame, number) -> DataFrame:
    """Facts of lines whose unit is their return flag."""
    key = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_quantity")
    return as_facts(lines, F.lit("x"), number, F.lit("e"), F.lit("2000-01-01").cast("date"), {"line": key}, F.col("l_returnflag"), key)


@query("""
    SELECT l_returnflag AS flag, sum(CAST(l_quantity AS DECIMAL(18,7)) - CAST(CASE WHEN l_linenumber % 2 = 0 THEN 0.05 ELSE 0 END AS DECIMAL(18,7)))::DECIMAL(38,7)::VARCHAR AS low, sum(CAST(l_quantity AS DECIMAL(18,7)) + CAST(CASE WHEN l_linenumber % 2 = 0 THEN 0.05 ELSE 0 END AS DECIMAL(18,7)))::DECIMAL(38,7)::VARCHAR AS high FROM lineitem GROUP BY 1""")
def bounded_totals(spark: SparkSession, d: str) -> DataFrame:
    """What a sum may truly be: facts reported to one decimal are off by half a tenth at most, the others are exact."""
    lines = table(spark, d, "lineitem")
    f = line_facts_of(lines, F.col("l_quantity")).join(lines.select(F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_quantity").alias("fact_id"), F.when(F.col("l_linenumber") % 2 == 0, "1").otherwise("INF").alias("_d")).distinct(), "fact_id")
    f = f.withColumn("decimals", F.col("_d")).drop("_d")
    rule = rules.VariableSet([rules.FactVariable("x", [filters.aspect_cover("line", "entity", "period", "concept")], bind_as_sequence=True, matches=True, aggregates=("low", "high"))], dimensions=["line"], exact=True)
    e = rules.evaluate(rule, f)
    return e.select(F.col("x__key_unit").alias("flag"), F.col("x__low").cast("string").alias("low"), F.col("x__high").cast("string").alias("high"))


@query("SELECT o_orderkey AS order_key, CASE WHEN o_orderkey % 3 = 0 THEN 'INF' WHEN o_orderkey % 2 = 0 THEN '-2' ELSE '1' END AS decimals FROM orders WHERE o_orderstatus <> 'F'")
def derived_checked(spark: SparkSession, d: str) -> DataFrame:
    """Derived facts at the coarsest of their sources' decimals, without those whose dimension the concept's hypercube forbids."""
    o = table(spark, d, "orders")
    k, own = F.col("o_orderkey"), {"order": F.col("o_orderkey"), "status": F.col("o_orderstatus")}
    day = F.lit("2000-01-01").cast("date")
    a = as_facts(o, F.lit("gross"), F.col("o_totalprice"), F.lit("e"), day, own, F.lit("pure"), F.concat(F.lit("g"), k)).withColumn("decimals", F.when(F.col("dims")["order"].cast("long") % 3 == 0, "INF").otherwise("1"))
    b = as_facts(o, F.lit("tax"), F.col("o_totalprice") / 10, F.lit("e"), day, own, F.lit("pure"), F.concat(F.lit("t"), k)).withColumn("decimals", F.when(F.col("dims")["order"].cast("long") % 3 == 0, "INF").when(F.col("dims")["order"].cast("long") % 2 == 0, "-2").otherwise("2"))
    rule = rules.VariableSet([rules.FactVariable(n, [filters.concept_name(n)]) for n in ("gross", "tax")])
    formula = rules.Formula("net", rule, "$gross - $tax", concept="'net'", decimals="coarsest")
    made = formula.run(a.unionByName(b))
    text = lambda *rows: spark.createDataFrame(list(rows), "hypercube string, role string, dimension string, kind string, default_member string")
    cubes = spark.createDataFrame([("cube", "r", "net", True, "segment")], "hypercube string, role string, primary_item string, closed boolean, context_element string")
    members = o.where("o_orderstatus <> 'F'").select(F.lit("status").alias("dimension"), F.lit("r").alias("role"), F.lit("a").alias("arcrole"), F.lit("p").alias("parent"), F.col("o_orderstatus").alias("member"), F.lit(True).alias("usable")).distinct()
    # What the check and the join after it both read is worked out once.
    typed = made.select("doc_id", "concept", "context_ref", F.map_filter("dims", lambda x, _: x == "order").alias("typed_dims"), F.map_filter("dims", lambda x, _: x != "order").alias("dims"), "decimals").persist(StorageLevel.DISK_ONLY)
    bad = formula.violations(typed, cubes, text(("cube", "r", "status", "explicit", None), ("cube", "r", "order", "typed", None)), members).select("object_id")
    left = typed.withColumn("object_id", F.concat_ws("#", "concept", "context_ref")).join(bad.distinct(), "object_id", "left_anti")
    return left.select(F.col("typed_dims")["order"].cast("long").alias("order_key"), "decimals")


# --- report sections --------------------------------------------------------------------------------------------


@query("""
    WITH f AS (SELECT c_mktsegment AS s, n_name, r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 5000 GROUP BY ALL)
    SELECT 'segment=' || s AS section, n_name AS concept, 1 AS depth, CAST(n AS BIGINT) AS facts FROM f UNION ALL SELECT DISTINCT 'segment=' || s, r_name, 0, 0 FROM f""")
def report_sections(spark: SparkSession, d: str) -> DataFrame:
    """Facts of rich customers by segment: each section shows its nations and the regions above them."""
    c = table(spark, d, "customer").where("c_acctbal > 5000").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    f = as_facts(c, F.col("n_name"), F.col("c_acctbal"), F.col("c_custkey"), F.lit("2000-01-01").cast("date"), {"segment": F.col("c_mktsegment")}, F.lit("pure"), F.col("c_custkey"))
    rows = report_groups.placed(hierarchies.tree(place_arcs(spark, d)), report_groups.sections(f))
    return rows.select("section", "concept", "depth", "facts")


@query("""
    WITH c AS (SELECT DISTINCT o_orderpriority AS section, CAST(o_custkey AS VARCHAR) AS row, o_orderstatus || (o_orderkey % 3) AS col, year(o_orderdate) AS period, CAST(floor(o_totalprice / 150000) AS INT) AS value FROM orders),
    l AS (SELECT section, period, col, string_agg(row || ':' || value, ',' ORDER BY row, value) AS look FROM c GROUP BY ALL), k AS (SELECT section, period, look, min(col) AS kept FROM l GROUP BY ALL),
    f AS (SELECT DISTINCT c.section, row, c.period, kept AS col, value FROM c JOIN l ON c.section = l.section AND c.period = l.period AND c.col = l.col JOIN k ON k.section = l.section AND k.period = l.period AND k.look = l.look),
    x AS (SELECT section, period, max(n) = 1 AS fits FROM (SELECT section, period, row, count(DISTINCT value) AS n FROM f GROUP BY ALL) GROUP BY ALL)
    SELECT DISTINCT f.section, row, CASE WHEN fits THEN min(col) OVER (PARTITION BY f.section, f.period) ELSE col END AS shown, CAST(f.period AS INT) AS period, value FROM f JOIN x ON f.section = x.section AND f.period = x.period""")
def report_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns by status and key, merged where they agree."""
    o = table(spark, d, "orders")
    cells = o.select(F.col("o_orderpriority").alias("section"), F.col("o_custkey").cast("string").alias("row"), F.concat("o_orderstatus", (F.col("o_orderkey") % 3).cast("string")).alias("column"), F.year("o_orderdate").alias("period"), F.floor(F.col("o_totalprice") / 150000).cast("int").alias("value"))
    return report_groups.compacted(cells)


# --- ranges in rules --------------------------------------------------------------------------------------------


@query("""
    WITH q AS (SELECT DISTINCT o_custkey AS c, date_trunc('quarter', o_orderdate) AS a FROM orders), i AS (SELECT o_custkey AS c, o_orderdate + INTERVAL 1 DAY AS t, o_totalprice AS p FROM orders)
    SELECT q.c AS customer, CAST(count(*) AS BIGINT) AS prices, round(sum(p), 2) AS total FROM q JOIN i ON i.c = q.c AND t >= a AND t <= a + INTERVAL 3 MONTH GROUP BY 1""")
def range_rule(spark: SparkSession, d: str) -> DataFrame:
    """A rule over prices at moments within the quarters that a customer reports: a moment on a border belongs to both."""
    o = table(spark, d, "orders")
    moments = as_facts(o, F.lit("price"), F.col("o_totalprice"), F.col("o_custkey"), F.col("o_orderdate"), {}, F.lit("pure"), F.concat(F.lit("p"), "o_orderkey"))
    start = F.date_trunc("quarter", "o_orderdate").cast("timestamp_ntz")
    quarters = as_facts(o.select("o_custkey", start.alias("a")).distinct(), F.lit("quarter"), F.lit(1), F.col("o_custkey"), F.col("a"), {}, F.lit("pure"), F.concat_ws("-", F.lit("q"), "o_custkey", F.col("a").cast("string")))
    end = F.add_months(F.col("start").cast("date"), 3).cast("timestamp_ntz")
    quarters = quarters.withColumns({"period_type": F.lit("duration"), "start": (F.col("end") - F.expr("interval 1 day")).cast("timestamp_ntz")}).withColumn("end", end)
    quarters = quarters.withColumn("period_key", F.concat_ws("|", "period_type", F.col("start").cast("string"), F.col("end").cast("string")))
    rule = rules.VariableSet([rules.FactVariable("q", [filters.concept_name("quarter")]), rules.FactVariable("p", [filters.concept_name("price"), filters.during("q")])])
    e = rules.evaluate(rule, quarters.unionByName(moments))
    return e.groupBy(F.col("p__entity").cast("long").alias("customer")).agg(F.count(F.lit(1)).alias("prices"), F.round(F.sum("p"), 2).alias("total"))


# --- taxonomies -------------------------------------------------------------------------------------------------


@query("""
    SELECT n_name AS nation, 'c' || c_custkey AS concept, CAST(c_custkey AS DOUBLE) AS ord, CASE WHEN c_custkey % 4 = 1 THEN 'ext.xml' ELSE 'base.xml' END AS layer FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 <> 0 AND (c_custkey % 4 <> 1 OR c_acctbal > 0)""")
def extension_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    """Base taxonomies of nations with their customers as concepts, and extensions that prohibit every third arc of the base and bring
    arcs of their own; what stands in each extension's taxonomy, and which layer it is from."""
    from ..sources import discovery

    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("key", F.col("c_custkey").cast("string"))
    heads = 'xmlns:xs="http://www.w3.org/2001/XMLSchema" xmlns:link="http://www.xbrl.org/2003/linkbase" xmlns:xlink="http://www.w3.org/1999/xlink" xmlns:xbrli="http://www.xbrl.org/2003/instance"'
    rich = F.col("c_acctbal") > 0
    name = lambda *x: F.concat(*[F.lit(i) if isinstance(i, str) else i for i in x])
    join = lambda x, when=None: F.array_join(F.collect_list(x if when is None else F.when(when, x)), "")
    element = name('<xs:element name="c', F.col("key"), '" id="c', F.col("key"), '" substitutionGroup="xbrli:item"/>')

    def arc(schema: str, use: str, priority: int):
        return name('<link:loc xlink:type="locator" xlink:href="', schema, "#c", F.col("key"), '" xlink:label="c', F.col("key"), '"/><link:presentationArc xlink:type="arc" xlink:arcrole="pc" xlink:from="top" xlink:to="c', F.col("key"), f'" order="', F.col("key"), f'" use="{use}" priority="{priority}"/>')

    by_nation = c.groupBy("n_name").agg(
        join(element, F.col("c_custkey") % 4 != 1).alias("base_elements"), join(element, (F.col("c_custkey") % 4 == 1) & rich).alias("own_elements"), join(arc("base.xsd", "optional", 0), F.col("c_custkey") % 4 != 1).alias("base_arcs"),
        join(arc("ext.xsd", "optional", 0), (F.col("c_custkey") % 4 == 1) & rich).alias("own_arcs"), join(arc("../base/base.xsd", "prohibited", 1), (F.col("c_custkey") % 4 != 1) & (F.col("c_custkey") % 3 == 0)).alias("stops"), join(arc("ext.xsd", "prohibited", 1), (F.col("c_custkey") % 4 == 1) & (F.col("c_custkey") % 3 == 0) & rich).alias("own_stops"),
    )
    schema = lambda ns, body: name(f'<xs:schema {heads} targetNamespace="{ns}">', body, "</xs:schema>")
    refers = lambda href: f'<link:linkbaseRef xlink:type="simple" xlink:href="{href}"/>'
    links = lambda top, body: name(f'<link:linkbase {heads}><link:presentationLink xlink:type="extended" xlink:role="r"><link:loc xlink:type="locator" xlink:href="{top}" xlink:label="top"/>', body, "</link:presentationLink></link:linkbase>")
    files = {
        "base/base.xsd": schema("urn:base", name(refers("base.xml"), '<xs:element name="top" id="top" substitutionGroup="xbrli:item"/>', F.col("base_elements"))), "base/base.xml": links("base.xsd#top", F.col("base_arcs")),
        "own/ext.xsd": schema("urn:own", name('<xs:import schemaLocation="../base/base.xsd"/>', refers("./ext.xml"), F.col("own_elements"))), "own/ext.xml": links("../base/base.xsd#top", name(F.col("own_arcs"), F.col("stops"), F.col("own_stops"))),
    }
    docs = by_nation.select(F.explode(F.array(*[F.struct(name("http://t/", F.col("n_name"), f"/{path}").alias("uri"), text.alias("text")) for path, text in files.items()])).alias("x")).select("x.*")
    parts = discovery.parse(docs).persist()
    entries = table(spark, d, "nation").select(name("http://t/", F.col("n_name"), "/own/ext.xsd").alias("entry"))
    found = discovery.arcs(parts, discovery.reached(parts, entries))
    return found.select(F.regexp_extract("entry", "//t/([^/]*)/", 1).alias("nation"), F.regexp_extract("to", r"\}(.*)$", 1).alias("concept"), "ord", F.regexp_extract("layer", "([^/]*)$", 1).alias("layer"))
