"""Work that must not outgrow its input, and results on shapes that only large tables have."""

import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from test_structures import arcs

from ledgerloom import catalog
from ledgerloom.functions import equality, transforms
from ledgerloom.operators import hierarchies, networks
from ledgerloom.operators.rounds import Rounds
from ledgerloom.sources import inline


def size(df):
    return len(df._jdf.queryExecution().optimizedPlan().toString())


# --- iterations ---------------------------------------------------------------------------------------------------


def test_rounds_keep_plans_short(spark):
    rounds = Rounds()
    now = rounds.keep(spark.range(4).withColumn("x", F.col("id")))
    first = size(now)
    for _ in range(5):
        other = now.select("id", F.col("x").alias("y"))
        now = rounds.keep(now.join(other, "id").select("id", (F.col("x") + F.col("y")).alias("x")))
    assert size(now) <= 2 * first and sorted(map(tuple, now.collect())) == [(i, 32 * i) for i in range(4)]


# --- hierarchies --------------------------------------------------------------------------------------------------


def test_leaves_are_not_ranked(spark, monkeypatch):
    ranked, own = [], hierarchies.list_ranks

    def seen(links, *rest):
        ranked.append(links.count())
        return own(links, *rest)

    monkeypatch.setattr(hierarchies, "list_ranks", seen)
    trees = hierarchies.tree(arcs(spark, [("t", "top", f"c{i:03}", i) for i in range(200)]))
    assert ranked == [2] and [(r.first, r.last, r.depth) for r in trees.orderBy("first").collect()] == [(0, 200, 0)] + [(i, i, 1) for i in range(1, 201)]


@pytest.mark.parametrize("seed", range(2))
def test_tree_of_any_shape(spark, seed):
    rng = random.Random(seed)
    rows = [("t", f"n{rng.randrange(max(0, i - 12), i)}", f"n{i}", rng.randrange(3)) for i in range(1, 80)]
    children = {}
    for _, a, b, n in rows:
        children.setdefault(a, []).append((n, b))
    want = []

    def visit(node, depth):
        at = len(want)
        want.append(None)
        for _, c in sorted(children.get(node, [])):
            visit(c, depth + 1)
        want[at] = (node, at, len(want) - 1, depth)

    visit("n0", 0)
    trees = hierarchies.tree(arcs(spark, rows))
    assert [(r.concept, r.first, r.last, r.depth) for r in trees.orderBy("first").collect()] == want
    kept = {f"n{rng.randrange(80)}" for _ in range(5)} | {"n0"}
    left = hierarchies.pruned(trees, spark.createDataFrame([(k,) for k in kept], "concept string"))
    parents = {b: a for _, a, b, _ in rows}
    stay = set()
    for k in kept:
        while k:
            stay.add(k)
            k = parents.get(k)
    assert {r.concept for r in left.collect()} == stay
    alone = hierarchies.pruned(trees, spark.createDataFrame([("n0",)], "concept string")).collect()
    assert [(r.concept, r.first, r.last, r.depth) for r in alone] == [("n0", 0, 0, 0)]


# --- cycles -------------------------------------------------------------------------------------------------------


def test_cycles_keep_tables_small(spark, monkeypatch):
    most, keep = [], Rounds.keep

    def seen(self, df, *rest):
        out = keep(self, df, *rest)
        most.append(out.count())
        return out

    monkeypatch.setattr(Rounds, "keep", seen)
    n = 150
    rows = [("t", "top", f"c{i}") for i in range(n)] + [("t", f"c{i}", "top") for i in range(n)]
    assert networks.directed_cycles(arcs(spark, rows)).count() == n + 1
    assert max(most) <= 2 * len(rows)


@pytest.mark.parametrize("seed", range(3))
def test_cycles_of_any_shape(spark, seed):
    rng = random.Random(seed)
    rows = {(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(36)} | {("loop", "loop"), ("x", "y"), ("y", "x"), ("y", "u"), ("u", "v"), ("v", "u")}
    to = {}
    for a, b in rows:
        to.setdefault(a, set()).add(b)

    def reached(a):
        met, left = set(), [a]
        while left:
            for b in to.get(left.pop(), ()):
                if b not in met:
                    met.add(b)
                    left.append(b)
        return met

    want = {a for a in to if a in reached(a)}
    got = networks.directed_cycles(arcs(spark, [("t", a, b) for a, b in sorted(rows)])).collect()
    assert sorted(r.concept for r in got) == sorted(want)


# --- documents ----------------------------------------------------------------------------------------------------


def test_inline_documents_are_spread_and_parsed_once(spark):
    html = '<p><ix:nonFraction id="v" name="e:n" contextRef="c" unitRef="u">7</ix:nonFraction></p>'
    docs = spark.createDataFrame([(str(i), html) for i in range(40)], "doc_id string, text string").coalesce(1)
    rows = inline.elements(docs)
    assert rows.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = inline.facts(rows)
    assert "MapIn" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.doc_id, r.value) for r in got.select("doc_id", "value").collect()) == sorted((str(i), "7.0") for i in range(40))


# --- functions ----------------------------------------------------------------------------------------------------


def test_pairs_of_equal_prices(spark, tmp_path):
    """Orders 36 apart with one price: the facts of the query still differ, as its SQL says."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    day = datetime.datetime(1995, 3, 1)
    rows = [(k, 3, "F", 1234.5, day, "1-URGENT") for k in range(1, 120)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = con.execute(catalog.oracle_sql()["registry_pairs"])
    cols = [c[0] for c in want.description]
    assert sorted(map(tuple, catalog.queries()["registry_pairs"](spark, str(tmp_path)).select(*cols).collect())) == sorted(want.fetchall())


def test_numbers_are_compared_without_patterns_first(spark):
    texts = ["0", "-0", "00.50", "0.5", ".5", "5.", "+5", "5", " 5 ", "1e2", "100", "100.0", "0.1", "0.10000000000000000001", "0.1000000000000000000", "123456789012345678", "123456789012345679", "-123456789012345678", "123456789012345.6", "1234567890123456", "0" * 20 + "7", "7", "1" + "0" * 400, "2" + "0" * 400]
    df = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    got = df.withColumn("same", equality.x_equal(F.col("a"), F.col("b")))
    for r in got.collect():
        assert r.same == (Decimal(r.a.strip()) == Decimal(r.b.strip())), r
    odd = [("INF", "inf", True), ("INF", "Infinity", False), ("INF", "1", False), ("NaN", "NaN", True), ("true", "1", True), ("false", "true", False), ("x", "x", True), ("", "", True), (None, None, True), (None, "1", False)]
    rows = spark.createDataFrame(odd, "a string, b string, want boolean").withColumn("same", equality.x_equal(F.col("a"), F.col("b"))).collect()
    assert [r.same for r in rows] == [r.want for r in rows]
    assert "regexp_replace" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_columns_of_a_key_are_made_once(spark):
    rows = spark.createDataFrame([(i, None if i % 5 == 0 else f"{i % 5}/2/1999") for i in range(200)], "id long, day string")
    got = transforms.once_each(rows, "day", {"done": transforms.transform(F.col("day"), "date-day-month-year")})
    assert sorted(map(tuple, got.select("id", "done").collect())) == [(i, None if i % 5 == 0 else f"1999-02-0{i % 5}") for i in range(200)]


@pytest.mark.parametrize("name", ["transform_languages", "transforms_fourth"])
def test_dates_are_read_once_each(spark, name):
    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "Aggregate" in plan


# --- cutoffs ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(2))
def test_cutoff_of_all_rows(spark, seed):
    from ledgerloom.llm import quality

    rng = random.Random(seed)
    rows = [(good, round(rng.gauss(good, 0.7), 2)) for good in (rng.randrange(2) for _ in range(25_000))]
    good, poor = sum(g for g, _ in rows), sum(1 - g for g, _ in rows)
    by = {}
    for g, m in rows:
        by.setdefault(m, [0, 0])[1 - g] += 1
    best, lost, left, values = None, 0, 0, sorted(by)
    for i, m in enumerate(values):
        cost = 4 * lost * poor - left * good
        if best is None or cost < best[0]:
            best = (cost, i)
        lost, left = lost + by[m][0], left + by[m][1]
    i = best[1]
    df = spark.createDataFrame(rows, "good int, m double")
    assert i and quality.least_cost(df) == (values[i - 1] + values[i]) / 2
    assert quality.least_cost(df.where("good = 1")) == -float("inf") == quality.least_cost(df.limit(0))


# --- rules --------------------------------------------------------------------------------------------------------


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_own_equality_is_not_sorted_by_expressions(spark):
    from ledgerloom.operators import filters, rules

    own = "regexp_replace(a, '^(a|b)-', '') = regexp_replace(b, '^(a|b)-', '')"
    rule = rules.VariableSet([rules.FactVariable(n, [filters.concept_name(n)]) for n in ("x", "y")], equalities={"d": own})
    day = F.lit("2000-01-01").cast("date")
    rows = spark.createDataFrame([("x", "a-1", 1), ("y", "b-1", 2), ("y", "b-2", 3), ("x", None, 4), ("y", None, 5)], "c string, d string, n int")
    from ledgerloom.plans.reporting import as_facts

    got = rules.evaluate(rule, as_facts(rows, F.col("c"), F.col("n"), F.lit("e"), day, {"d": F.col("d")}, F.lit("pure"), F.col("n")))
    lines = [x for x in plan(got.hint("merge")).splitlines() if "Sort [" in x or "Join [" in x or "hashpartitioning(" in x]
    assert lines and not any("regexp_replace" in x for x in lines)
    assert sorted((r.x, r.y) for r in got.collect()) == [(1.0, 2.0), (4.0, 5.0)] and not [c for c in got.columns if "packed" in c]


def test_later_variables_find_rows_dealt_out(spark):
    from ledgerloom.operators import filters, rules
    from ledgerloom.plans.reporting import as_facts

    rule = rules.VariableSet([rules.FactVariable(n, [filters.concept_name(n)]) for n in "xyz"])
    rows = spark.createDataFrame([(c, k) for c in "xyz" for k in range(3)], "c string, k int")
    f = as_facts(rows, F.col("c"), F.col("k"), F.lit("e"), F.lit("2000-01-01").cast("date"), {"k": F.col("k")}, F.lit("pure"), F.concat("c", F.col("k").cast("string")))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = rules.evaluate(rule, f)
        assert plan(got).count("Exchange hashpartitioning(") == 3 and sorted((r.x, r.y, r.z) for r in got.collect()) == [(float(k),) * 3 for k in range(3)]
        assert all("packed_hash" in x for x in plan(got).splitlines() if "Sort [" in x)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_sorted_entries_as_before(spark):
    from ledgerloom.functions.aspects import sorted_entries

    maps = spark.createDataFrame([({"b": "1", "a": None},), ({},), (None,)], "m map<string,string>")
    old = F.to_json(F.array_sort(F.map_entries(F.coalesce("m", F.create_map().cast("map<string,string>")))))
    assert all(r[0] == r[1] for r in maps.select(sorted_entries(F.col("m")), old).collect())


def test_duplicates_are_sorted_in_many_tasks(spark):
    from ledgerloom.operators import facts

    keys = ["doc_id", "concept", "parent_id", "entity_key", "period_key", "dims_key", "non_dim", "scenario", "unit_key"]
    rows = spark.createDataFrame([("d", "c", None, "e", "p", k, None, None, "u", ref) for k, ref in [("1", "a"), ("1", "b"), ("2", "c"), (None, "d"), (None, None)]], ", ".join(f"{k} string" for k in [*keys, "context_ref"]))
    got = facts.duplicates(rows)
    parts = facts.SORTS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert f", {parts}), REPARTITION_BY_NUM" in plan(got)
    assert sorted((r.context_ref, r.n_duplicates) for r in got.collect()) == [("a", 2), ("b", 2), ("d", 2)] and got.columns == [*rows.columns, "n_duplicates"]


def test_facts_are_dealt_out_once_for_hypercubes(spark):
    from ledgerloom.operators import validation

    f = spark.createDataFrame([("d", f"f{i}", "net", "c", {"status": m}) for i, m in enumerate(("O", "F", "P"))], "doc_id string, fact_id string, concept string, context_ref string, dims map<string,string>").withColumn("typed_dims", F.create_map().cast("map<string,string>"))
    cubes = spark.createDataFrame([("cube", "r", "net", True)], "hypercube string, role string, primary_item string, closed boolean")
    dims = spark.createDataFrame([("cube", "r", "status", "explicit", None)], "hypercube string, role string, dimension string, kind string, default_member string")
    members = spark.createDataFrame([("status", "r", m, True) for m in "OP"], "dimension string, role string, member string, usable boolean")
    got = validation.hypercubes(f, cubes, dims, members)
    assert plan(got).count("Exchange hashpartitioning(doc_id") == 1 and "hashpartitioning(concept" not in plan(got)
    assert [r.object_id for r in got.collect()] == ["f1"]


# --- documents ----------------------------------------------------------------------------------------------------


def test_instances_come_back_in_bounded_batches():
    import pyarrow as pa

    from ledgerloom.sources import instance

    text = instance.xml_head("e.xsd") + "".join(f'<f:x xmlns:f="urn:f" id="f{i}" contextRef="c">{i}</f:x>' for i in range(instance.ROWS + 7)) + "</xbrl>"
    got = list(instance._parse([pa.RecordBatch.from_pydict({"doc_id": ["one", "two", "none"], "text": [text, "<x", None]})]))
    assert max(b.num_rows for b in got) <= instance.ROWS
    kinds = [k for b in got for k in b["kind"].to_pylist()]
    assert kinds.count("fact") == instance.ROWS + 7 and kinds.count("schema_ref") == 1 and kinds.count("error") == 2


def test_taxonomies_are_read_in_pieces():
    import tracemalloc

    from ledgerloom.sources import discovery

    x = 'xmlns:link="http://www.xbrl.org/2003/linkbase" xmlns:xlink="http://www.w3.org/1999/xlink"'
    arc = lambda i: f'<link:presentationArc xlink:type="arc" xlink:arcrole="pc" xlink:from="top" xlink:to="c{i}" order="{i + 1}"/>'
    loc = lambda i: f'<link:loc xlink:type="locator" xlink:href="b.xsd#c{i}" xlink:label="c{i}"/>'
    n = 20_000  # arcs stand before their locators
    text = f'<link:linkbase {x}><link:presentationLink xlink:type="extended" xlink:role="r">' + "".join(map(arc, range(n))) + "".join(map(loc, range(n))) + '<link:loc xlink:type="locator" xlink:href="b.xsd#top" xlink:label="top"/></link:presentationLink></link:linkbase>'
    tracemalloc.start()
    found = 0
    for row in discovery.each_row("http://t/a.xml", text):
        found += row["part"] == "arc" and (row["to_uri"], row["to_id"]) == ("http://t/b.xsd", f"c{int(row['ord']) - 1}")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == n and peak < 6 * len(text), peak / len(text)
    assert [r["part"] for r in discovery.rows_of("http://t/a.xml", text[:-5])] == ["error"]
