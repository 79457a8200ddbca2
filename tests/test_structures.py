"""Hierarchies, list ranking, interval joins, dimension sets and chained rules on small cases."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.model import ARCROLES
from ledgerloom.operators import dimension_sets, filters, hierarchies, intervals, networks, rules
from ledgerloom.operators.rounds import list_ranks
from ledgerloom.plans.reporting import as_facts

ARC = "role string, arcrole string, `from` string, `to` string, ord double, weight double, priority int, `use` string, preferred_label string, link_name string, arc_name string, attrs map<string,string>"


def arcs(spark, rows, arcrole="parent-child"):
    """Arcs of (role, from, to[, ord[, attrs[, arcrole]]])."""
    out = []
    for r in rows:
        role, a, b, n, attrs, kind = [*r, *[1.0, {}, arcrole][len(r) - 3 :]]
        out.append((role, ARCROLES.get(kind, kind), a, b, float(n), None, 0, "optional", None, "", "", attrs))
    return spark.createDataFrame(out, ARC)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- lists and hierarchies ---------------------------------------------------------------------------------------


def test_list_ranks(spark):
    rows = [(i, i + 1 if i % 100 < 99 else None, 1, i) for i in range(300)] + [(900, 901, 1, 1), (901, 902, 1, 1), (902, 901, 1, 1), (903, 77777, 1, 5)]
    got = {r.id: r for r in list_ranks(spark.createDataFrame(rows, "id long, next long, n int, w int"), ["n", "w"]).collect()}
    for i in range(300):
        end = i // 100 * 100 + 99
        assert (got[i].last, got[i].cyclic, got[i].n, got[i].w) == (end, False, end - i + 1, sum(range(i, end + 1)))
    assert all(got[i].cyclic for i in (900, 901, 902)) and not got[903].cyclic and got[903].w == 5
    assert list_ranks(spark.createDataFrame([], "id long, next long, n int"), ["n"]).count() == 0


def some_arcs(spark):
    plain = [("t", "a", "b", 2), ("t", "a", "c", 1), ("t", "c", "d", 1), ("t", "c", "e", 2), ("t", "z", "y", 1)]
    shared = [("g", "a", "b", 1), ("g", "a", "c", 2), ("g", "b", "d", 1), ("g", "c", "d", 1), ("g", "d", "e", 1), ("g", "e", "b", 1), ("g", "q", "q2", 1), ("g", "q2", "q", 1)]
    return arcs(spark, plain + shared)


def test_tree_equals_walk(spark, tmp_path):
    trees = hierarchies.tree(some_arcs(spark))
    for role, root in (("t", "a"), ("t", "z"), ("g", "a")):
        want = [(r.concept, r.parent, r.depth, r.ord) for r in networks.walk(some_arcs(spark), root, role).collect()]
        rows = trees.where((F.col("role") == role) & (F.col("root") == root)).orderBy("first").collect()
        assert [(r.concept, r.parent, r.depth, r.ord) for r in rows] == want
        assert [r.first for r in rows] == list(range(len(rows)))
        for r in rows:  # an interval holds the places below, which follow at once
            assert all(x.depth > r.depth for x in rows[r.first + 1 : r.last + 1]) and (r.last + 1 == len(rows) or rows[r.last + 1].depth <= r.depth)
    assert trees.where("concept in ('q', 'q2')").count() == 0
    hierarchies.save(trees, str(tmp_path / "trees"))
    back = hierarchies.load(spark, str(tmp_path / "trees"))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, trees.collect()), key=str)
    assert hierarchies.tree(some_arcs(spark).limit(0)).count() == 0


def test_tree_of_a_long_chain(spark):
    chain = spark.range(600).select(F.lit("t").alias("role"), F.lit("r").alias("arcrole"), F.col("id").cast("string").alias("from"), (F.col("id") + 1).cast("string").alias("to"), F.lit(1.0).alias("ord"), F.lit(0).alias("priority"), F.lit("optional").alias("use"), F.lit(None).cast("string").alias("preferred_label"))
    rows = hierarchies.tree(chain).orderBy("first").collect()
    assert [(r.concept, r.depth, r.last) for r in rows] == [(str(i), i, 600) for i in range(601)]


def test_ranges_of_trees(spark):
    trees = hierarchies.tree(some_arcs(spark)).persist()
    one = lambda c, name: spark.createDataFrame([(c,)], f"{name} string")
    below = hierarchies.below(trees.where("role = 'g'"), one("b", "anchor"))
    assert sorted((r.concept, r.away) for r in below.collect()) == [("d", 1), ("e", 2)]  # the way over c meets b at its end
    assert hierarchies.below(trees, one("a", "anchor"), generations=1).where("role = 't'").count() == 2
    up = hierarchies.above(trees.where("role = 't'"), one("e", "point"), itself=True)
    assert sorted((r.concept, r.away) for r in up.collect()) == [("a", 2), ("c", 1), ("e", 0)]
    left = hierarchies.pruned(trees.where("role = 't'"), one("e", "concept")).orderBy("first").collect()
    assert [(r.concept, r.first, r.last, r.depth) for r in left] == [("a", 0, 2, 0), ("c", 1, 2, 1), ("e", 2, 2, 2)]
    assert hierarchies.to_depth(trees, 0).count() == 3
    assert [r.line for r in hierarchies.flattened(trees).where("role = 't' and root = 'a'").collect()] == ["a", "  c", "    d", "    e", "  b"]


# --- interval joins ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", [1, 2])
def test_points_in_intervals(spark, seed):
    rng = random.Random(seed)
    points = [(i, rng.randint(-200, 200) if rng.random() > 0.05 else None, rng.choice(["x", "y", None])) for i in range(200)]
    ends = []
    for i in range(60):
        a = rng.randint(-220, 220)
        b = a + rng.choice([0, 1, 5, 70, 400, -3])
        ends.append((i, a if rng.random() > 0.1 else None, b if rng.random() > 0.1 else None, rng.choice(["x", "y", None])))
    p, q = spark.createDataFrame(points, "pid int, at int, k string"), spark.createDataFrame(ends, "iid int, low int, high int, k string")
    held = lambda x, lo, hi: x is not None and (lo is None or lo <= x) and (hi is None or x <= hi)
    want = sorted((i, j) for i, x, k in points for j, lo, hi, m in ends if held(x, lo, hi) and k == m and k is not None)
    got = intervals.hold(p, q, "at", "low", "high", ["k"])
    assert sorted((r.pid, r.iid) for r in got.collect()) == want
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    loose = intervals.hold(p.drop("k"), q.drop("k"), "at", "low", "high")
    assert loose.count() == sum(held(x, lo, hi) for _, x, _ in points for _, lo, hi, _ in ends)
    assert {r.pid for r in intervals.hold(p, q, "at", "low", "high", ["k"], "left_semi").collect()} == {i for i, _ in want}
    assert {r.pid for r in intervals.hold(p, q, "at", "low", "high", ["k"], "left_anti").collect()} == {i for i, _, _ in points} - {i for i, _ in want}
    assert intervals.hold(p.limit(0), q, "at", "low", "high", ["k"]).count() == intervals.hold(p, q.limit(0), "at", "low", "high", ["k"]).count() == 0


def test_moments(spark):
    got = spark.sql("select timestamp_ntz'1969-12-31 23:59:59.5' a, timestamp_ntz'2024-03-10 02:30:00.000001' b").select(intervals.moments(F.col("a")), intervals.moments(F.col("b"))).first()
    assert tuple(got) == (-500_000, 1_710_037_800_000_001)


# --- dimension sets ----------------------------------------------------------------------------------------------


def test_dimension_sets(spark):
    to = lambda r, **more: {"targetRole": r, **more}
    net = arcs(spark, [
        ("base", "p", "h", 1, to("R1", closed="true", contextElement="segment"), "all"), ("base", "p", "child", 1, {}, "domain-member"), ("base", "child", "p", 1, {}, "domain-member"),
        ("base", "child", "x", 1, to("not"), "notAll"), ("other", "stranger", "h", 1, {}, "all"),
        ("R1", "h", "d", 1, to("R2"), "hypercube-dimension"), ("R2", "d", "dom", 1, to("R3", usable="false"), "dimension-domain"),
        ("R3", "dom", "m1", 1, {}, "domain-member"), ("R3", "m1", "m2", 1, to("R4"), "domain-member"), ("R3", "m2", "no", 1, {}, "domain-member"), ("R4", "m2", "m3", 1, {"usable": "false"}, "domain-member"),
        ("R4", "m2", "m4", 1, {}, "domain-member"), ("R4", "m4", "m2", 1, {}, "domain-member"),
        ("not", "x", "d", 1, {}, "hypercube-dimension"), ("not", "d", "m4", 1, {}, "dimension-domain"),
    ])
    got = {(r.base_role, r.primary_item, r.member) for r in dimension_sets.valid_members(net).collect()}
    # m3 and the domain's head can't be used, "no" hangs on m2 in a role that isn't entered, the child must not take m4,
    # and as p inherits from its child what that must not have, neither must p.
    assert got == {("base", p, m) for p in ("p", "child") for m in ("m1", "m2")}
    cubes = {(r.kind, r.primary_item, r.inherited, r.closed) for r in dimension_sets.hypercubes(net).where("base_role = 'base'").collect()}
    assert cubes == {("all", "p", False, True), ("all", "child", True, True), ("notAll", "child", False, False), ("notAll", "p", True, False)}
    ask = lambda axis, frm, role=None: {r.member for r in dimension_sets.select_members(net, spark.createDataFrame([("child", "d", frm, role)], "primary_item string, dimension string, from_member string, base_role string"), axis).collect()}
    assert ask("DRS-child", "dom") == {"m1"} and ask("DRS-descendant", "dom") == {"m1", "m2", "m4"}
    assert ask("DRS-descendant", "m2", "base") == {"m2", "m4"} or ask("DRS-descendant", "m2", "base") == {"m4"}
    assert ask("DRS-child", "dom", "other") == set()
    with pytest.raises(ValueError):
        dimension_sets.select_members(net, net, "sideways")
    assert dimension_sets.valid_members(net.limit(0)).count() == 0


# --- chained rules -----------------------------------------------------------------------------------------------


def facts(spark, rows):
    """(concept, id, number, dimensions) of one entity and day."""
    df = spark.createDataFrame([(c, i, float(n), {k: str(v) for k, v in dims.items()}) for c, i, n, dims in rows], "c string, i string, n double, dims map<string,string>")
    made = as_facts(df, F.col("c"), F.col("n"), F.lit("e"), F.lit("2020-01-01").cast("date"), {}, F.lit("pure"), F.col("i"))
    from ledgerloom.functions.aspects import dims_key

    out = made.join(df.select(F.col("i").alias("fact_id"), F.col("dims").alias("_d")), "fact_id").withColumn("dims", F.col("_d")).drop("_d")
    return out.withColumn("dims_key", dims_key(F.col("dims"), F.col("typed_dims")))


def test_scope_meets_on_aspects(spark):
    wide = facts(spark, [(c, f"{c}{i}", i, {"k": i, "side": c}) for i in range(10) for c in ("a", "b")])
    cover = filters.aspect_cover("side")
    a, b = (rules.FactVariable(c, [filters.concept_name(c), cover]) for c in "ab")
    first = rules.VariableSet([a])
    both = rules.evaluate(rules.VariableSet([a, b]), wide)
    chained = rules.evaluate(rules.VariableSet([b]), wide, scope=rules.Scope(first, rules.evaluate(first, wide)))
    pairs = lambda df: sorted((r.a, r.b) for r in df.select("a", "b").collect())
    assert pairs(both) == pairs(chained) == [(i, i) for i in range(10)]
    assert rules.distinct_evaluations(chained, rules.VariableSet([b])).count() == 10
    # A rule that names a dimension which the first one doesn't still meets it there.
    named = rules.VariableSet([b], dimensions=["k"])
    assert pairs(rules.evaluate(named, wide, scope=rules.Scope(first, rules.evaluate(first, wide)))) == [(i, i) for i in range(10)]
    # A covered dimension is free.
    free = rules.VariableSet([rules.FactVariable("b", [filters.concept_name("b"), cover, filters.aspect_cover("k")])])
    assert rules.evaluate(free, wide, scope=rules.Scope(first, rules.evaluate(first, wide))).count() == 100
    with pytest.raises(ValueError):
        rules.evaluate(first, wide, scope=rules.Scope(first, rules.evaluate(first, wide)))
    sequence = rules.VariableSet([rules.FactVariable("a", [filters.concept_name("a"), cover], bind_as_sequence=True)])
    with pytest.raises(ValueError):
        rules.evaluate(named, wide, scope=rules.Scope(sequence, rules.evaluate(sequence, wide)))
    sums = rules.VariableSet(sequence.variables, dimensions=["k"])
    assert rules.evaluate(named, wide, scope=rules.Scope(sums, rules.evaluate(sums, wide))).count() == 10


def test_equalities_keep_literals(spark):
    wide = facts(spark, [("x", "x1", 1, {"k": "A"}), ("x", "x2", 2, {"k": "b"}), ("x", "x3", 3, {}), ("y", "y1", 1, {"k": "a"}), ("y", "y2", 2, {"k": "B"}), ("y", "y3", 3, {}), ("y", "y4", 3, {"k": "z"})])
    variables = [rules.FactVariable(c, [filters.concept_name(c)]) for c in "xy"]
    run = lambda test: rules.evaluate(rules.VariableSet(variables, equalities={"k": test}), wide)
    pairs = lambda df: sorted((r.x__fact_id, r.y__fact_id) for r in df.collect())
    same = run("lower(a) = lower(b)")
    assert pairs(same) == [("x1", "y1"), ("x2", "y2"), ("x3", "y3")]
    assert pairs(run("lower(a) = 'a' and lower(b) = 'b'")) == [("x1", "y2"), ("x3", "y3")]
    assert pairs(run("nullif(lower(a), 'a') = nullif(lower(b), 'a')")) == [("x2", "y2"), ("x3", "y3")]  # null equals none
    assert pairs(run("a <> b and upper(b) = 'Z'")) == [("x1", "y4"), ("x2", "y4"), ("x3", "y3")]
    assert "lower(x__key_k" in plan(same) and "Filter" not in plan(same).split("Join")[0]  # keys of the join, no test after it


# --- running values and date ranges ------------------------------------------------------------------------------


def test_discrete_ranges_against_one_pass(spark):
    import datetime as dt

    from ledgerloom.operators.contexts import Contexts

    rng, rows = random.Random(6), []
    day = lambda n: dt.datetime(2019, 1, 1) + dt.timedelta(days=n)
    for d in ("a", "b", None):
        for i in range(70):
            start = rng.randint(0, 500)
            instant = rng.random() < 0.3
            rows.append((d, f"c{i}", None if instant else day(start), day(start + (0 if instant else rng.choice([1, 30, 90, 365, 400])))))
    rows.append(("a", "forever", None, None))
    df = spark.createDataFrame(rows, "doc_id string, context_id string, start timestamp_ntz, end timestamp_ntz")
    got = {(r.doc_id, r.context_id): (r.range_start, r.range_end) for r in Contexts(df.where("doc_id is not null")).discrete_ranges().collect()}
    for d in ("a", "b"):
        ranges = []
        own = sorted(((-e.timestamp(), s or e, c, e) for x, c, s, e in rows if x == d and e), key=lambda r: r[:3])
        for _, s, c, e in own:
            home = next((r for r in ranges if r[0] <= s and e <= r[1]), None)
            if home is None:
                ranges.append(home := (s, e))
            assert got[d, c] == home
    assert len(got) == 140


def test_running(spark):
    from ledgerloom.operators.running import running

    rng = random.Random(1)
    rows = [(rng.choice(["x", None]), i, rng.choice([None, rng.randint(0, 99)])) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, at int, v int")
    out = running(df, ["k"], F.floor(F.col("at") / 13), [F.asc("at")], F.col("v"), "max", "most").orderBy("at").collect()
    seen = {}
    for k, at, v in rows:
        seen[k] = max((x for x in (seen.get(k), v) if x is not None), default=None)
        assert out[at].most == seen[k]


# --- continuations, tuple circles, rewriting ---------------------------------------------------------------------


def inline_rows(spark, rows):
    return spark.createDataFrame([(d, tag, i, "n", text, attrs, parent, n) for n, (d, tag, i, text, attrs, parent) in enumerate(rows)], "doc_id string, tag string, id string, name string, text string, attrs map<string,string>, parent string, ordinal int")


def test_long_continuations(spark):
    from ledgerloom.sources import inline

    n = 10_000
    chain = [("d", "nonnumeric", "h", "start ", {"continuedat": "c0"}, None)] + [("d", "continuation", f"c{i}", f"{i} ", {"continuedat": f"c{i + 1}"} if i + 1 < n else {}, None) for i in range(n)]
    odd = [("e", "nonnumeric", "h", "a", {"continuedat": "x"}, None), ("e", "nonnumeric", "h2", "b", {"continuedat": "x"}, None), ("e", "continuation", "x", "x", {"continuedat": "y"}, None), ("e", "continuation", "y", "y", {"continuedat": "x"}, None), ("e", "nonnumeric", "lost", "l", {"continuedat": "none"}, None), ("e", "nonnumeric", "plain", "p", {}, None)]
    got = {(r.doc_id, r.id): r.text for r in inline.with_continuations(inline_rows(spark, chain + odd)).collect()}
    assert got["d", "h"] == "start " + "".join(f"{i} " for i in range(n))
    assert {k[1]: v for k, v in got.items() if k[0] == "e"} == {"h": "axy", "h2": "bxy", "lost": "l", "plain": "p"}


def test_tuple_circles(spark):
    from ledgerloom.sources import inline

    rows = [("d", "tuple", "a", "", {"tupleref": "b"}, None), ("d", "tuple", "b", "", {"tupleref": "c"}, None), ("d", "tuple", "c", "", {}, "a"), ("d", "tuple", "into", "", {"tupleref": "a"}, None), ("d", "tuple", "self", "", {"tupleref": "self"}, None), ("d", "tuple", "fine", "", {}, None), ("d", "tuple", "in", "", {}, "fine"), ("e", "tuple", "b", "", {}, None)]
    got = inline.tuple_circles(inline_rows(spark, rows)).collect()
    assert sorted(map(tuple, got)) == [("d", "a"), ("d", "b"), ("d", "c"), ("d", "self")]
    assert {r.id for r in inline.problems(inline_rows(spark, rows)).where("rule = 'circle'").collect()} == {"a", "b", "c", "self"}


def test_longest_prefix(spark):
    from ledgerloom.sources import packages

    urls = spark.createDataFrame([("p", "http://a/b/c.xsd"), ("q", "http://a/b/c.xsd"), ("p", "http://a/x"), ("p", "other"), (None, "http://a/x"), ("p", None), ("p", "http://a/b/c.xsd")], "package string, url string")
    rules_ = spark.createDataFrame([("p", "http://a/", "one/"), ("p", "http://a/b/", "two/"), ("q", "http://a/b/c.xsd", "three"), ("p", "", "never")], "package string, prefix string, replacement string")
    got = sorted(((r.package, r.url, r.location) for r in packages.rewrite(urls, rules_).collect()), key=str)
    assert got == sorted([("p", "http://a/b/c.xsd", "two/c.xsd")] * 2 + [("q", "http://a/b/c.xsd", "three"), ("p", "http://a/x", "one/x"), ("p", "other", "other"), (None, "http://a/x", "http://a/x"), ("p", None, None)], key=str)
    assert packages.rewrite(urls, rules_.limit(0)).where("location <=> url").count() == 7


# --- taxonomies --------------------------------------------------------------------------------------------------

SCHEMA = '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" xmlns:link="http://www.xbrl.org/2003/linkbase" xmlns:xlink="http://www.w3.org/1999/xlink" xmlns:xbrli="http://www.xbrl.org/2003/instance" targetNamespace="{ns}">{body}</xs:schema>'


def _element(name):
    return f'<xs:element name="{name}" id="{name}" type="xbrli:monetaryItemType" substitutionGroup="xbrli:item" xbrli:periodType="instant"/>'


def _ref(href):
    return f'<xs:annotation><xs:appinfo><link:linkbaseRef xlink:type="simple" xlink:href="{href}"/></xs:appinfo></xs:annotation>'


def _linkbase(*arcs_, labels=()):
    locs = {h for a in arcs_ for h in a[:2]} | {h for h, _ in labels}
    body = "".join(f'<link:loc xlink:type="locator" xlink:href="{h}" xlink:label="{h}"/>' for h in sorted(locs))
    body += "".join(f'<link:presentationArc xlink:type="arc" xlink:arcrole="{ARCROLES["parent-child"]}" xlink:from="{a}" xlink:to="{b}" order="{n}" priority="{p}" use="{u}"/>' for a, b, n, p, u in arcs_)
    body += "".join(f'<link:label xlink:type="resource" xlink:label="l{i}" xlink:role="r" xml:lang="en">{t}</link:label><link:labelArc xlink:type="arc" xlink:arcrole="x" xlink:from="{h}" xlink:to="l{i}"/>' for i, (h, t) in enumerate(labels))
    return f'<link:linkbase xmlns:link="http://www.xbrl.org/2003/linkbase" xmlns:xlink="http://www.w3.org/1999/xlink"><link:presentationLink xlink:type="extended" xlink:role="role">{body}</link:presentationLink></link:linkbase>'


def documents(spark, extra=()):
    base, own = "http://t/base/", "http://t/own/"
    rows = [
        (base + "core.xsd", SCHEMA.format(ns="urn:base", body=_ref("pre/core.xml") + _element("Assets") + _element("Cash") + _element("Old"))),
        (base + "pre/core.xml", _linkbase(("../core.xsd#Assets", "../core.xsd#Cash", 1, 0, "optional"), ("../core.xsd#Assets", "../core.xsd#Old", 2, 0, "optional"), labels=[("../core.xsd#Cash", "Cash at hand")])),
        (own + "ext.xsd", SCHEMA.format(ns="urn:own", body='<xs:import namespace="urn:base" schemaLocation="../base/core.xsd"/>' + _ref("ext.xml#x") + _element("Cash") + _element("Crypto"))),
        (own + "ext.xml", _linkbase(("../base/core.xsd#Assets", "../base/core.xsd#Old", 2, 1, "prohibited"), ("../base/core.xsd#Assets", "ext.xsd#Crypto", 3, 0, "optional"), ("../base/core.xsd#Assets", "ext.xsd#Cash", 4, 0, "optional"), labels=[("ext.xsd#Crypto", "Coins"), ("gone.xsd#X", "lost")])),
        (base + "broken.xsd", "<xs:schema"),
        *extra,
    ]
    return spark.createDataFrame(rows, "uri string, text string")


def test_extension_taxonomy(spark):
    from ledgerloom.sources import discovery, instance

    docs = documents(spark)
    parts = discovery.parse(docs).persist()
    entries = spark.createDataFrame([("http://t/own/ext.xsd",), ("http://t/base/core.xsd",)], "entry string")
    taxonomy = discovery.reached(parts, entries)
    assert {(r.entry[9:12], r.uri.rpartition("/")[2], r.depth) for r in taxonomy.collect()} == {("own", "ext.xsd", 0), ("own", "core.xsd", 1), ("own", "ext.xml", 1), ("own", "core.xml", 2), ("own", "gone.xsd", 2), ("bas", "core.xsd", 0), ("bas", "core.xml", 1)}
    assert [r.uri for r in discovery.missing(taxonomy, docs).collect()] == ["http://t/own/gone.xsd"]
    net = {(r.entry[9:12], r["from"], r.to, r.ord) for r in discovery.arcs(parts, taxonomy).collect()}
    assets, cash = "{urn:base}Assets", "{urn:base}Cash"
    # The extension prohibits one arc of its base and adds two; the base alone is as it was, and two concepts of one name stay apart.
    assert net == {("own", assets, cash, 1.0), ("own", assets, "{urn:own}Crypto", 3.0), ("own", assets, "{urn:own}Cash", 4.0), ("bas", assets, cash, 1.0), ("bas", assets, "{urn:base}Old", 2.0)}
    assert {(r.entry[9:12], r.concept, r.text) for r in discovery.labels(parts, taxonomy).collect()} == {("own", "Cash", "Cash at hand"), ("own", "Crypto", "Coins"), ("bas", "Cash", "Cash at hand")}
    assert parts.where("part = 'error'").select("uri").collect()[0][0].endswith("broken.xsd")
    text = '<xbrl xmlns="http://www.xbrl.org/2003/instance" xmlns:link="http://www.xbrl.org/2003/linkbase" xmlns:xlink="http://www.w3.org/1999/xlink" xmlns:b="urn:base" xmlns:o="urn:own"><link:schemaRef xlink:type="simple" xlink:href="../own/ext.xsd"/><b:Cash contextRef="c">1</b:Cash><o:Cash contextRef="c">2</o:Cash><o:Unknown contextRef="c">3</o:Unknown></xbrl>'
    made = instance.tables(instance.parse(spark.createDataFrame([("http://t/filing/i.xml", text)], "doc_id string, text string")))
    own = discovery.resolve_facts(made["facts"], discovery.entries_of(made["schema_refs"]), discovery.concepts(parts, taxonomy))
    assert sorted((r.ns, r.concept, r.resolved, (r.layer or "").rpartition("/")[2], r.item_type) for r in own.collect()) == [("urn:base", "Cash", True, "core.xsd", "monetaryItemType"), ("urn:own", "Cash", True, "ext.xsd", "monetaryItemType"), ("urn:own", "Unknown", False, "", None)]


def test_taxonomy_store(spark, tmp_path):
    import os

    from ledgerloom.sources import discovery, taxonomy_store as store

    at = str(tmp_path / "store")
    assert store.versions(spark, at) == [] and store.load(spark, at).count() == 0
    plain = lambda df: sorted(map(str, df.collect()))
    assert store.compile(documents(spark), at) == 0
    assert plain(store.load(spark, at)) == plain(discovery.parse(documents(spark)))
    files = lambda n: sum(f.endswith(".parquet") for f in os.listdir(f"{at}/parts/{n}"))
    before = {f: os.path.getmtime(f"{at}/parts/0/{f}") for f in os.listdir(f"{at}/parts/0")}
    changed = [("http://t/own/ext.xml", _linkbase(("../base/core.xsd#Assets", "ext.xsd#Cash", 9, 0, "optional")))]
    assert store.compile(spark.createDataFrame(changed, "uri string, text string"), at) == 1
    assert {r.uri for r in spark.read.parquet(f"{at}/parts/1").select("uri").distinct().collect()} == {"http://t/own/ext.xml"} and files(1) >= 1
    assert before == {f: os.path.getmtime(f"{at}/parts/0/{f}") for f in os.listdir(f"{at}/parts/0")}
    now = documents(spark).where("uri <> 'http://t/own/ext.xml'").unionByName(spark.createDataFrame(changed, "uri string, text string"))
    assert plain(store.load(spark, at)) == plain(discovery.parse(now))
    assert plain(store.load(spark, at, 0)) == plain(discovery.parse(documents(spark)))  # readers of the old version aren't disturbed
    assert [tuple(r) for r in store.changed(spark, at, 0, 1).collect()] == [("http://t/own/ext.xml", "changed")]
    assert store.compile(documents(spark), at, replace=True) == 2  # all of it is stored already
    assert plain(store.load(spark, at)) == plain(discovery.parse(documents(spark)))
    os.makedirs(f"{at}/manifests/3")  # a compiler that failed before it was done
    assert store.versions(spark, at) == [0, 1, 2] and store.compile(documents(spark).limit(0), at) == 4
    with pytest.raises(ValueError):
        store.load(spark, at, 3)


# --- XML documents -----------------------------------------------------------------------------------------------


def test_xml_sink(spark, tmp_path):
    from ledgerloom.sources import instance, xml_sink

    item = lambda i, n="": f'<e:name{n} id="{i}" contextRef="c" unitRef="u" decimals="0">{len(i)}</e:name{n}>'
    deep = item("in0")
    for i in range(12):
        deep = f'<e:box id="b{i}">{item(f"x{i}")}{deep}{item(f"y{i}", "2")}</e:box>'
    body = item("first") + deep + '<e:box id="second">' + item("only") + "</e:box>" + item("last")
    text = '<xbrl xmlns="http://www.xbrl.org/2003/instance" xmlns:e="urn:e"><context id="c"><entity><identifier scheme="s">A&amp;B</identifier></entity><period><instant>2020-01-01</instant></period></context><unit id="u"><measure>m</measure></unit>' + body + "</xbrl>"
    raw = instance.parse(spark.createDataFrame([("one", text), ("two", text.replace("first", "erst"))], "doc_id string, text string"))
    made = instance.tables(raw)
    at = str(tmp_path / "xml")
    xml_sink.write(made["facts"], made["contexts"], made["units"], "e.xsd", at)
    back = instance.tables(instance.parse(xml_sink.read(spark, at)))
    key = lambda df: [tuple(r) for r in df.select("doc_id", "fact_id", "parent_id", "concept", "ns", F.when(F.col("context_ref").isNotNull(), F.col("value")), "context_ref", "unit_ref", "decimals").orderBy("doc_id", "ordinal").collect()]
    assert key(back["facts"]) == key(made["facts"]) and len(key(back["facts"])) == 82
    assert [r.entity for r in back["contexts"].collect()] == ["A&B"] * 2 and back["errors"].count() == 0


# --- report sections ---------------------------------------------------------------------------------------------


def test_columns_are_merged(spark):
    from ledgerloom.operators import report_groups

    cells = [("s", "r1", "a", 1, 5), ("s", "r2", "b", 1, 6), ("s", "r1", "c", 2, 5), ("s", "r1", "d", 2, 7), ("s", "r1", "e", 2, 5), ("s", "r3", "gone", 1, None), ("t", "r1", "b", 1, 5)]
    got = report_groups.compacted(spark.createDataFrame(cells, "section string, row string, column string, period int, value int"))
    # Of period 1 nothing clashes, so a and b are one; of period 2 c and e are the same, d says something else.
    assert sorted(map(tuple, got.collect())) == [("s", "r1", "a", 1, 5), ("s", "r1", "c", 2, 5), ("s", "r1", "d", 2, 7), ("s", "r2", "a", 1, 6), ("t", "r1", "b", 1, 5)]
    assert report_groups.compacted(got.limit(0).withColumnRenamed("shown", "column")).count() == 0


def test_sections(spark):
    from ledgerloom.operators import report_groups

    f = spark.createDataFrame([("d", {"x": "1", "a": "2"}), ("e", {}), ("e", None), ("no", {"x": "1"})], "concept string, dims map<string,string>")
    named = report_groups.sections(f)
    assert [r.section for r in named.collect()] == ["a=2;x=1", "", "", "x=1"]
    rows = report_groups.placed(hierarchies.tree(some_arcs(spark)).where("role = 't'"), named)
    assert sorted((r.section, r.first, r.concept, r.depth, r.facts) for r in rows.collect()) == [("", 0, "a", 0, 0), ("", 1, "c", 1, 0), ("", 3, "e", 2, 2), ("a=2;x=1", 0, "a", 0, 0), ("a=2;x=1", 1, "c", 1, 0), ("a=2;x=1", 2, "d", 2, 1)]
    assert [r.section for r in report_groups.sections(f, ["x"]).collect()] == ["x=1", "", "", "x=1"]


def test_scenario_dimensions_and_uncovered_aspects(spark):
    from ledgerloom.functions import registry
    from ledgerloom.functions.aspects import wide
    from ledgerloom.sources import instance

    member = lambda d: f'<d:explicitMember dimension="{d}">m-{d}</d:explicitMember>'
    text = f'<xbrl xmlns="http://www.xbrl.org/2003/instance" xmlns:d="http://xbrl.org/2006/xbrldi" xmlns:e="urn:e"><context id="c"><entity><identifier scheme="s">A</identifier><segment>{member("in")}</segment></entity><period><instant>2020-01-01</instant></period><scenario>{member("out")}</scenario></context><e:x id="f" contextRef="c">1</e:x></xbrl>'
    made = instance.tables(instance.parse(spark.createDataFrame([("one", text)], "doc_id string, text string")))
    none = spark.createDataFrame([], "concept string, base_types array<string>, subst_group string, subst_groups array<string>, period_type string, balance string, attrs map<string,string>, abstract boolean, nillable boolean")
    facts_ = wide(made["facts"], made["contexts"], made["units"], none)
    of = lambda d: [registry.call("xfi:fact-explicit-scenario-dimension-value", d), registry.call("xfi:fact-explicit-dimension-value", d)]
    assert list(facts_.select(*of("in"), *of("out")).first()) == [None, "m-in", "m-out", "m-out"]
    e = rules.evaluate(rules.VariableSet([rules.FactVariable("x", [filters.aspect_cover("unit", "entity")])], dimensions=["in"]), facts_)
    assert sorted(registry.call("xff:uncovered-dimensional-aspects", e, "x")) == ["dims", "in"]
    assert sorted(registry.call("xff:uncovered-non-dimensional-aspects", e, "x")) == ["concept", "location", "period", "scenario", "segment"]


def test_range_rules(spark):
    wide = facts(spark, [("q", "q1", 1, {"k": "A"}), ("q", "q2", 1, {"k": "B"}), ("p", "p1", 5, {"k": "A"}), ("p", "p2", 6, {"k": "B"}), ("p", "p3", 7, {"k": "A"})])
    moment = lambda n: F.expr(f"timestamp_ntz'2020-01-01 00:00:00' + interval {n} days")
    at = {"q1": ("duration", 0, 10), "q2": ("duration", 0, 1), "p1": ("instant", None, 10), "p2": ("instant", None, 11), "p3": ("duration", 2, 11)}
    for i, (kind, a, b) in at.items():
        own = F.col("fact_id") == i
        wide = wide.withColumns({"period_type": F.when(own, kind).otherwise(F.col("period_type")), "start": F.when(own, moment(a) if a is not None else F.lit(None).cast("timestamp_ntz")).otherwise(F.col("start")), "end": F.when(own, moment(b)).otherwise(F.col("end"))})
    p = rules.FactVariable("p", [filters.concept_name("p"), filters.during("q")])
    e = rules.evaluate(rules.VariableSet([rules.FactVariable("q", [filters.concept_name("q")]), p]), wide)
    assert [(r.q__fact_id, r.p__fact_id) for r in e.collect()] == [("q1", "p1")]  # p3 begins within q1 and ends after it
    assert "NestedLoop" not in plan(e) and "Cartesian" not in plan(e)
    with pytest.raises(ValueError):
        rules.evaluate(rules.VariableSet([rules.FactVariable("q", [filters.concept_name("q")]), rules.FactVariable("p", p.filters, fallback="0")]), wide)
    with pytest.raises(ValueError):
        rules.evaluate(rules.VariableSet([rules.FactVariable("q", [filters.concept_name("q")]), rules.FactVariable("p", [filters.or_filter(filters.during("q"), filters.nilled())])]), wide)
