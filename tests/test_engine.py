"""The reporting engine on hand-written facts: parsing, rules, networks, roll-ups, validation, reports."""

import datetime as dt
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import equality, registry, transforms
from ledgerloom.functions.aspects import period_end, period_start, wide, without_defaults
from ledgerloom.functions.numbers import format_number
from ledgerloom.functions.rounding import inferred_decimals, inferred_precision, presented, round_even
from ledgerloom.model import ARCROLES, ARCS, CONCEPTS
from ledgerloom.operators import calc, contexts, facts, filters, networks, report, rules, sets, validation
from ledgerloom.sources import inline, instance, packages, taxonomy

XML = """<xbrl xmlns="http://www.xbrl.org/2003/instance" xmlns:link="http://www.xbrl.org/2003/linkbase" xmlns:xlink="http://www.w3.org/1999/xlink"
 xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xmlns:xbrldi="http://xbrl.org/2006/xbrldi" xmlns:iso4217="http://www.xbrl.org/2003/iso4217" xmlns:e="urn:e">
<link:schemaRef xlink:type="simple" xlink:href="e.xsd"/>
<context id="i06"><entity><identifier scheme="urn:s">A</identifier></entity><period><instant>2006-12-31</instant></period></context>
<context id="i07"><entity><identifier scheme="urn:s">A</identifier></entity><period><instant>2007-12-31</instant></period></context>
<context id="d07"><entity><identifier scheme="urn:s">A</identifier></entity><period><startDate>2007-01-01</startDate><endDate>2007-12-31</endDate></period></context>
<context id="east"><entity><identifier scheme="urn:s">A</identifier><segment><xbrldi:explicitMember dimension="e:region">e:east</xbrldi:explicitMember></segment></entity><period><instant>2007-12-31</instant></period></context>
<context id="west"><entity><identifier scheme="urn:s">A</identifier><segment><xbrldi:explicitMember dimension="e:region">e:west</xbrldi:explicitMember></segment></entity><period><instant>2007-12-31</instant></period></context>
<context id="typed"><entity><identifier scheme="urn:s">B</identifier></entity><period><forever/></period><scenario><xbrldi:typedMember dimension="e:day"><e:d>1</e:d></xbrldi:typedMember></scenario></context>
<unit id="eur"><measure>iso4217:EUR</measure></unit>
<unit id="perShare"><divide><unitNumerator><measure>iso4217:EUR</measure></unitNumerator><unitDenominator><measure>xbrli:shares</measure></unitDenominator></divide></unit>
<e:assets id="f1" contextRef="i07" unitRef="eur" decimals="0">300</e:assets>
<e:assets id="f0" contextRef="i06" unitRef="eur" decimals="0">250</e:assets>
<e:cash id="f2" contextRef="i07" unitRef="eur" decimals="0">100</e:cash>
<e:stock id="f3" contextRef="i07" unitRef="eur" decimals="0">199.6</e:stock>
<e:change id="f4" contextRef="d07" unitRef="eur" decimals="0">50</e:change>
<e:sales id="f5" contextRef="east" unitRef="eur" decimals="0">7</e:sales>
<e:sales id="f6" contextRef="west" unitRef="eur" decimals="0">5</e:sales>
<e:sales id="f7" contextRef="i07" unitRef="eur" decimals="0">12</e:sales>
<e:note id="f8" contextRef="i07">text</e:note>
<e:gone id="f9" contextRef="i07" unitRef="eur" xsi:nil="true"/>
<e:person id="t1"><e:name id="f10" contextRef="i07">Ann</e:name><e:wage id="f11" contextRef="i07" unitRef="eur" decimals="INF">9</e:wage></e:person>
<link:footnoteLink xlink:type="extended"><link:loc xlink:href="#f1" xlink:label="l"/><link:footnoteArc xlink:from="l" xlink:to="n"/><link:footnote xlink:label="n" xlink:role="r" xml:lang="en">see</link:footnote></link:footnoteLink>
</xbrl>"""


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([("d1", XML), ("bad", "<xbrl")], "doc_id string, text string")
    names = {"assets": ("monetaryItemType", "instant", "debit"), "cash": ("monetaryItemType", "instant", "debit"), "stock": ("monetaryItemType", "instant", "debit"), "change": ("monetaryItemType", "duration", "debit"), "sales": ("monetaryItemType", "instant", "credit"), "note": ("stringItemType", "instant", None), "gone": ("monetaryItemType", "instant", None), "name": ("stringItemType", "instant", None), "wage": ("monetaryItemType", "instant", None)}
    rows = [(n, "urn:e", t, ["decimalItemType"] if t == "monetaryItemType" else [], "item", ["item"], p, b, False, True, {"kind": "x"} if n == "cash" else {}) for n, (t, p, b) in names.items()]
    rows.append(("person", "urn:e", None, [], "tuple", ["tuple"], None, None, False, True, {}))
    concepts = spark.createDataFrame(rows, CONCEPTS)
    raw = instance.parse(docs)
    out = instance.tables(raw, concepts) | {"concepts": concepts}
    out["wide"] = wide(out["facts"], out["contexts"], out["units"], concepts).cache()
    return out


def arcs_of(spark, *rows):
    return spark.createDataFrame([(r, a, f, t, o, w, p, u, None, "link", "arc", {}) for r, a, f, t, o, w, p, u in rows], ARCS)


def test_parse(tables):
    assert tables["facts"].count() == 13 and tables["contexts"].count() == 6 and tables["units"].count() == 2
    assert [r["doc_id"] for r in tables["errors"].collect()] == ["bad"]
    assert tables["footnotes"].collect()[0]["text"] == "see"
    ctx = {r["context_id"]: r for r in tables["contexts"].collect()}
    assert ctx["i06"]["end"] == ctx["d07"]["start"] == dt.datetime(2007, 1, 1)
    assert ctx["typed"]["period_type"] == "forever" and ctx["typed"]["end"] is None and "1" in ctx["typed"]["typed_dims"]["e:day"]
    assert ctx["east"]["dims"] == {"e:region": "e:east"}
    assert {r["fact_id"]: r["parent_id"] for r in tables["facts"].collect()}["f11"] == "t1"


def test_xml_round_trip(spark, tables):
    items = tables["facts"].where("context_ref is not null and parent_id is null")
    text = instance.to_xml(items, tables["contexts"], tables["units"], "e.xsd")
    again = instance.tables(instance.parse(text), tables["concepts"])
    key = lambda df: sorted((r["fact_id"], r["concept"], r["value"], r["context_ref"], r["unit_ref"], r["is_nil"]) for r in df.collect() if not r["is_nil"])
    assert key(again["facts"]) == key(items)
    ends = lambda df: sorted((r["context_id"], str(r["start"]), str(r["end"]), r["dims_key"]) for r in df.collect() if r["context_id"] != "typed")
    assert ends(again["contexts"]) == ends(tables["contexts"])


def test_cache(spark, tables, tmp_path):
    parsed = {n: tables[n] for n in ("facts", "contexts", "units", "footnotes", "schema_refs", "errors")}
    instance.write_cache(parsed, str(tmp_path))
    assert instance.read_cache(spark, str(tmp_path))["facts"].count() == 13


def test_contexts(tables):
    c = contexts.Contexts(tables["contexts"])
    ids = lambda x: sorted(r["context_id"] for r in x.df.collect())
    assert ids(c.containing_date("2007-06-30")) == ["d07"]
    assert ids(c.containing_date("2006-12-31")) == ["i06"]
    assert ids(c.for_year(2006)) == ["i06"] and ids(c.with_duration(12)) == ["d07"]
    assert ids(c.instants()) == ["east", "i06", "i07", "west"] and ids(c.durations()) == ["d07", "typed"]
    assert ids(c.with_segment("E:REGION")) == ["east", "west"] and ids(c.without_segment()) == ["d07", "i06", "i07"]
    assert ids(c.of_entity("B", "URN:S")) == ["typed"] and ids(c.same_segment("i06")) == ["d07", "i06", "i07"]
    assert ids(c.remove(c.instants())) == ["d07", "typed"] and ids(c.instants().add(c)) == ids(c)
    assert [r["year"] for r in c.years().collect()] == [2006, 2007]
    assert c.explicit_dimensions().collect()[0]["contexts"] == ["east", "west"]
    assert c.instants().period_label().first()[0] == "2006-12-31 - 2007-12-31" and c.by_ref("i07").period_label().first()[0] == "2007-12-31"
    ranges = {r["context_id"]: r["range_start"] for r in c.discrete_ranges().collect()}
    assert ranges["d07"] == ranges["i07"] == dt.datetime(2007, 1, 1)


def test_facts(spark, tables):
    f = facts.Facts(tables["facts"])
    assert f.by_name("sales").df.count() == 3 and f.tuples().df.count() == 1 and f.in_tuple("t1").df.count() == 2
    assert f.non_nil().df.count() == 12 and f.by_namespaces("URN:E").df.count() == 13
    assert f.by_contexts(tables["contexts"].where("context_id = 'I07' or context_id = 'i07'")).df.where("concept = 'person'").count() == 1
    assert f.unique().df.count() == 13 and f.footnotes(tables["footnotes"], "en").count() == 1
    labels = spark.createDataFrame([("cash", "http://www.xbrl.org/2003/role/label", "en", "Cash"), ("cash", "http://www.xbrl.org/2003/role/label", "de", "Geld")], "concept string, role string, lang string, text string")
    assert f.by_name("cash").with_labels(labels, "de-AT").collect()[0]["label"] == "Geld"
    twice = tables["wide"].unionByName(tables["wide"].where("fact_id = 'f2'").withColumn("fact_id", F.lit("f2b")))
    assert sorted(r["fact_id"] for r in facts.duplicates(twice).collect()) == ["f2", "f2b"]


def test_value_and_existence(tables):
    w = tables["wide"]
    var = lambda n, c, *more, **k: rules.FactVariable(n, [filters.concept_name(c), *more], **k)
    rule = rules.VariableSet([var("a", "assets"), var("c", "cash"), var("s", "stock")])
    got = rules.ValueAssertion("sum", rule, "$a = $c + $s", unsatisfied_message="{$a} is not {$c + $s}").run(w).collect()
    assert len(got) == 1 and not got[0]["satisfied"] and got[0]["message"] == "300.0 is not 299.6"
    assert rules.ExistenceAssertion("e", rules.VariableSet([var("x", "nothing")]), "$count = 0").run(w).collect()[0]["satisfied"]
    two = rules.VariableSet([var("a", "assets"), var("b", "missing", fallback="0")])
    assert sorted(r["b"] for r in rules.evaluate(two, w).collect()) == [0.0, 0.0]
    none = rules.VariableSet([var("a", "missing", fallback="1"), var("b", "missing2", fallback="0")])
    assert rules.evaluate(none, w).count() == 0
    crossed = rules.VariableSet([var("a", "assets"), var("c", "cash")], implicit_filtering=False)
    assert rules.evaluate(crossed, w).count() == 2


def test_opening_balance(tables):
    """A stock at the start and end of a flow's period, by normalised moments."""
    w = tables["wide"]
    rule = rules.VariableSet([
        rules.FactVariable("flow", [filters.concept_name("change")]),
        rules.FactVariable("open", [filters.concept_name("assets"), filters.instant_duration("flow", "start")]),
        rules.FactVariable("close", [filters.concept_name("assets"), filters.instant_duration("flow", "end")]),
    ])
    got = rules.evaluate(rule, w).collect()
    assert [(r["open"], r["flow"], r["close"]) for r in got] == [(250.0, 50.0, 300.0)]


def test_sequence_across_dimension(spark, tables):
    w = tables["wide"]
    members = rules.FactVariable("m", [filters.concept_name("sales"), filters.explicit_dimension("e:region")], bind_as_sequence=True)
    got = rules.evaluate(rules.VariableSet([members]), w).collect()
    assert len(got) == 1 and sorted(got[0]["m"]) == [5.0, 7.0]
    net = spark.createDataFrame([("e:east",)], "member string")
    one = rules.VariableSet([rules.FactVariable("m", [filters.explicit_dimension("e:region", network=net)])])
    assert [r["m"] for r in rules.evaluate(one, w).collect()] == [7.0]
    tree = spark.createDataFrame([("all", "e:east"), ("all", "e:west")], "parent string, member string")
    assert float(calc.across_dimension(w, "e:region", tree).collect()[0]["total"]) == 12


def test_formula_and_consistency(tables):
    w = tables["wide"]
    rule = rules.VariableSet([rules.FactVariable("c", [filters.concept_name("cash")]), rules.FactVariable("s", [filters.concept_name("stock")])])
    f = rules.Formula("total", rule, "$c + $s", concept="'assets'", source="c")
    got = f.run(w).collect()
    assert len(got) == 1 and abs(got[0]["derived"] - 299.6) < 1e-9 and got[0]["unit_key"] == "iso4217:EUR"
    ok = lambda **k: rules.ConsistencyAssertion("t", f, **k).run(w).collect()[0]["satisfied"]
    assert ok() and ok(absolute=0.5) and not ok(absolute=0.3) and ok(proportional=0.01) and not ok(proportional=0.001)
    lost = rules.Formula("lost", rule, "$c", concept="'none'", source="c")
    assert rules.ConsistencyAssertion("t", lost).run(w).count() == 0
    assert not rules.ConsistencyAssertion("t", lost, strict=True).run(w).collect()[0]["satisfied"]
    per = rules.Formula("per", rule, "$c", concept="'x'", source="c", divide_by=["s"])
    assert per.run(w).collect()[0]["unit_key"] == ""


def test_filters(tables):
    w = tables["wide"]
    n = lambda f: w.where(f.column()).where("context_ref is not null").count()
    assert n(filters.concept_balance("credit")) == 3 and n(filters.concept_data_type("decimalItemType")) == 10 and n(filters.concept_data_type("decimalItemType", True)) == 0
    assert n(filters.period_instant_is("2006-12-31")) == 1 and n(filters.period_start_is("2007-01-01")) == 1 and n(filters.period_end_is("2007-12-31")) == 1
    assert n(filters.single_measure("iso4217:EUR")) == 10 and n(filters.nilled()) == 1 and n(~filters.nilled()) == 11
    assert n(filters.concept_custom_attribute("kind")) == 1 and n(filters.regexp_identifier("^A$")) == 12
    assert n(filters.precision_at_least(3)) == 5 and n(filters.precision_at_least("INF")) == 1
    both = filters.and_filter(filters.concept_name("sales"), filters.explicit_dimension("e:region", "e:east"))
    assert n(both) == 1 and both.covered() == {"concept", "e:region"}
    assert n(filters.or_filter()) == 0 and n(filters.or_filter(filters.concept_name("cash"), filters.concept_name("note"))) == 2
    assert filters.aspect_cover("all", exclude=("unit",)).covered() == set(filters.ASPECTS) - {"unit"}
    rule = rules.VariableSet([rules.FactVariable("n", [filters.concept_name("name")], nils=True), rules.FactVariable("w", [filters.concept_name("wage"), filters.sibling_filter("n")])])
    assert rules.evaluate(rule, w).count() == 0  # units differ, and nothing covers them
    rule.variables[1].filters.append(filters.aspect_cover("unit"))
    assert rules.evaluate(rule, w).count() == 1
    parents = filters.parent_filter(tables["facts"], "person")
    assert rules.evaluate(rules.VariableSet([rules.FactVariable("x", [parents])]), w).count() == 2
    closure = networks.ancestors_of_facts(tables["facts"])
    assert rules.evaluate(rules.VariableSet([rules.FactVariable("x", [filters.ancestor_filter(tables["facts"], closure, "person")])]), w).count() == 2


def test_functions_and_parameters(tables):
    rule = rules.VariableSet([rules.FactVariable("c", [filters.concept_name("cash")])], parameters=[rules.Parameter("b", "$a * 2"), rules.Parameter("a", "50")], functions=[rules.Function("twice", ["x"], "$y + $y", [("y", "$x")])])
    assert rules.ValueAssertion("v", rule, "twice($c) = $b + $b").run(tables["wide"]).collect()[0]["satisfied"]
    with pytest.raises(ValueError):
        rules.resolve_parameters(rules.VariableSet([], parameters=[rules.Parameter("a", "$b"), rules.Parameter("b", "$a")]))
    with pytest.raises(ValueError):
        rules.Function("f", ["x"], "$x").expand(["1", "2"])


def test_networks(spark):
    a = arcs_of(spark, ("r", "p", "a", "b", 1.0, 1.0, 0, "optional"), ("r", "p", "a", "c", 2.0, 1.0, 0, "optional"), ("r", "p", "b", "d", 1.0, 1.0, 0, "optional"), ("r", "p", "d", "e", 1.0, 1.0, 0, "optional"), ("r", "p", "a", "x", 3.0, 1.0, 0, "optional"), ("r", "p", "a", "x", 3.0, 1.0, 1, "prohibited"))
    on = lambda s, axis, **k: sorted(r["concept"] for r in networks.concept_relationships(a, s, axis, **k).collect())
    assert on("a", "descendant") == ["b", "c", "d", "e"] and on("a", "descendant", generations=2) == ["b", "c", "d"]
    assert on("a", "child-or-self") == ["a", "b", "c"] and on("e", "ancestor") == ["a", "b", "d"] and on("d", "parent") == ["b"]
    assert on("b", "sibling") == ["c"] and on("b", "sibling-or-descendant") == ["c", "d", "e"]
    assert [r["concept"] for r in networks.walk(a, "a").collect()] == ["a", "b", "d", "e", "c"]
    loop = arcs_of(spark, ("r", "p", "a", "b", 1.0, 1.0, 0, "optional"), ("r", "p", "b", "c", 1.0, 1.0, 0, "optional"), ("r", "p", "c", "b", 1.0, 1.0, 0, "optional"), ("r", "p", "z", "z", 1.0, 1.0, 0, "optional"))
    assert sorted(r[0] for r in networks.directed_cycles(loop).collect()) == ["b", "c", "z"] and networks.directed_cycles(a).count() == 0
    assert sorted(r["concept"] for r in networks.concept_relationships(loop, "a", "descendant").collect()) == ["b", "c"]


def test_calculation_and_relations(spark, tables):
    s = ARCROLES["summation-item"]
    a = arcs_of(spark, ("r", s, "assets", "cash", 1.0, 1.0, 0, "optional"), ("r", s, "assets", "stock", 2.0, 1.0, 0, "optional"), ("r", s, "assets", "sales", 2.0, 1.0, 0, "prohibited"), ("q", ARCROLES["requires-element"], "cash", "ghost", 1.0, None, 0, "optional"), ("q", ARCROLES["essence-alias"], "cash", "stock", 1.0, None, 0, "optional"))
    got = calc.calculation(tables["wide"], a, s).collect()
    assert [(r["reported"], r["calculated"], r["consistent"]) for r in got] == [(300.0, 300.0, True)]
    broken = {r["rule"] for r in validation.relations(tables["wide"], a, tables["concepts"]).collect()}
    assert broken == {"requires-element", "essence-alias"}
    signs = arcs_of(spark, ("r", s, "assets", "sales", 1.0, 1.0, 0, "optional"))
    assert calc.sign_conflicts(signs, tables["concepts"], s).count() == 1


def test_validation(spark, tables):
    broken = lambda df: sorted(r["rule"] for r in df.collect())
    v = lambda f: broken(validation.facts(f, tables["contexts"], tables["units"], tables["concepts"]))
    good = tables["facts"]
    assert v(good) == []
    change = lambda fid, **k: good.where(F.col("fact_id") == fid).withColumns({c: F.lit(x).cast("string") if c != "is_nil" else F.lit(x) for c, x in k.items()})
    assert v(change("f1", context_ref="zz")) == ["context-ref"] and v(change("f1", unit_ref="zz")) == ["unit-ref"]
    assert v(change("f1", unit_ref=None)) == ["unit-missing"] and v(change("f1", precision="3")) == ["accuracy-both"]
    assert v(change("f1", decimals=None)) == ["accuracy-none"] and v(change("f1", decimals="x")) == ["decimals-form"]
    assert v(change("f1", context_ref="d07")) == ["period-type"] and v(change("f1", value="1,0")) == ["numeric-value"]
    assert v(change("f1", unit_ref="perShare")) == ["monetary-unit"] and v(change("f8", decimals="0")) == ["text-accuracy"]
    assert v(change("f9", decimals="0")) == ["nil-accuracy"] and v(change("t1", context_ref="i07")) == ["tuple-context"]
    assert broken(validation.contexts(tables["contexts"])) == [] and broken(validation.units(tables["units"])) == []
    late = tables["contexts"].where("context_id = 'd07'").withColumn("start", F.col("end"))
    assert broken(validation.contexts(late)) == ["period-order"]
    odd = spark.createDataFrame([("d", "u", ["iso4217:eur", "xbrli:foo"], ["iso4217:eur"])], "doc_id string, unit_id string, numerator array<string>, denominator array<string>")
    assert broken(validation.units(odd)) == ["currency", "divide-overlap", "standard-measure"]
    assert broken(validation.documents(good, tables["contexts"], tables["units"], tables["schema_refs"])) == []
    assert broken(validation.documents(good, tables["contexts"].limit(0), tables["units"].limit(0), tables["schema_refs"].limit(0))) == ["no-contexts", "no-units", "schema-ref"]
    cubes = spark.createDataFrame([("h", "r", "sales", True, "segment")], "hypercube string, role string, primary_item string, closed boolean, context_element string")
    dims = spark.createDataFrame([("h", "r", "e:region", "explicit", None)], "hypercube string, role string, dimension string, kind string, default_member string")
    members = spark.createDataFrame([("e:region", "r", "m", "all", "e:east", True)], "dimension string, role string, arcrole string, parent string, member string, usable boolean")
    bad = validation.hypercubes(tables["wide"], cubes, dims, members)
    assert sorted(r["object_id"] for r in bad.collect()) == ["f6", "f7"]
    default = dims.withColumn("default_member", F.lit("e:all"))
    assert sorted(r["object_id"] for r in validation.hypercubes(tables["wide"], cubes, default, members).collect()) == ["f6"]
    known = validation.dimensions(tables["contexts"], dims, members)
    assert sorted(r["rule"] for r in known.collect()) == ["explicit-member", "typed-dimension"]
    enum = spark.createDataFrame([("d", "f", "c", "enumerationSetItemType", "a b b", False)], "doc_id string, fact_id string, concept string, item_type string, value string, is_nil boolean")
    allowed = spark.createDataFrame([("c", ["a"])], "concept string, members array<string>")
    assert broken(validation.enumerations(enum, allowed)) == ["enumeration-repeated", "enumeration-value"]


def test_report(spark, tables):
    a = arcs_of(spark, ("r", "p", "root", "assets", 1.0, 1.0, 0, "optional"), ("r", "p", "root", "sales", 2.0, 1.0, 0, "optional"), ("r", "p", "root", "empty", 3.0, 1.0, 0, "optional"))
    tree = networks.walk(a, "root")
    both = report.combine([tables["wide"], tables["wide"]], [2006, 2007])
    latest = report.latest_in_year(both)
    m = report.matrix(report.place(report.prune(tree, latest), latest), [2006, 2007])
    got = {(r["concept"], r["dims_key"]): (r["2006"], r["2007"]) for r in m.collect()}
    assert len(got) == 5 and {tuple(map(lambda x: x and float(x), v)) for k, v in got.items() if k[0] == "assets"} == {(250.0, 300.0)}
    assert report.to_html(m, [2006, 2007]).count() == 5 and report.to_json(m).count() == 5
    diff = report.compare(m, m, [2007])
    assert diff.where("diff_2007 <> 0").count() == 0
    balances = tables["wide"].where("concept = 'assets'").select("entity_key", "end", F.col("num").cast("double").alias("num"))
    changes = tables["wide"].where("concept = 'change'").select("entity_key", "start", "end", F.col("num").cast("double").alias("num"))
    assert report.roll_forward(balances, changes, ["entity_key"]).collect()[0]["satisfied"]
    assert [r["opening"] for r in report.opening_closing(balances, ["entity_key"]).orderBy("end").collect()] == [None, 250.0]
    assert {r["node_kind"] for r in report.classify(tables["concepts"]).collect()} == {"line", "tuple"}


def test_sets(spark):
    a, b = (spark.createDataFrame([(1, j)], "k int, j string") for j in ('{"x": 1, "y": [1, 2], "z": {"q": "s"}}', '{"x": 1, "y": [1, 3], "w": true}'))
    fa, fb = sets.flatten_json(a, "k", "j"), sets.flatten_json(b, "k", "j")
    got = {r["path"]: r["state"] for r in sets.structural_diff(fa, fb, ["k", "path"]).collect()}
    assert got == {"$.y[1]": "differs", "$.z.q": "only_a", "$.w": "only_b"}
    assert sets.multiset_difference(spark.range(3), spark.range(2)).collect()[0]["side"] == "a"


def test_equality(spark):
    df = spark.createDataFrame([("1.0", "1", True), ("true", "1", True), ("a", "b", False), ("INF", "-INF", False), (None, None, True), ("", "0", False), (None, "x", False)], "a string, b string, want boolean")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", equality.x_equal(F.col("a"), F.col("b"))).collect())
    names = spark.range(1).select(equality.clark(F.lit("p:x"), {"p": "u"}), equality.clark(F.lit("q:x"), {"p": "u"}), equality.nodes_correspond(F.lit("<a> <b/></a>"), F.lit("<a><b/></a>"))).first()
    assert tuple(names) == ("{u}x", None, True)


@pytest.mark.parametrize("value,decimals,precision,want_d,want_p", [("123", "2", None, "2", "5"), ("123.4567", None, "5", "2", "5"), ("0", "2", None, "2", "0"), ("0.001", None, "2", "4", "2"), ("7", None, None, "INF", "INF"), ("7", "INF", None, "INF", "INF"), ("12345", "-3", None, "-3", "2"), ("10", "0", None, "0", "2")])
def test_inference(spark, value, decimals, precision, want_d, want_p):
    df = spark.createDataFrame([(value, decimals, precision)], "v string, d string, p string").withColumn("v", F.col("v").cast("decimal(38,6)"))
    r = df.select(inferred_decimals(F.col("v"), F.col("d"), F.col("p")), inferred_precision(F.col("v"), F.col("d"), F.col("p"))).first()
    assert tuple(r) == (want_d, want_p)


def test_rounding(spark):
    df = spark.createDataFrame([(2.5, 0, 2.0), (3.5, 0, 4.0), (125.0, -1, 120.0), (135.0, -1, 140.0), (1.005, 2, 1.0), (0.125, 2, 0.12), (-2.5, 0, -2.0)], "v double, d int, want double")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", round_even(F.col("v").cast("decimal(38,6)"), F.col("d"))).collect())
    assert spark.range(1).select(presented(F.lit("2.5").cast("decimal(38,6)"), F.lit("INF"))).first()[0] == 2.5


def test_periods(spark):
    r = spark.range(1).select(*[period_end(F.lit(x)) for x in ("2007-12-31", "2007-12-31T24:00:00", "2007-12-31T10:00:00", "x")], period_start(F.lit("2008-01-01"))).first()
    assert r[0] == r[1] == r[4] == dt.datetime(2008, 1, 1) and r[2] == dt.datetime(2007, 12, 31, 10) and r[3] is None


def test_defaults(spark):
    df = spark.sql("select map('d', 'all', 'e', 'x') as dims").select(without_defaults(F.col("dims"), {"d": "all"}))
    assert df.first()[0] == {"e": "x"}


TRANSFORMS = [
    (transforms.TR1, "dateslashus", "12/31/7", "2007-12-31"), (transforms.TR1, "dateslasheu", "31/12/2007", "2007-12-31"), (transforms.TR1, "datedoteu", "31.12.17", "2017-12-31"), (transforms.TR1, "datelongus", "March 1, 2020", "2020-03-01"),
    (transforms.TR1, "dateshortuk", "1 Mar 20", "2020-03-01"), (transforms.TR1, "numcommadot", "1,234.5", "1234.5"), (transforms.TR1, "numdotcomma", "1.234,5", "1234.5"), (transforms.TR1, "numspacecomma", "1 234,5", "1234.5"), (transforms.TR1, "numdash", "-", "0"), (transforms.TR1, "numcomma", "12,5", "12.5"),
    (transforms.TR1, "datelongdaymonthuk", "3 March", "--03-03"), (transforms.TR1, "dateshortmonthyear", "Mar 2020", "2020-03"), (transforms.TR2, "datedaymonth", "31.12", "--12-31"), (transforms.TR2, "dateyearmonthdaycjk", "２０２０年３月１日", "2020-03-01"), (transforms.TR2, "dateerayearmonthdayjp", "平成元年5月1日", "1989-05-01"),
    (transforms.TR2, "dateerayearmonthjp", "令和2年3月", "2020-03"), (transforms.TR2, "numunitdecimal", "2 dollars 5 cents", "2.05"), (transforms.TR2, "zerodash", "–", "0"), (transforms.TR2, "nocontent", "x", ""), (transforms.TR2, "booleantrue", "yes", "true"), (transforms.TR3, "datedaymonthyeardk", "1. okt. 2020", "2020-10-01"),
    (transforms.TR3, "datedaymonthyearin", "१ जनवरी २०२०", "2020-01-01"), (transforms.TR3, "numdotdecimalin", "1,23,456.78", "123456.78"), (transforms.TR3, "calindaymonthyear", "1 चैत्र 1942", "2020-03-21"), (transforms.TR4, "date-day-monthname-year-cs", "5. července 2021", "2021-07-05"), (transforms.TR4, "date-day-monthname-year-cs", "5. června 2021", "2021-06-05"),
    (transforms.TR4, "date-day-monthname-fi", "5. marraskuuta", "--11-05"), (transforms.TR4, "date-monthname-year-pl", "listopad 2021", "2021-11"), (transforms.TR4, "date-monthname-year-hr", "listopad 2021", "2021-10"), (transforms.TR4, "date-day-monthname-year-el", "5 ΜΑΡΤΙΟΥ 2021", "2021-03-05"), (transforms.TR4, "date-day-monthname-year-el", "5 μαρτίου 2021", "2021-03-05"),
    (transforms.TR4, "date-day-monthname-year-de", "5. März 2021", "2021-03-05"), (transforms.TR4, "date-day-monthname-year-fr", "5 août 2021", "2021-08-05"), (transforms.TR4, "date-day-monthname-year-en", "31 February 2021", None), (transforms.TR4, "date-day-monthroman-year", "5 XI 2021", "2021-11-05"), (transforms.TR4, "date-monthroman-year", "iv 2021", "2021-04"),
    (transforms.TR4, "date-year-monthname-day-hu", "2021. március 5", "2021-03-05"), (transforms.TR4, "date-year-monthname-lt", "2021 m. kovas", "2021-03"), (transforms.TR4, "date-year-day-monthname-lv", "2021. gada 5. marts", "2021-03-05"), (transforms.TR4, "date-monthname-day-hu", "március 5", "--03-05"), (transforms.TR4, "date-year-month-day", "2021/3/5", "2021-03-05"),
    (transforms.TR4, "fixed-zero", "nil", "0"), (transforms.TR4, "num-dot-decimal", "1 234.5", "1234.5"), (transforms.TR4, "num-comma-decimal", "1.234,5", "1234.5"), (transforms.TR4, "numdotdecimalin", "0,12,345.50", "12345.5"), (transforms.TR4, "num-dot-decimal", "abc", None), (transforms.TR4, "date-day-month-year", "५.१.२०२०", "2020-01-05"),
]


def test_transforms(spark):
    row = spark.range(1).select(*[transforms.transform(F.lit(text), name, reg).alias(f"c{i}") for i, (reg, name, text, _) in enumerate(TRANSFORMS)]).first()
    wrong = [(t[1], t[2], t[3], got) for t, got in zip(TRANSFORMS, row) if got != t[3]]
    assert not wrong
    assert (len(transforms.TR1), len(transforms.TR2), len(transforms.TR3), len(transforms.TR4) - len(transforms.TR3)) == (24, 21, 31, 98)
    with pytest.raises(KeyError):
        transforms.transform(F.lit("x"), "no-such-format")
    assert spark.range(1).select(transforms.errors(F.lit("x"), "num-dot-decimal")).first()[0]


def test_pictures(spark):
    cases = [(1234.5, "#,##0.00", "1,234.50"), (-1234.5, "#,##0.00;(#,##0.00)", "(1,234.50)"), (0.125, "0.0#", "0.12"), (0.5, "0%", "50%"), (7, "000", "007"), (1234567, "#,###", "1,234,567"), (-3, "0", "-3"), (0.25, ".00", ".25")]
    row = spark.range(1).select(*[format_number(F.lit(v), p).alias(f"c{i}") for i, (v, p, _) in enumerate(cases)]).first()
    assert list(row) == [w for *_, w in cases]


def test_registry(spark, tables):
    w = tables["wide"]
    r = w.where("fact_id = 'f5'").select(registry.call("xfi:fact-explicit-dimension-value", "e:region"), registry.call("xfi:is-instant-period"), registry.call("xfi:is-numeric"), registry.call("xfi:decimals"), registry.call("xfi:period-start"), registry.call("xfi:fact-dimensions"), registry.call("xfi:identifier-value")).first()
    assert tuple(r) == ("e:east", True, True, "0", dt.datetime(2008, 1, 1), ["e:region"], "A")
    agg = tables["contexts"].withColumn("ordinal", F.lit(0)).agg(registry.call("xfi:single-unique-identifier"), F.size(registry.call("xfi:unique-identifiers"))).first()
    assert tuple(agg) == (False, 2)
    assert registry.call("xfi:tuples-in-instance", tables["facts"]).count() == 1 and registry.call("xfi:items-in-tuple", tables["facts"], "t1").count() == 2
    pair = rules.evaluate(rules.VariableSet([rules.FactVariable("a", [filters.concept_name("cash")]), rules.FactVariable("b", [filters.concept_name("stock")])]), w)
    got = pair.select(registry.call("xfi:cu-equal", "a", "b"), registry.call("xfi:v-equal", "a", "b"), registry.call("xfi:identical-nodes", "a", "b"), registry.call("ext:aspectMatch", "a", "b", "period")).first()
    assert tuple(got) == (True, False, False, True)
    with pytest.raises(KeyError):
        registry.call("xfi:nothing")
    assert len(registry.COLUMNS) + len(registry.TABLES) >= 125


HTML = """<html><body><ix:header><ix:hidden><ix:nonNumeric id="h" name="e:doc" contextRef="c">10-K</ix:nonNumeric></ix:hidden></ix:header>
<ix:nonFraction id="a" name="e:cash" contextRef="c" unitRef="u" format="ixt:num-dot-decimal" scale="3" decimals="-3">1,234<ix:exclude>*</ix:exclude></ix:nonFraction>
<ix:nonFraction id="b" name="e:loss" contextRef="c" unitRef="u" sign="-" decimals="0">56</ix:nonFraction>
<ix:nonNumeric id="n" name="e:note" contextRef="c" continuedAt="n2">one <ix:nonFraction id="z" name="e:zero" contextRef="c" unitRef="u" format="ixt:fixed-zero">none</ix:nonFraction></ix:nonNumeric>
<ix:continuation id="n2" continuedAt="n3"> two</ix:continuation><ix:continuation id="n3"> three</ix:continuation>
<ix:fraction id="f" name="e:ratio" contextRef="c" unitRef="p"><ix:numerator>1</ix:numerator><ix:denominator>3</ix:denominator></ix:fraction>
<ix:nonNumeric id="d" name="e:day" contextRef="c" format="ixt:date-day-monthname-year-en" target="t">31 December 2020</ix:nonNumeric>
<ix:nonFraction id="w" name="e:bad" contextRef="c" format="ixt:num-dot-decimal">x</ix:nonFraction><ix:nonNumeric id="lost" name="e:l" contextRef="c" continuedAt="nowhere">q</ix:nonNumeric></body></html>"""


def test_inline(spark):
    rows = inline.elements(spark.createDataFrame([("d", HTML)], "doc_id string, text string")).cache()
    f = {r["fact_id"]: r for r in inline.facts(rows, formats=["num-dot-decimal", "fixed-zero", "date-day-monthname-year-en"]).collect()}
    assert float(f["a"]["num"]) == 1234000 and float(f["b"]["num"]) == -56 and float(f["z"]["num"]) == 0
    assert f["n"]["value"] == "one none two three" and f["d"]["value"] == "2020-12-31" and f["d"]["target"] == "t"
    assert f["w"]["bad_format"] and not f["a"]["bad_format"]
    assert [tuple(map(float, r[2:])) for r in inline.fractions(rows).collect()] == [(1.0, 3.0)]
    assert sorted((r["id"], r["rule"]) for r in inline.problems(rows).collect()) == [("lost", "reference"), ("w", "unit")]
    assert {r["target"]: r["facts"] for r in inline.targets(rows).collect()} == {"": 8, "t": 1}


def test_packages(spark, tmp_path):
    meta = '<p xmlns="http://xbrl.org/2016/taxonomy-package"><entryPoints><entryPoint><name>all</name><entryPointDocument href="http://x/e.xsd"/></entryPoint></entryPoints></p>'
    cat = '<catalog xmlns="urn:oasis:names:tc:entity:xmlns:xml:catalog"><rewriteURI uriStartString="http://x/" rewritePrefix="../"/></catalog>'
    for name, files in (("a", {"p/META-INF/taxonomyPackage.xml": meta, "p/META-INF/catalog.xml": cat, "p/e.xsd": "<x/>"}), ("b", {"e.xsd": "<x/>"}), ("c", {"MetaLinks.json": '{"v": 1}'})):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            for path, text in files.items():
                z.writestr(path, text)
    files = packages.read(spark, str(tmp_path)).cache()
    assert {r["package"][-5:]: r["kind"] for r in packages.classify(files).collect()} == {"a.zip": "taxonomy-package", "b.zip": "schema-folder", "c.zip": "json-manifest"}
    assert packages.entry_points(files).collect()[0]["href"] == "http://x/e.xsd"
    urls = spark.createDataFrame([("http://x/e.xsd",), ("http://y/",)], "url string")
    assert [r["location"] for r in packages.rewrite(urls, packages.catalog(files)).collect()] == ["../e.xsd", "http://y/"]
    assert packages.manifest(files).collect()[0]["value"] == "1" and packages.package_hash(files).count() == 3


def test_taxonomy(spark):
    xsd = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" xmlns:xbrli="http://www.xbrl.org/2003/instance" targetNamespace="urn:e">
    <xs:complexType name="myType"><xs:simpleContent><xs:restriction base="xbrli:monetaryItemType"/></xs:simpleContent></xs:complexType>
    <xs:complexType name="monetaryItemType"><xs:simpleContent><xs:restriction base="xbrli:decimalItemType"/></xs:simpleContent></xs:complexType>
    <xs:element name="cash" id="e_cash" type="e:myType" substitutionGroup="xbrli:item" xbrli:periodType="instant" xbrli:balance="debit" nillable="true"/></xs:schema>"""
    base = 'xmlns:link="http://www.xbrl.org/2003/linkbase" xmlns:xlink="http://www.w3.org/1999/xlink"'
    lnk = f"""<link:linkbase {base}><link:calculationLink xlink:type="extended" xlink:role="r"><link:loc xlink:label="a" xlink:href="e.xsd#e_a"/><link:loc xlink:label="b" xlink:href="e.xsd#e_b"/>
    <link:calculationArc xlink:type="arc" xlink:arcrole="s" xlink:from="a" xlink:to="b" order="2" weight="-1"/></link:calculationLink>
    <link:labelLink xlink:type="extended"><link:loc xlink:label="a" xlink:href="e.xsd#e_a"/><link:label xlink:label="l" xlink:role="x" xml:lang="en">A!</link:label><link:labelArc xlink:type="arc" xlink:from="a" xlink:to="l"/></link:labelLink></link:linkbase>"""
    docs = spark.createDataFrame([("x", xsd)], "doc_id string, text string")
    c = taxonomy.with_chains(taxonomy.concepts(docs), taxonomy.type_pairs(docs)).collect()[0]
    assert c["base_types"] == ["decimalItemType", "monetaryItemType"] and c["subst_groups"] == ["item"] and c["balance"] == "debit" and c["nillable"]
    links = spark.createDataFrame([("l", lnk)], "doc_id string, text string")
    a = taxonomy.arcs(links).collect()[0]
    assert (a["from"], a["to"], a["weight"], a["ord"]) == ("e_a", "e_b", -1.0, 2.0)
    assert taxonomy.labels(links).collect()[0]["text"] == "A!"


def test_stream(spark, tmp_path):
    from ledgerloom.streaming import filings

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.xml").write_text(XML)
    stream = filings.arriving(spark, str(folder))
    q = filings.validated_into(stream, str(tmp_path / "out"), str(tmp_path / "ck"), lambda t: validation.contexts(t["contexts"].withColumn("entity", F.lit(None).cast("string"))))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).where("rule = 'entity-value'").count() == 6
