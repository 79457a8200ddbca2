"""Validation rules: each gives violations (doc_id, rule, section, object_id, message); a pack is their union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import ARCROLES, NUMERIC_TYPES
from . import calc
from .networks import directed_cycles

DECIMALS = r"^\s*(INF|[-+]?[0-9]+)\s*$"
PRECISION = r"^\s*(INF|[0-9]+)\s*$"
QNAME = r"^\s*([A-Za-z_][\w.-]*:)?[A-Za-z_][\w.-]*\s*$"
NUMBER = r"^\s*[-+]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][-+]?[0-9]+)?\s*$"


def _violations(df: DataFrame, test: Column, rule: str, section: str, object_id: Column, message: str) -> DataFrame:
    return df.where(F.coalesce(test, F.lit(False))).select("doc_id", F.lit(rule).alias("rule"), F.lit(section).alias("section"), object_id.cast("string").alias("object_id"), F.lit(message).alias("message"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def documents(facts: DataFrame, contexts: DataFrame, units: DataFrame, schema_refs: DataFrame) -> DataFrame:
    """A schema reference with a location; contexts where there are items; units where there are numbers."""
    docs = facts.select("doc_id").distinct()
    item = facts.where("context_ref is not null").select("doc_id").distinct()
    number = facts.where(F.col("item_type").isin(NUMERIC_TYPES)).select("doc_id").distinct()
    lacks = lambda have, other, rule, section, text: _violations(have.join(other.select("doc_id").distinct(), "doc_id", "left_anti"), F.lit(True), rule, section, F.col("doc_id"), text)
    return _union([
        lacks(docs, schema_refs.where("href is not null and href <> ''"), "schema-ref", "4.2", "a document needs a schema reference"),
        lacks(item, contexts, "no-contexts", "4.7", "items need contexts"),
        lacks(number, units, "no-units", "4.8", "numbers need units"),
    ])


def contexts(ctx: DataFrame) -> DataFrame:
    """Ids, dates in order, and entities. ``start_text`` and ``end_text`` are the dates as written, if kept."""
    cid = F.col("context_id")
    w = Window.partitionBy("doc_id", "context_id")
    twice = ctx.withColumn("_n", F.count(F.lit(1)).over(w))
    parts = [
        _violations(ctx, cid.isNull() | (cid == ""), "context-id", "4.7.1", cid, "a context needs an id"),
        _violations(twice, F.col("_n") > 1, "context-id-twice", "4.7.1", cid, "the id is used more than once"),
        _violations(ctx, (F.col("period_type") != "forever") & F.col("end").isNull(), "period-date", "4.7.2", cid, "a date is missing or is no date"),
        _violations(ctx, (F.col("period_type") == "duration") & F.col("start").isNull(), "period-start", "4.7.2", cid, "the start is missing or is no date"),
        _violations(ctx, (F.col("period_type") == "duration") & (F.col("start") >= F.col("end")), "period-order", "4.7.2", cid, "a duration must start before it ends"),
        _violations(ctx, (F.col("period_type") == "instant") & F.col("start").isNotNull() & (F.col("start") != F.col("end")), "instant-dates", "4.7.2", cid, "an instant has one date"),
        _violations(ctx, F.col("entity").isNull() | (F.col("entity") == ""), "entity-value", "4.7.3", cid, "an identifier needs a value"),
        _violations(ctx, F.col("scheme").isNull() | (F.col("scheme") == ""), "entity-scheme", "4.7.3", cid, "an identifier needs a scheme"),
    ]
    return _union(parts)


def dimensions(ctx: DataFrame, hypercube_dims: DataFrame, dim_members: DataFrame) -> DataFrame:
    """Explicit dimensions and members that the taxonomy knows; typed ones that are declared as typed."""
    used = ctx.select("doc_id", "context_id", F.explode("dims").alias("dimension", "member"))
    known = hypercube_dims.where("kind = 'explicit'").select("dimension").distinct()
    members = dim_members.select("dimension", "member").distinct()
    typed = ctx.select("doc_id", "context_id", F.explode("typed_dims").alias("dimension", "member"))
    declared = hypercube_dims.where("kind = 'typed'").select("dimension").distinct()
    return _union([
        _violations(used.join(known, "dimension", "left_anti"), F.lit(True), "explicit-dimension", "3.1.4", F.concat_ws(" ", "context_id", "dimension"), "no explicit dimension of that name"),
        _violations(used.join(known, "dimension", "left_semi").join(members, ["dimension", "member"], "left_anti"), F.lit(True), "explicit-member", "3.1.4", F.concat_ws(" ", "context_id", "member"), "no member of that dimension"),
        _violations(typed.join(declared, "dimension", "left_anti"), F.lit(True), "typed-dimension", "3.1.4", F.concat_ws(" ", "context_id", "dimension"), "no typed dimension of that name"),
        _violations(typed, F.col("member").isNull() | (F.trim("member") == ""), "typed-member", "3.1.4", F.concat_ws(" ", "context_id", "dimension"), "a typed member needs content"),
    ])


def units(u: DataFrame) -> DataFrame:
    uid = F.col("unit_id")
    none = F.array().cast("array<string>")
    num, den = F.coalesce("numerator", none), F.coalesce("denominator", none)
    every = F.concat(num, den)
    return _union([
        _violations(u, uid.isNull() | (uid == ""), "unit-id", "4.8.1", uid, "a unit needs an id"),
        _violations(u, (F.size(num) == 0), "unit-measure", "4.8.2", uid, "a unit needs a measure"),
        _violations(u, F.exists(every, lambda m: ~m.rlike(QNAME)), "measure-name", "4.8.2", uid, "a measure is a qualified name"),
        _violations(u, F.exists(every, lambda m: m.startswith("iso4217:") & ~m.rlike("^iso4217:[A-Z]{3}$")), "currency", "4.8.2", uid, "a currency has three capitals"),
        _violations(u, F.exists(every, lambda m: m.startswith("xbrli:") & ~m.isin("xbrli:pure", "xbrli:shares")), "standard-measure", "4.8.2", uid, "the standard knows pure and shares only"),
        _violations(u, F.arrays_overlap(num, den), "divide-overlap", "4.8.4", uid, "a measure stands on both sides"),
    ])


def facts(f: DataFrame, ctx: DataFrame, u: DataFrame, concepts: DataFrame) -> DataFrame:
    """Rules of single facts, on one join with contexts, units and concepts."""
    c = ctx.select("doc_id", F.col("context_id").alias("context_ref"), F.col("period_type").alias("_period"), F.lit(True).alias("_ctx")).dropDuplicates(["doc_id", "context_ref"])
    v = u.select("doc_id", F.col("unit_id").alias("unit_ref"), F.col("numerator").alias("_num"), F.col("denominator").alias("_den"), F.lit(True).alias("_unit")).dropDuplicates(["doc_id", "unit_ref"])
    k = concepts.select("concept", F.col("period_type").alias("_kind"), "base_types", "subst_group", F.col("nillable").alias("_nillable"))
    j = f.join(c, ["doc_id", "context_ref"], "left").join(v, ["doc_id", "unit_ref"], "left").join(k, "concept", "left")
    fid, is_tuple = F.col("fact_id"), F.coalesce(F.col("subst_group").endswith("tuple"), F.lit(False))
    of = lambda t: (F.col("item_type") == t) | F.array_contains("base_types", t)
    numeric = F.col("item_type").isin(NUMERIC_TYPES) | F.arrays_overlap(F.coalesce("base_types", F.array().cast("array<string>")), F.array(*map(F.lit, NUMERIC_TYPES)))
    fraction, nil, item = of("fractionItemType"), F.coalesce("is_nil", F.lit(False)), ~is_tuple
    has_d, has_p = F.col("decimals").isNotNull(), F.col("precision").isNotNull()
    single = (F.size("_num") == 1) & (F.coalesce(F.size("_den"), F.lit(0)) < 1)
    period_fits = F.when(F.col("_kind") == "instant", F.col("_period") == "instant").otherwise(F.col("_period") != "instant")
    rules = [
        ("context-ref", "4.6.1", item & F.col("context_ref").isNotNull() & F.col("_ctx").isNull(), "the context does not exist"),
        ("context-missing", "4.6.1", item & F.col("context_ref").isNull(), "an item needs a context"),
        ("period-type", "4.7.2", item & F.col("_ctx") & F.col("_kind").isNotNull() & ~period_fits, "the context's period is not of the concept's type"),
        ("nil-accuracy", "4.6.3", nil & (has_d | has_p), "a nil fact has no decimals or precision"),
        ("not-nillable", "4.6.3", nil & ~F.col("_nillable"), "the concept does not allow nil"),
        ("unit-missing", "4.6.2", item & numeric & F.col("unit_ref").isNull(), "a number needs a unit"),
        ("unit-ref", "4.6.2", item & F.col("unit_ref").isNotNull() & F.col("_unit").isNull(), "the unit does not exist"),
        ("accuracy-both", "4.6.3", item & numeric & ~nil & has_d & has_p, "decimals and precision exclude each other"),
        ("accuracy-none", "4.6.3", item & numeric & ~nil & ~fraction & ~has_d & ~has_p, "a number needs decimals or precision"),
        ("fraction-accuracy", "4.6.3", item & fraction & (has_d | has_p), "a fraction has no decimals or precision"),
        ("decimals-form", "4.6.5", has_d & ~F.col("decimals").rlike(DECIMALS), "decimals are a whole number or INF"),
        ("precision-form", "4.6.4", has_p & ~F.col("precision").rlike(PRECISION), "precision is a positive number or INF"),
        ("numeric-value", "5.1.1", item & numeric & ~fraction & ~nil & ~F.coalesce(F.col("value").rlike(NUMBER), F.lit(False)), "the value is no number"),
        ("monetary-unit", "4.8.2", of("monetaryItemType") & F.col("_unit") & ~(single & F.col("_num")[0].startswith("iso4217:")), "money is in one currency"),
        ("pure-unit", "4.8.2", of("pureItemType") & F.col("_unit") & ~(single & (F.col("_num")[0] == "xbrli:pure")), "pure numbers are in xbrli:pure"),
        ("shares-unit", "4.8.2", of("sharesItemType") & F.col("_unit") & ~(single & (F.col("_num")[0] == "xbrli:shares")), "shares are in xbrli:shares"),
        ("text-unit", "4.6.2", item & ~numeric & F.col("unit_ref").isNotNull(), "only numbers have units"),
        ("text-accuracy", "4.6.3", item & ~numeric & (has_d | has_p), "only numbers have decimals or precision"),
        ("qname-value", "5.1.1", of("QNameItemType") & ~nil & ~F.col("value").rlike(QNAME), "the value is no qualified name"),
        ("tuple-context", "4.9", is_tuple & F.col("context_ref").isNotNull(), "a tuple has no context"),
        ("tuple-unit", "4.9", is_tuple & F.col("unit_ref").isNotNull(), "a tuple has no unit"),
    ]
    # One pass over the facts: each rule that is broken gives a struct, and the array of them is exploded.
    broken = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.struct(F.lit(r).alias("rule"), F.lit(s).alias("section"), F.lit(m).alias("message"))) for r, s, t, m in rules]))
    return j.select("doc_id", fid.alias("object_id"), F.explode(broken).alias("b")).select("doc_id", "b.rule", "b.section", "object_id", "b.message")


def enumerations(f: DataFrame, allowed: DataFrame) -> DataFrame:
    """Values of enumerations (a set divides by spaces) against (concept, members array)."""
    j = f.where(F.col("item_type").isin("enumerationItemType", "enumerationSetItemType") & ~F.coalesce("is_nil", F.lit(False))).join(allowed, "concept")
    values = F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")
    j = j.withColumn("_values", values)
    return _union([
        _violations(j, F.size(F.array_except("_values", "members")) > 0, "enumeration-value", "ee2", F.col("fact_id"), "a value is not in the domain"),
        _violations(j, F.size(F.array_distinct("_values")) < F.size("_values"), "enumeration-repeated", "ee2", F.col("fact_id"), "a value stands twice in a set"),
    ])


def hypercubes(wide: DataFrame, cubes: DataFrame, cube_dims: DataFrame, dim_members: DataFrame) -> DataFrame:
    """Dimensional validity: in some role all the hypercubes of the concept must fit.

    A cube fits if each of its dimensions has a usable member (or a default, when it is absent), and, if it is
    closed, no other dimension is there. Defaults must not be written. Facts meet cubes by concept, members are
    looked up by equi-joins; nothing is compared pair by pair.
    """
    empty = F.create_map().cast("map<string,string>")
    own = wide.where("context_ref is not null").select("doc_id", "fact_id", "concept", F.coalesce("dims", empty).alias("dims"), F.coalesce("typed_dims", empty).alias("typed"))
    # Cubes and their dimensions are a taxonomy's; facts of one concept would all be dealt to one task by a shuffle.
    shape = cubes.select(F.col("primary_item").alias("concept"), "hypercube", "role", "closed").join(cube_dims, ["hypercube", "role"], "left")
    need = own.join(F.broadcast(shape), "concept")
    member = F.when(F.col("kind") == "typed", F.try_element_at("typed", F.col("dimension"))).otherwise(F.try_element_at("dims", F.col("dimension")))
    need = need.withColumn("member", member)
    usable = dim_members.where("usable").select("dimension", "role", "member", F.lit(True).alias("_ok")).distinct()
    j = need.join(usable, ["dimension", "role", "member"], "left")
    default_written = (F.col("kind") == "explicit") & (F.col("member") == F.col("default_member"))
    fits = F.when(F.col("dimension").isNull(), True).when(F.col("member").isNull(), F.col("default_member").isNotNull()).when(F.col("kind") == "typed", True).otherwise(F.coalesce("_ok", F.lit(False)) & ~F.coalesce(default_written, F.lit(False)))
    size = F.size("dims") + F.size("typed")
    told = j.select("doc_id", "fact_id", "role", "hypercube", fits.alias("fits"), "closed", size.alias("size"), F.col("member").isNotNull().alias("used"))
    # Dealt out by facts, what follows needs no other shuffle.
    by_cube = told.repartition("doc_id", "fact_id").groupBy("doc_id", "fact_id", "role", "hypercube").agg(F.bool_and("fits").alias("ok"), F.first("closed").alias("closed"), F.max("size").alias("size"), F.count_if("used").alias("used"))
    by_role = by_cube.groupBy("doc_id", "fact_id", "role").agg(F.bool_and(F.col("ok") & (~F.col("closed") | (F.col("size") == F.col("used")))).alias("ok"))
    by_fact = by_role.groupBy("doc_id", "fact_id").agg(F.bool_or("ok").alias("ok"))
    return _violations(by_fact, ~F.col("ok"), "hypercube", "3.1.1", F.col("fact_id"), "the fact fits no hypercube of its concept")


def footnotes(arcs: DataFrame, f: DataFrame) -> DataFrame:
    """Footnotes of facts that are not there; ``arcs``: doc_id, fact_id."""
    return _violations(arcs.join(f.select("doc_id", "fact_id"), ["doc_id", "fact_id"], "left_anti"), F.lit(True), "footnote-fact", "4.11", F.col("fact_id"), "the footnote's fact does not exist")


def relations(wide: DataFrame, arcs: DataFrame, concepts: DataFrame) -> DataFrame:
    """Rules that arcs ask for: roll-ups, required elements, aliases, signs and cycles."""
    sums = calc.calculation(wide, arcs, ARCROLES["summation-item"])
    need = calc.requires_element(wide, arcs, ARCROLES["requires-element"])
    alias = calc.essence_alias(wide, arcs, ARCROLES["essence-alias"])
    signs = calc.sign_conflicts(arcs, concepts, ARCROLES["summation-item"]).withColumn("doc_id", F.lit(None).cast("string"))
    parts = [
        _violations(sums, ~F.col("consistent"), "calculation", "5.2.5.2", F.col("fact_id"), "the total is not the weighted sum"),
        _violations(need, F.lit(True), "requires-element", "5.2.6.2.4", F.concat_ws(" ", "concept", "required"), "a required element is missing"),
        _violations(alias, F.lit(True), "essence-alias", "5.2.6.2.2", F.concat_ws(" ", "essence_fact", "alias_fact"), "alias and essence differ"),
        _violations(signs, F.lit(True), "calculation-sign", "5.1.1.2", F.concat_ws(" ", "from", "to"), "the weight contradicts the balances"),
    ]
    for name in ("essence-alias", "general-special"):
        loops = directed_cycles(arcs, arcrole=ARCROLES[name]).withColumn("doc_id", F.lit(None).cast("string"))
        parts.append(_violations(loops, F.lit(True), f"{name}-cycle", "5.2.6.2", F.col("concept"), "the network has a directed cycle"))
    return _union(parts)


def log_counts(violations: DataFrame) -> DataFrame:
    """How often each rule was broken, by document."""
    return violations.groupBy("doc_id", "rule", "section").agg(F.count(F.lit(1)).alias("violations"))
