"""Functions of the rule language by name, as columns over wide facts or as tables.

``COLUMNS`` maps a name to a function of columns; arguments named ``a`` and ``b`` are column prefixes of two facts
in one row, as a rule's variables are. ``TABLES`` maps a name to a function of tables. ``call`` finds either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import NUMERIC_TYPES
from ..operators import networks
from ..operators.facts import concept_labels
from . import equality, maths
from .numbers import format_number
from .rounding import inferred_decimals, inferred_precision


def _c(name: str, side: str = "") -> Column:
    return F.col(f"{side}__{name}" if side else name)


def _field(name: str):
    return lambda side="": _c(name, side)


def _moment(kind: str, name: str):
    """A date of a period; NULL where the period has none, as for one without end."""
    if kind == "instant":
        return lambda side="": F.when(_c("period_type", side) == "instant", _c("end", side))
    if name == "start":
        return lambda side="": F.when(_c("period_type", side) == "duration", _c("start", side)).when(_c("period_type", side) == "instant", _c("end", side))
    return lambda side="": F.when(_c("period_type", side) != "forever", _c("end", side))


def _type_is(*kinds: str):
    return lambda side="": _c("period_type", side).isin(*kinds)


def _struct(*names: str):
    return lambda side="": F.struct(*[_c(n, side).alias(n) for n in names])


def _dimension(dimension: str, side: str = "") -> Column:
    return F.coalesce(F.try_element_at(_c("dims", side), F.lit(dimension)), F.try_element_at(_c("typed_dims", side), F.lit(dimension)))


def is_numeric(side: str = "") -> Column:
    return F.coalesce(_c("item_type", side).isin(NUMERIC_TYPES), F.lit(False)) | F.coalesce(F.arrays_overlap(_c("base_types", side), F.array(*map(F.lit, NUMERIC_TYPES))), F.lit(False))


def aspect_match(a: str, b: str, aspect: str, dimension: str | None = None) -> Column:
    if aspect == "dimension":
        return _dimension(dimension, a).eqNullSafe(_dimension(dimension, b))
    col = {"concept": "concept", "location": "parent_id", "unit": "unit_key", "entity-identifier": "entity_key", "period": "period_key", "complete-segment": "dims_key", "non-XDT-segment": "non_dim", "complete-scenario": "scenario", "non-XDT-scenario": "scenario"}[aspect]
    return _c(col, a).eqNullSafe(_c(col, b))


def minimized_date(moment: Column, as_end: Column | bool = False) -> Column:
    """A date alone where the time is midnight; an end's midnight is shown as the day before."""
    as_end = F.lit(as_end) if isinstance(as_end, bool) else as_end
    midnight = F.date_format(moment, "HH:mm:ss") == "00:00:00"
    day = F.when(as_end, F.date_sub(moment.cast("date"), 1)).otherwise(moment.cast("date"))
    return F.when(midnight, F.date_format(day, "yyyy-MM-dd")).otherwise(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss"))


COLUMNS = {
    "xfi:context": _struct("context_ref", "scheme", "entity", "period_type", "start", "end", "dims", "typed_dims"),
    "xfi:unit": _struct("unit_ref", "numerator", "denominator"),
    "xfi:unit-numerator": _field("numerator"),
    "xfi:unit-denominator": _field("denominator"),
    "xfi:measure-name": lambda measures, i=1: F.try_element_at(measures, F.lit(i)),
    "xfi:period": _struct("period_type", "start", "end"),
    "xfi:context-period": _struct("period_type", "start", "end"),
    "xfi:is-start-end-period": _type_is("duration"),
    "xfi:is-forever-period": _type_is("forever"),
    "xfi:is-duration-period": _type_is("duration", "forever"),
    "xfi:is-instant-period": _type_is("instant"),
    "xfi:period-start": _moment("duration", "start"),
    "xfi:period-end": _moment("duration", "end"),
    "xfi:period-instant": _moment("instant", "end"),
    "xfi:entity": _struct("scheme", "entity", "dims", "typed_dims", "non_dim"),
    "xfi:context-entity": _struct("scheme", "entity", "dims", "typed_dims", "non_dim"),
    "xfi:identifier": _struct("scheme", "entity"),
    "xfi:context-identifier": _struct("scheme", "entity"),
    "xfi:entity-identifier": _struct("scheme", "entity"),
    "xfi:identifier-value": _field("entity"),
    "xfi:identifier-scheme": _field("scheme"),
    "xfi:segment": _struct("dims", "typed_dims", "non_dim"),
    "xfi:entity-segment": _struct("dims", "typed_dims", "non_dim"),
    "xfi:context-segment": _struct("dims", "typed_dims", "non_dim"),
    "xfi:scenario": _field("scenario"),
    "xfi:context-scenario": _field("scenario"),
    "xfi:fact-identifier-value": _field("entity"),
    "xfi:fact-identifier-scheme": _field("scheme"),
    "xfi:is-numeric": is_numeric,
    "xfi:is-non-numeric": lambda side="": ~is_numeric(side),
    "xfi:is-fraction": lambda side="": F.coalesce(_c("item_type", side) == "fractionItemType", F.lit(False)),
    "xfi:precision": lambda side="": inferred_precision(_c("num", side), _c("decimals", side), _c("precision", side)),
    "xfi:decimals": lambda side="": inferred_decimals(_c("num", side), _c("decimals", side), _c("precision", side)),
    "xff:uncovered-aspect": lambda variable, aspect: F.col(f"{variable}__key_{aspect}"),
    "xff:has-fallback-value": lambda variable: F.col(f"{variable}__fallback"),
    "xfi:identical-nodes": lambda a, b: F.col(f"{a}__fact_id").eqNullSafe(F.col(f"{b}__fact_id")),
    "xfi:s-equal": lambda a, b: equality.s_equal(f"{a}_", f"{b}_"),
    "xfi:u-equal": lambda a, b: equality.u_equal(f"{a}_", f"{b}_"),
    "xfi:v-equal": lambda a, b: equality.v_equal(f"{a}_", f"{b}_"),
    "xfi:c-equal": lambda a, b: equality.c_equal(f"{a}_", f"{b}_"),
    "xfi:p-equal": lambda a, b: equality.p_equal(f"{a}_", f"{b}_"),
    "xfi:cu-equal": lambda a, b: equality.cu_equal(f"{a}_", f"{b}_"),
    "xfi:pc-equal": lambda a, b: equality.pc_equal(f"{a}_", f"{b}_"),
    "xfi:pcu-equal": lambda a, b: equality.pcu_equal(f"{a}_", f"{b}_"),
    "xfi:x-equal": equality.x_equal,
    "xfi:duplicate-item": lambda a, b: equality.duplicate_item(f"{a}_", f"{b}_"),
    "xfi:duplicate-tuple": lambda a, b: equality.set_equal(a, b),
    "xfi:start-equal": equality.start_equal,
    "xfi:end-equal": equality.end_equal,
    "xfi:nodes-correspond": equality.nodes_correspond,
    "xfi:identical-node-set": equality.set_equal,
    "xfi:s-equal-set": equality.set_equal,
    "xfi:v-equal-set": equality.set_equal,
    "xfi:c-equal-set": equality.set_equal,
    "xfi:u-equal-set": equality.set_equal,
    "xfi:concept-balance": _field("balance"),
    "xfi:concept-period-type": _field("concept_period_type"),
    "xfi:concept-custom-attribute": lambda name, side="": F.try_element_at(_c("attrs", side), F.lit(name)),
    "xfi:concept-data-type": _field("item_type"),
    "xfi:concept-data-type-derived-from": lambda t, side="": (_c("item_type", side) == t) | F.array_contains(_c("base_types", side), t),
    "xfi:concept-substitutions": _field("subst_groups"),
    "xfi:fact-segment-remainder": _field("non_dim"),
    "xfi:fact-scenario-remainder": _field("scenario"),
    "xfi:fact-has-explicit-dimension": lambda d, side="": F.coalesce(F.map_contains_key(_c("dims", side), d), F.lit(False)),
    "xfi:fact-has-typed-dimension": lambda d, side="": F.coalesce(F.map_contains_key(_c("typed_dims", side), d), F.lit(False)),
    "xfi:fact-has-explicit-dimension-value": lambda d, m, side="": F.coalesce(F.try_element_at(_c("dims", side), F.lit(d)) == m, F.lit(False)),
    "xfi:fact-explicit-dimension-value": lambda d, side="": F.try_element_at(_c("dims", side), F.lit(d)),
    "xfi:fact-explicit-scenario-dimension-value": lambda d, side="": F.try_element_at(_c("scenario_dims", side), F.lit(d)),
    "xfi:fact-typed-dimension-value": lambda d, side="": F.try_element_at(_c("typed_dims", side), F.lit(d)),
    "xfi:fact-typed-dimension-simple-value": lambda d, side="": F.regexp_replace(F.try_element_at(_c("typed_dims", side), F.lit(d)), "<[^>]*>", ""),
    "xfi:fact-explicit-dimensions": lambda side="": F.array_sort(F.map_keys(_c("dims", side))),
    "xfi:fact-typed-dimensions": lambda side="": F.array_sort(F.map_keys(_c("typed_dims", side))),
    "xfi:fact-dimensions": lambda side="": F.array_sort(F.concat(F.map_keys(_c("dims", side)), F.map_keys(_c("typed_dims", side)))),
    "xfi:fact-dimension-s-equal2": lambda a, b, d: _dimension(d, a).eqNullSafe(_dimension(d, b)),
    "xfi:format-number": format_number,
    "ext:is-item": lambda side="": ~F.coalesce(_c("subst_group", side).endswith("tuple"), F.lit(False)),
    "ext:is-tuple": lambda side="": F.coalesce(_c("subst_group", side).endswith("tuple"), F.lit(False)),
    "ext:context-reference": _field("context_ref"),
    "ext:non-XDT-scenario-aspect-test": lambda a, b: _c("scenario", a).eqNullSafe(_c("scenario", b)),
    "ext:non-XDT-segment-aspect-test": lambda a, b: _c("non_dim", a).eqNullSafe(_c("non_dim", b)),
    "ext:aspectMatch": aspect_match,
    "ext:minimized-date-string": minimized_date,
    # Aggregates over an instance: any value in document order, all values, whether there is one only.
    "xfi:taxonomy-refs": lambda: F.array_sort(F.collect_set("schema_ref")),
    **{f"xfi:any-{n}": (lambda e=e: F.min_by(e(), "ordinal")) for n, e in {"identifier": _struct("scheme", "entity"), "start-date": _moment("duration", "start"), "end-date": _moment("duration", "end"), "instant-date": _moment("instant", "end")}.items()},
    **{f"xfi:unique-{n}s": (lambda e=e: F.array_sort(F.collect_set(e()))) for n, e in {"identifier": _struct("scheme", "entity"), "start-date": _moment("duration", "start"), "end-date": _moment("duration", "end"), "instant-date": _moment("instant", "end")}.items()},
    **{f"xfi:single-unique-{n}": (lambda e=e: F.count_distinct(e()) == 1) for n, e in {"identifier": _struct("scheme", "entity"), "start-date": _moment("duration", "start"), "end-date": _moment("duration", "end"), "instant-date": _moment("instant", "end")}.items()},
    **{f"xfm:{n}": f for n, f in maths.FUNCTIONS.items()},
}


def _indicators(positive: bool):
    """Filing indicators: codes of the tables a document files, or says it does not."""

    def find(facts: DataFrame, code: str | None = None) -> DataFrame:
        own = facts.where(equality.local_name(F.col("concept")) == "filingIndicator")
        filed = F.coalesce(F.try_element_at("attrs", F.lit("filed")), F.lit("true")) if "attrs" in facts.columns else F.lit("true")
        own = own.where(filed.isin("true", "1") if positive else filed.isin("false", "0"))
        own = own.select("doc_id", F.trim("value").alias("indicator")).distinct()
        return own.where(F.col("indicator") == code) if code else own

    return find


def _attribute(name_col: str):
    return lambda relationships, name: relationships.withColumn("value", F.try_element_at(name_col, F.lit(name)))


#: Aspects that are no dimensions; others are a dimension each, or dims for all that no rule names.
PLAIN_ASPECTS = ("location", "concept", "entity", "period", "unit", "segment", "scenario")


def _uncovered(evaluations: DataFrame, variable: str) -> list[str]:
    return [c.removeprefix(f"{variable}__key_") for c in evaluations.columns if c.startswith(f"{variable}__key_")]


TABLES = {
    "xfi:facts-in-instance": lambda facts: facts,
    "xfi:items-in-instance": lambda facts: facts.where("context_ref is not null"),
    "xfi:tuples-in-instance": lambda facts: facts.where("context_ref is null"),
    "xfi:items-in-tuple": lambda facts, parent: facts.where((F.col("parent_id") == parent) & F.col("context_ref").isNotNull()),
    "xfi:tuples-in-tuple": lambda facts, parent: facts.where((F.col("parent_id") == parent) & F.col("context_ref").isNull()),
    "xfi:non-nil-facts-in-instance": lambda facts: facts.where("not coalesce(is_nil, false)"),
    "xfi:xbrl-instance": lambda facts, doc: facts.where(F.col("doc_id") == doc),
    "xfi:filter-member-network-selection": networks.member_network,
    "xfi:filter-member-DRS-selection": networks.valid_members,
    "xfi:linkbase-link-roles": lambda arcs, arcrole=None: (arcs if arcrole is None else arcs.where(F.col("arcrole") == arcrole)).select("role").distinct(),
    "xfi:navigate-relationships": networks.concept_relationships,
    "xfi:concept-relationships": networks.concept_relationships,
    "xfi:concept-label": concept_labels,
    "xfi:arcrole-definition": lambda definitions, arcrole: definitions.where(F.col("arcrole") == arcrole).select("definition"),
    "xfi:role-definition": lambda definitions, role: definitions.where(F.col("role") == role).select("definition"),
    "xfi:fact-footnotes": lambda facts, notes, lang=None, role=None: facts.select("doc_id", "fact_id").join(notes.where((F.lit(lang is None) | (F.col("lang") == lang)) & (F.lit(role is None) | (F.col("role") == role))), ["doc_id", "fact_id"]),
    "xfi:relationship-from-concept": lambda relationships: relationships.select("from"),
    "xfi:relationship-to-concept": lambda relationships: relationships.select("to"),
    "xfi:relationship-attribute": _attribute("attrs"),
    "xfi:relationship-link-attribute": _attribute("link_attrs"),
    "xfi:relationship-name": lambda relationships: relationships.select("arc_name"),
    "xfi:relationship-link-name": lambda relationships: relationships.select("link_name"),
    "xfi:distinct-nonAbstract-parent-concepts": networks.concrete_parents,
    "xfi:positive-filing-indicators": _indicators(True),
    "xfi:negative-filing-indicators": _indicators(False),
    "xfi:positive-filing-indicator": _indicators(True),
    "xfi:negative-filing-indicator": _indicators(False),
    "xff:uncovered-non-dimensional-aspects": lambda evaluations, variable: [a for a in _uncovered(evaluations, variable) if a in PLAIN_ASPECTS],
    "xff:uncovered-dimensional-aspects": lambda evaluations, variable: [a for a in _uncovered(evaluations, variable) if a not in PLAIN_ASPECTS],
}


def call(name: str, *args, **named):
    """The function of that name; an unknown name is an error at once, not in a job."""
    if name in COLUMNS:
        return COLUMNS[name](*args, **named)
    if name in TABLES:
        return TABLES[name](*args, **named)
    raise KeyError(f"no function {name}")
