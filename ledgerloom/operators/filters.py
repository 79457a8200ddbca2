"""Predicates of a fact variable. Each filter is a column over wide facts, and says which aspects it covers.

A covered aspect is fixed by its filter and so takes no part in matching between variables. Filters on other
variables are join conditions: they give the name of the variable and the aspects that must agree.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aspects import period_end, period_start
from ..functions.rounding import INF, inferred_precision

ASPECTS = ("location", "concept", "entity", "period", "unit", "segment", "scenario", "dims")
TRUE = F.lit


@dataclass
class Filter:
    """A test and what it covers; ``complement`` negates the test and covers as before."""

    test: Column | None = None
    covers: frozenset = frozenset()
    complement: bool = False
    cover: bool = True
    match: tuple | None = None  # (variable, aspects) for filters that refer to another variable
    semi: DataFrame | None = None  # concepts or facts that may stay, by the columns it has
    uncovers: frozenset = frozenset()
    parts: tuple = ()  # filters that a combination is made of
    any_part: bool = False  # one of them is enough
    band: str | None = None  # the variable within whose period a fact's period lies

    def leaves(self) -> list["Filter"]:
        return [x for f in self.parts for x in f.leaves()] if self.parts else [self]

    def truth(self, leaf) -> Column:
        """The combination's truth from that of its leaves (each before its own complement)."""
        if not self.parts:
            out = leaf(self)
        else:
            out = F.lit(not self.any_part)
            for f in self.parts:
                out = (out | f.truth(leaf)) if self.any_part else (out & f.truth(leaf))
        return ~out if self.complement else out

    def column(self) -> Column:
        if any(f.semi is not None or f.match for f in self.leaves()):
            raise ValueError("a filter that needs a join has no column; give it to a variable")
        return self.truth(lambda f: F.coalesce(f.test, F.lit(False)) if f.test is not None else F.lit(True))

    def covered(self) -> frozenset:
        return self.covers if self.cover else frozenset()

    def __invert__(self) -> "Filter":
        return replace(self, complement=not self.complement)


def _make(test: Column, *covers: str) -> Filter:
    return Filter(test, frozenset(covers))


# --- concepts -------------------------------------------------------------------------------------------------


def concept_name(*names: str) -> Filter:
    return _make(F.col("concept").isin(*names), "concept")


def concept_period_type(kind: str) -> Filter:
    return _make(F.col("concept_period_type") == kind, "concept")


def concept_balance(balance: str | None) -> Filter:
    return _make(F.col("balance").isNull() if balance in (None, "none") else F.col("balance") == balance, "concept")


def concept_custom_attribute(name: str, value: str | None = None) -> Filter:
    got = F.try_element_at("attrs", F.lit(name))
    return _make(got.isNotNull() if value is None else got == value, "concept")


def concept_data_type(item_type: str, strict: bool = False) -> Filter:
    same = F.col("item_type") == item_type
    return _make(same if strict else same | F.array_contains("base_types", item_type), "concept")


def concept_substitution_group(group: str, strict: bool = False) -> Filter:
    same = F.col("subst_group") == group
    return _make(same if strict else same | F.array_contains("subst_groups", group), "concept")


def concept_relation(related: DataFrame) -> Filter:
    """Concepts on an axis, as ``networks.concept_relationships`` gives them."""
    return Filter(None, frozenset({"concept"}), semi=related.select("concept").distinct())


# --- periods --------------------------------------------------------------------------------------------------


def period_start_is(date: str) -> Filter:
    return _make((F.col("period_type") == "duration") & (F.col("start") == period_start(F.lit(date))), "period")


def period_end_is(date: str) -> Filter:
    return _make((F.col("period_type") == "duration") & (F.col("end") == period_end(F.lit(date))), "period")


def period_instant_is(date: str) -> Filter:
    return _make((F.col("period_type") == "instant") & (F.col("end") == period_end(F.lit(date))), "period")


def period_test(sql: str) -> Filter:
    return _make(F.expr(sql), "period")


def forever() -> Filter:
    return _make(F.col("period_type") == "forever", "period")


def instant_duration(variable: str, boundary: str) -> Filter:
    """Instants at the start or end of the duration of another variable: an equi-join on normalised moments."""
    return Filter(F.col("period_type") == "instant", frozenset({"period"}), match=(variable, (("end", boundary),)))


def during(variable: str) -> Filter:
    """Facts whose period lies within that of another variable's fact, ends included: an instant at a moment of it, a duration
    between its ends. A range join on blocks of days, no pair by pair comparison; not part of a combination."""
    return Filter(F.col("period_type") != "forever", frozenset({"period"}), band=variable)


# --- units and entities ---------------------------------------------------------------------------------------


def single_measure(measure: str) -> Filter:
    return _make((F.size("numerator") == 1) & (F.coalesce(F.size("denominator"), F.lit(0)) < 1) & (F.col("numerator")[0] == measure), "unit")


def general_measures(sql: str) -> Filter:
    return _make(F.col("numerator").isNotNull() & F.expr(sql), "unit")


def specific_identifier(scheme: str, value: str) -> Filter:
    return _make((F.col("scheme") == scheme) & (F.col("entity") == value), "entity")


def specific_scheme(scheme: str) -> Filter:
    return _make(F.col("scheme") == scheme, "entity")


def regexp_identifier(pattern: str) -> Filter:
    return _make(F.col("entity").rlike(pattern), "entity")


def regexp_scheme(pattern: str) -> Filter:
    return _make(F.col("scheme").rlike(pattern), "entity")


def identifier_test(sql: str) -> Filter:
    return _make(F.expr(sql), "entity")


# --- segments, scenarios and dimensions -----------------------------------------------------------------------


def segment(sql: str | None = None) -> Filter:
    return _make(F.col("non_dim").isNotNull() & (F.expr(sql) if sql else F.lit(True)), "segment")


def scenario(sql: str | None = None) -> Filter:
    return _make(F.col("scenario").isNotNull() & (F.expr(sql) if sql else F.lit(True)), "scenario")


def explicit_dimension(dimension: str, *members: str, network: DataFrame | None = None) -> Filter:
    """The dimension is there; its member is one of these, or one of a network's (a column ``concept`` or ``member``)."""
    own = F.try_element_at("dims", F.lit(dimension))
    test = own.isin(*members) if members else own.isNotNull()
    semi = None
    if network is not None:
        name = "member" if "member" in network.columns else "concept"
        semi = network.select(F.col(name).alias(f"member of {dimension}")).distinct()
    return Filter(test, frozenset({dimension}), semi=semi)


def typed_dimension(dimension: str, sql: str | None = None) -> Filter:
    """The typed dimension is there; ``sql`` may test its content as ``member``."""
    own = F.try_element_at("typed_dims", F.lit(dimension))
    test = own.isNotNull() & (F.expr(sql.replace("member", f"try_element_at(typed_dims, '{dimension}')")) if sql else F.lit(True))
    return _make(test, dimension)


# --- facts ----------------------------------------------------------------------------------------------------


def general(sql: str) -> Filter:
    return _make(F.expr(sql))


def nilled() -> Filter:
    return _make(F.coalesce(F.col("is_nil"), F.lit(False)))


def precision_at_least(minimum: int | str) -> Filter:
    got = inferred_precision(F.col("num"), F.col("decimals"), F.col("precision"))
    enough = (got == INF) if minimum == INF else (got == INF) | (F.when(got != INF, got).cast("int") >= int(minimum))
    fraction = F.col("item_type") == "fractionItemType"
    return _make(fraction | (F.col("num").isNotNull() & ~F.coalesce("is_nil", F.lit(False)) & enough))


def parent_filter(facts: DataFrame, *names: str) -> Filter:
    """Facts whose tuple has one of these names."""
    kids = facts.where(F.col("concept").isin(*names)).select("doc_id", F.col("fact_id").alias("parent_id"))
    return Filter(None, frozenset({"location"}), semi=kids)


def ancestor_filter(facts: DataFrame, closure: DataFrame, *names: str) -> Filter:
    """Facts with such a name among all the tuples around them; ``closure`` from ``networks.ancestors_of_facts``."""
    named = facts.where(F.col("concept").isin(*names)).select("doc_id", F.col("fact_id").alias("ancestor_id"))
    return Filter(None, frozenset({"location"}), semi=closure.join(named, ["doc_id", "ancestor_id"], "left_semi").select("doc_id", "fact_id").distinct())


def sibling_filter(variable: str) -> Filter:
    return Filter(None, frozenset({"location"}), match=(variable, (("parent_id", "parent_id"),)))


def location_filter(variable: str, up: int = 1) -> Filter:
    """A fact in the tuple ``up`` levels above the variable's fact; one level is its siblings' place. For more levels the
    facts need the columns of ``networks.with_places``."""
    if up < 1:
        raise ValueError("a place is one level up or more")
    return sibling_filter(variable) if up == 1 else Filter(None, frozenset({"location"}), match=(variable, (("parent_id", f"up_{up}"),)))


# --- combinations and matches ---------------------------------------------------------------------------------


def and_filter(*filters: Filter) -> Filter:
    """All filters, whatever they need: columns, joins, or another variable. None at all lets nothing through."""
    return _combined(filters, False)


def or_filter(*filters: Filter) -> Filter:
    """At least one of the filters."""
    return _combined(filters, True)


def _combined(filters: tuple[Filter, ...], any_part: bool) -> Filter:
    covers = frozenset().union(*[f.covered() for f in filters])
    return Filter(covers=covers, parts=filters, any_part=any_part) if filters else Filter(F.lit(False), covers)


def aspect_cover(*aspects: str, exclude: tuple = ()) -> Filter:
    """No test; adds aspects to the covered ones, or takes some away."""
    named = set(ASPECTS) if "all" in aspects else set(aspects)
    return Filter(None, frozenset(named - set(exclude)), uncovers=frozenset(exclude))


_MATCHES = {
    "concept": ("concept",), "location": ("parent_id",), "unit": ("unit_key",), "entity": ("entity_key",), "period": ("period_key",),
    "segment": ("non_dim", "dims_key"), "scenario": ("scenario",), "non_xdt_segment": ("non_dim",), "non_xdt_scenario": ("scenario",),
}


def match(aspect: str, variable: str) -> Filter:
    """The same concept, place, unit, entity, period, segment or scenario as another variable's fact."""
    cols = tuple((c, c) for c in _MATCHES[aspect])
    return Filter(None, frozenset({aspect.removeprefix("non_xdt_")}), match=(variable, cols))


def match_dimension(dimension: str, variable: str) -> Filter:
    return Filter(None, frozenset({dimension}), match=(variable, ((f"dim:{dimension}", f"dim:{dimension}"),)))


def relative_filter(variable: str) -> Filter:
    """Every aspect that no other filter covers agrees with the variable's fact."""
    return Filter(None, match=(variable, "uncovered"))
