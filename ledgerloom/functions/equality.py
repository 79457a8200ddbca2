"""Equality of facts, contexts, units and values, as column expressions over two sides.

Sides are column prefixes: ``s_equal("a", "b")`` compares ``a_period_key`` with ``b_period_key`` and so on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rounding import inferred_decimals, presented


def _both(a: str, b: str, name: str) -> Column:
    return F.col(f"{a}_{name}").eqNullSafe(F.col(f"{b}_{name}"))


#: Types whose values are compared as they are written.
TEXTUAL = ("stringItemType", "normalizedStringItemType", "tokenItemType", "languageItemType", "NameItemType", "NCNameItemType", "anyURIItemType", "QNameItemType", "string", "normalizedString", "token", "anyURI", "QName")


def _exact(c: Column) -> Column:
    """A number's digits without leading and trailing zeros, of any length; NULL for other texts."""
    t, zero = F.trim(c), F.lit("0")
    digits = F.ltrim(t, F.lit("+-"))
    whole = F.ltrim(F.substring_index(digits, ".", 1), zero)
    part = F.when(digits.contains("."), F.rtrim(F.substring_index(digits, ".", -1), zero)).otherwise(F.lit(""))
    sign = F.when(t.startswith("-") & (F.length(F.concat(whole, part)) > 0), F.lit("-")).otherwise(F.lit(""))
    return F.when(t.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"), F.concat(sign, whole, F.lit("."), part))


def x_equal(a: Column, b: Column, a_type: Column | None = None, b_type: Column | None = None) -> Column:
    """Typed values: numbers by their digits, to any length; booleans as booleans, else strings; missing equals missing only.

    Where declared types are given and one of them is textual, both are compared as written. Most numbers are settled without their
    digits: those of different doubles differ, and up to 15 characters are told apart by their doubles.
    """
    na, nb, ea, eb = a.try_cast("double"), b.try_cast("double"), _exact(a), _exact(b)
    flag = lambda c: F.when(c.isin("true", "1"), F.lit(True)).when(c.isin("false", "0"), F.lit(False))
    inf = lambda c: F.upper(c).isin("INF", "-INF")
    textual = lambda t: F.coalesce(t.isin(*TEXTUAL), F.lit(False)) if t is not None else F.lit(False)
    short = (F.length(a) <= 15) & (F.length(b) <= 15)
    digits = F.when(na != nb, F.lit(False)).when(short, F.lit(True)).otherwise(F.coalesce(ea == eb, F.lit(True)))
    return (
        F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull())
        .when(textual(a_type) | textual(b_type), a == b)
        .when((F.abs(na) < float("inf")) & (F.abs(nb) < float("inf")), digits)
        .when(inf(a) | inf(b), F.upper(a) == F.upper(b))
        .when(ea.isNotNull() & eb.isNotNull(), ea == eb)
        .when(na.isNotNull() & nb.isNotNull(), na == nb)
        .when(flag(a).isNotNull() & flag(b).isNotNull(), flag(a) == flag(b))
        .otherwise(a == b)
    )


def entity_equal(a: str, b: str) -> Column:
    return _both(a, b, "scheme") & _both(a, b, "entity")


def period_equal(a: str, b: str) -> Column:
    return _both(a, b, "period_key")


def start_equal(a: Column, b: Column) -> Column:
    """Moments compared after normalisation, so a day's end is the next day's start."""
    return a.cast("timestamp_ntz").eqNullSafe(b.cast("timestamp_ntz"))


end_equal = start_equal


def segment_equal(a: str, b: str, ordinal: bool = False) -> Column:
    """Dimensions in any order; with ``ordinal`` the remaining content must agree in order as well."""
    dims = _both(a, b, "dims_key")
    return dims & _both(a, b, "non_dim") if ordinal else dims


def s_equal(a: str, b: str) -> Column:
    """Contexts: entity, period, dimensions and other content."""
    return entity_equal(a, b) & period_equal(a, b) & segment_equal(a, b, True) & _both(a, b, "scenario")


def c_equal(a: str, b: str) -> Column:
    return _both(a, b, "context_ref") | s_equal(a, b)


def u_equal(a: str, b: str) -> Column:
    return _both(a, b, "unit_key")


def p_equal(a: str, b: str) -> Column:
    return _both(a, b, "parent_id")


def cu_equal(a: str, b: str) -> Column:
    return c_equal(a, b) & u_equal(a, b)


def pc_equal(a: str, b: str) -> Column:
    return p_equal(a, b) & c_equal(a, b)


def pcu_equal(a: str, b: str) -> Column:
    return p_equal(a, b) & cu_equal(a, b)


def v_equal(a: str, b: str) -> Column:
    """Values of comparable facts: numbers rounded to the coarser of both decimals, others as text, nils as nils."""
    da, db = (inferred_decimals(F.col(f"{p}_num"), F.col(f"{p}_decimals"), F.col(f"{p}_precision")) for p in (a, b))
    coarse = F.when(da == "INF", db).when(db == "INF", da).otherwise(F.least(da.cast("int"), db.cast("int")).cast("string"))
    numbers = presented(F.col(f"{a}_num"), coarse) == presented(F.col(f"{b}_num"), coarse)
    text = F.trim(F.col(f"{a}_value")).eqNullSafe(F.trim(F.col(f"{b}_value")))
    nil = F.coalesce(F.col(f"{a}_is_nil"), F.lit(False)) | F.coalesce(F.col(f"{b}_is_nil"), F.lit(False))
    same = F.when(nil, _both(a, b, "is_nil")).when(F.col(f"{a}_num").isNotNull() & F.col(f"{b}_num").isNotNull(), numbers).otherwise(text)
    return cu_equal(a, b) & F.coalesce(same, F.lit(False))


def duplicate_item(a: str, b: str) -> Column:
    """Same concept, tuple, unit and context, but another fact."""
    return ~_both(a, b, "fact_id") & _both(a, b, "concept") & pcu_equal(a, b)


def set_equal(a: Column, b: Column) -> Column:
    """Arrays that hold the same members."""
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def nodes_correspond(a: Column, b: Column) -> Column:
    """Content that agrees but for white space between its parts."""
    plain = lambda c: F.regexp_replace(F.trim(c), r">\s+<", "><")
    return plain(a).eqNullSafe(plain(b))


# --- qualified names --------------------------------------------------------------------------------------------


def clark(prefixed: Column, namespaces: dict[str, str]) -> Column:
    """{namespace}local of a prefixed name; a name without prefix takes the default namespace."""
    table = F.create_map(*[F.lit(x) for kv in {"": "", **namespaces}.items() for x in kv])
    prefix = F.when(prefixed.contains(":"), F.split_part(prefixed, F.lit(":"), F.lit(1))).otherwise(F.lit(""))
    ns = F.try_element_at(table, prefix)
    local = F.regexp_extract(prefixed, r"([^:]*)$", 1)
    return F.when(ns.isNotNull(), F.concat(F.lit("{"), ns, F.lit("}"), local))


def local_name(name: Column) -> Column:
    return F.regexp_extract(name, r"([^:}]*)$", 1)


def namespace_of(clark_name: Column) -> Column:
    return F.regexp_extract(clark_name, r"^\{([^}]*)\}", 1)


def qname_compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by Clark name, from which all six comparisons follow."""
    return F.when(a < b, -1).when(a == b, 0).when(a > b, 1)
