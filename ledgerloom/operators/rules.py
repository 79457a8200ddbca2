"""Rules over facts: variables joined on their aspects, assertions and derived facts.

A variable set compiles to one logical plan. Each fact variable is a filtered projection of the wide facts; each
further one joins the earlier ones on the aspects that neither side covers, null-safely and as equi-join keys, so
Spark may hash, sort or broadcast. A sequence is a group by the uncovered aspects; a fallback is an outer join.
Expressions are Spark SQL over columns named ``variable``; other columns of a fact are ``variable__column``.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aspects import dims_key
from ..functions.rounding import inferred_decimals, presented
from . import intervals
from .filters import ASPECTS, Filter
from .networks import dependency_order
from .validation import hypercubes

KEYS = {"location": "parent_id", "concept": "concept", "entity": "entity_key", "period": "period_key", "unit": "unit_key", "segment": "non_dim", "scenario": "scenario"}
CARRIED = ["fact_id", "concept", "value", "num", "is_nil", "decimals", "precision", "context_ref", "unit_ref", "parent_id", "scheme", "entity", "entity_key", "period_type", "start", "end", "period_key", "unit_key", "numerator", "denominator", "non_dim", "scenario", "dims", "typed_dims", "dims_key", "ordinal"]


@dataclass
class FactVariable:
    name: str
    filters: list[Filter] = field(default_factory=list)
    bind_as_sequence: bool = False
    fallback: str | None = None
    matches: bool = False
    nils: bool = False
    #: A sequence's sums, counts and so on (sum, count, avg, min, max, low, high) instead of its items: partial sums, no arrays.
    aggregates: tuple[str, ...] = ()
    #: The name of another set of facts (``evaluate``'s ``instances``) to bind from, whatever documents these are.
    instance: str | None = None

    def covered(self) -> set[str]:
        out: set[str] = set()
        for f in self.filters:
            out = (out | f.covered()) - f.uncovers
        return out


@dataclass
class GeneralVariable:
    """An expression over earlier variables; a sequence unless it is spread into one row an item."""

    name: str
    select: str
    bind_as_sequence: bool = True


@dataclass
class Parameter:
    name: str
    select: str


@dataclass
class Function:
    """A custom function: inputs, steps in order, and an output expression. Compiled into the rule, never run by row."""

    name: str
    inputs: list[str]
    output: str
    steps: list[tuple[str, str]] = field(default_factory=list)

    def expand(self, args: list[str]) -> str:
        if len(args) != len(self.inputs):
            raise ValueError(f"{self.name} takes {len(self.inputs)} arguments, not {len(args)}")
        known = dict(zip(self.inputs, args))
        for name, expression in self.steps:
            known[name] = _replace(expression, known)
        return _replace(self.output, known)


@dataclass
class VariableSet:
    variables: list[FactVariable | GeneralVariable]
    parameters: list[Parameter] = field(default_factory=list)
    preconditions: list[str] = field(default_factory=list)
    group_filters: list[Filter] = field(default_factory=list)
    functions: list[Function] = field(default_factory=list)
    implicit_filtering: bool = True
    dimensional: bool = True
    dimensions: list[str] = field(default_factory=list)  # dimensions that filters treat one by one
    equalities: dict[str, str] = field(default_factory=dict)  # a dimension's own test of two members, SQL over a and b
    exact: bool = False  # numbers stay decimals of 38 digits, six of them after the point, where else they are doubles
    unique_facts: bool = False  # the caller's facts have unique ids, so that equal evaluations can't come up


@dataclass
class Scope:
    """The evaluations of another rule, whose variables a rule sees as if they were bound before its own: these meet them on
    all aspects that both leave uncovered."""

    rule: VariableSet
    evaluations: DataFrame

    def bound(self, rule: VariableSet) -> tuple[DataFrame, dict[str, str]]:
        """The evaluations with their keys worked out anew for the dimensions that either rule names, and the first variable
        that leaves each aspect uncovered."""
        names = {v.name for v in self.rule.variables}
        if clash := names & {v.name for v in rule.variables}:
            raise ValueError(f"the scope has variables of the same name: {sorted(clash)}")
        named, df, uncovered = _dimensions(self.rule), self.evaluations, {}
        every = sorted({*named, *rule.dimensions})
        empty = F.create_map().cast("map<string,string>")
        for v in self.rule.variables:
            if isinstance(v, GeneralVariable):
                continue
            covered = v.covered() | {a for f in self.rule.group_filters for a in f.covered()}
            if "dims" not in covered and every != named:
                if v.bind_as_sequence:
                    raise ValueError(f"the sequence {v.name} of the scope is not grouped by {sorted(set(every) - set(named))}: name these in its rule's dimensions")
                dims, typed = (F.coalesce(F.col(f"{v.name}__{c}"), empty) for c in ("dims", "typed_dims"))
                df = df.withColumn(f"{v.name}__key_dims", dims_key(dims, typed, every))
                for d in every:
                    if d not in covered:
                        df = df.withColumn(f"{v.name}__key_{d}", F.coalesce(F.try_element_at(dims, F.lit(d)), F.try_element_at(typed, F.lit(d))))
            for c in df.columns:
                if c.startswith(f"{v.name}__key_"):
                    uncovered.setdefault(c.removeprefix(f"{v.name}__key_"), v.name)
        return df, uncovered


def _dimensions(rule: VariableSet) -> list[str]:
    """The dimensions that a rule treats one by one."""
    named = {d for v in rule.variables if isinstance(v, FactVariable) for d in v.covered() if d not in ASPECTS}
    return sorted(set(rule.dimensions) | named | set(rule.equalities))


def _pieces(expression: str) -> list[tuple[str, bool]]:
    """An expression cut into text and string literals (true)."""
    return [(x, x[0] in "'\"") for x in re.split(r"""('(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*")""", expression) if x]


def _replace(expression: str, names: dict[str, str]) -> str:
    def one(text: str) -> str:
        return re.sub(r"\$([A-Za-z_]\w*)", lambda m: f"({names[m[1]]})" if m[1] in names else m[0], text)

    return "".join(x if quoted else one(x) for x, quoted in _pieces(expression))


def _call(expression: str, name: str) -> tuple[int, int, list[str]] | None:
    """The first call of a function outside string literals: where it starts and stops, and its arguments."""
    quoted, at = [], 0
    for x, is_text in _pieces(expression):
        quoted += [is_text] * len(x)
    for m in re.finditer(rf"(?<![\w.]){re.escape(name)}\(", expression):
        if quoted[m.start()]:
            continue
        depth, args, at = 1, [], m.end()
        for i in range(m.end(), len(expression)):
            if quoted[i]:
                continue
            depth += (expression[i] in "([{") - (expression[i] in ")]}")
            if depth == 0 or (depth == 1 and expression[i] == ","):
                args.append(expression[at:i].strip())
                at = i + 1
            if depth == 0:
                return m.start(), i + 1, [a for a in args if a] if len(args) == 1 else args
        raise ValueError(f"{name} has no closing bracket: {expression}")
    return None


def compile_expression(expression: str, rule: VariableSet, parameters: dict[str, str]) -> str:
    """$variables and $parameters to columns and constants, custom functions to what they compute, to any depth of calls."""
    out = _replace(expression, parameters)
    for f in rule.functions:
        while found := _call(out, f.name):
            start, stop, args = found
            out = out[:start] + f"({f.expand(args)})" + out[stop:]
    column = lambda text: re.sub(r"\$([A-Za-z_]\w*)", r"`\1`", text)
    return "".join(x if quoted else column(x) for x, quoted in _pieces(out))


def resolve_parameters(rule: VariableSet, given: dict[str, str] | None = None) -> dict[str, str]:
    """Constant expressions in order of their dependencies; values given from outside come first."""
    by_name = {p.name: p.select for p in rule.parameters} | (given or {})
    needs = {n: {x for x in re.findall(r"\$(\w+)", e) if x in by_name} for n, e in by_name.items()}
    out: dict[str, str] = {}
    for n in dependency_order(needs):
        out[n] = _replace(by_name[n], out)
    return out


def _joins(f: Filter) -> bool:
    if f.parts and any(x.band for x in f.leaves()):
        raise ValueError("a filter on another variable's period can't be part of a combination")
    return any(x.match for x in f.leaves())


def _marked(df: DataFrame, f: Filter, marks: dict[int, str]) -> DataFrame:
    """``df`` with a column for each leaf that asks whether a row is in another table."""
    for leaf in f.leaves():
        if leaf.semi is not None:
            special = [c for c in leaf.semi.columns if c.startswith("member of ")]
            for c in special:
                df = df.withColumn(c, F.try_element_at("dims", F.lit(c.removeprefix("member of "))))
            name = f"test_{len(marks)}"
            df = df.join(leaf.semi.distinct().withColumn(name, F.lit(True)), leaf.semi.columns, "left").drop(*special)
            marks[id(leaf)] = name
    return df


def _leaf(marks: dict[int, str]):
    def test(f: Filter) -> Column:
        own = F.coalesce(f.test, F.lit(False)) if f.test is not None else F.lit(True)
        return own & F.col(marks[id(f)]).isNotNull() if f.semi is not None else own

    return test


def _filtered(wide: DataFrame, v: FactVariable, rule: VariableSet) -> DataFrame:
    """The facts that pass a variable's own filters. Of combinations with a filter on another variable the tests are kept
    as columns test_0, ... for the join."""
    df = wide if v.nils else wide.where("not coalesce(is_nil, false)")
    df = df.where("context_ref is not null")
    for i, f in enumerate([*rule.group_filters, *v.filters]):
        marks: dict[int, str] = {}
        if not f.parts and f.semi is not None and not (f.complement and f.test is not None):
            special = [c for c in f.semi.columns if c.startswith("member of ")]
            for c in special:
                df = df.withColumn(c, F.try_element_at("dims", F.lit(c.removeprefix("member of "))))
            df = df.join(f.semi, f.semi.columns, "left_anti" if f.complement else "left_semi").drop(*special)
            df = df if f.test is None else df.where(F.coalesce(f.test, F.lit(False)))
        elif f.parts and _joins(f):
            if v.bind_as_sequence:
                raise ValueError("a combination with a filter on another variable can't limit a sequence")
            df = _marked(df, f, marks)
            for n, leaf in enumerate(x for x in f.leaves() if not x.match):
                df = df.withColumn(f"leaf_{i}_{n}", _leaf(marks)(leaf))
            df = df.drop(*marks.values())
        elif f.test is not None or f.parts or f.semi is not None:
            df = _marked(df, f, marks)
            df = df.where(f.truth(_leaf(marks))).drop(*marks.values())
    return df


def _keys(covered: set[str], rule: VariableSet) -> dict[str, Column]:
    """Uncovered aspects of a variable as key columns."""
    out = {a: F.col(c) for a, c in KEYS.items() if a not in covered}
    if "dims" not in covered:
        named = [d for d in covered if d not in ASPECTS]
        out["dims"] = F.col("dims_key") if not named and not rule.dimensions else dims_key(F.coalesce("dims", F.create_map().cast("map<string,string>")), F.coalesce("typed_dims", F.create_map().cast("map<string,string>")), sorted(set(named) | set(rule.dimensions)))
        for d in rule.dimensions:
            if d not in covered:
                out[d] = F.coalesce(F.try_element_at("dims", F.lit(d)), F.try_element_at("typed_dims", F.lit(d)))
    return out


def _match_column(side: str, col: str) -> Column:
    """Column of a bound variable, or of the candidate where the side is empty."""
    prefix = f"{side}__" if side else ""
    if col.startswith("dim:"):
        d = F.lit(col.removeprefix("dim:"))
        return F.coalesce(F.try_element_at(f"{prefix}dims", d), F.try_element_at(f"{prefix}typed_dims", d))
    return F.col(f"{prefix}{col}")


def evaluate(rule: VariableSet, wide: DataFrame, parameters: dict[str, str] | None = None, scope: Scope | None = None, instances: dict[str, DataFrame] | None = None) -> DataFrame:
    """All bindings of a rule: one row an evaluation. ``scope`` feeds the evaluations of another rule, ``instances`` names
    other facts that variables may bind from."""
    known = resolve_parameters(rule, parameters)
    named = _dimensions(rule)
    rule = VariableSet(**{**rule.__dict__, "dimensions": sorted({*named, *(_dimensions(scope.rule) if scope else [])})})
    bound, uncovered = scope.bound(rule) if scope else (None, {})
    fallbacks = []
    for v in rule.variables:
        if isinstance(v, GeneralVariable):
            value = F.expr(compile_expression(v.select, rule, known))
            bound = bound.withColumn(v.name, value if v.bind_as_sequence else F.explode(value))
            continue
        group = {a for f in rule.group_filters for a in f.covered()}
        covered = v.covered() | group
        keys = _keys(covered, rule)
        df = _filtered(wide if v.instance is None else instances[v.instance], v, rule)
        key_cols = {f"{v.name}__key_{a}": c for a, c in keys.items()}
        if v.bind_as_sequence:
            df = _sequence(df, v, key_cols, rule.exact)
        else:
            shown = _number(rule.exact)
            df = df.select("doc_id", *[c.alias(n) for n, c in key_cols.items()], shown.alias(v.name), *[F.col(c).alias(f"{v.name}__{c}") for c in [*CARRIED, *[c for c in df.columns if c.startswith(("leaf_", "up_"))]]])
        if v.fallback is not None:
            fallbacks.append(v)
        bound = df if bound is None else _join(bound, df, v, uncovered, rule)
        for a in keys:
            uncovered.setdefault(a, v.name)
        if v.fallback is not None:
            filler = F.expr(compile_expression(v.fallback, rule, known))
            bound = bound.withColumn(f"{v.name}__fallback", F.col(v.name).isNull()).withColumn(v.name, F.coalesce(F.col(v.name), filler))
    if fallbacks and len(fallbacks) == len([v for v in rule.variables if isinstance(v, FactVariable)]):
        all_missing = F.lit(True)
        for v in fallbacks:
            all_missing = all_missing & F.col(f"{v.name}__fallback")
        bound = bound.where(~all_missing)
    for p in rule.preconditions:
        bound = bound.where(F.coalesce(F.expr(compile_expression(p, rule, known)).cast("boolean"), F.lit(False)))
    return bound.drop(*[c for c in bound.columns if c.startswith(("packed_hash_", "packed_keys_"))])


def _number(exact: bool) -> Column:
    return F.col("num").cast("decimal(38,6)" if exact else "double")


def half_unit() -> Column:
    """Half a unit of a fact's last reported place, which its true value may be off by; 0 where it is exact."""
    d = inferred_decimals(F.col("num"), F.col("decimals"), F.col("precision"))
    return F.when(d.isNull() | (d == "INF"), F.lit("0")).otherwise(F.concat(F.lit("5e"), (-d.try_cast("int") - 1).cast("string"))).try_cast("decimal(38,7)")


def _sequence(df: DataFrame, v: FactVariable, key_cols: dict[str, Column], exact: bool = False) -> DataFrame:
    """One row a group of equal uncovered aspects, its values in document order, or its aggregates with their number.

    Sums of exact numbers are exact; ``low`` and ``high`` bound the sum of the true values, by the facts' decimals."""
    df = df.withColumns({**key_cols})
    if not v.matches:
        df = df.dropDuplicates(["doc_id", *key_cols, "concept", "entity_key", "period_key", "unit_key", "dims_key", "parent_id"])
    if v.aggregates:
        number = _number(exact)
        bound = lambda sign: lambda n: F.sum((F.col("num") + sign * half_unit()).cast("decimal(38,7)" if exact else "double"))
        made = {"sum": F.sum, "count": F.count, "avg": F.avg, "min": F.min, "max": F.max, "low": bound(-1), "high": bound(1)}
        return df.groupBy("doc_id", *key_cols).agg(F.count(F.lit(1)).alias(v.name), *[made[a](number).alias(f"{v.name}__{a}") for a in v.aggregates])
    items = F.array_sort(F.collect_list(F.struct("ordinal", "fact_id", _number(exact).alias("num"))))
    out = df.groupBy("doc_id", *key_cols).agg(F.transform(items, lambda x: x["num"]).alias(v.name), F.transform(items, lambda x: x["fact_id"]).alias(f"{v.name}__fact_ids"), *[F.min(c).alias(f"{v.name}__{c}") for c in CARRIED if c not in ("dims", "typed_dims", "numerator", "denominator", "num")])
    return out


def _join(bound: DataFrame, df: DataFrame, v: FactVariable, uncovered: dict[str, str], rule: VariableSet) -> DataFrame:
    """The candidate's rows with those bound so far, by the aspects both leave uncovered and by explicit matches."""
    right = df.withColumnRenamed("doc_id", f"{v.name}__doc")
    on = F.col("doc_id") == F.col(f"{v.name}__doc") if v.instance is None else F.lit(True)
    own = [c.removeprefix(f"{v.name}__key_") for c in right.columns if c.startswith(f"{v.name}__key_")]
    explicit = [f for f in v.filters if f.match]
    pairs: list[tuple[Column, Column]] = [] if v.instance is not None else [(F.col("doc_id"), F.col(f"{v.name}__doc"))]
    relative = next((f.match[0] for f in explicit if f.match[1] == "uncovered"), None)
    same: list[tuple[str, Column, Column]] = []  # what must be alike, null-safely: a name, the bound side, the candidate's
    if rule.implicit_filtering or relative:
        for a in own:
            first = relative or uncovered.get(a)
            if first and f"{first}__key_{a}" in bound.columns:
                mine, theirs = f"{v.name}__key_{a}", f"{first}__key_{a}"
                if a in rule.equalities:
                    made = _own_keys(rule.equalities[a], theirs, mine)
                    if made is None:
                        on = on & _own_equality(rule.equalities[a], theirs, mine)
                    else:
                        same.append((f"{theirs} by {rule.equalities[a]}", *made))
                else:
                    same.append((theirs, F.col(theirs), F.col(mine)))
                    pairs.append((F.col(theirs), F.col(mine)))
    for f in explicit:
        other, cols = f.match
        for own_col, other_col in [] if cols == "uncovered" else cols:
            ours, others = _match_column(v.name, own_col), _match_column(other, other_col)
            if f.complement:
                on = on & ~ours.eqNullSafe(others)
            else:
                same.append((f"{other}__{other_col}", others, ours))
    bands = [f.band for f in v.filters if f.band]
    if bands:
        for _, theirs, mine in same:
            on = on & mine.eqNullSafe(theirs)
    elif same:
        bound, right, on = _packed(bound, right, same, v, on)
    for i, f in enumerate([*rule.group_filters, *v.filters]):
        if f.parts and _joins(f):
            on = on & f.truth(_joined_leaf(f, i, v))
    if bands:
        if v.fallback is not None or v.bind_as_sequence or any(f.complement for f in v.filters if f.band):
            raise ValueError("a filter on another variable's period takes no fallback, sequence or complement")
        out = _within(bound, right, v, bands[0], pairs).where(on)
        for other in bands[1:]:
            out = out.where(_lies_within(v.name, other))
    else:
        out = bound.join(right, on, "left" if v.fallback is not None else "inner")
    return out.drop(*([f"{v.name}__doc"] if v.instance is None else []), *[c for c in out.columns if c.startswith((f"{v.name}__leaf_", f"{v.name}__packed_"))])


def _packed(bound: DataFrame, right: DataFrame, same: list[tuple[str, Column, Column]], v: FactVariable, on: Column) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides with their keys as one column each and its hash, and the join's condition.

    Keys that are columns are worked out once a row, where a sort would work out expressions at each comparison; as the hash comes
    first, sorts hardly ever compare the keys. The bound side's columns stay for later variables with the same keys, whose joins
    then find it dealt out already."""
    alone = v.instance is not None  # its documents aren't those bound
    name = hashlib.md5("\x1f".join([str(alone), *[n for n, _, _ in same]]).encode()).hexdigest()[:16]
    hashes, keys = f"packed_hash_{name}", f"packed_keys_{name}"
    fields = lambda side: F.struct(*[x[side].alias(f"k{i}") for i, x in enumerate(same)])
    if keys not in bound.columns:
        bound = bound.withColumn(keys, fields(1))
        bound = bound.withColumn(hashes, F.xxhash64(*([] if alone else ["doc_id"]), *_hashable(bound, keys)))
    mine, own = f"{v.name}__packed_hash", f"{v.name}__packed_keys"
    right = right.withColumn(own, fields(2))
    right = right.withColumn(mine, F.xxhash64(*([] if alone else [f"{v.name}__doc"]), *_hashable(right, own)))
    return bound, right, (F.col(hashes) == F.col(mine)) & on & (F.col(keys) == F.col(own))


def _hashable(df: DataFrame, keys: str) -> list[Column]:
    """The keys whose equal values have equal hashes: texts compared by a collation may not."""
    return [F.col(keys)[x.name] for x in df.schema[keys].dataType.fields if "collate" not in x.dataType.simpleString()]


def _lies_within(name: str, other: str) -> Column:
    first = F.coalesce(F.col(f"{name}__start"), F.col(f"{name}__end"))
    begins, ends = F.coalesce(F.col(f"{other}__start"), F.col(f"{other}__end")), F.col(f"{other}__end")
    return (begins.isNull() | (first >= begins)) & (ends.isNull() | (F.col(f"{name}__end") <= ends))


def _within(bound: DataFrame, right: DataFrame, v: FactVariable, other: str, pairs: list[tuple[Column, Column]]) -> DataFrame:
    """Rows bound so far with the candidates whose period ends within another variable's: points meet intervals on blocks of days
    and on the keys that both sides have."""
    key = lambda c: F.coalesce(c.cast("string"), F.lit("\x00"))
    day = lambda c: F.unix_date(c.cast("date")).cast("long")
    names = [f"_key_{i}" for i in range(len(pairs))]
    left = bound.withColumns({n: key(a) for n, (a, _) in zip(names, pairs)} | {"_from": day(F.coalesce(f"{other}__start", f"{other}__end")), "_to": day(F.col(f"{other}__end"))})
    points = right.withColumns({n: key(b) for n, (_, b) in zip(names, pairs)} | {"_at": day(F.col(f"{v.name}__end"))})
    return intervals.hold(points, left, "_at", "_from", "_to", names).where(_lies_within(v.name, other)).drop("_at", "_from", "_to", *names)


def _of_members(test: str, a: str, b: str) -> str:
    """A test over ``a`` and ``b`` with these names in place of the two, literals left alone."""
    one = lambda text: re.sub(r"\b([ab])\b", lambda m: a if m[1] == "a" else b, text)
    return "".join(x if quoted else one(x) for x, quoted in _pieces(test))


def _normal_form(test: str) -> str | None:
    """The left side of a test that asks whether the same is made of both members, as lower(a) = lower(b) does."""
    sides = [i for x, quoted, at in _placed(test) if not quoted for i in (at + m.start() for m in re.finditer(r"(?<![<>!=])=(?![=>])", x))]
    if len(sides) != 1 or any(re.search(r"(?i)\b(and|or|not|case|in|is|like|rlike|between)\b|[<>!]", x) for x, quoted in _pieces(test) if not quoted):
        return None
    left, right = test[: sides[0]].strip(), test[sides[0] + 1 :].strip()
    uses = {m for x, quoted in _pieces(left) if not quoted for m in re.findall(r"\b[ab]\b", x)}
    return left if len(uses) == 1 and _of_members(left, "b", "a") == right else None


def _placed(expression: str) -> list[tuple[str, bool, int]]:
    out, at = [], 0
    for x, quoted in _pieces(expression):
        out.append((x, quoted, at))
        at += len(x)
    return out


def _own_equality(test: str, a: str, b: str) -> Column:
    """A test that a rule gives for two members of a dimension; both may be missing, one may not."""
    both_missing, any_missing = F.col(a).isNull() & F.col(b).isNull(), F.col(a).isNull() | F.col(b).isNull()
    return F.when(any_missing, both_missing).otherwise(F.coalesce(F.expr(_of_members(test, f"`{a}`", f"`{b}`")), F.lit(False)))


def _own_keys(test: str, a: str, b: str) -> tuple[Column, Column] | None:
    """A test that compares the same expression of both members as an equality of keys, so the join stays an equi-join; members
    for which it is null equal none. None for other tests."""
    form = _normal_form(test)
    if form is None:
        return None

    def key(own: str, side: str) -> Column:
        made = F.expr(_of_members(form, f"`{own}`", f"`{own}`"))
        state = F.when(F.col(own).isNull(), F.lit("missing")).when(made.isNull(), F.lit(side)).otherwise(F.lit("known"))
        return F.struct(state.alias("state"), made.alias("value"))

    return key(a, "unknown on the left"), key(b, "unknown on the right")


def _joined_leaf(f: Filter, number: int, v: FactVariable):
    """A leaf of a combination in a join: a kept test, or equality with another variable."""
    plain = [id(x) for x in f.leaves() if not x.match]

    def test(x: Filter) -> Column:
        if not x.match:
            return F.col(f"{v.name}__leaf_{number}_{plain.index(id(x))}")
        other, cols = x.match
        if cols == "uncovered":
            raise ValueError("a relative filter can't be part of a combination")
        same = F.lit(True)
        for own_col, other_col in cols:
            same = same & _match_column(v.name, own_col).eqNullSafe(_match_column(other, other_col))
        return same

    return test


def not_used(facts: DataFrame, evaluations: DataFrame, variable: str) -> DataFrame:
    """Facts that no earlier evaluation has bound."""
    used = evaluations.select("doc_id", F.col(f"{variable}__fact_id").alias("fact_id")).where("fact_id is not null").distinct()
    return facts.join(used, ["doc_id", "fact_id"], "left_anti")


def distinct_evaluations(evaluations: DataFrame, rule: VariableSet) -> DataFrame:
    """Evaluations with the same facts count once; no shuffle where the rule says that facts are unique and nothing is spread."""
    spread = any(isinstance(v, GeneralVariable) and not v.bind_as_sequence for v in rule.variables)
    if rule.unique_facts and not spread:
        return evaluations
    return evaluations.dropDuplicates(["doc_id", *[c for c in evaluations.columns if c.endswith(("__fact_id", "__fact_ids"))]])  # of a scope's variables too


# --- assertions -----------------------------------------------------------------------------------------------


@dataclass
class ValueAssertion:
    id: str
    rule: VariableSet
    test: str
    satisfied_message: str | None = None
    unsatisfied_message: str | None = None
    severity: str = "error"

    def run(self, wide: DataFrame, parameters: dict[str, str] | None = None, scope: Scope | None = None) -> DataFrame:
        """One row a distinct evaluation with its outcome and message."""
        got = distinct_evaluations(evaluate(self.rule, wide, parameters, scope), self.rule)
        known = resolve_parameters(self.rule, parameters)
        ok = F.coalesce(F.expr(compile_expression(self.test, self.rule, known)).cast("boolean"), F.lit(False))
        text = F.when(ok, message(self.satisfied_message, self.rule, known)).otherwise(message(self.unsatisfied_message, self.rule, known))
        return got.withColumns({"assertion": F.lit(self.id), "satisfied": ok, "severity": F.when(~ok, F.lit(self.severity)), "message": text})

    def counts(self, wide: DataFrame, parameters: dict[str, str] | None = None) -> DataFrame:
        return count_outcomes(self.run(wide, parameters))


@dataclass
class ExistenceAssertion:
    """Counts each document's distinct evaluations; the test sees the count as $count, and a document in which nothing binds
    has a row too. An input without documents has one row, with no document and a count of zero."""

    id: str
    rule: VariableSet
    test: str = "$count > 0"

    def run(self, wide: DataFrame, parameters: dict[str, str] | None = None) -> DataFrame:
        got = distinct_evaluations(evaluate(self.rule, wide, parameters), self.rule)
        known = resolve_parameters(self.rule, parameters)
        found = got.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
        documents = wide.select("doc_id").distinct()
        counts = documents.join(found, "doc_id", "left").select("doc_id", F.coalesce("_n", F.lit(0)).cast("long").alias("count"))
        none = wide.agg(F.count(F.lit(1)).alias("_n")).where("_n = 0").select(F.lit(None).cast("string").alias("doc_id"), F.lit(0).cast("long").alias("count"))
        ok = F.expr(compile_expression(self.test, self.rule, known))
        return counts.unionByName(none).select(F.lit(self.id).alias("assertion"), "doc_id", "count", ok.alias("satisfied"))


def count_outcomes(results: DataFrame) -> DataFrame:
    return results.groupBy("assertion").agg(F.count_if("satisfied").alias("satisfied"), F.count_if(~F.col("satisfied")).alias("unsatisfied"))


def assertion_set(name: str, results: list[DataFrame]) -> DataFrame:
    """Outcomes of several assertions under one label."""
    out = None
    for r in results:
        r = r.select(F.lit(name).alias("assertion_set"), "assertion", "satisfied")
        out = r if out is None else out.unionByName(r)
    return out


def message(template: str | None, rule: VariableSet, parameters: dict[str, str]) -> Column:
    """Text with expressions in braces; doubled braces stand for themselves."""
    if template is None:
        return F.lit(None).cast("string")
    parts = []
    for piece in re.split(r"(\{\{|\}\}|\{[^{}]*\})", template):
        if piece in ("{{", "}}"):
            parts.append(F.lit(piece[0]))
        elif piece.startswith("{"):
            parts.append(F.coalesce(F.expr(compile_expression(piece[1:-1], rule, parameters)).cast("string"), F.lit("")))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts) if parts else F.lit("")


# --- derived facts --------------------------------------------------------------------------------------------


def multiply_units(numerator: Column, denominator: Column, by_numerator: Column, by_denominator: Column) -> tuple[Column, Column]:
    """Product of two units: measures on both sides of the line cancel one for one."""
    top, bottom = F.concat(numerator, by_numerator), F.concat(denominator, by_denominator)
    return cancel(top, bottom), cancel(bottom, top)


def cancel(left: Column, right: Column) -> Column:
    """Measures of ``left`` beyond those that ``right`` holds too, as a sorted array."""
    count = lambda array, m: F.size(F.filter(array, lambda x: x == m))
    rest = F.transform(F.array_distinct(left), lambda m: F.array_repeat(m, F.greatest(F.lit(0), count(left, m) - count(right, m))))
    return F.array_sort(F.flatten(rest))


@dataclass
class Formula:
    """A derived fact: a value and, for each aspect, a source variable or an expression."""

    id: str
    rule: VariableSet
    value: str
    concept: str | None = None  # an expression, or from the source
    source: str | None = None
    period: dict | None = None  # {"instant": e} | {"start": e, "end": e} | {"forever": True}
    entity: tuple[str, str] | None = None
    multiply_by: list[str] = field(default_factory=list)
    divide_by: list[str] = field(default_factory=list)
    dims: dict[str, str] = field(default_factory=dict)
    omit_dims: list[str] = field(default_factory=list)
    decimals: str | None = None
    precision: str | None = None

    def run(self, wide: DataFrame, parameters: dict[str, str] | None = None, scope: Scope | None = None) -> DataFrame:
        return self.of(distinct_evaluations(evaluate(self.rule, wide, parameters, scope), self.rule), parameters)

    def _decimals(self, e) -> Column:
        """The rule's decimals; "coarsest" takes the least that the bound facts report, INF where all are exact."""
        if self.decimals != "coarsest":
            return e(self.decimals).cast("string") if self.decimals else F.lit(None).cast("string")
        each = [inferred_decimals(*[F.col(f"{v.name}__{c}") for c in ("num", "decimals", "precision")]) for v in self.rule.variables if isinstance(v, FactVariable) and not v.bind_as_sequence]
        least = F.array_min(F.array(*[F.when(d != "INF", d.try_cast("int")) for d in each]))
        known = F.exists(F.array(*each), lambda d: d.isNotNull())
        return F.when(known, F.coalesce(least.cast("string"), F.lit("INF")))

    def violations(self, derived: DataFrame, cubes: DataFrame, cube_dims: DataFrame, dim_members: DataFrame) -> DataFrame:
        """Derived facts whose dimensions their concept's hypercubes don't allow, as ``validation.hypercubes`` reports them; a
        fact is named by its concept and context."""
        named = derived.withColumn("fact_id", F.concat_ws("#", "concept", "context_ref"))
        typed = named if "typed_dims" in named.columns else named.withColumn("typed_dims", F.create_map().cast("map<string,string>"))
        return hypercubes(typed, cubes, cube_dims, dim_members)

    def of(self, got: DataFrame, parameters: dict[str, str] | None = None, carry: list[str] = ()) -> DataFrame:
        """The derived facts of evaluations, with some of their columns."""
        rule, known = self.rule, resolve_parameters(self.rule, parameters)
        src = self.source or next(v.name for v in rule.variables if isinstance(v, FactVariable))
        e = lambda text: F.expr(compile_expression(text, rule, known))
        start, end, kind = F.col(f"{src}__start"), F.col(f"{src}__end"), F.col(f"{src}__period_type")
        if self.period:
            if "instant" in self.period:
                kind, start, end = F.lit("instant"), F.lit(None), e(self.period["instant"])
            elif "start" in self.period:
                kind, start, end = F.lit("duration"), e(self.period["start"]), e(self.period["end"])
            else:
                kind, start, end = F.lit("forever"), F.lit(None), F.lit(None)
        none = F.array().cast("array<string>")
        side = lambda v, c: F.coalesce(F.col(f"{v}__{c}"), none) if f"{v}__{c}" in got.columns else none
        num, den = side(src, "numerator"), side(src, "denominator")
        for v in self.multiply_by:
            num, den = multiply_units(num, den, side(v, "numerator"), side(v, "denominator"))
        for v in self.divide_by:
            num, den = multiply_units(num, den, side(v, "denominator"), side(v, "numerator"))
        empty = F.create_map().cast("map<string,string>")
        dims = F.coalesce(F.col(f"{src}__dims"), empty) if f"{src}__dims" in got.columns else empty
        gone = [*self.omit_dims, *self.dims]
        if gone:
            dims = F.map_filter(dims, lambda k, _: ~k.isin(gone))
        if self.dims:
            dims = F.map_concat(dims, F.create_map(*[x for d, m in self.dims.items() for x in (F.lit(d), e(m))]))
        scheme, entity = (e(self.entity[0]), e(self.entity[1])) if self.entity else (F.col(f"{src}__scheme"), F.col(f"{src}__entity"))
        concept = e(self.concept) if self.concept else F.col(f"{src}__concept")
        out = got.select("doc_id", *carry, concept.alias("concept"), e(self.value).cast("decimal(38,6)" if rule.exact else "double").alias("derived"), scheme.alias("scheme"), entity.alias("entity"), kind.alias("period_type"), start.cast("timestamp_ntz").alias("start"), end.cast("timestamp_ntz").alias("end"), F.array_sort(num).alias("numerator"), F.array_sort(den).alias("denominator"), dims.alias("dims"), self._decimals(e).alias("decimals"), (e(self.precision).cast("string") if self.precision else F.lit(None).cast("string")).alias("precision"))
        return with_context_keys(out)


@dataclass
class TupleFormula:
    """A derived tuple for each evaluation, and the formulas of the facts in it, over the same variables."""

    id: str
    concept: str
    rule: VariableSet
    parts: list[Formula] = field(default_factory=list)
    inside: str | None = None  # the variable whose tuple holds the new one

    def _id(self) -> Column:
        facts = [F.coalesce(F.col(f"{v.name}__fact_id"), F.lit("")) for v in self.rule.variables if isinstance(v, FactVariable) and not v.bind_as_sequence]
        return F.concat(F.lit("t-"), F.substring(F.sha2(F.concat_ws("|", F.lit(self.id), "doc_id", *facts), 256), 1, 16))

    def run(self, wide: DataFrame, parameters: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
        """The tuples (doc_id, fact_id, concept, parent_id), and their facts as ``Formula.run`` gives them with a parent_id."""
        got = distinct_evaluations(evaluate(self.rule, wide, parameters), self.rule)
        above = F.col(f"{self.inside}__parent_id") if self.inside else F.lit(None).cast("string")
        tuples = got.select("doc_id", self._id().alias("fact_id"), F.lit(self.concept).alias("concept"), above.alias("parent_id"))
        facts = None
        for n, part in enumerate(self.parts):
            made = part.of(got.withColumn("_tuple", self._id()), parameters, ["_tuple"]).withColumnRenamed("_tuple", "parent_id").withColumn("ordinal", F.lit(n))
            facts = made if facts is None else facts.unionByName(made)
        return tuples, facts


def with_context_keys(derived: DataFrame) -> DataFrame:
    """Derived facts with synthetic ids for their contexts and units: equal content, equal id."""
    from ..functions.aspects import period_key, sorted_entries, unit_key

    context = F.concat_ws("|", "scheme", "entity", period_key(F.col("period_type"), F.col("start"), F.col("end")), sorted_entries(F.col("dims")))
    unit = unit_key(F.col("numerator"), F.col("denominator"))
    return derived.withColumns({
        "context_ref": F.concat(F.lit("c-"), F.substring(F.sha2(context, 256), 1, 16)),
        "unit_ref": F.when(unit != "", F.concat(F.lit("u-"), F.substring(F.sha2(unit, 256), 1, 16))),
        "entity_key": F.concat_ws("|", "scheme", "entity"),
        "period_key": period_key(F.col("period_type"), F.col("start"), F.col("end")),
        "dims_key": F.concat_ws("|", sorted_entries(F.col("dims")), sorted_entries(F.lit(None).cast("map<string,string>"))),
        "unit_key": unit,
    })


@dataclass
class ConsistencyAssertion:
    """Derived against reported facts of the same aspects, within a radius or by rounding to the decimals."""

    id: str
    formula: Formula
    absolute: float | None = None
    proportional: float | None = None
    strict: bool = False

    def run(self, wide: DataFrame, parameters: dict[str, str] | None = None) -> DataFrame:
        keys = ["doc_id", "concept", "entity_key", "period_key", "unit_key", "dims_key"]
        derived = self.formula.run(wide, parameters).drop("decimals", "precision")
        facts = wide.where("num is not null").select(*[F.col(k).alias(f"r_{k}") for k in keys], "fact_id", _number(self.formula.rule.exact).alias("reported"), "decimals", "precision", "num")
        safe = [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in keys]
        both = derived.join(facts, safe, "left" if self.strict else "inner")
        if self.absolute is not None:
            ok = F.abs(F.col("derived") - F.col("reported")) <= self.absolute
        elif self.proportional is not None:
            ok = F.abs(F.col("derived") - F.col("reported")) <= F.abs(F.col("reported")) * self.proportional
        else:
            d = inferred_decimals(F.col("num"), F.col("decimals"), F.col("precision"))
            digits = F.when(d != "INF", d).cast("int")
            scale = F.pow(F.lit(10.0), digits.cast("double"))
            half_up = F.when(digits.isNull(), F.col("derived")).otherwise(F.signum("derived") * F.floor(F.abs(F.col("derived")) * scale + 0.5) / scale)
            ok = half_up == presented(F.col("num"), d)
        return both.select(F.lit(self.id).alias("assertion"), "doc_id", "concept", "context_ref", "fact_id", "derived", "reported", F.coalesce(ok, F.lit(False)).alias("satisfied"))


def summary(results: DataFrame) -> DataFrame:
    """Tests by assertion, concept and context."""
    return results.groupBy("assertion", "concept", "context_ref").agg(F.count_if("satisfied").alias("satisfied"), F.count_if(~F.col("satisfied")).alias("unsatisfied"))
