"""Binds a SELECT to tables and builds its DataFrame.

Conditions of WHERE and ON form one pool of conjuncts. Column equalities are closed into classes, and every implied
equality between two relations becomes a join condition, so that Spark may join any two members of a class directly.
Filters on one relation go below the joins; comparisons with a literal hold for all of a class. A join whose keys repeat on
both sides is dealt by its expected rows, for which the relations that may have such keys are counted. The rest is Spark's planning.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import cache
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions.semantics import int_div, real_div, truthy
from ..operators.aggregates import grouped
from ..operators.joins import counted, dealt, inner, many, planned_bytes, width
from .syntax import Expr, Select

AGGREGATES = ("count", "sum", "avg", "min", "max")
NUMBERS = ("int", "double", "bool")
MOST_RELATIONS = 16


@dataclass
class Typed:
    """A Spark column with the dialect's type (int, double, text, or bool for a truth value) and whether it can be NULL."""

    column: Column
    kind: str
    nullable: bool = False
    two_valued: bool = False  # of AND and OR, whose NULL is false

    def value(self) -> Column:
        if self.kind != "bool":
            return self.column
        return (F.coalesce(self.column, F.lit(False)) if self.two_valued and self.nullable else self.column).cast("bigint")

    def test(self) -> Column:
        """As a condition, where NULL counts as false: above it stand ANDs and ORs only, so Spark may push it down as it is."""
        return truthy(self.column, self.kind, False)

    def holds(self) -> Column:
        """The same with false for NULL, for what is negated."""
        return truthy(self.column, self.kind, self.nullable)

    @property
    def shown(self) -> str:
        return "int" if self.kind == "bool" else self.kind


@dataclass
class Bound:
    """What binding a SELECT found, beside the DataFrame: for explaining and estimating."""

    select: Select
    frame: DataFrame | None = None
    relations: dict[str, str] = field(default_factory=dict)  # alias: table
    filters: dict[str, list[Expr]] = field(default_factory=dict)
    classes: list[list[tuple[str, str]]] = field(default_factory=list)  # of (alias, column)
    complex: list[Expr] = field(default_factory=list)
    keys: list[Expr] = field(default_factory=list)


def conjuncts(e: Expr) -> list[Expr]:
    return conjuncts(e.args[0]) + conjuncts(e.args[1]) if e.kind == "and" else [e]


def columns_of(e: Expr) -> set[Expr]:
    if e.kind == "col":
        return {e}
    inside = e.args[1] or () if e.kind == "call" else e.args
    return {c for a in inside if isinstance(a, Expr) for c in columns_of(a)}


def has_aggregate(e: Expr) -> bool:
    if e.kind == "call":
        return True
    return any(has_aggregate(a) for a in e.args if isinstance(a, Expr))


class Scope:
    """Tables of a query by alias, with the columns and types of each, and the columns that can be NULL."""

    def __init__(self, relations: list[tuple[str, str, dict[str, str]]], nullable: dict[str, set[str]]):
        self.columns, self.nullable = {alias: columns for _, alias, columns in relations}, nullable

    def resolve(self, e: Expr) -> Expr:
        alias, name = e.args
        if alias is not None:
            if alias not in self.columns:
                raise EngineError(f"unknown table {alias}")
            if name not in self.columns[alias]:
                raise EngineError(f"unknown column {alias}.{name}")
            return e
        having = [a for a, columns in self.columns.items() if name in columns]
        if len(having) != 1:
            raise EngineError(f"{'ambiguous' if having else 'unknown'} column {name}")
        return Expr("col", (having[0], name))

    def qualified(self, e: Expr) -> Expr:
        """The expression with every column named by its table."""
        if e.kind == "col":
            return self.resolve(e)
        if e.kind == "call":
            return Expr("call", (e.args[0], None if e.args[1] is None else tuple(map(self.qualified, e.args[1]))))
        return Expr(e.kind, tuple(self.qualified(a) if isinstance(a, Expr) else a for a in e.args))

    def column(self, e: Expr) -> Typed:
        alias, name = e.args
        return Typed(F.col(f"`{alias}.{name}`"), self.columns[alias][name], name in self.nullable[alias])


def compiled(e: Expr, leaf) -> Typed:
    """A qualified expression as a Spark column; leaf(e) gives that of columns, aggregates and grouped expressions."""
    if (found := leaf(e)) is not None:
        return found
    if e.kind == "lit":
        value, kind = e.args
        return Typed(F.lit(value).cast({"int": "bigint", "double": "double", "text": "string"}[kind]), kind)
    if e.kind in ("and", "or"):
        a, b = (compiled(x, leaf) for x in e.args)
        return Typed(a.test() & b.test() if e.kind == "and" else a.test() | b.test(), "bool", a.nullable or b.nullable, True)
    if e.kind == "not":
        return Typed(~compiled(e.args[0], leaf).holds(), "bool")
    if e.kind == "neg":
        t = compiled(e.args[0], leaf)
        if t.kind == "text":
            raise EngineError("a text cannot be negated")
        return Typed(-t.value(), t.shown, t.nullable)
    if e.kind == "call":
        if e.args[0] not in AGGREGATES:
            raise EngineError(f"unknown function {e.args[0]}")
        raise EngineError(f"{e.args[0]} cannot stand here")
    if e.kind == "col":
        raise EngineError(f"column {e} is neither grouped nor aggregated")
    op, a, b = e.args[0], compiled(e.args[1], leaf), compiled(e.args[2], leaf)
    nullable = a.nullable or b.nullable
    if e.kind == "cmp":
        if (a.kind == "text") != (b.kind == "text"):
            raise EngineError(f"cannot compare {a.shown} with {b.shown}")
        x, y = a.value(), b.value()
        return Typed({"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], "bool", nullable)
    if "text" in (a.kind, b.kind):
        raise EngineError(f"operator {op} needs numbers")
    whole = "double" not in (a.kind, b.kind)
    if op == "/":
        return Typed(int_div(a.value(), b.value()) if whole else real_div(a.value(), b.value()), "int" if whole else "double", True)
    x, y = (t.value() if whole else t.value().cast("double") for t in (a, b))
    return Typed({"+": x + y, "-": x - y, "*": x * y}[op], "int" if whole else "double", nullable)


def equal_classes(equalities: list[tuple[Expr, Expr]]) -> list[list[Expr]]:
    parent: dict[Expr, Expr] = {}

    def root(x: Expr) -> Expr:
        while parent.setdefault(x, x) is not x:
            x = parent[x]
        return x

    for a, b in equalities:
        parent[root(a)] = root(b)
    by: dict[Expr, list[Expr]] = {}
    for x in list(parent):
        by.setdefault(root(x), []).append(x)
    return [sorted(xs, key=str) for xs in by.values()]


def implied(filters: dict[str, list[Expr]], classes: list[list[Expr]], scope: Scope) -> dict[str, list[Expr]]:
    """Comparisons with a literal, for the other columns of the class that have the column's type."""
    kind = lambda x: scope.columns[x.args[0]][x.args[1]]
    out: dict[str, list[Expr]] = {}
    for group in classes:
        for x, y in ((x, y) for x in group for y in group if x.args[0] != y.args[0] and kind(x) == kind(y)):
            for f in filters.get(x.args[0], []):
                if f.kind == "cmp" and x in f.args and any(isinstance(a, Expr) and a.kind == "lit" for a in f.args):
                    out.setdefault(y.args[0], []).append(Expr("cmp", tuple(y if a == x else a for a in f.args)))
    return out


class Sizes:
    """Expected rows of joins of relations: their rows by the distinct values of each class. A relation is counted when it is
    first asked about. Keys are taken as evenly frequent, so of a key far above the mean of its column nothing is known."""

    def __init__(self, frames: dict[str, DataFrame], classes: list[list[Expr]]):
        self.columns = {a: sorted({x.args[1] for g in classes for x in g if x.args[0] == a}) for a in frames}
        self.classes = classes
        self.count = cache(lambda a: counted(frames[a], [f"{a}.{c}" for c in self.columns[a]]))
        self.bytes = cache(lambda a: planned_bytes(frames[a]))

    def distinct(self, group: list[Expr], aliases: set[str]) -> list[int]:
        """Of a class, in each of the relations that have it."""
        by: dict[str, int] = {}
        for x in group:
            if (a := x.args[0]) in aliases:
                by[a] = min(by.get(a, 1 << 63), self.count(a)[1][f"{a}.{x.args[1]}"])
        return sorted(by.values())

    def rows(self, aliases: set[str]) -> float:
        return math.prod(self.count(a)[0] for a in aliases) / math.prod(d for g in self.classes for d in self.distinct(g, aliases)[1:])

    def groups(self, done: set[str], alias: str) -> float | None:
        """Keys of the join of a relation with others if it makes many rows of them. The smaller side is counted first: where
        its keys do not repeat, the other is not read."""
        both = [g for g in self.classes if (at := {x.args[0] for x in g}) & done and alias in at]
        for side in sorted((done, {alias}), key=lambda s: sum(map(self.bytes, s))):
            if self.rows(side) < 2 * max(self.distinct(g, side)[0] for g in both):
                return None
        if not many(self.rows(done | {alias}), self.rows(done), self.rows({alias})):
            return None
        return math.prod(self.distinct(g, done | {alias})[0] for g in both)


def joined(select: Select, frames: dict[str, DataFrame], layouts: dict[str, dict[str, DataFrame]], scope: Scope, strategy: str | None, bound: Bound) -> DataFrame:
    pool = [c for e in select.conditions for c in conjuncts(scope.qualified(e))]
    if any(has_aggregate(c) for c in pool):
        raise EngineError("aggregates cannot stand in WHERE or ON")
    leaf = lambda e: scope.column(e) if e.kind == "col" else None
    always, equalities, across = [], [], []
    for c in pool:
        test, used = compiled(c, leaf).test(), {x.args[0] for x in columns_of(c)}
        if not used:
            always.append(test)
        elif c.kind == "cmp" and c.args[0] == "=" and c.args[1].kind == c.args[2].kind == "col":
            if c.args[1] != c.args[2]:
                equalities.append((c.args[1], c.args[2]))
        elif len(used) == 1:
            bound.filters.setdefault(next(iter(used)), []).append(c)
        else:
            across.append((used, test))
            bound.complex.append(c)
    edges, pairs, classes = [], [], equal_classes(equalities)
    for group in classes:
        bound.classes.append([x.args for x in group])
        for a, b in combinations(group, 2):  # at most 16 relations' columns
            test = compiled(Expr("cmp", ("=", a, b)), leaf).test()
            if a.args[0] == b.args[0]:
                bound.filters.setdefault(a.args[0], []).append(Expr("cmp", ("=", a, b)))
            else:
                edges.append(({a.args[0], b.args[0]}, test))
                pairs.append((a.args, b.args))
    aliases = [alias for _, alias in select.relations]
    ready, more = {}, implied(bound.filters, classes, scope)
    for alias in aliases:
        # the layout of an indexed column that is filtered, if there is one
        used = sorted(x.args[1] for f in bound.filters.get(alias, []) for x in columns_of(f))
        df = next((layouts[alias][x] for x in used if x in layouts[alias]), frames[alias])
        df = df.select(*[F.col(f"`{c}`").alias(f"{alias}.{c}") for c in scope.columns[alias]])
        for c in bound.filters.get(alias, []) + more.get(alias, []):
            df = df.filter(compiled(c, leaf).test())
        ready[alias] = df
    every = [*(e for e, _ in select.items), *select.group, *(e for e, _ in select.order), *select.conditions]
    read = None if None in every else {x.args[1] for e in every for x in columns_of(e)}
    wide = lambda among: width([k for a in among for c, k in scope.columns[a].items() if read is None or c in read])
    sizes = Sizes(ready, classes)
    done, waiting, out = {aliases[0]}, aliases[1:], ready[aliases[0]]
    while waiting:  # the next relation that an equality connects, else one that any condition does, else the next
        touches = lambda a, conditions: any(a in used and used <= done | {a} for used, _ in conditions)
        alias = next((a for a in waiting if touches(a, edges)), None) or next((a for a in waiting if touches(a, across)), waiting[0])
        waiting.remove(alias)
        before, done = done, done | {alias}
        on = None
        for used, test in edges + across:
            if alias in used and used <= done:
                on = test if on is None else on & test
        linked = any(alias in used and used <= done for used, _ in edges)
        if linked and strategy != "nestloop" and (groups := sizes.groups(before, alias)):
            ends = [x if x[0][0] == alias else x[::-1] for x in pairs if alias in (at := {a for a, _ in x}) and at <= done]
            keys = [(".".join(b), ".".join(a)) for a, b in ends]
            out = dealt(out, ready[alias], on, keys, sizes.rows(done), groups, (sizes.rows(before), sizes.rows({alias})), (wide(before), wide({alias})), strategy)
        else:
            out = inner(out, ready[alias], on, strategy if linked else None)
    for test in always:
        out = out.filter(test)
    return out


def bind(select: Select, tables, strategy: str | None = None) -> Bound:
    """tables(name) gives (DataFrame, {column: type}, columns that can be NULL, {indexed column: the rows in its order}), or
    raises EngineError."""
    if len(select.relations) > MOST_RELATIONS:
        raise EngineError(f"more than {MOST_RELATIONS} tables")
    frames, relations, nullable, layouts = {}, [], {}, {}
    for table, alias in select.relations:
        if alias in frames:
            raise EngineError(f"duplicate alias {alias}")
        frames[alias], columns, nullable[alias], layouts[alias] = tables(table)
        relations.append((table, alias, columns))
    scope = Scope(relations, nullable)
    bound = Bound(select, relations={alias: table for table, alias, _ in relations})
    df = joined(select, frames, layouts, scope, strategy, bound)

    items: list[tuple[Expr, str]] = []
    for e, alias in select.items:
        if e is None:
            if select.group or any(x is not None and has_aggregate(x) for x, _ in select.items):
                raise EngineError("* cannot stand beside aggregates or grouping")
            items += [(Expr("col", (a, c)), f"{a}.{c}") for _, a, columns in relations for c in columns]
        else:
            items.append((scope.qualified(e), alias or str(e)))
    named = {alias: scope.qualified(e) for e, alias in select.items if alias and e is not None}
    order: list[tuple[Expr, bool]] = []
    for e, down in select.order:
        if e.kind == "lit" and e.args[1] == "int":
            if not 1 <= e.args[0] <= len(items):
                raise EngineError(f"ORDER BY position {e.args[0]} is not in the select list")
            order.append((items[e.args[0] - 1][0], down))
        elif e.kind == "col" and e.args[0] is None and e.args[1] in named:
            order.append((named[e.args[1]], down))
        else:
            order.append((scope.qualified(e), down))

    group = [scope.qualified(e) for e in select.group]
    base = lambda e: scope.column(e) if e.kind == "col" else None
    leaf = base
    if group or any(has_aggregate(e) for e, _ in items + order):
        if any(has_aggregate(e) for e in group):
            raise EngineError("aggregates cannot stand in GROUP BY")
        bound.keys = group
        made: dict[Expr, Typed] = {}
        keys, aggregates = [], []
        for i, e in enumerate(group):
            t = compiled(e, base)
            keys.append(t.value().alias(f"key{i}"))
            made.setdefault(e, Typed(F.col(f"key{i}"), t.shown, t.nullable))

        def collect(e: Expr) -> None:
            if e in made:
                return
            if e.kind == "call":
                made[e] = aggregate(e, base, f"agg{len(aggregates)}", aggregates)
            else:
                for a in e.args:
                    if isinstance(a, Expr):
                        collect(a)

        for e, _ in items + order:
            collect(e)
        df = grouped(df, keys, aggregates)
        leaf = made.get

    # sorting stands below the projection, so that keys need not be in the select list
    outputs = [(compiled(e, leaf).value(), name) for e, name in items]
    sort = [compiled(e, leaf).value() for e, _ in order]
    if sort:
        df = df.orderBy(*[s.desc() if down else s.asc() for s, (_, down) in zip(sort, order, strict=True)])
    if select.limit is not None:
        df = df.limit(select.limit)
    bound.frame = df.select(*[c.alias(name) for c, name in outputs])
    return bound


def aggregate(e: Expr, base, name: str, into: list[Column]) -> Typed:
    call, args = e.args
    if call not in AGGREGATES:
        raise EngineError(f"unknown function {call}")
    if args is None:
        if call != "count":
            raise EngineError(f"{call}(*) is not an aggregate")
        into.append(F.count(F.lit(1)).alias(name))
        return Typed(F.col(name), "int")
    if len(args) != 1:
        raise EngineError(f"{call} takes one argument")
    if has_aggregate(args[0]):
        raise EngineError("aggregates cannot be nested")
    t = compiled(args[0], base)
    if call in ("sum", "avg") and t.kind == "text":
        raise EngineError(f"{call} needs numbers")
    into.append(getattr(F, call)(t.value()).alias(name))
    kind = "int" if call == "count" else "double" if call == "avg" else t.shown
    return Typed(F.col(name), kind, call != "count")
