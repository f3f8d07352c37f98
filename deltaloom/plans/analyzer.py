"""From statements to plans: names, kinds and what each surface allows, in a fixed order of errors.

Surfaces: `query` (one-off), `raw_view` (a subscribed table shape), `declared_query` and `declared_view`.
Order of checks: tables, ON, WHERE as written, projection, aggregate, ORDER BY, LIMIT and OFFSET.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field, replace
from typing import Any

from deltaloom.functions.kinds import Kind, Literal, coerce
from deltaloom.plans import parser as P
from deltaloom.plans.errors import (
    DuplicateName,
    InvalidLiteral,
    InvalidOperator,
    PlanError,
    UnexpectedType,
    UnqualifiedNames,
    Unresolved,
    UnsupportedFeature,
    UnsupportedSelect,
    UnsupportedSQL,
)
from deltaloom.plans.schema import Caller, Catalog, ColumnDef, TableDef

LARGEST = (1 << 64) - 1


@dataclass(frozen=True)
class Col:
    """A column of a relation, by the relation's place."""

    relation: int
    name: str
    kind: Kind
    nullable: bool


@dataclass(frozen=True)
class Test:
    column: Col
    op: str  # = != < <= > >=
    value: Any  # as stored; None only from a parameter


@dataclass(frozen=True)
class NullTest:
    column: Col
    negated: bool


@dataclass(frozen=True)
class Edge:
    left: Col
    right: Col


@dataclass(frozen=True)
class All:
    terms: tuple


@dataclass(frozen=True)
class Any_:
    terms: tuple


@dataclass(frozen=True)
class Truth:
    value: bool


@dataclass(frozen=True)
class Agg:
    function: str
    column: Col | None
    distinct: bool
    name: str


@dataclass(frozen=True)
class Plan:
    relations: tuple[TableDef, ...]
    edges: tuple[Edge | None, ...]  # how each relation but the first is linked; None: crossed
    where: object
    output: tuple[tuple[Col, str], ...]
    emitted: int | None  # the relation a star names
    aggregate: Agg | None = None
    order: tuple[tuple[Col, bool], ...] = ()
    limit: int | None = None
    offset: int | None = None
    visible: tuple[object, ...] = ()  # each relation's row filter
    sql: str = field(default="", compare=False)

    def key(self) -> str:
        """The same for plans that mean the same: what canonical() makes equal."""
        p = canonical(self)
        text = repr((tuple(t.name for t in p.relations), p.edges, p.where, p.output, p.emitted, p.aggregate, p.order, p.limit, p.offset, p.visible))
        return hashlib.sha256(text.encode()).hexdigest()


def fold(e: object) -> object:
    """Constants go; conjunctions and disjunctions are flat."""
    if isinstance(e, (All, Any_)):
        stop = isinstance(e, Any_)
        terms: list = []
        for t in map(fold, e.terms):
            if isinstance(t, Truth):
                if t.value is stop:
                    return t
            elif type(t) is type(e):
                terms += t.terms
            else:
                terms.append(t)
        return Truth(not stop) if not terms else terms[0] if len(terms) == 1 else type(e)(tuple(terms))
    return e


def canonical(plan: Plan) -> Plan:
    """Terms in one order, each once, with `a OR (a AND b)` and `a AND (a OR b)` brought down to `a`."""

    def sort(e: object) -> object:
        if isinstance(e, Edge):
            return Edge(*sorted((e.left, e.right), key=repr))
        if not isinstance(e, (All, Any_)):
            return e
        terms = sorted({repr(t): t for t in map(sort, e.terms)}.items())
        other = Any_ if isinstance(e, All) else All
        names = {r for r, _ in terms}
        kept = tuple(t for r, t in terms if not (isinstance(t, other) and any(repr(x) in names for x in t.terms)))
        return kept[0] if len(kept) == 1 else type(e)(kept)

    return replace(plan, where=sort(fold(plan.where)), edges=tuple(e and sort(e) for e in plan.edges), visible=tuple(sort(fold(v)) for v in plan.visible))


@dataclass(frozen=True)
class Surface:
    name: str
    live: bool = False
    shapes: bool = True  # projections, aggregates, ORDER BY, LIMIT and OFFSET
    parameters: bool = False


SURFACES = {s.name: s for s in (Surface("query"), Surface("raw_view", live=True, shapes=False), Surface("declared_query", parameters=True), Surface("declared_view", live=True, parameters=True))}


class Analyzer:
    def __init__(self, catalog: Catalog, caller: Caller | None = None, surface: str = "query", parameters: dict[str, tuple[Kind, bool, Any]] | None = None):
        """caller None: trusted, all tables and rows. parameters: name -> (kind, nullable, value)."""
        self.catalog, self.caller, self.surface = catalog, caller, SURFACES[surface]
        self.parameters = parameters or {}
        self.used: set[str] = set()

    def plan(self, sql: str) -> Plan:
        try:
            s = P.parse(sql)
        except UnsupportedSelect:
            raise UnsupportedSelect(sql, self.surface.live) from None
        if not self.surface.shapes and (s.items or s.aggregate or s.order or s.limit or s.offset):
            raise UnsupportedFeature(sql)
        declared = self.surface.parameters
        tables = [self.catalog.lookup(r.table, None if declared else self.caller) for r in s.relations]
        self.aliases: dict[str, int] = {}
        for i, r in enumerate(s.relations):
            if r.alias in self.aliases:
                raise DuplicateName(r.alias)
            self.aliases[r.alias] = i
        self.tables, self.joined = tables, len(tables) > 1
        edges: list[Edge | None] = []
        for i, r in enumerate(s.relations[1:], 1):
            edges.append(self._on(r.on, i) if r.on else None)
        where = self._predicate(s.where) if s.where is not None else Truth(True)
        emitted, output = self._projection(s)
        aggregate = self._aggregate(s.aggregate) if s.aggregate else None
        order = self._order(s, output, emitted, aggregate)
        limit, offset = self._count(s.limit, sql), self._count(s.offset, sql)
        if unused := sorted(self.parameters.keys() - self.used):
            raise PlanError(f"parameter :{unused[0]} is not used")
        self._live_rules(s, where, edges, emitted, output, aggregate, order, limit, offset)
        where = fold(where)
        if self.joined and len(tables) == 2 and edges[0] is None and s.where is not None:
            self._crossed(where, tables)
        visible = tuple(self._visible(i, t) for i, t in enumerate(tables))
        return Plan(tuple(tables), tuple(edges), where, output, emitted, aggregate, order, limit, offset, visible, sql)

    # --- names

    def _col(self, ref: P.Ref) -> Col:
        if ref.qualifier is None:
            if self.joined:
                raise UnqualifiedNames
            at = 0
        elif ref.qualifier in self.aliases:
            at = self.aliases[ref.qualifier]
        else:
            raise Unresolved(ref.qualifier)
        return self._of(at, ref.name)

    def _of(self, at: int, name: str) -> Col:
        c: ColumnDef | None = self.tables[at].column(name)
        if c is None:
            raise Unresolved(name)
        return Col(at, c.name, c.kind, c.nullable)

    def _on(self, on: tuple[P.Ref, P.Ref], at: int) -> Edge:
        left, right = map(self._col, on)
        if at not in (left.relation, right.relation) or left.relation == right.relation or max(left.relation, right.relation) > at:
            raise PlanError("ON must link the joined relation to one before it")
        return self._edge(left, right)

    def _edge(self, left: Col, right: Col) -> Edge:
        if left.kind != right.kind:
            raise UnexpectedType(left.kind.label, right.kind.label)
        if left.kind.name == "ArrayString":
            raise InvalidOperator("=", left.kind.label)
        return Edge(left, right)

    # --- WHERE

    def _predicate(self, e: object) -> object:
        if isinstance(e, P.Constant):
            return Truth(e.value)
        if isinstance(e, (P.Both, P.Either)):
            return (All if isinstance(e, P.Both) else Any_)((self._predicate(e.left), self._predicate(e.right)))
        if isinstance(e, P.IsNull):
            return NullTest(self._col(e.ref), e.negated)
        if isinstance(e, P.Equal):
            return self._edge(self._col(e.left), self._col(e.right))
        c = self._col(e.ref)
        return Test(c, e.op, self._value(e.literal, c))

    def _value(self, literal: Literal, c: Col) -> Any:
        if literal.kind == "parameter" and self.surface.parameters and literal.value in self.parameters:
            kind, nullable, value = self.parameters[literal.value]
            self.used.add(literal.value)
            if kind != c.kind:
                raise UnexpectedType(c.kind.label, kind.label)
            if value is None and not nullable:
                raise PlanError(f"parameter :{literal.value} is not nullable")
            return value
        return coerce(literal, c.kind, self.caller.identity if self.caller else None)

    def _crossed(self, where: object, tables: list[TableDef]) -> None:
        """A cross join of two tables with WHERE: one equality of the two, and literal tests, joined by AND."""
        terms = where.terms if isinstance(where, All) else (where,)
        if isinstance(where, Truth):
            return
        edges = [t for t in terms if isinstance(t, Edge)]
        if any(isinstance(t, (Any_, All)) for t in terms) or not edges:
            raise PlanError("cross join WHERE only supports qualified column equality")
        if len(edges) > 1 or tables[0] is tables[1]:
            raise PlanError("cross join WHERE supports exactly one qualified column equality")

    # --- outputs

    def _projection(self, s: P.Statement) -> tuple[int | None, tuple[tuple[Col, str], ...]]:
        if s.star is not None:
            if s.star == "" and self.joined:
                raise PlanError("SELECT * is not supported for joins")
            if s.star and s.star not in self.aliases:
                raise Unresolved(s.star)
            at = self.aliases[s.star] if s.star else 0
            return at, tuple((self._of(at, c.name), c.name) for c in self.tables[at].columns)
        out: list[tuple[Col, str]] = []
        for item in s.items:
            c = self._col(item.ref)
            if item.name in (n for _, n in out):
                raise DuplicateName(item.name)
            out.append((c, item.name))
        return None, tuple(out)

    def _aggregate(self, a: P.Aggregate) -> Agg:
        c = self._col(a.ref) if a.ref else None
        if a.function == "SUM" and (c.kind.wide or not (c.kind.integer or c.kind.floating)):
            raise PlanError("SUM aggregate only supports integer and float columns")
        return Agg(a.function, c, a.distinct, a.name)

    def _order(self, s: P.Statement, output: tuple, emitted: int | None, aggregate: Agg | None) -> tuple[tuple[Col, bool], ...]:
        out = []
        for ref, down in s.order:
            if aggregate:
                if ref.qualifier is not None or ref.name != aggregate.name:
                    raise PlanError("ORDER BY with aggregate projections only supports the aggregate output alias")
                continue
            named = [c for c, n in output if ref.qualifier is None and n == ref.name and (emitted is None)]
            if named:
                own = self.tables[named[0].relation].column(ref.name)
                if not self.joined and own is not None and own.name != named[0].name:
                    raise PlanError(f"ORDER BY `{ref.name}` is ambiguous")
                out.append((named[0], down))
                continue
            c = self._col(ref)
            if self.joined and c.relation not in ({emitted} if emitted is not None else {x.relation for x, _ in output}):
                raise PlanError("ORDER BY only supports columns from the projected table")
            out.append((c, down))
        return tuple(out)

    def _count(self, literal: Literal | None, sql: str) -> int | None:
        if literal is None:
            return None
        if literal.kind in ("parameter", "sender"):
            raise UnsupportedFeature(sql)
        if literal.kind != "int" or not 0 <= literal.value <= LARGEST:
            raise InvalidLiteral(literal.text, "U64")
        return literal.value

    # --- surfaces

    def _live_rules(self, s, where, edges, emitted, output, aggregate, order, limit, offset) -> None:
        if not self.surface.live:
            return
        if (order or limit is not None or offset is not None) and (self.joined or aggregate):
            raise UnsupportedFeature(s.sql)
        if len(self.tables) == 2 and output and emitted is None and not aggregate and len({c.relation for c, _ in output}) > 1:
            raise PlanError("a live join projects columns of one relation")
        for e in [x for x in edges if x] + [t for t in _terms(where) if isinstance(t, Edge)]:
            if not any(self.tables[c.relation].indexed(c.name) for c in (e.left, e.right)):
                raise PlanError("Subscriptions require indexes on join columns")

    def _visible(self, at: int, table: TableDef) -> object:
        filters = self.catalog.filters.get(table.name, [])
        if not filters or self.caller is None or self.caller.allow_all:
            return Truth(True)
        inner = Analyzer(self.catalog, None)
        inner.caller = self.caller
        inner.tables, inner.aliases, inner.joined = [table], {table.name: 0}, False
        terms = []
        for text in filters:
            s = P.parse(f"SELECT * FROM {_quoted(table.name)} WHERE {text}")
            if len(s.relations) != 1 or s.order or s.limit or s.offset:
                raise UnsupportedSQL("a row filter is a predicate")
            terms.append(_moved(inner._predicate(s.where), at))
        return fold(Any_(tuple(terms)))


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _terms(e: object) -> list:
    return [x for t in e.terms for x in _terms(t)] if isinstance(e, (All, Any_)) else [e]


def _moved(e: object, at: int) -> object:
    """The same predicate on another relation."""
    if isinstance(e, (All, Any_)):
        return type(e)(tuple(_moved(t, at) for t in e.terms))
    return replace(e, column=replace(e.column, relation=at)) if isinstance(e, (Test, NullTest)) else e
