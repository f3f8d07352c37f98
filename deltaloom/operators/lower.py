"""From plans to DataFrames: the one place that builds columns.

Predicates have two values. A comparison with null is never unknown: null equals null, differs from every
value, and is below all of them. Joins on columns that can be null compare the same way, by `<=>`, which
stays a hash or sort-merge join; where both sides declare no nulls plain equality is used. The rest is left
to Catalyst: filters reach the scans, columns are pruned, joins are ordered and chosen at run time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaloom.functions.kinds import Kind, canonical_order, column_of
from deltaloom.plans.analyzer import All, Any_, Col, Edge, NullTest, Plan, Test, Truth
from deltaloom.plans.errors import LimitExceeded
from deltaloom.sources.folders import checkpointed

#: Up to so many rows are skipped and taken by Spark's own top-k; it counts them in 32 bits, and gathers what it
#: skips in one task.
MOST = 1 << 20
#: Rows of a gathered result and their bytes, where a host sets no limits of its own.
ROWS, BYTES = 100_000, 64 << 20


def name_of(c: Col) -> str:
    return f"r{c.relation}_{c.name}"


def col(c: Col) -> Column:
    return F.col(f"`{name_of(c).replace('`', '``')}`")


def relation(source: DataFrame, plan: Plan, at: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """A relation's rows under names of its own, after its row filter."""
    table = plan.relations[at]
    cols = [F.col(f"`{c.name}`").alias(f"r{at}_{c.name}") for c in table.columns]
    out = source.select(*cols, *(F.col(k).alias(f"r{at}{k}") for k in keep))
    return out if plan.visible[at] == Truth(True) else out.where(predicate(plan.visible[at]))


def predicate(e: object) -> Column:
    if isinstance(e, Truth):
        return F.lit(e.value)
    if isinstance(e, (All, Any_)):
        out = predicate(e.terms[0])
        for t in e.terms[1:]:
            out = out & predicate(t) if isinstance(e, All) else out | predicate(t)
        return out
    if isinstance(e, NullTest):
        return col(e.column).isNotNull() if e.negated else col(e.column).isNull()
    if isinstance(e, Edge):
        return equality(e)
    return comparison(e)


def equality(e: Edge) -> Column:
    a, b = col(e.left), col(e.right)
    return a.eqNullSafe(b) if e.left.nullable or e.right.nullable else a == b


def comparison(t: Test) -> Column:
    c, open_ = col(t.column), t.column.nullable
    if t.value is None:
        return {"=": c.isNull(), "!=": c.isNotNull(), ">": c.isNotNull(), ">=": F.lit(True), "<": F.lit(False), "<=": c.isNull()}[t.op]
    v = column_of(t.value, t.column.kind)
    if t.op in ("=", "!="):
        same = c.eqNullSafe(v) if open_ else c == v
        return same if t.op == "=" else ~c.eqNullSafe(v) if open_ else c != v
    out = {"<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v}[t.op]
    if not open_:
        return out
    return out | c.isNull() if t.op[0] == "<" else c.isNotNull() & out


def joined(plan: Plan, sources: Callable[[str], DataFrame] | list[Callable[[], DataFrame]], keep: tuple[str, ...] = (), shape: Callable[[DataFrame, int], DataFrame] = lambda rows, at: rows) -> DataFrame:
    """All relations joined and filtered, with every column, each relation as shape() returns it. Equalities of
    WHERE count as join conditions where nothing else links a relation, so no product is made where the
    statement has an equality. sources: by table, or for each relation what gives its rows."""
    own = sources if isinstance(sources, list) else [partial(sources, t.name) for t in plan.relations]
    terms = list(plan.where.terms) if isinstance(plan.where, All) else [plan.where]
    out = shape(relation(own[0](), plan, 0, keep), 0)
    for at in range(1, len(plan.relations)):
        right = shape(relation(own[at](), plan, at, keep), at)
        links = [plan.edges[at - 1]] if plan.edges[at - 1] else []
        links += [t for t in terms if isinstance(t, Edge) and max(t.left.relation, t.right.relation) == at and t.left.relation != t.right.relation]
        terms = [t for t in terms if t not in links]
        if links:
            on = equality(links[0])
            for e in links[1:]:
                on = on & equality(e)
            out = out.join(right, on)
        else:
            out = out.crossJoin(right)
    rest = All(tuple(terms)) if terms else Truth(True)
    return out if rest in (Truth(True), All((Truth(True),))) else out.where(predicate(rest))


def sums(c: Column, kind: Kind, nullable: bool) -> Column:
    """Signed sums are 64 bits, unsigned ones unsigned 64 bits, others doubles; overflow is an error. Over no
    value a sum is 0 where the column has no nulls, else null."""
    if kind.floating:
        out, zero = F.sum(c.cast("double")), F.lit(0.0)
    elif kind.signed:
        total = F.sum(c.cast("decimal(38,0)"))
        fits = total.between(F.lit(str(-(1 << 63))).cast("decimal(38,0)"), F.lit(str((1 << 63) - 1)).cast("decimal(38,0)"))
        if kind.bits < 64:
            total, fits = F.sum(c.cast("bigint")), None
        out, zero = total if fits is None else F.when(fits | total.isNull(), total).otherwise(F.raise_error("SUM aggregate overflowed Int64")).cast("bigint"), F.lit(0).cast("bigint")
    else:
        total = F.sum(c.cast("decimal(20,0)"))
        fits = total <= F.lit(str((1 << 64) - 1)).cast("decimal(38,0)")
        out = F.when(fits | total.isNull(), total).otherwise(F.raise_error("SUM aggregate overflowed Uint64")).cast("decimal(20,0)")
        zero = F.lit(0).cast("decimal(20,0)")
    return out if nullable else F.coalesce(out, zero)


def aggregate(rows: DataFrame, plan: Plan) -> DataFrame:
    a = plan.aggregate
    if a.column is None:
        value = F.count(F.lit(1))
    elif a.function == "SUM":
        value = sums(col(a.column), a.column.kind, a.column.nullable)
    else:
        value = F.count_distinct(col(a.column)) if a.distinct else F.count(col(a.column))
    return rows.agg(value.alias(a.name))


def canonical_keys(plan: Plan) -> list[Column]:
    """The last word on ties: the rows' own bytes, relation by relation."""
    return [k for at, t in enumerate(plan.relations) for c in t.columns for k in canonical_order(col(Col(at, c.name, c.kind, c.nullable)), c.kind)]


def order_keys(plan: Plan) -> list[Column]:
    return [col(c).desc() if down else col(c).asc() for c, down in plan.order] + canonical_keys(plan)


def paged(rows: DataFrame, limit: int | None, offset: int | None, keys: list[Column] | None = None) -> DataFrame:
    """Rows in the order of keys, without the first `offset`, at most `limit`; both are of any size. Short
    windows are a top-k. For others the rows are sorted by ranges and written as they lie, and the counts of
    the ranges tell which places of each belong to the window, so no task has more than a range."""
    ordered = rows.orderBy(*keys) if keys else rows
    skip = offset or 0
    if limit is None and not skip:
        return ordered
    if limit is not None and skip + limit <= MOST:
        return (ordered.offset(skip) if skip else ordered).limit(limit)
    total = rows.count()
    stop = total if limit is None else min(total, skip + limit)
    if skip >= stop:
        return rows.limit(0)
    if not skip and stop == total:
        return ordered
    lain = checkpointed(ordered.withColumn("_place", F.monotonically_increasing_id()))
    part, within = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    at, spans = 0, []
    for p, n in sorted((r["p"], r["n"]) for r in lain.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()):  # a row per range
        if at < stop and skip < at + n:
            spans.append((p, max(0, skip - at), min(n, stop - at)))
        at += n
    wanted = rows.sparkSession.createDataFrame(spans, "_p long, _low long, _high long")
    window = lain.join(F.broadcast(wanted), part == F.col("_p")).where((within >= F.col("_low")) & (within < F.col("_high")))
    return window.orderBy("_place").select(*rows.columns)


def output(rows: DataFrame, plan: Plan, *more: Column) -> DataFrame:
    return rows.select(*more, *(col(c).alias(n) for c, n in plan.output))


def run(plan: Plan, sources: Callable[[str], DataFrame]) -> DataFrame:
    """The plan's result over the tables that sources gives by name. Event tables hold no rows between
    transactions."""
    present = lambda t: sources(t).limit(0) if next(x for x in plan.relations if x.name == t).event else sources(t)
    if plan.aggregate and plan.aggregate.column is None and len(plan.relations) == 2 and plan.edges == (None,) and plan.where == Truth(True):
        # The count of a product is the product of counts.
        counts = [relation(present(t.name), plan, at).agg(F.count(F.lit(1)).alias(f"n{at}")) for at, t in enumerate(plan.relations)]
        return paged(counts[0].crossJoin(counts[1]).select((F.col("n0") * F.col("n1")).alias(plan.aggregate.name)), plan.limit, plan.offset)
    rows = joined(plan, present)
    if plan.aggregate:
        return paged(aggregate(rows, plan), plan.limit, plan.offset)
    if plan.order or plan.limit is not None or plan.offset is not None:
        rows = paged(rows, plan.limit, plan.offset, order_keys(plan))
    return output(rows, plan)


def bounded(result: DataFrame, rows: int | None = None, size: int | None = None) -> list:
    """A result for a host that limits its rows and their bytes as JSON: over a limit is an error, never a
    shorter result."""
    rows, size = ROWS if rows is None else rows, BYTES if size is None else size
    some = result.limit(rows + 1)
    check_size(some, rows, size, "result")
    got = some.collect()
    if len(got) > rows:
        raise LimitExceeded(f"result exceeded {rows} rows")
    return got


def check_size(result: DataFrame, rows: int | None, size: int | None, what: str) -> None:
    """Raises where a result has more rows or bytes; no more rows than that are looked at. None: no limit."""
    some = result if rows is None else result.limit(rows + 1)
    text = F.to_json(F.struct(*(F.col(f"`{c}`") for c in some.columns)), {"ignoreNullFields": "false"})
    n, total = some.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    if rows is not None and n > rows:
        raise LimitExceeded(f"{what} exceeded {rows} rows")
    if size is not None and total > size:
        raise LimitExceeded(f"{what} exceeded {size} bytes")


def check_work(plan: Plan, sources: Callable[[str], DataFrame], most: int) -> None:
    """Raises where a join of more than two relations makes more rows on its way than `most`, all steps
    together; no step is counted any further."""
    done = 0
    for n in range(2, len(plan.relations) + 1) if len(plan.relations) > 2 else ():
        terms = plan.where.terms if isinstance(plan.where, All) else (plan.where,)
        own = tuple(t for t in terms if not isinstance(t, (All, Any_, Truth)) and all(r < n for r in relations_of(t)))
        part = replace(plan, relations=plan.relations[:n], edges=plan.edges[: n - 1], visible=plan.visible[:n], where=All(own) if own else Truth(True))
        done += joined(part, sources).limit(most - done + 1).count()
        if done > most:
            raise LimitExceeded(f"a join of {len(plan.relations)} relations exceeded {most} rows of work")


def relations_of(term: object) -> list[int]:
    if isinstance(term, Edge):
        return [term.left.relation, term.right.relation]
    return [term.column.relation]
