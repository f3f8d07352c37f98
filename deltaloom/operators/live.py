"""Live views: what each transaction inserts into and deletes from a query's result, for many transactions in
one job.

A table's history is its rows with the interval of transactions [from, to) in which they are there, derived
from signed changes. A joined row is there while all its parts are: from the greatest `from` to the least
`to`. So the deltas of a join over any number of transactions are the ends of the joined intervals; equal
rows that come and go in one transaction cancel. Aggregates are running sums of signed rows over
transactions, windows are per-transaction ranks compared with the transaction before. A row of an event table
is there in its own transaction alone, and its end is no change.

Deltas after a transaction are made from what changed after it. A joined row matters if all its parts are
there later than that and one of them came or goes later; so the join is a union of joins with the changed
rows of one relation each - with rows that do not change of the relations before it, and all of those after.
Aggregates begin from the value as of that transaction, and a window of the first k rows needs, of the rows
that do not change, the first k.

Everything is keyed by transaction, value or row; the one running window without a key is over one row per
transaction that touched the view, after partial sums.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deltaloom.operators import lower
from deltaloom.plans.analyzer import All, Any_, Col, Edge, NullTest, Plan, Test

#: The end of rows that are still there.
END = (1 << 63) - 1


def history(changes: DataFrame, columns: list[str], event: bool = False, since: int = 0) -> DataFrame:
    """(columns, _from, _to) from changes (columns, _rid, _tx, _w): w is 1 for an insert, -1 for a delete of
    the row with that surrogate. A row that a transaction both inserts and deletes never was. Of changes
    after `since` alone, rows that were there before begin at `since`."""
    if event:
        return changes.where("_w > 0").select(*columns, F.col("_tx").alias("_from"), (F.col("_tx") + 1).alias("_to"))
    named = [F.first(F.col(f"`{c}`")).alias(c) for c in columns]
    begin, stop = F.min(F.when(F.col("_w") > 0, F.col("_tx"))), F.min(F.when(F.col("_w") < 0, F.col("_tx")))
    rows = changes.groupBy("_rid").agg(*named, F.coalesce(begin, F.lit(since)).alias("_from"), F.coalesce(stop, F.lit(END)).alias("_to"))
    return rows.where("_from < _to").select(*columns, "_from", "_to")


Histories = Callable[[str], DataFrame]
#: The part of a table's history that a batch after some transaction asks for, by table and part: "changed" rows
#: came or go after it, "still" rows do neither but are there, and "later" rows are both.
Parts = Callable[[str, str], DataFrame]


def parts_of(histories: Histories, since: int) -> Parts:
    """The parts of whole histories; the tests on _from and _to reach the scan."""
    moves = (F.col("_from") > since) | (F.col("_to") < END)

    def get(name: str, part: str) -> DataFrame:
        rows = histories(name).where(F.col("_to") > since)
        return rows if part == "later" else rows.where(moves if part == "changed" else ~moves)

    return get


def _named(e: object) -> list[Col]:
    """The columns of a predicate."""
    if isinstance(e, (All, Any_)):
        return [c for t in e.terms for c in _named(t)]
    if isinstance(e, Edge):
        return [e.left, e.right]
    return [e.column] if isinstance(e, (Test, NullTest)) else []


def intervals(plan: Plan, histories: Histories | list[Callable[[], DataFrame]]) -> DataFrame:
    """Joined rows with _from and _to of the whole, _m: how often, and _event: whether an event's row takes part.
    Of a joined relation that shows no column, rows alike in what the joins and tests read are one row before
    the join, so a hot key costs its different intervals, not its rows. histories: by table, or for each
    relation what gives its rows."""
    n = range(len(plan.relations))
    many = len(plan.relations) > 1
    shown = {c.relation for c, _ in plan.output} | ({plan.aggregate.column.relation} if plan.aggregate and plan.aggregate.column else set())
    read = [c for e in (plan.where, *(e for e in plan.edges if e)) for c in _named(e)]

    def fold(rows: DataFrame, at: int) -> DataFrame:
        if not many or at in shown:
            return rows.withColumn(f"r{at}_m", F.lit(1).cast("long"))
        names = dict.fromkeys(lower.name_of(c) for c in read if c.relation == at)
        return rows.groupBy(*(F.col(f"`{c}`") for c in names), f"r{at}_from", f"r{at}_to").agg(F.count("*").alias(f"r{at}_m"))

    rows = lower.joined(plan, histories, ("_from", "_to"), fold)
    often = functools.reduce(lambda a, b: a * b, (F.col(f"r{i}_m") for i in n))
    start = F.greatest(*(F.col(f"r{i}_from") for i in n)) if many else F.col("r0_from")
    stop = F.least(*(F.col(f"r{i}_to") for i in n)) if many else F.col("r0_to")
    event = F.lit(any(t.event for t in plan.relations))
    return rows.withColumns({"_from": start, "_to": stop, "_m": often, "_event": event}).where("_from < _to")


def signed(rows: DataFrame) -> DataFrame:
    """The ends of intervals as signed rows (_tx, _w)."""
    ends = F.array(
        F.struct(F.col("_from").alias("tx"), F.col("_m").alias("w")),
        F.struct(F.when((F.col("_to") < END) & ~F.col("_event"), F.col("_to")).alias("tx"), (-F.col("_m")).alias("w")),
    )
    return rows.withColumn("_end", F.explode(ends)).where("_end.tx is not null").withColumns({"_tx": F.col("_end.tx"), "_w": F.col("_end.w")}).drop("_end")


def netted(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(columns, _tx, _w) with equal rows of a transaction in one and those that cancel gone."""
    keys = [F.col(f"`{c}`") for c in columns]
    return rows.groupBy("_tx", *keys).agg(F.sum("_w").alias("_w")).where("_w <> 0")


def changes_after(plan: Plan, parts: Parts, since: int) -> DataFrame:
    """The signed rows of the joined relations (as signed() gives them) of transactions after `since`."""
    n = len(plan.relations)
    out = None
    for k in range(n if since else 1):
        own = [functools.partial(parts, t.name, "later" if not since or at > k else "changed" if at == k else "still") for at, t in enumerate(plan.relations)]
        one = intervals(plan, own)
        out = one if out is None else out.unionByName(one)
    return signed(out).where(F.col("_tx") > since)


def deltas(plan: Plan, histories: Histories | None, since: int = 0, parts: Parts | None = None, base: tuple | None = None) -> DataFrame:
    """(_tx, _op, _n, columns): per transaction after `since`, the rows inserted and deleted, each with how
    often. parts: instead of whole histories, what gives parts of them. base: an aggregate's sum and number of
    values as of `since`, where they are known."""
    parts = parts or parts_of(histories, since)
    if plan.aggregate:
        out = _aggregate(plan, parts, since, base)
    elif (plan.order or plan.limit is not None or plan.offset is not None) and not plan.relations[0].event:
        out = _window(plan, parts, since)
    else:
        names = [n for _, n in plan.output]
        out = netted(lower.output(changes_after(plan, parts, since), plan, F.col("_tx"), F.col("_w")), names)
    names = [c for c in out.columns if c not in ("_tx", "_w")]
    op = F.when(F.col("_w") > 0, "insert").otherwise("delete")
    return out.select("_tx", op.alias("_op"), F.abs("_w").alias("_n"), *names)


def snapshot(plan: Plan, histories: Histories, at: int, op: str = "insert") -> DataFrame:
    """The result as of a transaction, as the inserts a subscriber begins with or the deletes it ends with."""
    live = lambda name: histories(name).where((F.col("_from") <= at) & (at < F.col("_to"))).drop("_from", "_to")
    rows = lower.run(plan, live)
    if plan.aggregate:
        return rows.select(F.lit(at).cast("long").alias("_tx"), F.lit(op).alias("_op"), F.lit(1).cast("long").alias("_n"), "*")
    names = rows.columns
    return rows.groupBy(*(F.col(f"`{c}`") for c in names)).agg(F.count("*").alias("_n")).select(F.lit(at).cast("long").alias("_tx"), F.lit(op).alias("_op"), "_n", *names)


def _there(plan: Plan, parts: Parts, since: int) -> DataFrame:
    """The joined rows that are there as of `since`, each with _m, how often."""
    return intervals(plan, [functools.partial(parts, t.name, "later") for t in plan.relations]).where(F.col("_from") <= since)


def _measures(plan: Plan) -> tuple:
    """An aggregate's value, the type its sums are exact in, and the sums over rows (v, _w)."""
    a = plan.aggregate
    summed = a.function == "SUM"
    exact = "double" if summed and a.column.kind.floating else "decimal(38,0)"
    known = F.sum(F.when(F.col("v").isNotNull(), F.col("_w")).otherwise(0)).cast("decimal(38,0)")
    part = F.sum(F.col("v").cast(exact) * F.col("_w").cast(exact)).cast(exact) if summed else known
    return lower.col(a.column) if a.column else F.lit(1), exact, [F.coalesce(part, F.lit(0).cast(exact)).alias("x"), F.coalesce(known, F.lit(0).cast("decimal(38,0)")).alias("n")]


def _steps(plan: Plan, parts: Parts, since: int) -> DataFrame:
    """(_tx, x, n): how much each transaction after `since` adds to an aggregate's sum and number of values."""
    value, _, sums = _measures(plan)
    rows = changes_after(plan, parts, since).select("_tx", "_w", value.alias("v"))
    if plan.aggregate.distinct:
        # One row per value and transaction; a value counts from when its rows are more than none. Values that
        # the transactions touch begin with the rows they had.
        per = rows.where("v is not null").groupBy("v", "_tx").agg(F.sum("_w").alias("w"))
        if any(t.event for t in plan.relations):
            rows = per.select("_tx", F.lit(1).cast("long").alias("_w"), F.lit(1).alias("v"))
        else:
            if since:
                had = _there(plan, parts, since).select(value.alias("v"), "_m").join(per.select("v").distinct(), "v", "left_semi")
                per = per.unionByName(had.groupBy("v").agg(F.sum("_m").alias("w")).select("v", F.lit(since).cast("long").alias("_tx"), "w"))
            w = Window.partitionBy("v").orderBy("_tx")
            now = F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, 0))
            per = per.withColumn("now", now).withColumn("was", F.coalesce(F.lag("now").over(w), F.lit(0)))
            rows = per.select("_tx", ((F.col("now") > 0).cast("long") - (F.col("was") > 0).cast("long")).alias("_w"), F.lit(1).alias("v")).where(F.col("_tx") > since)
    return rows.groupBy("_tx").agg(*sums)


def value_at(plan: Plan, parts: Parts, since: int) -> DataFrame:
    """(x, n), one row: an aggregate's sum and number of values as of `since`."""
    value, exact, sums = _measures(plan)
    rows = _there(plan, parts, since).select(value.alias("v"), F.col("_m").alias("_w"))
    if plan.aggregate.distinct:
        return rows.agg(F.count_distinct("v").cast(exact).alias("x"), F.count_distinct("v").cast("decimal(38,0)").alias("n"))
    return rows.agg(*sums)


def moved_base(plan: Plan, parts: Parts, since: int, base: tuple | None) -> tuple | None:
    """An aggregate's sum and number of values after the transactions that follow `since`; base: those as of it.
    Aggregates of events carry nothing on."""
    if any(t.event for t in plan.relations):
        return None
    x, n = base or ((0, 0) if not since else value_at(plan, parts, since).first())
    step = _steps(plan, parts, since).agg(F.sum("x"), F.sum("n")).first()
    return x + (step[0] or 0), n + (step[1] or 0)


def _aggregate(plan: Plan, parts: Parts, since: int, base: tuple | None) -> DataFrame:
    """-old +new where the value changed. Values are running sums over the transactions that touched the view;
    an event's rows count in their own transaction only, from the values without them."""
    a = plan.aggregate
    event = any(t.event for t in plan.relations)
    _, exact, _ = _measures(plan)
    per = _steps(plan, parts, since)
    if since and not event:
        if base is None:
            first = value_at(plan, parts, since)
        else:
            first = per.sparkSession.range(1).select(F.lit(str(base[0])).cast(exact).alias("x"), F.lit(str(base[1])).cast("decimal(38,0)").alias("n"))
        per = per.unionByName(first.select(F.lit(since).cast("long").alias("_tx"), "x", "n"))
    over = Window.orderBy("_tx").rowsBetween(Window.unboundedPreceding, 0)
    total = lambda c: F.col(c) if event else F.sum(c).over(over)
    per = per.select("_tx", total("x").alias("x"), total("n").alias("n"))
    summed = a.function == "SUM"
    kind = a.column.kind if a.column else None
    if summed and not kind.floating:
        lo, hi, name = (-(1 << 63), (1 << 63) - 1, "Int64") if kind.signed else (0, (1 << 64) - 1, "Uint64")
        inside = F.col("x").between(F.lit(str(lo)).cast("decimal(38,0)"), F.lit(str(hi)).cast("decimal(38,0)"))
        per = per.withColumn("x", F.when(inside, F.col("x")).otherwise(F.raise_error(f"SUM aggregate overflowed {name}")))
    spark_type = ("double" if kind.floating else "bigint" if kind.signed else "decimal(20,0)") if summed else "bigint"
    shown = F.col("x").cast(spark_type)
    if summed and a.column.nullable:
        shown = F.when(F.col("n") > 0, shown)
    none = F.lit(None).cast(spark_type) if summed and a.column.nullable else F.lit(0).cast(spark_type)
    by = Window.orderBy("_tx")
    per = per.select("_tx", shown.alias("now"))
    was = none if event else F.when(F.row_number().over(by) == 1, none).otherwise(F.lag("now").over(by))
    per = per.withColumn("was", was).where(~F.col("now").eqNullSafe(F.col("was")) & (F.col("_tx") > since))
    both = F.array(F.struct(F.lit(-1).cast("long").alias("w"), F.col("was").alias("v")), F.struct(F.lit(1).cast("long").alias("w"), F.col("now").alias("v")))
    out = per.select("_tx", F.explode(both).alias("e")).select("_tx", F.col("e.w").alias("_w"), F.col("e.v").alias(a.name))
    if plan.limit == 0 or plan.offset:
        return out.limit(0)
    return out


def _window(plan: Plan, parts: Parts, since: int) -> DataFrame:
    """Membership of an ordered window of one table, per transaction after `since` that touched its rows,
    against the touched one before it, or `since` itself. Of the rows that do not change, those behind the
    first `offset + limit` (`offset` without a limit) are members always or never: they take no part."""
    bare = replace(plan, order=(), limit=None, offset=None)
    name = plan.relations[0].name
    keys = lower.order_keys(plan)
    lo = plan.offset or 0
    rows = intervals(bare, [functools.partial(parts, name, "changed" if since else "later")])
    if since:
        still = intervals(bare, [functools.partial(parts, name, "still")])
        rows = rows.unionByName(lower.paged(still, lo + (plan.limit or 0), None, keys))
    # The transactions that touched the rows, numbered; a row's life is a range of numbers, as it begins and
    # ends at such transactions. Equal joins give the range, and the rows are spread over it.
    touched = signed(rows).where(F.col("_tx") > since).select("_tx").distinct()
    touched = touched.unionByName(touched.sparkSession.range(1).select(F.lit(since).cast("long").alias("_tx")))
    step = Window.orderBy("_tx")
    steps = touched.select("_tx", F.row_number().over(step).alias("i"), F.lead("_tx").over(step).alias("next"))
    begin = steps.select(F.col("_tx").alias("_begin"), F.col("i").alias("i_from"))
    stop = steps.select(F.col("_tx").alias("_to"), F.col("i").alias("i_to"))
    count = touched.agg((F.count("*") + 1).alias("i_end"))
    spans = rows.withColumn("_begin", F.greatest("_from", F.lit(since))).join(begin, "_begin").join(stop, "_to", "left").crossJoin(F.broadcast(count))  # one row
    spread = F.explode(F.sequence(F.col("i_from"), F.coalesce("i_to", "i_end") - 1))
    live = spans.withColumn("i", spread).join(steps, "i")
    rank = F.row_number().over(Window.partitionBy("_tx").orderBy(*keys))
    inside = F.col("_rank") > lo
    if plan.limit is not None:
        inside = inside & (F.col("_rank") <= lo + plan.limit)
    members = live.withColumn("_rank", rank).where(inside)
    shown = lower.output(members, plan, F.col("_tx"), F.col("next"))
    both = F.array(F.struct(F.col("_tx").alias("t"), F.lit(1).cast("long").alias("w")), F.struct(F.col("next").alias("t"), F.lit(-1).cast("long").alias("w")))
    names = [n for _, n in plan.output]
    moved = shown.withColumn("_e", F.explode(both)).where("_e.t is not null").select(F.col("_e.t").alias("_tx"), F.col("_e.w").alias("_w"), *names)
    return netted(moved.where(F.col("_tx") > since), names)


def touches(views: dict[str, Plan]) -> list[tuple[str, str, str, object]]:
    """(view, table, column, value): equality tests that every row a view can change for must pass; a view
    without one for a table has (view, table, "", None)."""
    out = []
    for name, plan in views.items():
        terms = plan.where.terms if isinstance(plan.where, All) else (plan.where,)
        for at, table in enumerate(plan.relations):
            tests = [t for t in terms if isinstance(t, Test) and t.op == "=" and t.column.relation == at]
            out.append((name, table.name, tests[0].column.name, tests[0].value) if tests else (name, table.name, "", None))
    return out


def candidates(views: dict[str, Plan], changed: dict[str, list[dict]]) -> set[str]:
    """Views that changed rows (per table, small) can matter to; the others need no evaluation."""
    return {v for v, table, column, value in touches(views) if any(not column or row.get(column) == value for row in changed.get(table, []))}


def applied(before: DataFrame, delta: DataFrame) -> DataFrame:
    """The bag after deltas: what was there, and what they inserted, without what they deleted."""
    names = before.columns
    each = lambda op: delta.where(F.col("_op") == op).select(*names, F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_i")).drop("_i")
    return before.unionAll(each("insert")).exceptAll(each("delete"))
