"""Live views against brute force: after = before + delta for every transaction of random histories."""

import random
from collections import Counter

import pytest

from deltaloom import queries
from deltaloom.operators import live
from deltaloom.plans.analyzer import Analyzer
from deltaloom.plans.schema import Catalog, IndexDef, TableDef, columns

A = TableDef("a", columns(id="Int64", k="Int64?", v="Int64?"), (IndexDef("k", ("k",)),), policy="public")
B = TableDef("b", columns(k="Int64?", w="Int64"), (IndexDef("k", ("k",)),), policy="public")
C = TableDef("c", columns(w="Int64", name="String"), (IndexDef("w", ("w",)),), policy="public")
E = TableDef("e", columns(k="Int64?", note="String"), (IndexDef("k", ("k",)),), event=True, policy="public")
CATALOG = Catalog.of(A, B, C, E)
TXS = 10


def random_changes(seed):
    rng = random.Random(seed)
    out, rid = {t: [] for t in "abce"}, 0
    live_rows = {t: {} for t in "abc"}
    make = {
        "a": lambda: (rng.randrange(50), rng.choice([None, 0, 1, 2]), rng.choice([None, 1, 2, 3, 9])), "b": lambda: (rng.choice([None, 0, 1, 2]), rng.randrange(3)),
        "c": lambda: (rng.randrange(3), rng.choice("xyz")), "e": lambda: (rng.choice([None, 0, 1]), rng.choice("pq")),
    }
    for tx in range(1, TXS + 1):
        for t in "abce":
            for _ in range(rng.randrange(4)):
                rid += 1
                row = make[t]()
                out[t].append((*row, rid, tx, 1))
                if t != "e":
                    live_rows[t][rid] = row
                    if rng.random() < 0.15:  # gone in the same transaction
                        out[t].append((*live_rows[t].pop(rid), rid, tx, -1))
            if t != "e" and live_rows[t] and rng.random() < 0.6:
                gone = rng.choice(list(live_rows[t]))
                out[t].append((*live_rows[t].pop(gone), gone, tx, -1))
    return out


def frames(spark, changes):
    schema = {t.name: ", ".join(f"{c.name} {c.kind.spark}" for c in t.columns) + ", _rid long, _tx long, _w int" for t in (A, B, C, E)}
    made = {t: spark.createDataFrame(rows, schema[t]).coalesce(1).cache() for t, rows in changes.items()}
    return lambda name: live.history(made[name], [c.name for c in CATALOG.tables[name].columns], CATALOG.tables[name].event)


def at(changes, table, tx):
    """A table's rows after a transaction; an event table's are those of it alone."""
    if table == "e":
        return [r[:-3] for r in changes["e"] if r[-2] == tx]
    rows = {}
    for r in changes[table]:
        if r[-2] <= tx:
            rows[r[-3]] = r[:-3] if r[-1] > 0 else None
    return [r for r in rows.values() if r is not None]


def null_low(v):
    return (v is not None, v)


def canonical(row):
    """The order of row bytes for the small non-negative numbers and one-letter texts used here."""
    return tuple(null_low(x) for x in row)


def top(rows, key, limit, offset):
    for part in reversed(key):
        rows = sorted(rows, key=part[0], reverse=part[1])
    return rows[offset:][:limit]


VIEWS = {
    "SELECT * FROM a WHERE v < 3": lambda t: [r for r in t["a"] if r[2] is None or r[2] < 3],
    "SELECT v FROM a": lambda t: [(r[2],) for r in t["a"]],
    "SELECT a.* FROM a JOIN b ON a.k = b.k WHERE b.w != 1": lambda t: [r for r in t["a"] for x in t["b"] if r[1] == x[0] and x[1] != 1],
    "SELECT b.* FROM a CROSS JOIN b": lambda t: [x for _ in t["a"] for x in t["b"]],
    "SELECT x.* FROM a x JOIN a y ON x.k = y.k": lambda t: [r for r in t["a"] for x in t["a"] if r[1] == x[1]],
    "SELECT a.id, c.name FROM a JOIN b ON a.k = b.k JOIN c ON b.w = c.w": lambda t: [(r[0], y[1]) for r in t["a"] for x in t["b"] for y in t["c"] if r[1] == x[0] and x[1] == y[0]],
    "SELECT COUNT(*) AS n FROM a JOIN b ON a.k = b.k": lambda t: [(sum(r[1] == x[0] for r in t["a"] for x in t["b"]),)],
    "SELECT SUM(v) AS s FROM a": lambda t: [(sum(x) if (x := [r[2] for r in t["a"] if r[2] is not None]) else None,)],
    "SELECT SUM(w) AS s FROM b WHERE w > 0": lambda t: [(sum(x[1] for x in t["b"] if x[1] > 0),)],
    "SELECT COUNT(DISTINCT v) AS n FROM a": lambda t: [(len({r[2] for r in t["a"]} - {None}),)],
    "SELECT COUNT(v) AS n FROM a WHERE k = 1": lambda t: [(sum(r[1] == 1 and r[2] is not None for r in t["a"]),)],
    "SELECT * FROM a ORDER BY v DESC LIMIT 3 OFFSET 1": lambda t: top(t["a"], [(lambda r: null_low(r[2]), True), (canonical, False)], 3, 1),
    "SELECT id FROM a ORDER BY k, id DESC OFFSET 4": lambda t: [(r[0],) for r in top(t["a"], [(lambda r: null_low(r[1]), False), (lambda r: r[0], True), (canonical, False)], None, 4)],
    "SELECT * FROM a LIMIT 2": lambda t: top(t["a"], [(canonical, False)], 2, 0),
}


def evaluate(work, changes, tx):
    return Counter(work({t: at(changes, t, tx) for t in "abce"}))


@pytest.mark.parametrize("sql", VIEWS)
def test_deltas_take_every_version_to_the_next(spark, sql):
    for seed in (1, 2):
        changes = random_changes(seed)
        plan = Analyzer(CATALOG, None, "declared_view").plan(sql)
        got = {}
        for r in live.deltas(plan, frames(spark, changes)).collect():
            assert r["_n"] > 0
            got.setdefault(r["_tx"], {}).setdefault(r["_op"], Counter())[tuple(r)[3:]] += r["_n"]
        before = evaluate(VIEWS[sql], changes, 0)
        for tx in range(1, TXS + 1):
            after = evaluate(VIEWS[sql], changes, tx)
            assert got.get(tx, {}).get("insert", Counter()) == after - before, (sql, tx)
            assert got.get(tx, {}).get("delete", Counter()) == before - after, (sql, tx)
            before = after
    for since in (6, TXS - 1):
        later = {}
        for r in live.deltas(plan, frames(spark, changes), since=since).collect():
            later.setdefault(r["_tx"], {}).setdefault(r["_op"], Counter())[tuple(r)[3:]] += r["_n"]
        assert later == {tx: ops for tx, ops in got.items() if tx > since}, since
    if plan.aggregate:  # a value carried from batch to batch is the value as of then
        base, histories = None, frames(spark, changes)
        for since, upto in ((0, 4), (4, 7)):
            cut = {t: [r for r in rows if r[-2] <= upto] for t, rows in changes.items()}
            base = live.moved_base(plan, live.parts_of(frames(spark, cut), since), since, base)
        assert tuple(map(float, base)) == tuple(map(float, live.value_at(plan, live.parts_of(frames(spark, cut), 7), 7).first()))
        carried = Counter(map(tuple, live.deltas(plan, histories, 7, base=base).collect()))
        assert carried == Counter(map(tuple, live.deltas(plan, histories, 7).collect()))


def test_event_rows_come_and_never_go(spark):
    changes = random_changes(3)
    plan = Analyzer(CATALOG, None, "declared_view").plan("SELECT e.* FROM e JOIN a ON e.k = a.k")
    got = live.deltas(plan, frames(spark, changes)).collect()
    assert got and {r["_op"] for r in got} == {"insert"}
    for tx in range(1, TXS + 1):
        want = evaluate(lambda t: [r for r in t["e"] for x in t["a"] if r[0] == x[1]], changes, tx)
        assert Counter({tuple(r)[3:]: r["_n"] for r in got if r["_tx"] == tx}) == want


def test_an_aggregate_of_events_moves_from_its_value_without_them(spark):
    changes = random_changes(4)
    plan = Analyzer(CATALOG, None, "declared_view").plan("SELECT COUNT(*) AS n FROM e")
    got = {(r["_tx"], r["_op"]): r["n"] for r in live.deltas(plan, frames(spark, changes)).collect()}
    for tx in range(1, TXS + 1):
        n = len(at(changes, "e", tx))
        assert (got.get((tx, "delete")), got.get((tx, "insert"))) == ((0, n) if n else (None, None))


def test_a_batch_joins_what_changed_with_the_rest(spark):
    n = 4000
    made = spark.range(n).selectExpr("id", "id % 500 AS k", "id AS v", "id % 40 + 1 AS _from", "CASE WHEN id % 100 = 0 THEN 41L ELSE 9223372036854775807L END AS _to")
    plan = Analyzer(CATALOG, None, "declared_view").plan("SELECT x.id, x.v FROM a x JOIN a y ON x.k = y.k")
    rows = live.changes_after(plan, live.parts_of(lambda name: made, 39), 39)
    assert 0 < rows.count() < n  # of 8 n pairs
    branches = rows._jdf.queryExecution().optimizedPlan().toString().count("Join Inner")
    assert branches == 2


def test_snapshots_and_deltas_meet(spark):
    changes = random_changes(5)
    plan = Analyzer(CATALOG, None, "declared_view").plan("SELECT a.* FROM a JOIN b ON a.k = b.k")
    h = frames(spark, changes)
    bag = Counter()
    for r in live.snapshot(plan, h, 5).collect():
        bag[tuple(r)[3:]] += r["_n"]
    for r in live.deltas(plan, h, since=5).collect():
        bag[tuple(r)[3:]] += r["_n"] if r["_op"] == "insert" else -r["_n"]
    assert +bag == evaluate(lambda t: [r for r in t["a"] for x in t["b"] if r[1] == x[0]], changes, TXS) and not -bag


def test_views_that_cannot_change_are_not_evaluated():
    plans = {q: Analyzer(CATALOG, None, "declared_view").plan(q) for q in ("SELECT * FROM a WHERE k = 1", "SELECT * FROM a WHERE v > 1", "SELECT * FROM b")}
    assert live.candidates(plans, {"a": [{"id": 1, "k": 2, "v": 1}]}) == {"SELECT * FROM a WHERE v > 1"}
    assert live.candidates(plans, {"a": [{"id": 1, "k": 1, "v": 1}], "b": [{}]}) == set(plans)


def test_histories_hold_whole_tables(spark, sf_dir):
    tables = {"ev": "events", "usr": "customer", "nat": "nation", "ping": "events"}
    get = queries.histories(spark, sf_dir)
    for name in queries.HISTORIES:
        assert get(name).count() == spark.read.parquet(f"{sf_dir}/{tables[name]}.parquet").count(), name


def test_a_hot_key_costs_its_intervals(spark):
    n = 5000  # one key: 25 million pairs
    made = spark.range(n).selectExpr("id", "1L AS k", "id AS v", "id % 3 + 1 AS _from", "CASE WHEN id % 2 = 0 THEN 5L ELSE 9223372036854775807L END AS _to")
    plan = Analyzer(CATALOG, None, "declared_view").plan("SELECT x.k FROM a x JOIN a y ON x.k = y.k")
    assert live.intervals(plan, lambda name: made).count() <= 6 * n
    sizes = [sum(i % 3 + 1 <= tx and (tx < 5 or i % 2) for i in range(n)) for tx in range(7)]
    want = {tx: sizes[tx] ** 2 - sizes[tx - 1] ** 2 for tx in range(1, 7) if sizes[tx] != sizes[tx - 1]}
    assert {r["_tx"]: r["_n"] * (1 if r["_op"] == "insert" else -1) for r in live.deltas(plan, lambda name: made).collect()} == want
