"""Transactions, constraints, recovery, the runtime and streamed views."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from deltaloom.functions.kinds import KINDS
from deltaloom.operators import lower
from deltaloom.plans.analyzer import Analyzer
from deltaloom.plans.errors import ConstraintError, KindError, LimitExceeded, PlanError
from deltaloom.plans.schema import Caller, Catalog, IndexDef, SchemaError, TableDef, columns
from deltaloom.runtime import Denied, Module, Parameter, Runtime
from deltaloom.sources.store import Store
from deltaloom.streaming.views import Limits, Views, stream

PLAYERS = TableDef("players", columns(id="Uint64 primary autoincrement", name="String", team="Int32?"), (IndexDef("by_name", ("name",), True), IndexDef("by_team", ("team",))), policy="public")
PAIRS = TableDef("pairs", columns(a="Int32?", b="String"), policy="public")
NOTES = TableDef("notes", columns(player="Uint64", text="String"), event=True, policy="public")


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path), Catalog.of(PLAYERS, PAIRS, NOTES))


def bag(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_transactions(store):
    tx = store.begin()
    one = tx.insert("players", {"id": 0, "name": "ann", "team": None})
    tx.insert("players", {"id": 7, "name": "bob", "team": 1})
    three = tx.insert("players", {"id": 0, "name": "cat", "team": 1})
    assert tx.row("players", three)["id"] == 8
    for row in ({"id": 7, "name": "x", "team": 1}, {"id": 0, "name": "ann", "team": 2}):
        with pytest.raises(ConstraintError):
            tx.insert("players", row)
    with pytest.raises(KindError):
        tx.insert("players", {"id": 0, "name": None, "team": 1})
    tx.delete("players", three)
    with pytest.raises(ConstraintError):
        tx.delete("players", three)
    assert bag(tx.rows("players").select("id", "name")) == [(1, "ann"), (7, "bob")]
    assert tx.commit() == 1 and bag(store.table("players")) == [(1, "ann", None), (7, "bob", 1)]
    tx = store.begin()
    with pytest.raises(ConstraintError):
        tx.insert("players", {"id": 0, "name": "bob", "team": None})
    assert tx.insert("players", {"id": 0, "name": "dan", "team": None}) and tx.update("players", one, {"id": 1, "name": "ann", "team": 5}) != one
    with pytest.raises(ConstraintError):
        tx.update("players", 2, {"id": 7, "name": "dan", "team": 5})
    assert tx.row("players", 2)["name"] == "bob"
    tx.rollback()
    assert store.version == 1 and store.count("players") == 2
    tx = store.begin()
    tx.delete("players", one)
    assert tx.insert("players", {"id": 1, "name": "ann", "team": None}) == one  # it was never gone
    assert tx.commit() == 2 and store.changes("players", 1).count() == 0


def test_set_semantics_and_null_keys(store):
    tx = store.begin()
    tx.insert("pairs", {"a": None, "b": "x"})
    with pytest.raises(ConstraintError):
        tx.insert("pairs", {"a": None, "b": "x"})
    tx.insert("pairs", {"a": 1, "b": "x"})
    tx.commit()
    tx = store.begin()
    with pytest.raises(ConstraintError):
        tx.insert("pairs", {"a": None, "b": "x"})
    assert bag(store.seek("pairs", a=None).select("b")) == [("x",)]
    assert store.scan_range("pairs", ["a", "b"], (None, "w"), (1,), low_open=True, high_open=True).count() == 1
    assert store.scan_range("pairs", ["a"], None, (1,)).count() == 2 and store.scan_range("pairs", ["a"], (1,)).count() == 1


def test_bulk_inserts(store, spark):
    tx = store.begin()
    tx.insert_many("players", spark.range(100).selectExpr("cast(0 as decimal(20,0)) id", "concat('n', id) name", "cast(id % 3 as int) team").repartition(5))
    assert tx.commit() == 1
    ids = [r[0] for r in store.rows("players").select("_rid").collect()]
    assert sorted(ids) == list(range(1, 101)) and sorted(int(r[0]) for r in store.table("players").select("id").collect()) == list(range(1, 101))
    for rows in (spark.sql("select cast(0 as decimal(20,0)) id, 'n5' name, 1 team"), spark.sql("select cast(0 as decimal(20,0)) id, 'q' name, 1 team union all select cast(0 as decimal(20,0)), 'q', 2")):
        with pytest.raises(ConstraintError):
            store.begin().insert_many("players", rows)
    with pytest.raises(KindError):
        store.begin().insert_many("players", spark.sql("select cast(0 as decimal(20,0)) id, cast(null as string) name, 1 team"))


def test_writers_that_cross(store):
    one, two = store.begin(), store.begin()
    one.insert("players", {"id": 0, "name": "ann", "team": None})
    two.insert("players", {"id": 0, "name": "ann", "team": 3})
    one.commit()
    with pytest.raises(ConstraintError):
        two.commit()
    assert store.version == 1


def test_recovery_snapshots_and_compaction(store, spark, tmp_path):
    for i in range(4):
        tx = store.begin()
        tx.insert("players", {"id": 0, "name": f"n{i}", "team": i})
        tx.insert("notes", {"player": i, "text": "hello"})
        if i == 2:
            tx.delete("players", 1)
        tx.commit()
        if i == 1:
            store.snapshot()
            assert store.compact() == 2
    assert store.table("notes").count() == 0 and store.changes("notes", 2).count() == 2
    again = Store(spark, str(tmp_path), Catalog.of(PLAYERS, PAIRS, NOTES))
    want = [(2, "n1", 1), (3, "n2", 2), (4, "n3", 3)]
    assert again.version == 4 and bag(again.table("players")) == bag(store.table("players")) and [(int(a), b, c) for a, b, c in bag(again.table("players"))] == want
    assert again.table("players", 3).count() == 2
    again.backup(str(tmp_path / "copy"))
    with pytest.raises(FileExistsError):
        again.backup(str(tmp_path / "copy"))
    assert bag(Store.restore(spark, str(tmp_path / "copy"), str(tmp_path / "new"), Catalog.of(PLAYERS, PAIRS, NOTES)).table("players")) == bag(again.table("players"))
    tx = again.begin()
    assert tx.row("players", tx.insert("players", {"id": 0, "name": "new", "team": None}))["id"] == 5
    log = tmp_path / "log"
    (log / f"{5:020d}.json").write_text('{"tx": 5, "tab')  # a torn tail
    assert Store(spark, str(tmp_path), Catalog.of(PLAYERS, PAIRS, NOTES)).version == 4
    assert not (log / f"{5:020d}.json").exists()
    (log / f"{3:020d}.json").write_text("broken")
    with pytest.raises(RuntimeError):
        Store(spark, str(tmp_path), Catalog.of(PLAYERS, PAIRS, NOTES))
    with pytest.raises(SchemaError):
        Store(spark, str(tmp_path), Catalog.of(PAIRS, NOTES))


def test_bulk_deletes_and_updates(store, spark):
    tx = store.begin()
    tx.insert_many("players", spark.range(50).selectExpr("cast(id + 1 as decimal(20,0)) id", "concat('n', id) name", "cast(id % 3 as int) team"))
    tx.commit()
    tx = store.begin()
    assert tx.delete_many("players", tx.seek("players", team=0)) == 17 and tx.rows("players").count() == 33
    with pytest.raises(ConstraintError):
        tx.delete_many("players", store.seek("players", team=0))
    tx.update_many("players", tx.seek("players", team=1).selectExpr("_rid", "id", "upper(name) name", "9 team"))
    with pytest.raises(ConstraintError):  # two rows of one name: nothing changes
        tx.update_many("players", tx.seek("players", team=2).selectExpr("_rid", "id", "'same' name", "team"))
    assert tx.seek("players", team=2).count() == 16
    tx.commit()
    assert store.version == 2 and not [n for n in store.files.names("staging")]
    got = bag(store.table("players").selectExpr("cast(id as int) id", "name", "team"))
    assert got == sorted(((i + 1, f"N{i}" if i % 3 == 1 else f"n{i}", 9 if i % 3 == 1 else 2) for i in range(50) if i % 3), key=repr)
    tx = store.begin()  # what is deleted and given again was never gone
    rows = tx.seek("players", team=2)
    kept = rows.drop("_rid").collect()
    rids = sorted(r["_rid"] for r in rows.select("_rid").collect())
    tx.delete_many("players", rows)
    tx.insert_many("players", spark.createDataFrame(kept, store.table("players").schema))
    tx.commit()
    assert store.changes("players", 2).count() == 0 and sorted(r["_rid"] for r in store.seek("players", team=2).select("_rid").collect()) == rids


def test_bulk_writers_that_cross(store, spark):
    many = lambda lo, hi: spark.range(lo, hi).selectExpr("cast(0 as decimal(20,0)) id", "concat('n', id) name", "1 team")
    one, two, three = store.begin(), store.begin(), store.begin()
    one.insert_many("players", many(0, 20))
    two.insert_many("players", many(15, 30))
    three.insert_many("players", many(40, 60))
    three.insert("pairs", {"a": 1, "b": "x"})
    one.commit()
    with pytest.raises(ConstraintError):
        two.commit()
    two.rollback()
    assert three.commit() == 2
    rows = store.rows("players").collect()
    assert len({r["_rid"] for r in rows}) == len({r["id"] for r in rows}) == 40 and store.files.names("staging") == []
    four, five = store.begin(), store.begin()
    four.delete_many("players", store.seek("players", name="n3"))
    five.delete_many("players", store.seek("players", name="n3"))
    four.commit()
    with pytest.raises(ConstraintError):
        five.commit()


def test_damage_is_found(store, spark, tmp_path):
    catalog = Catalog.of(PLAYERS, PAIRS, NOTES)
    for i in range(3):
        tx = store.begin()
        tx.insert("pairs", {"a": i, "b": "x"})
        tx.commit()
        store.snapshot()
    assert store.verify() == [] and len(store.snapshots) == 3
    newest = max(store.snapshots)[1]
    part = next((tmp_path / newest / "pairs").glob("*.parquet"))
    whole = part.read_bytes()
    part.write_bytes(whole[:-5])  # a snapshot that lost its end: the one before it and the log serve
    again = Store(spark, str(tmp_path), catalog)
    assert len(again.snapshots) == 2 and again.version == 3 and again.table("pairs").count() == 3
    part.write_bytes(whole)
    swapped = next((tmp_path / store.log[2]["tables"]["pairs"]).glob("*.parquet"))
    held = swapped.read_bytes()
    swapped.write_bytes(held[:-20])  # rows of a sealed transaction
    with pytest.raises(RuntimeError, match="damaged"):
        Store(spark, str(tmp_path), catalog)
    swapped.write_bytes(held)
    text = (tmp_path / "log" / f"{1:020d}.json").read_text()
    (tmp_path / "log" / f"{1:020d}.json").write_text(text.replace('"tx": 1', '"tx": 7'))
    with pytest.raises(RuntimeError, match="damaged"):
        Store(spark, str(tmp_path), catalog)


def test_views_across_snapshots_compaction_and_restarts(spark, tmp_path):
    catalog = Catalog.of(PAIRS)
    store = Store(spark, str(tmp_path), catalog)
    views = Views(store)
    plans = {sql: Analyzer(catalog, None, "declared_view").plan(sql) for sql in ("SELECT * FROM pairs", "SELECT COUNT(*) AS n FROM pairs", "SELECT b FROM pairs ORDER BY a DESC LIMIT 2", "SELECT COUNT(DISTINCT b) AS n FROM pairs")}

    def write(*changes):
        tx = store.begin()
        for w, a, b in changes:
            if w > 0:
                tx.insert("pairs", {"a": a, "b": b})
            else:
                tx.delete("pairs", store.seek("pairs", a=a, b=b).first()["_rid"])
        tx.commit()

    write((1, 1, "x"), (1, 2, "y"), (1, 3, "z"))
    seen = {k: Counter() for k in plans}
    for sql, p in plans.items():
        for r in views.subscribe("me", sql, [p])[p.key()].collect():
            seen[sql][tuple(r)[3:]] += r["_n"]

    def check(got):
        for sql, p in plans.items():
            for r in got[p.key()].collect() if p.key() in got else ():
                seen[sql][tuple(r)[3:]] += r["_n"] * (1 if r["_op"] == "insert" else -1)
            want = Counter(tuple(r) for r in lower.run(p, store.table).collect())
            assert +seen[sql] == want and not -seen[sql], sql

    write((-1, 2, "y"))
    store.snapshot()
    write((1, 5, "x"))
    store.compact()  # the views still need the delete
    check(views.advance())
    write((-1, 5, "x"), (1, 6, "w"))
    store.snapshot()
    write((1, 7, "w"), (-1, 1, "x"))
    held = views.batch
    with pytest.raises(OSError):  # a sink that fails: nothing moves on
        views.deliver(4, store.version, lambda rows: (_ for _ in ()).throw(OSError("full")))
    upto = store.version
    write((1, 8, "v"))
    again = Views(Store(spark, str(tmp_path), catalog))  # a new process runs the same batch, with its range
    assert held is None and again.batch["upto"] == upto and again.store.compact() >= 0
    got = []
    again.deliver(4, store.version, lambda rows: got.extend(rows.collect()))
    assert {r["_tx"] for r in got} <= set(range(upto - 1, upto + 1)) and len(got) > 3
    check(views.advance())
    again.deliver(4, store.version, lambda rows: None)  # and once more: the same
    assert all(v.since == upto for v in again.views.values())


def test_a_view_that_fails_goes_and_the_others_stay(spark, tmp_path):
    wide = TableDef("wide", columns(id="Int64 primary", x="Int64"), policy="public")
    catalog = Catalog.of(wide)
    store = Store(spark, str(tmp_path), catalog)
    views = Views(store)
    plan = lambda sql: Analyzer(catalog, None, "declared_view").plan(sql)
    views.subscribe("me", "sum", [plan("SELECT SUM(x) AS s FROM wide")])
    views.subscribe("me", "all", [plan("SELECT * FROM wide")])
    tx = store.begin()
    for i in range(3):
        tx.insert("wide", {"id": i + 1, "x": (1 << 62)})
    tx.commit()
    got = []
    views.deliver(0, 1, lambda rows: got.extend(rows.collect()))
    assert {r["subscription"] for r in got} == {"all"} and [e[:2] for e in views.errors] == [("me", "sum")] and len(views.views) == 1


def test_limits_are_errors(spark, tmp_path):
    r = Runtime(spark, str(tmp_path), Module(Catalog.of(PAIRS)), limits=Limits(bytes=200, work=30))
    tx = r.store.begin()
    tx.insert_many("pairs", spark.range(6).selectExpr("cast(id % 2 as int) a", "concat('name', id) b"))
    tx.commit()
    assert len(r.answer("SELECT * FROM pairs WHERE a = 0")) == 3
    with pytest.raises(LimitExceeded, match="200 bytes"):
        r.answer("SELECT * FROM pairs a JOIN pairs b ON a.a = b.a JOIN pairs c ON b.b = c.b".replace("*", "a.*").replace("JOIN pairs c ON b.b = c.b", ""))
    with pytest.raises(LimitExceeded, match="work"):
        r.answer("SELECT COUNT(*) AS n FROM pairs a JOIN pairs b ON a.a = b.a JOIN pairs c ON b.a = c.a")


def test_migrations_run_once(spark, tmp_path):
    runs = []
    for _ in range(2):
        m = Module(Catalog.of(PAIRS))
        m.migrations = [lambda ctx: (runs.append(1), ctx.db.insert("pairs", {"a": len(runs), "b": "m"}))]
        r = Runtime(spark, str(tmp_path), m)
    assert runs == [1] and r.read("pairs").count() == 1 and r.read("sys_migrations").count() == 1


@pytest.mark.parametrize(("limit", "offset"), [(None, 5), (3, None), (3, 6), (100, 0), (4, 98), (100, 99), (5, 1 << 63), (1 << 63, 90), (None, None), (0, 4)])
def test_windows_beyond_the_top_k_equal_those_within(spark, monkeypatch, limit, offset):
    rows = spark.range(100).selectExpr("(id * 37) % 100 AS k", "id").repartition(7)
    want = [r["k"] for r in sorted(rows.collect(), key=lambda r: r["k"])][offset or 0 :][:limit]
    for most in (lower.MOST, 2):
        monkeypatch.setattr(lower, "MOST", most)
        assert [r["k"] for r in lower.paged(rows, limit, offset, [F.col("k")]).collect()] == want


ALL = Caller(allow_all=True)


def module():
    m = Module(Catalog.of(PLAYERS, NOTES))
    m.catalog.add_filter("players", "team = 1")
    m.catalog.add_filter("players", "name = :sender")

    @m.reducer("join")
    def join(ctx, args):
        ctx.db.insert("players", {"id": 0, "name": args.decode(), "team": 1})
        if args == b"bad":
            raise ValueError("bad")

    @m.reducer("later", "staff")
    def later(ctx, args):
        return ctx.schedule_repeat("join", args, 10, 5) if args == b"again" else ctx.schedule("join", args, 10)

    @m.procedure("two")
    def two(runtime, args):
        runtime.call("join", b"p1")
        runtime.call("join", b"p2")

    m.read("team", "SELECT id, name FROM players WHERE team = :team", (Parameter("team", KINDS["Int32"], True),))
    m.read("count", "SELECT COUNT(*) AS n FROM players", live=True)
    m.read("only_a_name")
    m.read("secret", "SELECT * FROM players", permissions=("staff",))
    return m


def test_runtime(spark, tmp_path):
    now = [0]
    r = Runtime(spark, str(tmp_path / "r"), module(), clock=lambda: now[0])
    r.call("join", b"ann")
    with pytest.raises(ValueError):
        r.call("join", b"bad")
    assert r.read("players").count() == 1
    r.call_procedure("two")
    with pytest.raises(Denied):
        r.call("later", b"x", Caller())
    r.call("later", b"sched")
    assert r.run_due() == 0
    now[0] = 10
    assert r.run_due() == 1 and r.read("players").count() == 4 and r.read("sys_scheduled").count() == 0
    assert [x["name"] for x in r.call_query("team", ALL, team=1).orderBy("name").collect()] == ["ann", "p1", "p2", "sched"]
    assert r.call_query("team", ALL, team=None).count() == 0
    for name, values in (("team", {}), ("team", {"team": 1, "x": 2}), ("only_a_name", {}), ("nothing", {}), ("count", {})):
        with pytest.raises(PlanError):
            r.call_query(name, ALL, **values)
    with pytest.raises(Denied):
        r.call_query("secret")
    me = Caller(b"\x07" * 32)
    r.connect(b"c1", me)
    assert r.read("sys_clients").count() == 1
    r.disconnect(b"c1", me)
    assert r.read("sys_clients").count() == 0
    tx = r.store.begin()
    tx.insert("players", {"id": 0, "name": me.identity.hex(), "team": 9})
    tx.insert("players", {"id": 0, "name": "other", "team": None})
    tx.commit()
    assert r.query("SELECT name FROM players", me).count() == 5 and r.query("SELECT name FROM players").count() == 6
    assert r.query("SELECT COUNT(*) AS n FROM players a JOIN players b ON a.id = b.id", me).first()["n"] == 5
    assert '"reducers":["join","later"]' in r.module.contract()


def test_subscriptions_and_stream(spark, tmp_path):
    r = Runtime(spark, str(tmp_path / "r"), module(), limits=Limits(rows=3))
    r.call("join", b"ann")
    first = r.subscribe(["SELECT * FROM players", "select players.* from players;"], "me", "s1", Caller(allow_all=True))
    assert len(first) == 1 and [tuple(x)[1:3] for x in next(iter(first.values())).collect()] == [("insert", 1)]
    count = r.subscribe_view("count", "you", "s2", Caller(allow_all=True))
    assert count.collect()[0]["n"] == 1
    with pytest.raises(PlanError, match="executing: `SELECT id FROM players`"):
        r.subscribe(["SELECT id FROM players"], "me", "s3", Caller(allow_all=True))
    r.call("join", b"bob")
    query = stream(spark, r.views, str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination(120)
    assert query.exception() is None
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((x["subscriber"], x["subscription"], x["_tx"], x["_op"]) for x in rows) == [("me", "s1", 2, "insert")] * 2 + [("you", "s2", 2, "delete"), ("you", "s2", 2, "insert")]
    assert r.views.advance() == {}
    last = r.views.unsubscribe("you", "s2")
    assert [x["_op"] for x in next(iter(last.values())).collect()] == ["delete"] and len(r.views.views) == 1
    for n in (b"c", b"d"):
        r.call("join", n)
    with pytest.raises(LimitExceeded):
        r.subscribe(["SELECT * FROM players WHERE team = 1"], "late", "s9", Caller(allow_all=True))


@pytest.mark.parametrize(("rows", "width"), [(100_001, 1), (70, 1 << 20)])
def test_first_rows_of_a_large_view_are_whole(spark, tmp_path, rows, width):
    store = Store(spark, str(tmp_path), Catalog.of(PAIRS))
    tx = store.begin()
    tx.insert_many("pairs", spark.range(rows).selectExpr("cast(id as int) a", f"repeat('x', {width}) b"))
    tx.commit()
    plan = Analyzer(store.catalog, None, "declared_view").plan("SELECT * FROM pairs")
    first = Views(store).subscribe("me", "s", [plan])[plan.key()]
    assert list(first.agg(F.count("*"), F.sum("_n"), F.min("a"), F.max("a"), F.count_distinct("a"), F.min(F.length("b"))).first()) == [rows, rows, 0, rows - 1, rows, width]
    for limits in (Limits(rows=rows - 1), Limits(bytes=rows * width)):  # those that a host sets
        with pytest.raises(LimitExceeded, match="snapshot"):
            Views(store, limits).subscribe("you", "s", [plan])


def test_a_sum_that_overflows_is_refused_at_once(spark, tmp_path):
    store = Store(spark, str(tmp_path), Catalog.of(TableDef("wide", columns(id="Uint64 primary", x="Int64"), policy="public")))
    tx = store.begin()
    tx.insert_many("wide", spark.range(1, 4).selectExpr("id", "shiftleft(1L, 62) x"))
    tx.commit()
    views = Views(store)
    with pytest.raises(Exception, match="overflowed Int64"):
        views.subscribe("me", "s", [Analyzer(store.catalog, None, "declared_view").plan("SELECT SUM(x) AS s FROM wide")])
    assert not views.views


def test_first_rows_of_a_runtime_are_whole_and_answers_stay_limited(spark, tmp_path):
    m = Module(Catalog.of(PAIRS))
    m.read("from", "SELECT a, b FROM pairs WHERE a >= :least", (Parameter("least", KINDS["Int32"]),), live=True)
    r = Runtime(spark, str(tmp_path), m)
    tx = r.store.begin()
    tx.insert_many("pairs", spark.range(100_003).selectExpr("cast(id as int) a", "'x' b"))
    tx.commit()
    everyone = Caller(allow_all=True)
    for first in (r.subscribe_view("from", "me", "s1", everyone, least=2), *r.subscribe(["SELECT * FROM pairs WHERE a >= 2"], "me", "s2", everyone).values()):
        assert list(first.agg(F.count("*"), F.sum("_n"), F.min("a"), F.max("a"), F.count_distinct("a")).first()) == [100_001, 100_001, 2, 100_002, 100_001]
    with pytest.raises(LimitExceeded, match="100000 rows"):
        r.answer("SELECT * FROM pairs WHERE a >= 2")
    assert len(r.answer("SELECT * FROM pairs WHERE a >= 3")) == 100_000
