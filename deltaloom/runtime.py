"""Modules and their runtime: reducers, procedures, schedules, life cycle, declared reads, row filters."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from deltaloom.functions.kinds import Kind, check, from_spark
from deltaloom.operators import lower
from deltaloom.plans.analyzer import Analyzer, Plan
from deltaloom.plans.errors import LimitExceeded, PlanError, explain_error_text
from deltaloom.plans.schema import Caller, Catalog, TableDef, columns
from deltaloom.sources.store import Store, Transaction
from deltaloom.streaming.views import Limits, Views

#: Tables of the runtime itself.
CLIENTS = TableDef("sys_clients", columns(connection_id="Bytes primary", identity="Bytes", connected_at="Int64"))
MIGRATED = TableDef("sys_migrations", columns(name="String primary", applied_at_ns="Int64"))
SCHEDULED = TableDef("sys_scheduled", columns(schedule_id="Uint64 primary autoincrement", reducer_name="String", args="Bytes", next_run_at_ns="Int64", repeat_ns="Int64"))


@dataclass(frozen=True)
class Parameter:
    name: str
    kind: Kind
    nullable: bool = False


@dataclass(frozen=True)
class DeclaredRead:
    """A named query or view. Without SQL it is a name alone and can't be run."""

    name: str
    sql: str = ""
    parameters: tuple[Parameter, ...] = ()
    permissions: tuple[str, ...] = ()
    live: bool = False


@dataclass
class Module:
    catalog: Catalog
    reducers: dict[str, tuple[Callable, tuple[str, ...]]] = field(default_factory=dict)
    procedures: dict[str, tuple[Callable, tuple[str, ...]]] = field(default_factory=dict)
    reads: dict[str, DeclaredRead] = field(default_factory=dict)
    on_connect: Callable | None = None
    on_disconnect: Callable | None = None
    migrations: list[Callable] = field(default_factory=list)

    def reducer(self, name: str, *permissions: str):
        return lambda f: self.reducers.__setitem__(name, (f, permissions)) or f

    def procedure(self, name: str, *permissions: str):
        return lambda f: self.procedures.__setitem__(name, (f, permissions)) or f

    def read(self, name: str, sql: str = "", parameters: tuple[Parameter, ...] = (), permissions: tuple[str, ...] = (), live: bool = False) -> None:
        if name in self.reads:
            raise PlanError(f"read {name} is declared twice")
        self.reads[name] = DeclaredRead(name, sql, tuple(parameters), tuple(permissions), live)

    def contract(self) -> str:
        """The module as canonical JSON: tables, reducers, procedures, reads and row filters."""
        reads = [{"name": r.name, "sql": r.sql, "live": r.live, "permissions": list(r.permissions), "parameters": [{"name": p.name, "kind": p.kind.name, "nullable": p.nullable} for p in r.parameters]} for _, r in sorted(self.reads.items())]
        body = json.loads(self.catalog.contract()) | {"reducers": sorted(self.reducers), "procedures": sorted(self.procedures), "reads": reads, "filters": self.catalog.filters}
        return json.dumps(body, sort_keys=True, separators=(",", ":"))


class Denied(PermissionError):
    pass


class Context:
    """What a reducer gets: its transaction as db, its caller, and the schedule."""

    def __init__(self, runtime: Runtime, tx: Transaction, caller: Caller, now_ns: int):
        self.db, self.caller, self.now_ns, self._runtime = tx, caller, now_ns, runtime

    def schedule(self, reducer: str, args: bytes, at_ns: int) -> int:
        return self._plan(reducer, args, at_ns, 0)

    def schedule_repeat(self, reducer: str, args: bytes, first_ns: int, every_ns: int) -> int:
        if every_ns <= 0:
            raise ValueError("a repeat needs an interval")
        return self._plan(reducer, args, first_ns, every_ns)

    def _plan(self, reducer: str, args: bytes, at: int, every: int) -> int:
        rid = self.db.insert("sys_scheduled", {"schedule_id": 0, "reducer_name": reducer, "args": args, "next_run_at_ns": at, "repeat_ns": every})
        return self.db.row("sys_scheduled", rid)["schedule_id"]

    def cancel(self, schedule_id: int) -> bool:
        rows = self.db.seek("sys_scheduled", schedule_id=schedule_id).select("_rid").take(1)
        if rows:
            self.db.delete("sys_scheduled", rows[0]["_rid"])
        return bool(rows)


class Runtime:
    """One module over one store. Reducers run one after the other."""

    def __init__(self, spark: SparkSession, root: str, module: Module, limits: Limits = Limits(), clock: Callable[[], int] = time.time_ns):
        for t in (CLIENTS, SCHEDULED, MIGRATED):
            if t.name not in module.catalog.tables:
                module.catalog.add(t)
        self.spark, self.module, self.limits, self.clock = spark, module, limits, clock
        self.store = Store(spark, root, module.catalog)
        self.views = Views(self.store, limits)
        self.lock = threading.RLock()
        self._migrate()
        # Connections of an earlier process are gone.
        stale = [r["_rid"] for r in self.store.rows("sys_clients").select("_rid").collect()]
        if stale:
            self._transact(lambda tx: [tx.delete("sys_clients", r) for r in stale])

    def _migrate(self) -> None:
        """Runs each migration that is not recorded yet, in their order, in one transaction with its record."""
        done = {r["name"] for r in self.store.table("sys_migrations").select("name").collect()}
        for at, step in enumerate(self.module.migrations):
            name = f"{at:04d}-{getattr(step, '__qualname__', type(step).__qualname__)}"
            if name not in done:

                def work(tx: Transaction, step: Callable = step, name: str = name) -> None:
                    step(Context(self, tx, Caller(allow_all=True), self.clock()))
                    tx.insert("sys_migrations", {"name": name, "applied_at_ns": self.clock()})

                self._transact(work)

    def _transact(self, work: Callable[[Transaction], Any]) -> Any:
        with self.lock:
            tx = self.store.begin()
            try:
                out = work(tx)
            except BaseException:
                tx.rollback()
                raise
            if any(s.any() for s in tx.staged.values()):
                tx.commit()
            else:
                tx.close()
            return out

    @staticmethod
    def _allowed(caller: Caller, permissions: tuple[str, ...], what: str) -> None:
        if not caller.allow_all and not set(permissions) <= caller.permissions:
            raise Denied(what)

    def call(self, name: str, args: Any = b"", caller: Caller = Caller(allow_all=True)) -> Any:
        """A reducer in a transaction; an error rolls it back."""
        f, permissions = self.module.reducers[name]
        self._allowed(caller, permissions, name)
        return self._transact(lambda tx: f(Context(self, tx, caller, self.clock()), args))

    def call_procedure(self, name: str, args: Any = b"", caller: Caller = Caller(allow_all=True)) -> Any:
        """A function outside transactions, which may call reducers."""
        f, permissions = self.module.procedures[name]
        self._allowed(caller, permissions, name)
        return f(self, args)

    def connect(self, connection: bytes, caller: Caller) -> None:
        def work(tx: Transaction) -> None:
            tx.insert("sys_clients", {"connection_id": connection, "identity": caller.identity or b"", "connected_at": self.clock()})
            if self.module.on_connect:
                self.module.on_connect(Context(self, tx, caller, self.clock()))

        self._transact(work)

    def disconnect(self, connection: bytes, caller: Caller) -> None:
        """The row goes even if the hook fails."""

        def work(tx: Transaction, hook: bool = True) -> None:
            if hook and self.module.on_disconnect:
                self.module.on_disconnect(Context(self, tx, caller, self.clock()))
            for r in tx.seek("sys_clients", connection_id=connection).select("_rid").collect():
                tx.delete("sys_clients", r["_rid"])

        try:
            self._transact(work)
        except Exception:  # noqa: BLE001
            self._transact(lambda tx: work(tx, hook=False))
        self.views.drop(connection.hex())

    def run_due(self) -> int:
        """Runs what is due, each in its own transaction together with its row's next time or end; how many."""
        done = 0
        while True:
            due = self.store.rows("sys_scheduled").where(f"next_run_at_ns <= {self.clock()}").orderBy("next_run_at_ns", "schedule_id").take(1)
            if not due:
                return done
            row = due[0].asDict()
            rid = row.pop("_rid")
            row = {k: from_spark(v) for k, v in row.items()}

            def work(tx: Transaction, row: dict = row, rid: int = rid) -> None:
                if row["repeat_ns"]:
                    tx.update("sys_scheduled", rid, row | {"next_run_at_ns": row["next_run_at_ns"] + row["repeat_ns"]})
                else:
                    tx.delete("sys_scheduled", rid)
                self.module.reducers[row["reducer_name"]][0](Context(self, tx, Caller(allow_all=True), self.clock()), row["args"])

            self._transact(work)
            done += 1

    # --- reads

    def plan(self, sql: str, caller: Caller | None = None, surface: str = "query", parameters: dict | None = None) -> Plan:
        return Analyzer(self.module.catalog, caller, surface, parameters).plan(sql)

    def query(self, sql: str, caller: Caller | None = None, version: int | None = None) -> DataFrame:
        return lower.run(self.plan(sql, caller), lambda name: self.store.table(name, version))

    def answer(self, sql: str, caller: Caller | None = None) -> list:
        """A result within the host's limits, or an error."""
        plan = self.plan(sql, caller)
        lower.check_work(plan, self.store.table, self.limits.work)
        return lower.bounded(lower.run(plan, self.store.table), self.limits.rows, self.limits.bytes)

    def read(self, table: str) -> DataFrame:
        return self.store.table(table)

    def _declared(self, name: str, caller: Caller, values: dict[str, Any], live: bool) -> Plan:
        d = self.module.reads.get(name)
        if d is None or d.live != live:
            raise PlanError(f"no declared {'view' if live else 'query'} {name}")
        if not d.sql:
            raise PlanError(f"{name} is a declaration only")
        self._allowed(caller, d.permissions, name)
        if extra := sorted(values.keys() - {p.name for p in d.parameters}):
            raise PlanError(f"{name} has no parameter :{extra[0]}")
        if missing := [p.name for p in d.parameters if p.name not in values]:
            raise PlanError(f"{name} needs :{missing[0]}")
        bound = {p.name: (p.kind, p.nullable, check(values[p.name], p.kind, p.nullable)) for p in d.parameters}
        return self.plan(d.sql, caller, "declared_view" if live else "declared_query", bound)

    def call_query(self, name: str, caller: Caller = Caller(), **values: Any) -> DataFrame:
        return lower.run(self._declared(name, caller, values, False), lambda t: self.store.table(t))

    def subscribe_view(self, name: str, subscriber: str, subscription: str, caller: Caller = Caller(), **values: Any) -> DataFrame:
        plan = self._declared(name, caller, values, True)
        return self.views.subscribe(subscriber, subscription, [plan])[plan.key()]

    def subscribe(self, sqls: list[str], subscriber: str, subscription: str, caller: Caller | None = None) -> dict[str, DataFrame]:
        """Raw table-shaped views; all of them or none."""
        plans = []
        for sql in sqls:
            try:
                plans.append(self.plan(sql, caller, "raw_view"))
            except ValueError as e:
                raise PlanError(explain_error_text(e, sql, True)) from e
        return self.views.subscribe(subscriber, subscription, plans)


__all__ = ["CLIENTS", "SCHEDULED", "Context", "DeclaredRead", "Denied", "LimitExceeded", "Module", "Parameter", "Runtime"]
