"""Registered views over a store's change log, in batches or as a stream.

Views with the same canonical plan are one computation with many subscribers. Each batch takes the
transactions after the last one delivered, evaluates every view that their rows can matter to, and writes
signed rows keyed by (view, transaction). A view moves on only after its rows are written. The registry - plans,
subscribers, how far each view is, and the range of the batch under way - is kept in the store's folder, so a
batch that is run again, by the same process or a later one, covers the same transactions and overwrites its
own rows. A view that fails, when planned or when run, reports its error and is dropped; the others go on.
"""

from __future__ import annotations

import base64
import json
import pickle
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.functions.kinds import column_of
from deltaloom.operators import live, lower
from deltaloom.plans.analyzer import Plan
from deltaloom.plans.errors import LimitExceeded
from deltaloom.sources.store import Store


@dataclass
class View:
    plan: Plan
    since: int
    subscribers: dict[str, list[str]] = field(default_factory=dict)  # subscriber -> its subscription ids
    base: tuple | None = None  # an aggregate's sum and number of values as of `since`, where they are known


@dataclass(frozen=True)
class Limits:
    """What a host allows. rows and bytes are those of an answer or of a subscription's first rows; where a host
    sets none, first rows, which nobody gathers, have no limit, and answers that of lower.bounded()."""

    rows: int | None = None
    bytes: int | None = None
    work: int = 1_000_000
    queries_per_set: int = 256
    subscriptions: int = 4096
    relations: int = 8


class Views:
    def __init__(self, store: Store, limits: Limits = Limits()):
        self.store, self.limits = store, limits
        self.views: dict[str, View] = {}
        self.errors: list[tuple[str, str, str]] = []  # (subscriber, subscription, text)
        self.batch: dict | None = None  # number, upto and where each view was, of the batch under way or done last
        if store.files.exists("views.json"):
            held = json.loads(store.files.read("views.json"))
            self.batch = held["batch"]
            for v in held["views"]:
                plan = pickle.loads(base64.b64decode(v["plan"]))
                self.views[plan.key()] = View(plan, v["since"], v["subscribers"])
        store.readers.append(lambda: min([v.since for v in self.views.values()] + list((self.batch or {}).get("since", {}).values()), default=store.version))

    def _keep(self) -> None:
        """Writes the registry over the one that is there. Values that aggregates begin from are not kept: a
        process that starts makes them anew."""
        views = [{"plan": base64.b64encode(pickle.dumps(v.plan)).decode(), "since": v.since, "subscribers": v.subscribers} for v in self.views.values()]
        self.store.files.replace("views.json", json.dumps({"views": views, "batch": self.batch}))

    def subscribe(self, subscriber: str, subscription: str, plans: list[Plan]) -> dict[str, DataFrame]:
        """All or none of the plans; each view's rows as of now, as inserts, by the view's key."""
        if len(plans) > self.limits.queries_per_set or sum(len(v.subscribers.get(subscriber, ())) for v in self.views.values()) + len(plans) > self.limits.subscriptions:
            raise LimitExceeded("too many queries")
        at, out = self.store.version, {}
        for p in plans:
            if len(p.relations) > self.limits.relations:
                raise LimitExceeded("too many relations in a live join")
            lower.check_work(p, lambda name: self.store.table(name, at), self.limits.work)
            first = live.snapshot(p, self.histories(), at)
            if p.aggregate or self.limits.rows is not None or self.limits.bytes is not None:  # an aggregate may fail when run
                lower.check_size(first, self.limits.rows, self.limits.bytes, "snapshot")
            out[p.key()] = first
        for p in plans:
            view = self.views.get(p.key())
            if view is not None and view.since < at:  # its subscribers are behind: they and the new one must not mix
                raise LimitExceeded("the view has changes that are not delivered yet")
            view = self.views.setdefault(p.key(), View(p, at))
            view.subscribers.setdefault(subscriber, []).append(subscription)
        self._keep()
        return out

    def unsubscribe(self, subscriber: str, subscription: str) -> dict[str, DataFrame]:
        """Each of its views' rows as of now, as deletes. Views without subscribers go."""
        out = {}
        for key, view in list(self.views.items()):
            ids = view.subscribers.get(subscriber, [])
            if subscription in ids:
                ids.remove(subscription)
                out[key] = live.snapshot(view.plan, self.histories(), self.store.version, "delete")
                if not ids:
                    del view.subscribers[subscriber]
                if not view.subscribers:
                    del self.views[key]
        self._keep()
        return out

    def drop(self, subscriber: str) -> None:
        for key, view in list(self.views.items()):
            view.subscribers.pop(subscriber, None)
            if not view.subscribers:
                del self.views[key]
        self._keep()

    def histories(self, upto: int | None = None) -> live.Histories:
        return lambda name: self.store.history(name, upto)

    def _concerned(self, since: int, upto: int) -> set[str]:
        """Views that a changed row can matter to. Tests of equality are joined with the changed rows' distinct
        values, table by table."""
        plans = {k: v.plan for k, v in self.views.items()}
        out: set[str] = set()
        for name in {t.name for p in plans.values() for t in p.relations}:
            changed = self.store.changes(name, since, upto)
            rows = [(v, c, x) for v, t, c, x in live.touches(plans) if t == name]
            if rows and changed.take(1):
                out |= {v for v, c, _ in rows if not c}
                for column in {c for _, c, _ in rows if c}:
                    kind = self.store.catalog.tables[name].column(column).kind
                    own = [(v, x) for v, c, x in rows if c == column and v not in out]
                    found = [F.max(F.col(f"`{column}`").eqNullSafe(column_of(x, kind)).cast("int")).alias(f"v{i}") for i, (_, x) in enumerate(own)]
                    got = changed.agg(*found).first() if found else []
                    out |= {v for (v, _), hit in zip(own, got, strict=True) if hit}
        return out

    def pending(self, upto: int | None = None, since: dict[str, int] | None = None) -> dict[str, DataFrame]:
        """(_tx, _op, _n, columns) of each view from the transactions it has not delivered, up to one. Nothing
        moves on. since: where each view begins, instead of where it is."""
        upto = self.store.version if upto is None else upto
        places = {k: (since or {}).get(k, v.since) for k, v in self.views.items()}
        first = min(places.values(), default=upto)
        if first >= upto:
            return {}
        concerned, out = self._concerned(first, upto), {}
        for key, view in list(self.views.items()):
            if key in concerned and places[key] < upto:
                try:
                    base = view.base if places[key] == view.since else None
                    out[key] = live.deltas(view.plan, None, places[key], self.store.parts(places[key], upto), base)
                    out[key].schema  # noqa: B018  analysis errors show here
                except Exception as e:  # noqa: BLE001
                    self.fail(key, e)
        return out

    def advance(self, upto: int | None = None) -> dict[str, DataFrame]:
        """pending(), and the views move on: for a caller that can't lose what it is given."""
        upto = self.store.version if upto is None else upto
        out = self.pending(upto)
        self._move(upto, set(out))
        return out

    def _move(self, upto: int, changed: set[str]) -> None:
        for key, view in self.views.items():
            if view.since < upto:
                if view.plan.aggregate and key in changed:
                    view.base = live.moved_base(view.plan, self.store.parts(view.since, upto), view.since, view.base)
                view.since = upto
        self._keep()

    def deliver(self, number: int, upto: int, write: Callable[[DataFrame | None], None]) -> None:
        """Writes what the views gained up to a transaction as batch `number`, then moves them on. A batch that
        is run again begins and ends where it did the first time."""
        if self.batch and self.batch["number"] == number:
            upto = self.batch["upto"]
        else:
            self.batch = {"number": number, "upto": upto, "since": {k: v.since for k, v in self.views.items()}}
            self._keep()
        self.store.refresh(upto)
        places = self.batch["since"]
        while True:
            out = {k: d for k, d in self.pending(upto, places).items() if k in places}
            try:
                write(self.fan_out(out))
                break
            except Exception as e:
                if not self._drop_failing(out):
                    raise e  # it is the sink that fails
        self._move(upto, set(out))

    def _drop_failing(self, deltas: dict[str, DataFrame]) -> bool:
        """Runs each view by itself; those that fail report their errors and go."""
        found = False
        for key, d in deltas.items():
            try:
                d.write.format("noop").mode("overwrite").save()
            except Exception as e:  # noqa: BLE001
                self.fail(key, e)
                found = True
        return found

    def fail(self, key: str, error: Exception) -> None:
        for subscriber, ids in self.views.pop(key).subscribers.items():
            self.errors += [(subscriber, i, str(error)) for i in ids]
        self._keep()

    def fan_out(self, deltas: dict[str, DataFrame]) -> DataFrame | None:
        """(subscriber, subscription, view, _tx, _op, _n, row) of all views, a row as JSON, in the order of
        subscriptions."""
        parts = []
        for key, d in deltas.items():
            names = [c for c in d.columns if c not in ("_tx", "_op", "_n")]
            who = F.explode(F.array(*(F.struct(F.lit(s).alias("s"), F.lit(i).alias("i")) for s, ids in self.views[key].subscribers.items() for i in ids)))
            row = F.to_json(F.struct(*(F.col(f"`{n}`") for n in names)), {"ignoreNullFields": "false"})
            parts.append(d.select(who.alias("w"), F.lit(key).alias("view"), "_tx", "_op", "_n", row.alias("row")).select("w.s", "w.i", "view", "_tx", "_op", "_n", "row").toDF("subscriber", "subscription", "view", "_tx", "_op", "_n", "row"))
        out = parts[0] if parts else None
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def stream(spark: SparkSession, views: Views, sink: str, checkpoint: str, **trigger):
    """A streaming query that follows the published manifests, so nothing is delivered that is not durable.
    Every batch writes what the views gained under its own transaction range; a repeated batch overwrites it."""
    manifests = spark.readStream.schema("tx long").option("pathGlobFilter", "*.json").json(f"{views.store.root}/log")

    def each(batch: DataFrame, number: int) -> None:
        upto = batch.agg(F.max("tx")).first()[0]
        if upto is None:
            return
        views.deliver(number, upto, lambda rows: rows is None or rows.write.mode("overwrite").parquet(f"{sink}/batch={number:010d}"))

    return manifests.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
