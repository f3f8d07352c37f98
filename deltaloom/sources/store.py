"""Versioned tables over Parquet: a change log, snapshots, manifests, transactions and recovery.

A commit writes the net changes of each table it touched as Parquet files under a name of its own, then
publishes them by a manifest that is written last and renamed into place; what no manifest names does not
exist. A version of a table is its newest snapshot at or before that transaction and the changes after it.
All files go through Hadoop's file systems, so the folder may be on any store that Spark reads. One process
writes at a time; readers need no lock, as nothing that is published changes.

Manifests carry a checksum of themselves and the length of every file they name. A snapshot that does not
agree is passed over for an older one; a log entry that does not is an error, but for a torn last one, which
was never acknowledged. verify() reads everything and compares the rows' own checksums too.
"""

from __future__ import annotations

import json
import re
import threading
import uuid
import zlib
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deltaloom.functions.kinds import check, column_of, from_spark, to_spark
from deltaloom.operators import live
from deltaloom.plans.errors import ConstraintError, KindError
from deltaloom.plans.schema import Catalog, SchemaError, TableDef, incompatible

LAST_RID = (1 << 63) - 1


class Files:
    """The few file operations the store needs, on any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf, self.root = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), root.rstrip("/")
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def read(self, name: str) -> str:
        return self.jvm.org.apache.commons.io.IOUtils.toString(self.fs.open(self._path(name)), "UTF-8")

    def publish(self, name: str, text: str) -> None:
        """Written aside, then renamed: a reader sees all of it or nothing."""
        aside = f"{name}.{uuid.uuid4().hex}.tmp"
        out = self.fs.create(self._path(aside))
        out.write(bytearray(text.encode("utf-8")))
        out.hsync() if hasattr(out, "hsync") else None
        out.close()
        if not self.fs.rename(self._path(aside), self._path(name)):
            self.fs.delete(self._path(aside), False)
            raise RuntimeError(f"{name} is there already")

    def replace(self, name: str, text: str) -> None:
        """Written aside, then renamed over what is there: a reader sees the old or the new, at any moment."""
        aside = f"{name}.{uuid.uuid4().hex}.tmp"
        self.publish(aside, text)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.conf)
        option = self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        over = self.jvm.java.lang.reflect.Array.newInstance(option, 1)
        over[0] = option.getEnumConstants()[1]  # overwrite
        context.rename(self.fs.makeQualified(self._path(aside)), self.fs.makeQualified(self._path(name)), over)

    def lengths(self, folder: str) -> dict[str, int]:
        """The files of a written table and their lengths."""
        return {s.getPath().getName(): s.getLen() for s in self.fs.listStatus(self._path(folder)) if not s.getPath().getName().startswith(("_", "."))}

    def names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(folder))) if self.exists(folder) else []

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


def sealed(body: dict) -> str:
    """A manifest as JSON with a checksum of the rest of it."""
    text = json.dumps(body, sort_keys=True)
    return json.dumps(body | {"crc": zlib.crc32(text.encode())}, sort_keys=True)


def opened(text: str) -> dict:
    """A manifest whose checksum agrees; ValueError otherwise."""
    body = json.loads(text)
    crc = body.pop("crc", None)
    if crc != zlib.crc32(json.dumps(body, sort_keys=True).encode()):
        raise ValueError("checksum differs")
    return body


def rows_checksum(columns: list[str]) -> list:
    """Of a bag of rows, whatever their order: how many, and the sum of their hashes, as aggregates."""
    total = F.coalesce(F.sum(F.xxhash64(*(F.col(f"`{c}`") for c in columns)).cast("decimal(38,0)")), F.lit(0))
    return [F.count(F.lit(1)).alias("n"), total.cast("string").alias("sum")]


def copy_folder(spark: SparkSession, source: str, target: str) -> None:
    """The parts of a store, on any two Hadoop file systems."""
    old, new = Files(spark, source), Files(spark, target)
    if new.names(""):
        raise FileExistsError(target)
    if not old.exists("contract.json"):
        raise FileNotFoundError(f"{source} is no store")
    for part in ("data", "snapshots", "contract.json", "views.json", "log"):
        if old.exists(part):
            new.fs.mkdirs(new._path(""))
            old.jvm.org.apache.hadoop.fs.FileUtil.copy(old.fs, old._path(part), new.fs, new._path(part), False, old.conf)


class Store:
    """A folder of tables. `version` is the last committed transaction."""

    def __init__(self, spark: SparkSession, root: str, catalog: Catalog):
        self.spark, self.catalog, self.files, self.root = spark, catalog, Files(spark, root), root.rstrip("/")
        self.lock = threading.RLock()
        self.counters: dict[str, int] = {}
        self.rids: dict[str, int] = {}
        self.observers: list[Callable[[int], None]] = []
        self.readers: list[Callable[[], int]] = []  # each the oldest transaction a reader still needs changes after
        self._recover()

    # --- recovery

    def _recover(self) -> None:
        contract = self.catalog.contract()
        if self.files.exists("contract.json"):
            held = self.files.read("contract.json")
            if found := incompatible(json.loads(held), json.loads(contract)):
                raise SchemaError("; ".join(found))
            if held != contract:
                self.files.replace("contract.json", contract)
        else:
            self.files.publish("contract.json", contract)
        self.snapshots, broken = [], False
        for name in reversed(self.files.names("snapshots")):
            if not self.files.exists(f"snapshots/{name}/manifest.json"):
                continue  # it was never finished
            try:  # one that is damaged, or whose files are not as it says, is passed over
                m = opened(self.files.read(f"snapshots/{name}/manifest.json"))
                self._whole(m["files"])
            except Exception:  # noqa: BLE001
                broken = True
                continue
            self.snapshots.append((int(m["tx"]), f"snapshots/{name}"))
            self.counters |= {k: max(v, self.counters.get(k, 0)) for k, v in m["counters"].items()}
            self.rids |= {k: max(v, self.rids.get(k, 0)) for k, v in m["rids"].items()}
        self.log: dict[int, dict] = {}
        manifests = [(int(m[1]), n) for n in self.files.names("log") if (m := re.fullmatch(r"(\d{20})\.json", n))]
        for tx, name in sorted(manifests):
            try:
                self.log[tx] = opened(self.files.read(f"log/{name}"))
            except Exception:  # noqa: BLE001  unreadable, or not what was written
                if tx == manifests[-1][0]:  # a torn tail was never acknowledged
                    self.files.delete(f"log/{name}")
                    break
                raise RuntimeError(f"log/{name} is damaged") from None
            try:
                self._whole(self.log[tx]["files"])
            except Exception as e:  # noqa: BLE001
                raise RuntimeError(f"log/{name}: its rows are damaged") from e
        # What is left of the log must go on from some snapshot, or from the beginning, without a gap.
        txs = sorted(self.log)
        base = max((t for t, _ in self.snapshots), default=0)
        if txs and (txs != list(range(txs[0], txs[-1] + 1)) or txs[0] > base + 1) or broken and not txs and not base:
            raise RuntimeError("the log has a gap")
        self.version = max([base, *txs])
        for m in self.log.values():
            for k in ("counters", "rids"):
                getattr(self, k).update({t: max(v, getattr(self, k).get(t, 0)) for t, v in m[k].items()})

    def _whole(self, files: dict[str, dict]) -> None:
        for folder, entry in files.items():
            if self.files.lengths(folder) != entry["lengths"]:
                raise ValueError(f"{folder} is not as it was written")

    def _written(self, df: DataFrame, folder: str) -> dict:
        """Writes a table; what its manifest says of it."""
        seen = Observation()
        df.observe(seen, *rows_checksum(df.columns)).write.parquet(f"{self.root}/{folder}")
        return {"lengths": self.files.lengths(folder), "rows": [seen.get["n"], seen.get["sum"]]}

    def verify(self) -> list[str]:
        """Folders of the log and of snapshots whose rows are not those that were written."""
        bad = []
        held = [*self.log.values(), *(opened(self.files.read(f"{path}/manifest.json")) for _, path in self.snapshots)]
        for m in held:
            for folder, entry in m["files"].items():
                schema = self._schema(self.catalog.tables[entry["table"]])
                try:
                    self._whole({folder: entry})
                    same = list(self.spark.read.schema(schema).parquet(f"{self.root}/{folder}").agg(*rows_checksum(schema.names)).first()) == entry["rows"]
                except Exception:  # noqa: BLE001  unreadable
                    same = False
                bad += [] if same else [folder]
        return bad

    def refresh(self, upto: int) -> None:
        """Takes in what another process published, up to a transaction."""
        with self.lock:
            for tx in range(self.version + 1, upto + 1):
                self.log[tx] = opened(self.files.read(f"log/{tx:020d}.json"))
                self.version = tx

    # --- reading

    def _schema(self, table: TableDef) -> T.StructType:
        more = [T.StructField("_rid", T.LongType()), T.StructField("_tx", T.LongType()), T.StructField("_w", T.IntegerType())]
        return T.StructType([*table.spark_schema.fields, *more])

    def changes(self, name: str, since: int = 0, upto: int | None = None) -> DataFrame:
        """(columns, _rid, _tx, _w) of transactions in (since, upto], from the files of those alone."""
        table, upto = self.catalog.tables[name], self.version if upto is None else upto
        paths = [f"{self.root}/{p}" for t, m in sorted(self.log.items()) if since < t <= upto and (p := m["tables"].get(name))]
        reader = self.spark.read.schema(self._schema(table))
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], self._schema(table))

    def _base(self, name: str, upto: int) -> tuple[int, DataFrame | None]:
        for tx, path in sorted(self.snapshots, reverse=True):
            if tx <= upto and self.files.exists(f"{path}/{name}"):
                return tx, self.spark.read.schema(self._schema(self.catalog.tables[name])).parquet(f"{self.root}/{path}/{name}")
        return 0, None

    def all_changes(self, name: str, upto: int | None = None, since: int | None = None) -> DataFrame:
        """Changes up to a version from the newest snapshot on; a snapshot's rows keep the transaction that
        made them. since: the snapshot must be no newer, so that all changes after it are there."""
        upto = self.version if upto is None else upto
        if self.catalog.tables[name].event:  # no snapshot has their rows
            return self.changes(name, 0, upto)
        base, rows = self._base(name, upto if since is None else min(since, upto))
        kept = min(self.log, default=self.version + 1)
        if kept > base + 1 and upto > base:
            raise ValueError(f"the changes after transaction {base} are compacted away")
        later = self.changes(name, base, upto)
        return later if rows is None else rows.unionByName(later)

    def rows(self, name: str, version: int | None = None) -> DataFrame:
        """A table's rows with _rid as of a version."""
        table = self.catalog.tables[name]
        names = [c.name for c in table.columns]
        if table.event:
            return self.spark.createDataFrame([], self._schema(table)).select(*names, "_rid")
        changes = self.all_changes(name, version)
        gone = changes.where("_w < 0").select("_rid")
        return changes.where("_w > 0").join(gone, "_rid", "left_anti").select(*names, "_rid")

    def table(self, name: str, version: int | None = None) -> DataFrame:
        return self.rows(name, version).drop("_rid")

    def history(self, name: str, upto: int | None = None, since: int | None = None) -> DataFrame:
        """A table's rows with the interval in which they are there; since: with all that changed after it."""
        table = self.catalog.tables[name]
        return live.history(self.all_changes(name, upto, since), [c.name for c in table.columns], table.event)

    def parts(self, since: int, upto: int | None = None) -> live.Parts:
        """The parts of histories that deltas after `since` read. Changed rows come from the files of the later
        transactions alone, and the rest from a table's rows without them."""
        upto = self.version if upto is None else upto

        def get(name: str, part: str) -> DataFrame:
            table = self.catalog.tables[name]
            names = [c.name for c in table.columns]
            if not since or table.event and part != "still":
                rows = live.history(self.changes(name, since, upto) if table.event else self.all_changes(name, upto, since), names, table.event)
                return rows if part == "later" else live.parts_of(lambda _: rows, since)(name, part)
            moved = self.changes(name, since, upto)
            changed = live.history(moved, names, table.event, since)
            if part == "changed":
                return changed
            still = self.rows(name, since).join(moved.where("_w < 0").select("_rid"), "_rid", "left_anti")
            still = still.select(*names, F.lit(since).cast("long").alias("_from"), F.lit(live.END).alias("_to"))
            return still if part == "still" else still.unionByName(changed)

        return get

    def row(self, name: str, rid: int) -> dict | None:
        got = self.rows(name).where(F.col("_rid") == rid).drop("_rid").take(1)
        return _stored(got[0].asDict()) if got else None

    def count(self, name: str) -> int:
        return self.rows(name).count()

    def seek(self, name: str, /, **key: Any) -> DataFrame:
        """Rows with equal values in some columns; nulls are equal."""
        return seek(self.rows(name), self.catalog.tables[name], key)

    def scan_range(self, name: str, by: list[str], low: tuple | None = None, high: tuple | None = None, low_open: bool = False, high_open: bool = False) -> DataFrame:
        """Rows between two bounds of some columns, in the columns' order; a bound may name the first columns alone."""
        return scan_range(self.rows(name), self.catalog.tables[name], by, low, high, low_open, high_open)

    # --- writing

    def begin(self) -> Transaction:
        return Transaction(self)

    def commit(self, tx: Transaction) -> int:
        """Publishes the net effect; the new version. Nothing is left of a commit that fails."""
        with self.lock:
            if tx.version != self.version:
                tx.revalidate()
            number, tables, files = self.version + 1, {}, {}
            for name in sorted(tx.staged):
                staged, schema = tx.staged[name], self._schema(self.catalog.tables[name])
                rows = [(*_values(self.catalog.tables[name], r), rid, number, w) for w, bag in ((1, staged.inserted), (-1, staged.deleted)) for rid, r in sorted(bag.items())]
                frames = [self.spark.createDataFrame(rows, schema)] if rows else []
                marked = lambda df, w: df.withColumns({"_tx": F.lit(number).cast("long"), "_w": F.lit(w)})
                frames += [marked(b.numbered, 1) for b in staged.bulk] + [marked(df, -1) for df in staged.gone]
                if not frames:
                    continue
                tables[name] = f"data/{name}/{number:020d}-{uuid.uuid4().hex}"
                out = frames[0].select(*schema.names)
                for f in frames[1:]:
                    out = out.unionByName(f.select(*schema.names))
                files[tables[name]] = {"table": name} | self._written(out, tables[name])
            manifest = {"tx": number, "tables": tables, "files": files, "counters": tx.counters, "rids": tx.rids}
            self.files.publish(f"log/{number:020d}.json", sealed(manifest))
            self.log[number], self.version = manifest, number
            self.counters |= tx.counters
            self.rids |= tx.rids
            tx.close()
        for observe in self.observers:
            observe(number)
        return number

    def snapshot(self) -> str:
        """Writes every table's rows as of now; the manifest last."""
        with self.lock:
            path, files = f"snapshots/{self.version:020d}-{uuid.uuid4().hex}", {}
            for name, t in self.catalog.tables.items():
                if not t.event:
                    changes = self.all_changes(name)
                    gone = changes.where("_w < 0").select("_rid")
                    rows = changes.where("_w > 0").join(gone, "_rid", "left_anti").select(*self._schema(t).names)
                    files[f"{path}/{name}"] = {"table": name} | self._written(rows, f"{path}/{name}")
            self.files.publish(f"{path}/manifest.json", sealed({"tx": self.version, "files": files, "counters": self.counters, "rids": self.rids}))
            self.snapshots.append((self.version, path))
            return path

    def backup(self, target: str) -> None:
        """Copies all that is published to a folder that must not be there yet; the log goes last, so the copy
        never names files it lacks."""
        with self.lock:
            copy_folder(self.spark, self.root, target)

    @classmethod
    def restore(cls, spark: SparkSession, source: str, root: str, catalog: Catalog) -> Store:
        """A store in a new folder from a backup."""
        copy_folder(spark, source, root)
        return cls(spark, root, catalog)

    def compact(self) -> int:
        """Deletes log entries that a snapshot covers and no reader needs any more, and snapshots before that
        one; how many entries. The snapshot is the newest that is no newer than any reader's place."""
        needed = min([self.version, *(r() for r in self.readers)])
        base = max((t for t, _ in self.snapshots if t <= needed), default=0)
        old = [t for t in self.log if t <= base]
        for t in sorted(old):
            m = self.log.pop(t)
            self.files.delete(f"log/{t:020d}.json")
            for p in m["tables"].values():
                self.files.delete(p)
        for t, path in list(self.snapshots):
            if t < base:
                self.snapshots.remove((t, path))
                self.files.delete(path)
        return len(old)


class Bulk:
    """Rows of one bulk insert, written aside; numbered has them with surrogates and sequence values."""

    def __init__(self, placed: DataFrame):
        self.placed, self.numbered = placed, placed


class Staged:
    def __init__(self):
        self.inserted: dict[int, dict] = {}
        self.deleted: dict[int, dict] = {}
        self.bulk: list[Bulk] = []
        self.gone: list[DataFrame] = []  # committed rows that bulk deletes take away, with _rid

    def any(self) -> bool:
        return bool(self.inserted or self.deleted or self.bulk or self.gone)


class Transaction:
    """Staged inserts and deletes over a version. Its view of a table is the committed rows without the deleted
    ones and with the inserted ones. Only staged rows, which a caller gave one by one, are on the driver; bulk
    inserts stay DataFrames."""

    def __init__(self, store: Store):
        self.store, self.version, self.open = store, store.version, True
        self.staged: dict[str, Staged] = {}
        self.counters, self.rids = dict(store.counters), dict(store.rids)
        self.aside: list[str] = []  # folders that go with the transaction

    def _aside(self, df: DataFrame) -> DataFrame:
        """The rows as they are now, written for the time of the transaction."""
        name = f"staging/{uuid.uuid4().hex}"
        self.aside.append(name)
        df.write.parquet(f"{self.store.root}/{name}")
        return self.store.spark.read.schema(df.schema).parquet(f"{self.store.root}/{name}")

    def close(self) -> None:
        self.open = False
        for name in self.aside:
            self.store.files.delete(name)
        self.aside = []

    def _of(self, name: str) -> tuple[TableDef, Staged]:
        if not self.open:
            raise RuntimeError("the transaction is over")
        if name not in self.store.catalog.tables:
            raise KeyError(name)
        return self.store.catalog.tables[name], self.staged.setdefault(name, Staged())

    def rollback(self) -> None:
        self.staged = {}
        self.close()

    def commit(self) -> int:
        return self.store.commit(self)

    # --- reading

    def rows(self, name: str) -> DataFrame:
        table, staged = self._of(name)
        out = self._left(name, staged)
        if staged.inserted:
            schema = T.StructType([*table.spark_schema.fields, T.StructField("_rid", T.LongType())])
            out = out.unionByName(self.store.spark.createDataFrame([(*_values(table, r), k) for k, r in staged.inserted.items()], schema))
        for b in staged.bulk:
            out = out.unionByName(b.numbered.select(*out.columns))
        return out

    def _left(self, name: str, staged: Staged) -> DataFrame:
        """The committed rows without those the transaction deletes."""
        out = self.store.rows(name, self.version)
        if staged.deleted:
            out = out.join(self.store.spark.createDataFrame([(k,) for k in staged.deleted], "_rid long"), "_rid", "left_anti")
        for g in staged.gone:
            out = out.join(g.select("_rid"), "_rid", "left_anti")
        return out.select(*(c.name for c in self.store.catalog.tables[name].columns), "_rid")

    def row(self, name: str, rid: int) -> dict | None:
        _, staged = self._of(name)
        if rid in staged.inserted:
            return dict(staged.inserted[rid])
        if rid in staged.deleted:
            return None
        got = self.rows(name).where(F.col("_rid") == rid).drop("_rid").take(1)
        return _stored(got[0].asDict()) if got else None

    def seek(self, name: str, /, **key: Any) -> DataFrame:
        return seek(self.rows(name), self.store.catalog.tables[name], key)

    def scan_range(self, name: str, by: list[str], *bounds: Any, **options: Any) -> DataFrame:
        return scan_range(self.rows(name), self.store.catalog.tables[name], by, *bounds, **options)

    # --- writing

    def insert(self, name: str, row: dict[str, Any]) -> int:
        """The new row's surrogate. The same row deleted in this transaction comes back instead."""
        table, staged = self._of(name)
        if set(row) != {c.name for c in table.columns}:
            raise KindError(f"a row of {name} has the columns {', '.join(c.name for c in table.columns)}")
        counters = dict(self.counters)
        values = {}
        for c in table.columns:
            v = row[c.name]
            if c.autoincrement:
                v = self._next(counters, name, c, v)
            values[c.name] = check(v, c.kind, c.nullable)
        for rid, old in staged.deleted.items():
            if old == values:
                del staged.deleted[rid]
                self.counters = counters
                return rid
        self._unique(table, staged, values)
        rid = self.rids.get(name, 0) + 1
        if rid > LAST_RID:
            raise ConstraintError(f"{name}: no surrogates are left")
        self.counters, self.rids[name] = counters, rid
        staged.inserted[rid] = values
        return rid

    def _next(self, counters: dict[str, int], name: str, c, v: Any) -> int:
        if v in (0, None):
            v = counters.get(name, 0) + 1
            if v > c.kind.range[1]:
                raise ConstraintError(f"{name}.{c.name}: the sequence is exhausted")
        if isinstance(v, int) and v > counters.get(name, 0):
            counters[name] = v
        return v

    def _unique(self, table: TableDef, staged: Staged, values: dict) -> None:
        keys = table.unique_keys() or [tuple(c.name for c in table.columns)]
        what = "duplicate row" if not table.unique_keys() else "duplicate key"
        if table.primary is None and (every := tuple(c.name for c in table.columns)) not in keys:
            keys = [*keys, every]
        for key in keys:
            own = {k: values[k] for k in key}
            if any(all(r[k] == v for k, v in own.items()) for r in staged.inserted.values()):
                raise ConstraintError(f"{table.name}: {what} {own}")
        # One look at the committed rows for all keys; event tables have none.
        if not table.event:
            found = None
            for key in keys:
                same = _matches(table, {k: values[k] for k in key})
                found = same if found is None else found | same
            rows = self._left(table.name, staged)
            for b in staged.bulk:
                rows = rows.unionByName(b.numbered.select(*rows.columns))
            if rows.where(found).take(1):
                raise ConstraintError(f"{table.name}: {what} {values}")

    def insert_many(self, name: str, rows: DataFrame) -> None:
        """Bulk insert of a DataFrame with the table's columns: checked and numbered as sets. Surrogates and
        sequence values are dealt by partition counts and places within partitions, not by one sorted task.
        Rows that the transaction deletes come back instead, each once."""
        table, staged = self._of(name)
        cast = rows.select(*(F.col(f"`{c.name}`").cast(c.kind.spark).alias(c.name) for c in table.columns))
        for c in table.columns:
            if not c.nullable and not c.autoincrement and cast.where(F.col(f"`{c.name}`").isNull()).take(1):
                raise KindError(f"null in {name}.{c.name}")
        names = [c.name for c in table.columns]
        placed = self._aside(cast.withColumn("_place", F.monotonically_increasing_id()))
        for k, g in enumerate(staged.gone):
            same = _equal(names)
            back = self._aside(g.alias("l").join(placed.alias("r"), same).groupBy("l._rid").agg(F.min("r._place").alias("_place")))
            staged.gone[k] = self._aside(g.join(back.select("_rid"), "_rid", "left_anti"))
            placed = self._aside(placed.join(back.select("_place"), "_place", "left_anti"))
        bulk = Bulk(placed)
        self._number(table, bulk)
        self._unique_many(table, staged, bulk)
        staged.bulk.append(bulk)

    def _number(self, table: TableDef, bulk: Bulk) -> None:
        """Deals surrogates and sequence values after those that are taken."""
        base = self.rids.get(table.name, 0)
        numbered = self._numbered(bulk.placed, base)
        count = numbered.agg(F.max("_rid")).first()[0] or base
        zero = next((c for c in table.columns if c.autoincrement), None)
        if zero is not None:
            start = max(self.counters.get(table.name, 0), int(numbered.agg(F.max(zero.name)).first()[0] or 0))
            if start + count - base > zero.kind.range[1]:
                raise ConstraintError(f"{table.name}.{zero.name}: the sequence is exhausted")
            value = F.when(F.coalesce(F.col(zero.name), F.lit(0)) == 0, F.lit(int(start)) + F.col("_rid") - base).otherwise(F.col(zero.name))
            numbered = numbered.withColumn(zero.name, value.cast(zero.kind.spark))
            self.counters[table.name] = int(start) + count - base
        bulk.numbered, self.rids[table.name] = numbered, count

    def refused(self, name: str, rows: DataFrame, key: tuple[str, ...]) -> DataFrame:
        """(key columns, n): values of a key that more than one of the rows have, or that the transaction's
        view of the table has too; nulls are equal. n: how many rows, with those that are there."""
        table, _ = self._of(name)
        keys = [F.col(f"`{k}`") for k in key]
        given = rows.select(*(c.cast(table.column(k).kind.spark).alias(k) for k, c in zip(key, keys, strict=True))).withColumn("_new", F.lit(1))
        both = given if table.event else given.unionByName(self.rows(name).select(*keys).withColumn("_new", F.lit(0)))
        counted = both.groupBy(*keys).agg(F.count("*").alias("n"), F.max("_new").alias("_new"))
        return counted.where("n > 1 AND _new = 1").drop("_new")

    def _unique_many(self, table: TableDef, staged: Staged, bulk: Bulk) -> None:
        keys = table.unique_keys()
        if table.primary is None and (every := tuple(c.name for c in table.columns)) not in keys:
            keys = [*keys, every]
        for key in keys:
            if got := self.refused(table.name, bulk.numbered, key).take(1):
                raise ConstraintError(f"{table.name}: duplicate values {got[0].asDict()} in a bulk insert")

    def _numbered(self, placed: DataFrame, after: int) -> DataFrame:
        """Consecutive surrogates: each partition's count is gathered (one number per partition), and a row's
        rank among its partition's places goes on from it. The rows are written, so both passes see the same."""
        part = F.shiftright("_place", 33)
        counts = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
        starts, at = {}, after
        for p, n in counts:
            starts[p], at = at, at + n
        if not starts:
            return placed.select("*", F.lit(0).cast("long").alias("_rid")).drop("_place")
        begin = self.store.spark.createDataFrame(list(starts.items()), "p long, begin long")
        ranked = placed.withColumn("_rank", F.row_number().over(Window.partitionBy(part).orderBy("_place")))
        return self._aside(ranked.join(F.broadcast(begin), part == F.col("p")).withColumn("_rid", F.col("begin") + F.col("_rank")).drop("_place", "_rank", "p", "begin"))

    def delete_many(self, name: str, rows: DataFrame) -> int:
        """Bulk delete of committed rows by their _rid; how many. Rows inserted in the same transaction just go.
        A surrogate that is not there, or stands twice, is an error."""
        _, staged = self._of(name)
        wanted = self._aside(rows.select(F.col("_rid").cast("long")))
        n = wanted.count()
        if wanted.distinct().count() != n:
            raise ConstraintError(f"{name}: a row is deleted twice")
        if (there := self.rows(name).join(wanted, "_rid", "left_semi").count()) != n:
            raise ConstraintError(f"{name}: {n - there} of the rows to delete are not there")
        own = {r["_rid"] for r in wanted.join(self.store.spark.createDataFrame([(k,) for k in staged.inserted], "_rid long"), "_rid", "left_semi").collect()} if staged.inserted else set()
        for rid in own:  # rows that a caller gave one by one
            del staged.inserted[rid]
        gone = self._aside(self._left(name, staged).join(wanted, "_rid", "left_semi"))
        for b in staged.bulk:
            b.numbered = self._aside(b.numbered.join(wanted, "_rid", "left_anti"))
            b.placed = self._aside(b.numbered.withColumn("_place", F.col("_rid")).drop("_rid"))
        staged.gone.append(gone)
        return n

    def update_many(self, name: str, rows: DataFrame) -> None:
        """Bulk update: rows with _rid and the table's columns take the place of those with the same _rid, under
        new surrogates. If the new rows are refused the old ones stay."""
        _, staged = self._of(name)
        held = (dict(staged.inserted), dict(staged.deleted), [(b, b.placed, b.numbered) for b in staged.bulk], list(staged.gone))
        new = self._aside(rows)
        try:
            self.delete_many(name, new)
            self.insert_many(name, new.drop("_rid"))
        except Exception:
            staged.inserted, staged.deleted, bulk, staged.gone = held
            staged.bulk = [b for b, _, _ in bulk]
            for b, placed, numbered in bulk:
                b.placed, b.numbered = placed, numbered
            raise

    def delete(self, name: str, rid: int) -> None:
        _, staged = self._of(name)
        if rid in staged.inserted:
            del staged.inserted[rid]
            return
        row = None if rid in staged.deleted else self.row(name, rid)
        if row is None:
            raise ConstraintError(f"{name}: no row {rid}")
        if rid > self.store.rids.get(name, 0):  # of a bulk insert of this transaction
            self.delete_many(name, self.store.spark.createDataFrame([(rid,)], "_rid long"))
            return
        staged.deleted[rid] = row

    def update(self, name: str, rid: int, row: dict[str, Any]) -> int:
        """Delete and insert; if the new row is refused the old one stays."""
        _, staged = self._of(name)
        held = (dict(staged.inserted), dict(staged.deleted))
        try:
            self.delete(name, rid)
            return self.insert(name, row)
        except Exception:
            staged.inserted, staged.deleted = held
            raise

    def revalidate(self) -> None:
        """Checks staged rows against what was committed since the transaction began."""
        self.version = self.store.version
        self.counters |= {k: max(v, self.counters.get(k, 0)) for k, v in self.store.counters.items()}
        for name, staged in self.staged.items():
            table = self.store.catalog.tables[name]
            self.rids[name] = base = self.store.rids.get(name, 0)
            rows, bulk = list(staged.inserted.values()), staged.bulk
            staged.inserted, staged.bulk = {}, []
            there = self.store.rows(name).select("_rid")
            gone = [rid for rid in staged.deleted if self.store.row(name, rid) is None]
            gone += [r["_rid"] for g in staged.gone for r in g.select("_rid").join(there, "_rid", "left_anti").take(1)]
            if gone:
                raise ConstraintError(f"{name}: no row {gone[0]}")
            for i, r in enumerate(rows, 1):
                self._unique(table, staged, r)
                staged.inserted[base + i] = r
            self.rids[name] = base + len(rows)
            for b in bulk:  # numbered anew, after what was committed
                self._number(table, b)
                self._unique_many(table, staged, b)
                staged.bulk.append(b)


def _stored(row: dict) -> dict:
    return {k: from_spark(v) for k, v in row.items()}


def _values(table: TableDef, row: dict) -> tuple:
    return tuple(to_spark(row[c.name], c.kind) for c in table.columns)


def _equal(names: list[str]):
    """Whether rows of the aliases l and r are alike in some columns; nulls are equal."""
    out = F.lit(True)
    for n in names:
        out = out & F.col(f"l.`{n}`").eqNullSafe(F.col(f"r.`{n}`"))
    return out


def _matches(table: TableDef, key: dict[str, Any]):
    out = F.lit(True)
    for k, v in key.items():
        c = table.column(k)
        out = out & F.col(f"`{k}`").eqNullSafe(column_of(v, c.kind))
    return out


def seek(rows: DataFrame, table: TableDef, key: dict[str, Any]) -> DataFrame:
    return rows.where(_matches(table, {k: check(v, table.column(k).kind, True) for k, v in key.items()}))


def scan_range(rows: DataFrame, table: TableDef, by: list[str], low: tuple | None = None, high: tuple | None = None, low_open: bool = False, high_open: bool = False) -> DataFrame:
    def beyond(bound: Iterable[Any], above: bool, open_: bool):
        """Lexicographic: beyond at the first column that differs; all equal counts unless the bound is open."""
        out = F.lit(not open_)
        for k, v in reversed(list(zip(by, bound, strict=False))):
            c, kind = F.col(f"`{k}`"), table.column(k).kind
            x = column_of(check(v, kind, True), kind)
            past = F.coalesce(c > x, c.isNotNull() & x.isNull()) if above else F.coalesce(c < x, c.isNull() & x.isNotNull())
            out = past | c.eqNullSafe(x) & out
        return out

    if low is not None:
        rows = rows.where(beyond(low, True, low_open))
    if high is not None:
        rows = rows.where(beyond(high, False, high_open))
    return rows
