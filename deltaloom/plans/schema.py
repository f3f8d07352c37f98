"""Declared tables: columns with kinds, keys, indexes, read policies; what a change of declaration may do."""

from __future__ import annotations

import dataclasses
import json
import types
import typing
from dataclasses import dataclass, field

from pyspark.sql import types as T

from deltaloom.functions.kinds import KINDS, Kind
from deltaloom.plans.errors import NoSuchTable


class SchemaError(ValueError):
    pass


@dataclass(frozen=True)
class ColumnDef:
    name: str
    kind: Kind
    nullable: bool = False
    primary: bool = False
    unique: bool = False
    autoincrement: bool = False


@dataclass(frozen=True)
class IndexDef:
    name: str
    columns: tuple[str, ...]
    unique: bool = False


@dataclass(frozen=True)
class TableDef:
    name: str
    columns: tuple[ColumnDef, ...]
    indexes: tuple[IndexDef, ...] = ()
    event: bool = False
    policy: str = "private"  # private, public, or permissioned by tags
    permissions: tuple[str, ...] = ()

    def __post_init__(self):
        names = [c.name for c in self.columns]
        if not self.columns or len(set(names)) != len(names):
            raise SchemaError(f"{self.name}: columns must be there and have different names")
        keys = [c for c in self.columns if c.primary]
        counters = [c for c in self.columns if c.autoincrement]
        if len(keys) > 1 or len(counters) > 1:
            raise SchemaError(f"{self.name}: at most one primary key and one autoincrement column")
        for c in counters:
            if c.nullable or not c.kind.integer or c.kind.wide or not (c.primary or c.unique):
                raise SchemaError(f"{self.name}.{c.name}: autoincrement needs a keyed integer column without nulls")
        for c in keys:
            if c.nullable:
                raise SchemaError(f"{self.name}.{c.name}: a primary key has no nulls")
        if len({i.name for i in self.indexes}) != len(self.indexes):
            raise SchemaError(f"{self.name}: index names must be different")
        for i in self.indexes:
            if not i.columns or any(x not in names for x in i.columns) or any(x == k.name for x in i.columns for k in keys):
                raise SchemaError(f"{self.name}.{i.name}: unknown columns, or the primary key, in an index")
        if self.policy not in ("private", "public", "permissioned") or (self.policy == "permissioned") != bool(self.permissions):
            raise SchemaError(f"{self.name}: policy {self.policy} with permissions {self.permissions}")

    def column(self, name: str) -> ColumnDef | None:
        return next((c for c in self.columns if c.name == name), None)

    @property
    def primary(self) -> ColumnDef | None:
        return next((c for c in self.columns if c.primary), None)

    def unique_keys(self) -> list[tuple[str, ...]]:
        return [(c.name,) for c in self.columns if c.primary or c.unique] + [i.columns for i in self.indexes if i.unique]

    def indexed(self, name: str) -> bool:
        c = self.column(name)
        return bool(c and (c.primary or c.unique)) or any(i.columns[0] == name for i in self.indexes)

    @property
    def spark_schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, T._parse_datatype_string(c.kind.spark), True, {"kind": c.kind.name, "nullable": c.nullable}) for c in self.columns])

    def describe(self) -> dict:
        return {
            "name": self.name, "event": self.event, "policy": self.policy, "permissions": list(self.permissions),
            "columns": [{"name": c.name, "kind": c.kind.name, "nullable": c.nullable, "primary": c.primary, "unique": c.unique, "autoincrement": c.autoincrement} for c in self.columns],
            "indexes": [{"name": i.name, "columns": list(i.columns), "unique": i.unique} for i in self.indexes],
        }


def columns(**kinds: str) -> tuple[ColumnDef, ...]:
    """Shorthand: name="Int64 primary", name="String?" (nullable), name="Uint64 primary autoincrement"."""
    out = []
    for name, text in kinds.items():
        kind, *flags = text.split()
        out.append(ColumnDef(name, KINDS[kind.rstrip("?")], kind.endswith("?"), *(f in flags for f in ("primary", "unique", "autoincrement"))))
    return tuple(out)


_PYTHON = {bool: "Bool", int: "Int64", float: "Float64", str: "String", bytes: "Bytes"}


def from_dataclass(cls: type, **options) -> TableDef:
    """A table from a dataclass: Optional fields are nullable; field metadata has kind, name, primary, unique,
    autoincrement, index (a name, or True for the field's own) and skip."""
    hints, cols, indexes = typing.get_type_hints(cls), [], {}
    for f in dataclasses.fields(cls):
        m = f.metadata
        if m.get("skip"):
            continue
        own, name = hints[f.name], m.get("name", f.name)
        args = [a for a in typing.get_args(own) if a is not type(None)]
        nullable = typing.get_origin(own) in (types.UnionType, typing.Union) and len(args) == 1 and len(args) != len(typing.get_args(own))
        base = args[0] if nullable else own
        kind = m.get("kind") or ("ArrayString" if typing.get_origin(base) is list and typing.get_args(base) == (str,) else _PYTHON.get(base))
        if kind not in KINDS:
            raise SchemaError(f"{cls.__name__}.{f.name}: no kind for {own}")
        cols.append(ColumnDef(name, KINDS[kind], nullable, *(bool(m.get(k)) for k in ("primary", "unique", "autoincrement"))))
        if m.get("index"):
            indexes.setdefault(name if m["index"] is True else m["index"], []).append(name)
    return TableDef(options.pop("table", cls.__name__.lower()), tuple(cols), tuple(IndexDef(k, tuple(v)) for k, v in indexes.items()), **options)


@dataclass
class Catalog:
    """Tables and the row filters of each."""

    tables: dict[str, TableDef] = field(default_factory=dict)
    filters: dict[str, list[str]] = field(default_factory=dict)
    version: int = 1

    @classmethod
    def of(cls, *tables: TableDef) -> Catalog:
        out = cls()
        for t in tables:
            out.add(t)
        return out

    def add(self, table: TableDef) -> None:
        if table.name in self.tables:
            raise SchemaError(f"table {table.name} is declared twice")
        self.tables[table.name] = table

    def add_filter(self, table: str, predicate: str) -> None:
        """A row of the table is seen if any of its filters holds."""
        self.filters.setdefault(table, []).append(predicate)

    def lookup(self, name: str, caller: Caller | None) -> TableDef:
        table = self.tables.get(name)
        if table is None or caller is not None and not caller.may_read(table):
            raise NoSuchTable(name)
        return table

    def contract(self) -> str:
        return json.dumps({"version": self.version, "tables": [t.describe() for t in sorted(self.tables.values(), key=lambda t: t.name)]}, sort_keys=True, separators=(",", ":"))


@dataclass(frozen=True)
class Caller:
    """Who asks: an identity of 32 bytes, permission tags, or everything."""

    identity: bytes | None = None
    permissions: frozenset[str] = frozenset()
    allow_all: bool = False

    def may_read(self, table: TableDef) -> bool:
        return self.allow_all or table.policy == "public" or table.policy == "permissioned" and set(table.permissions) <= self.permissions


def incompatible(old: dict, new: dict) -> list[str]:
    """What keeps data of an old contract from being opened under a new one: only added tables and indexes,
    and changed policies, may differ."""
    out = []
    after = {t["name"]: t for t in new["tables"]}
    for t in old["tables"]:
        now = after.get(t["name"])
        if now is None:
            out.append(f"table {t['name']} was dropped")
        elif now["columns"] != t["columns"] or now["event"] != t["event"]:
            out.append(f"columns of {t['name']} changed")
        elif any(i not in now["indexes"] for i in t["indexes"]):
            out.append(f"an index of {t['name']} was dropped")
    return out
