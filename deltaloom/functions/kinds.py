"""The scalar kinds: their Spark types, the values they take from Python and from literals, and their order.

Unsigned and wide integers have no Spark type of their own. Unsigned ones up to 32 bits live in the next
wider signed type, 64 bits in decimal(20, 0); 128 and 256 bits are big-endian bytes with the sign bit
flipped, whose byte order is their numeric order. Timestamps are without zone, in UTC; durations are
microseconds; UUIDs are 16 bytes; JSON is canonical text.
"""

from __future__ import annotations

import datetime
import decimal
import json
import math
import re
from dataclasses import dataclass
from fractions import Fraction
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from deltaloom.plans.errors import InvalidLiteral, KindError, UnexpectedType, UnsupportedSQL


@dataclass(frozen=True)
class Kind:
    name: str  # of the declaration
    label: str  # in error texts
    spark: str
    bits: int = 0
    signed: bool = False

    @property
    def integer(self) -> bool:
        return bool(self.bits)

    @property
    def wide(self) -> bool:
        return self.bits > 64

    @property
    def floating(self) -> bool:
        return self.name in ("Float32", "Float64")

    @property
    def range(self) -> tuple[int, int]:
        return (-(1 << self.bits - 1), (1 << self.bits - 1) - 1) if self.signed else (0, (1 << self.bits) - 1)


_INTEGER_TYPES = {(8, True): "tinyint", (16, True): "smallint", (32, True): "int", (64, True): "bigint", (8, False): "smallint", (16, False): "int", (32, False): "bigint", (64, False): "decimal(20,0)"}
KINDS: dict[str, Kind] = {
    k.name: k
    for k in [
        Kind("Bool", "Bool", "boolean"),
        *(Kind(f"{'Int' if s else 'Uint'}{b}", f"{'I' if s else 'U'}{b}", _INTEGER_TYPES.get((b, s), "binary"), b, s) for s in (True, False) for b in (8, 16, 32, 64, 128, 256)),
        Kind("Float32", "F32", "float"), Kind("Float64", "F64", "double"), Kind("String", "String", "string"), Kind("Bytes", "Array<U8>", "binary"),
        Kind("Timestamp", "Timestamp", "timestamp_ntz"), Kind("Duration", "Duration", "bigint"), Kind("ArrayString", "Array<String>", "array<string>"),
        Kind("UUID", "UUID", "binary"), Kind("JSON", "JSON", "string"),
    ]
}

EPOCH = datetime.datetime(1970, 1, 1)


def wide_bytes(n: int, kind: Kind) -> bytes:
    return (n + (1 << kind.bits - 1) if kind.signed else n).to_bytes(kind.bits // 8, "big")


def wide_int(b: bytes, kind: Kind) -> int:
    return int.from_bytes(b, "big") - (1 << kind.bits - 1 if kind.signed else 0)


def canonical_json(text: str | bytes) -> str:
    """Without white space, keys in byte order; duplicate keys, NaN and infinities are errors."""

    def once(pairs: list[tuple[str, Any]]) -> dict:
        out = dict(pairs)
        if len(out) != len(pairs):
            raise ValueError("duplicate key")
        return dict(sorted(out.items(), key=lambda p: p[0].encode("utf-8", "surrogatepass")))

    def refuse(c: str) -> None:
        raise ValueError(c)

    class Number(str):  # numbers keep their text
        pass

    def show(x: Any) -> str:
        if isinstance(x, Number) or not isinstance(x, (str, list, dict)):
            return x if isinstance(x, Number) else {None: "null", True: "true", False: "false"}[x]
        if isinstance(x, list):
            return "[" + ",".join(map(show, x)) + "]"
        if isinstance(x, dict):
            return "{" + ",".join(f"{show(k)}:{show(v)}" for k, v in x.items()) + "}"
        out = json.dumps(x, ensure_ascii=False)
        for c in "<>&\u2028\u2029":
            out = out.replace(c, f"\\u{ord(c):04x}")
        return out

    return show(json.loads(text, object_pairs_hook=once, parse_constant=refuse, parse_float=Number, parse_int=Number))


def check(value: Any, kind: Kind, nullable: bool = False) -> Any:
    """The value as the column stores it; KindError if the kind does not have it."""
    if value is None:
        if not nullable:
            raise KindError(f"null in a column of kind {kind.name} that is not nullable")
        return None
    bad = KindError(f"{value!r} is not of kind {kind.name}")
    if kind.integer:
        if isinstance(value, (bytes, bytearray)) and kind.wide and len(value) == kind.bits // 8:
            return bytes(value)
        if isinstance(value, bool) or not isinstance(value, int) and value != int(value):
            raise bad
        lo, hi = kind.range
        if not lo <= int(value) <= hi:
            raise bad
        return wide_bytes(int(value), kind) if kind.wide else int(value)
    if kind.floating:
        if isinstance(value, bool) or not isinstance(value, (int, float)) or math.isnan(value):
            raise bad
        return float(value)
    if kind.name == "Bool" and isinstance(value, bool):
        return value
    if kind.name == "String" and isinstance(value, str):
        try:
            value.encode("utf-8")
        except UnicodeEncodeError:
            raise bad from None
        return value
    if kind.name == "JSON" and isinstance(value, (str, bytes)):
        try:
            return canonical_json(value)
        except ValueError:
            raise bad from None
    if kind.name == "Bytes" and isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if kind.name == "UUID":
        if isinstance(value, (bytes, bytearray)) and len(value) == 16:
            return bytes(value)
        if isinstance(value, str) and (u := parse_uuid(value)) is not None:
            return u
    if kind.name == "Timestamp":
        if isinstance(value, datetime.datetime):
            return value.astimezone(datetime.UTC).replace(tzinfo=None) if value.tzinfo else value
        if isinstance(value, int) and not isinstance(value, bool):
            return EPOCH + datetime.timedelta(microseconds=value)
    if kind.name == "Duration":
        if isinstance(value, datetime.timedelta):
            return value // datetime.timedelta(microseconds=1)
        if isinstance(value, int) and not isinstance(value, bool):
            return value
    if kind.name == "ArrayString" and isinstance(value, (list, tuple)) and all(isinstance(x, str) for x in value):
        return list(value)
    raise bad


def parse_uuid(text: str) -> bytes | None:
    """Lower-case hyphenated form only."""
    return bytes.fromhex(text.replace("-", "")) if re.fullmatch(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", text) else None


_RFC3339 = re.compile(r"(\d{4})-(\d\d)-(\d\d)[T ](\d\d):(\d\d):(\d\d)(?:[.,](\d+))?(Z|([+-])(\d\d):(\d\d))")


def parse_timestamp(text: str) -> datetime.datetime | None:
    m = _RFC3339.fullmatch(text)
    if not m:
        return None
    try:
        t = datetime.datetime(*(int(m[i]) for i in range(1, 7)), int((m[7] or "0")[:6].ljust(6, "0")))
        away = datetime.timedelta(hours=int(m[10] or 0), minutes=int(m[11] or 0))
        if int(m[10] or 0) > 24 or int(m[11] or 0) > 60:
            return None
        return t + away if m[9] == "-" else t - away
    except (ValueError, OverflowError):
        return None


#: Units of durations, in nanoseconds.
UNITS = {"ns": 1, "us": 10**3, "µs": 10**3, "μs": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9}
_PART = re.compile(r"(\d+\.?\d*|\.\d+)(ns|us|µs|μs|ms|s|m|h)")


def parse_duration(text: str) -> int | None:
    """Microseconds of a sequence of numbers with units, such as 1h30m or -250ms; cut towards zero."""
    sign, body = (-1, text[1:]) if text[:1] == "-" else (1, text[1:] if text[:1] == "+" else text)
    if body == "0":
        return 0
    at, total = 0, Fraction(0)
    while at < len(body):
        m = _PART.match(body, at)
        if not m:
            return None
        total, at = total + Fraction(m[1] if m[1][-1] != "." else m[1][:-1]) * UNITS[m[2]], m.end()
    nanos = int(total)
    if not body or nanos >= 1 << 63:
        return None
    return sign * (nanos // 1000)


@dataclass(frozen=True)
class Literal:
    """kind: int, float, bool, string, bytes, sender or parameter; text as it was written."""

    kind: str
    value: Any
    text: str


def number(text: str) -> Literal | None:
    """A numeric literal; what is integral in value is an integer, however it is written."""
    if not re.fullmatch(r"[+-]?(\d+(\.\d+)?|\.\d+)([eE][+-]?\d+)?", text):
        return None
    exponent = re.search(r"[eE]([+-]?\d+)$", text)
    if exponent and abs(int(exponent[1])) > 5000:
        value = float(text)
        return None if math.isinf(value) else Literal("float", value, text)
    exact = Fraction(text)
    if exact.denominator == 1:
        return Literal("int", int(exact), text)
    value = float(text)
    return None if math.isinf(value) else Literal("float", value, text)


def coerce(literal: Literal, kind: Kind, sender: bytes | None = None) -> Any:
    """The value a literal has in a column of a kind, as the column stores it."""
    if literal.kind == "sender":
        if sender is None:
            raise UnsupportedSQL(":sender requires caller identity")
        literal = Literal("bytes", sender, sender.hex())
    if literal.kind == "parameter":
        raise UnsupportedSQL(f"Unsupported expression: :{literal.value}", typed=True)
    if literal.kind == "bool":
        if kind.name == "Bool":
            return literal.value
        raise UnexpectedType("Bool", kind.label)
    invalid = InvalidLiteral(literal.text, kind.label)
    if literal.kind in ("string", "bytes") and (kind.integer or kind.floating):
        literal = number(literal.text) or _fail(invalid)
    if kind.integer:
        lo, hi = kind.range
        if literal.kind != "int" or not lo <= literal.value <= hi:
            raise invalid
        return wide_bytes(literal.value, kind) if kind.wide else literal.value
    if kind.floating:
        try:
            return float(literal.value)
        except OverflowError:
            raise invalid from None
    if kind.name == "String":
        return literal.text
    if kind.name == "Bytes":
        if literal.kind == "bytes":
            return literal.value
        digits = literal.text.removeprefix("0x")
        if not re.fullmatch(r"[0-9a-fA-F]*", digits) or len(digits) % 2:
            raise invalid
        return bytes.fromhex(digits)
    if literal.kind == "string":
        found: Any = None
        if kind.name == "Timestamp":
            found = parse_timestamp(literal.value)
        elif kind.name == "Duration":
            found = parse_duration(literal.value)
        elif kind.name == "UUID":
            found = parse_uuid(literal.value)
        elif kind.name == "JSON":
            try:
                found = canonical_json(literal.value)
            except ValueError:
                found = None
        if found is not None:
            return found
    raise invalid


def _fail(e: Exception):
    raise e


def to_spark(value: Any, kind: Kind) -> Any:
    """A stored value as createDataFrame takes it."""
    return decimal.Decimal(value) if value is not None and kind.spark.startswith("decimal") else value


def from_spark(value: Any) -> Any:
    """A collected value as it is stored."""
    return bytes(value) if isinstance(value, bytearray) else int(value) if isinstance(value, decimal.Decimal) else value


def column_of(value: Any, kind: Kind) -> Column:
    """A typed constant."""
    if value is None:
        return F.lit(None).cast(kind.spark)
    if isinstance(value, datetime.datetime):
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    if kind.spark.startswith("decimal"):
        return F.lit(str(value)).cast(kind.spark)
    return F.lit(bytearray(value) if isinstance(value, bytes) else value).cast(kind.spark)


def canonical_order(c: Column, kind: Kind) -> list[Column]:
    """What to sort by so that rows come in the order of their canonical row bytes: non-negative numbers
    before negative ones, shorter strings before longer ones, nulls first."""
    if kind.name in ("Bool", "UUID") or kind.integer and not kind.signed:
        return [c]
    if kind.wide:
        return [F.substring(c, 1, 1) < F.lit(bytearray(b"\x80")), c]
    if kind.floating:
        return [c < 0, F.abs(c)]
    if kind.integer or kind.name == "Duration":
        return [c < 0, c]
    if kind.name == "Timestamp":
        return [c < F.lit("1970-01-01").cast("timestamp_ntz"), c]
    if kind.name == "ArrayString":
        return [F.size(c), F.transform(c, lambda x: F.struct(F.octet_length(x), x))]
    return [F.octet_length(c), c]
