"""From text to statements: a lexer of one pattern and a parser by recursive descent.

    SELECT * | alias.* | column [AS] name, ... | COUNT(*) | COUNT([DISTINCT] column) | SUM(column)  FROM relations
    relations: table [alias] {[INNER | CROSS] JOIN table [alias] [ON a.x = b.y]}
    [WHERE predicate] [ORDER BY name [ASC | DESC], ...] [LIMIT n] [OFFSET n] [;]

Only keywords ignore case; identifiers are exact. Everything else is refused.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from deltaloom.functions.kinds import Literal, number
from deltaloom.plans.errors import UnqualifiedNames, UnsupportedJoin, UnsupportedSelect, UnsupportedSQL

LONGEST, DEEPEST = 50_000, 128
#: Words that are no identifiers unless quoted.
RESERVED = frozenset("SELECT FROM WHERE AND OR ORDER BY LIMIT OFFSET GROUP HAVING JOIN ON AS INNER TRUE FALSE NULL".split())
OUTER = frozenset("LEFT RIGHT FULL OUTER NATURAL".split())


@dataclass(frozen=True)
class Ref:
    qualifier: str | None
    name: str


@dataclass(frozen=True)
class Compare:
    ref: Ref
    op: str
    literal: Literal


@dataclass(frozen=True)
class Equal:
    """Two columns are equal."""

    left: Ref
    op: str
    right: Ref


@dataclass(frozen=True)
class IsNull:
    ref: Ref
    negated: bool


@dataclass(frozen=True)
class Both:
    left: object
    right: object


@dataclass(frozen=True)
class Either:
    left: object
    right: object


@dataclass(frozen=True)
class Constant:
    value: bool


@dataclass(frozen=True)
class Relation:
    table: str
    alias: str
    on: tuple[Ref, Ref] | None = None


@dataclass(frozen=True)
class Item:
    ref: Ref
    name: str


@dataclass(frozen=True)
class Aggregate:
    function: str  # COUNT or SUM
    ref: Ref | None
    distinct: bool
    name: str


@dataclass(frozen=True)
class Statement:
    relations: tuple[Relation, ...]
    star: str | None = None  # "" for a bare star, else an alias
    items: tuple[Item, ...] = ()
    aggregate: Aggregate | None = None
    where: object = None
    order: tuple[tuple[Ref, bool], ...] = ()
    limit: Literal | None = None
    offset: Literal | None = None
    sql: str = field(default="", compare=False)


_TOKEN = re.compile(
    r"""(?P<space>[\x20\t\r\n]+)
    |(?P<hex>0[xX][0-9a-fA-F]+(?![A-Za-z_.0-9])|[xX]'[0-9a-fA-F]+'(?![A-Za-z_.]))
    |(?P<badhex>0[xX]|[xX]')
    |(?P<number>[+-]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?(?![A-Za-z_.0-9]))
    |(?P<badnumber>[+-]?\.?[0-9]|[+-])
    |(?P<string>'(?:[^']|'')*')
    |(?P<quoted>"(?:[^"]|"")*")
    |(?P<word>[A-Za-z_][A-Za-z_0-9]*)
    |(?P<param>:[A-Za-z_0-9]+)
    |(?P<op><=|>=|<>|!=|[=<>])
    |(?P<mark>[*,;.()])
    |(?P<other>.)""",
    re.VERBOSE | re.DOTALL,
)


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    raw: str


def tokens(sql: str) -> list[Token]:
    if len(sql.encode("utf-8", "surrogatepass")) > LONGEST:
        raise UnsupportedSQL("SQL query exceeds maximum allowed length")
    out = []
    for m in _TOKEN.finditer(sql):
        kind, raw = m.lastgroup, m.group()
        if kind == "space":
            continue
        if kind in ("badhex", "badnumber") or kind == "other" and raw in "'\":":
            what = {"badhex": "malformed hex literal", "badnumber": "malformed numeric literal"}.get(kind, "unterminated text" if raw != ":" else "unexpected ':'")
            raise UnsupportedSQL(f"{what} at position {m.start()}")
        text = raw[1:-1].replace(raw[0] * 2, raw[0]) if kind in ("string", "quoted") else raw
        if kind == "quoted" and not text:
            raise UnsupportedSQL(f"empty quoted identifier at position {m.start()}")
        out.append(Token(kind, text, raw))
    return [*out, Token("end", "", "end of input")]


def parse(sql: str) -> Statement:
    return _Parser(sql).statement()


class _Parser:
    def __init__(self, sql: str):
        self.sql, self.all, self.at, self.depth = sql, tokens(sql), 0, 0

    # --- tokens

    @property
    def now(self) -> Token:
        return self.all[self.at]

    def word(self, *words: str, ahead: int = 0) -> bool:
        t = self.all[min(self.at + ahead, len(self.all) - 1)]
        return t.kind == "word" and t.text.upper() in words

    def take(self, *words: str) -> bool:
        if found := self.word(*words):
            self.at += 1
        return found

    def mark(self, text: str, ahead: int = 0) -> bool:
        t = self.all[min(self.at + ahead, len(self.all) - 1)]
        return t.kind in ("mark", "op") and t.text == text

    def take_mark(self, text: str) -> bool:
        if found := self.mark(text):
            self.at += 1
        return found

    def refuse(self, wanted: str) -> UnsupportedSQL:
        return UnsupportedSQL(f"expected {wanted}, got {self.now.raw}")

    def need(self, word: str) -> None:
        if not self.take(word):
            raise self.refuse(word)

    def need_mark(self, text: str) -> None:
        if not self.take_mark(text):
            raise self.refuse(f'"{text}"')

    def is_name(self, ahead: int = 0) -> bool:
        t = self.all[min(self.at + ahead, len(self.all) - 1)]
        return t.kind == "quoted" or t.kind == "word" and t.text.upper() not in RESERVED

    def name(self, wanted: str) -> str:
        if not self.is_name():
            raise self.refuse(wanted)
        self.at += 1
        return self.all[self.at - 1].text

    # --- clauses

    def statement(self) -> Statement:
        self.need("SELECT")
        if self.word("ALL", "DISTINCT") and not self.mark(",", 1) and not self.mark(".", 1) and not self.word("FROM", "AS", ahead=1):
            raise UnsupportedSelect(self.sql)
        star, items, aggregate = self.projection()
        self.need("FROM")
        relations = self.relations()
        joined = len(relations) > 1
        where = None
        if self.take("WHERE"):
            where = self.either(joined)
        if self.word("GROUP", "HAVING"):
            raise UnsupportedSQL(f"{self.now.text.upper()} is not supported")
        order: list[tuple[Ref, bool]] = []
        if self.take("ORDER"):
            self.need("BY")
            while True:
                ref = self.ref("column name")
                order.append((ref, self.take("DESC") or self.take("ASC") and False))
                if not self.take_mark(","):
                    break
        limit = self.count() if self.take("LIMIT") else None
        offset = self.count() if self.take("OFFSET") else None
        self.take_mark(";")
        if self.now.kind != "end":
            raise UnsupportedSQL(f"unexpected token {self.now.raw}")
        if joined and any(i.ref.qualifier is None for i in items):
            raise UnqualifiedNames
        return Statement(tuple(relations), star, tuple(items), aggregate, where, tuple(order), limit, offset, self.sql)

    def projection(self) -> tuple[str | None, list[Item], Aggregate | None]:
        if self.take_mark("*"):
            return "", [], None
        if self.is_name() and self.mark(".", 1) and self.mark("*", 2):
            self.at += 3
            return self.all[self.at - 3].text, [], None
        if self.is_name() and self.mark("(", 1):
            aggregate = self.aggregate()
            if self.mark(","):
                raise UnsupportedSQL("aggregates and columns cannot be mixed")
            return None, [], aggregate
        items = []
        while True:
            ref = self.ref("projection")
            if self.mark("("):
                raise UnsupportedSQL(f"function {ref.name} is not supported")
            items.append(Item(ref, self.alias() or ref.name))
            if not self.take_mark(","):
                return None, items, None

    def alias(self) -> str | None:
        if self.take("AS"):
            return self.name("alias")
        return self.name("alias") if self.is_name() else None

    def aggregate(self) -> Aggregate:
        function = self.name("aggregate").upper()
        if function not in ("COUNT", "SUM"):
            raise UnsupportedSQL(f"function {function} is not supported")
        self.need_mark("(")
        ref, distinct = None, False
        if self.mark("*") and function == "COUNT":
            self.at += 1
        else:
            distinct = self.word("DISTINCT") and not self.mark(")", 1) and not self.mark(".", 1)
            if distinct:
                self.at += 1
                if function == "SUM":
                    raise UnsupportedSQL("SUM(DISTINCT) is not supported")
            ref = self.ref("column name")
        self.need_mark(")")
        name = self.alias()
        if name is None:
            raise UnsupportedSQL("aggregates require an alias")
        return Aggregate(function, ref, distinct, name)

    def ref(self, wanted: str) -> Ref:
        first = self.name(wanted)
        return Ref(first, self.name(wanted)) if self.take_mark(".") else Ref(None, first)

    def relations(self) -> list[Relation]:
        out = [self.relation()]
        while True:
            if self.word(*OUTER):
                raise UnsupportedJoin
            if self.word("INNER", "CROSS") and self.word("JOIN", ahead=1):
                self.at += 1
            elif self.word("INNER", "CROSS") and self.word(*OUTER, ahead=1):
                raise UnsupportedJoin
            if not self.take("JOIN"):
                if self.mark(","):
                    raise UnsupportedSQL("comma joins are not supported")
                return out
            own = self.relation()
            on = None
            if self.take("ON"):
                left = self.ref("qualified column")
                if self.now.kind == "op" and self.now.text != "=":
                    raise UnsupportedJoin
                self.need_mark("=")
                right = self.ref("qualified column")
                if left.qualifier is None or right.qualifier is None:
                    raise UnqualifiedNames
                if self.word("AND", "OR"):
                    raise UnsupportedJoin
                on = (left, right)
            out.append(Relation(own.table, own.alias, on))

    def relation(self) -> Relation:
        table = self.name("table name")
        if self.take("AS"):
            return Relation(table, self.name("alias"))
        if self.is_name() and not self.word("INNER", "CROSS", *OUTER, "UNION", "INTERSECT", "EXCEPT"):
            return Relation(table, self.name("alias"))
        return Relation(table, table)

    def count(self) -> Literal:
        if self.now.kind not in ("number", "string", "hex", "param"):
            raise self.refuse("a count")
        return self.literal()

    # --- predicates

    def either(self, joined: bool) -> object:
        out = self.both(joined)
        while self.take("OR"):
            out = Either(out, self.both(joined))
        return out

    def both(self, joined: bool) -> object:
        out = self.term(joined)
        while self.take("AND"):
            out = Both(out, self.term(joined))
        return out

    def term(self, joined: bool) -> object:
        if self.take_mark("("):
            self.depth += 1
            if self.depth > DEEPEST:
                raise UnsupportedSQL("predicate nesting is too deep")
            out = self.either(joined)
            self.need_mark(")")
            self.depth -= 1
            return out
        if self.word("TRUE", "FALSE"):
            self.at += 1
            return Constant(self.all[self.at - 1].text.upper() == "TRUE")
        ref = self.ref("column name")
        if joined and ref.qualifier is None:
            raise UnqualifiedNames
        if self.take("IS"):
            negated = self.take("NOT")
            self.need("NULL")
            return IsNull(ref, negated)
        if self.now.kind != "op":
            raise self.refuse("comparison operator")
        op = "!=" if self.now.text == "<>" else self.now.text
        self.at += 1
        if self.is_name():
            if not joined:
                raise self.refuse("literal")
            other = self.ref("column name")
            if other.qualifier is None:
                raise UnqualifiedNames
            if op != "=":
                raise UnsupportedSQL("columns compare by = only")
            return Equal(ref, op, other)
        return Compare(ref, op, self.literal())

    def literal(self) -> Literal:
        t = self.now
        self.at += 1
        if t.kind == "number" and (found := number(t.text)):
            return found
        if t.kind == "hex":
            digits = t.text[2:].rstrip("'")
            return Literal("bytes", bytes.fromhex(digits if len(digits) % 2 == 0 else "0" + digits), t.text)
        if t.kind == "string":
            return Literal("string", t.text, t.text)
        if t.kind == "param":
            return Literal("sender" if t.text == ":sender" else "parameter", t.text[1:], t.text)
        if t.kind == "word" and t.text.upper() in ("TRUE", "FALSE"):
            return Literal("bool", t.text.upper() == "TRUE", t.text.upper())
        self.at -= 1
        if self.word("NULL"):
            raise UnsupportedSQL("NULL literal not supported")
        raise self.refuse("literal")
