"""The dialect: what it accepts, what it refuses and with which text, literals, and two-valued predicates."""

import datetime

import pytest

from deltaloom import queries
from deltaloom.functions.kinds import KINDS, Literal, canonical_json, check, coerce, number, parse_duration, parse_timestamp, wide_bytes, wide_int
from deltaloom.operators import lower
from deltaloom.plans.analyzer import Analyzer
from deltaloom.plans.errors import DialectError, KindError, UnsupportedSQL, explain_error_text
from deltaloom.plans.parser import parse
from deltaloom.plans.schema import Caller, Catalog, ColumnDef, IndexDef, SchemaError, TableDef, columns, from_dataclass, incompatible

T = TableDef("t", columns(id="Uint32 primary", name="String?", points="Uint32?", u32="Uint32", raw="Bytes", on_="Bool", at="Timestamp", took="Duration", tags="ArrayString", key="UUID", doc="JSON", big="Uint128", f="Float64"), policy="public")
S = TableDef("s", columns(id="Uint32 primary", u32="Uint32?", label="String"), (IndexDef("by_u32", ("u32",)),), policy="public")
CATALOG = Catalog.of(T, S, TableDef("hidden", columns(id="Uint32 primary")), TableDef("team", columns(id="Uint32 primary"), policy="permissioned", permissions=("staff",)))
ANYONE = Caller(b"\x01" * 32)


def plan(sql, **options):
    return Analyzer(CATALOG, options.pop("caller", ANYONE), **options).plan(sql)


GOOD = "SELECT u32 FROM t WHERE id = 3 ORDER BY u32 LIMIT 4"


def refusals():
    """Statements that no rule of the grammar derives: each good one with a word or mark put where none may
    stand, each clause out of its order or given twice, and every operator and function the lexer or parser has
    no rule for."""
    clauses = ["WHERE id = 3", "ORDER BY u32", "LIMIT 4", "OFFSET 2"]
    for i, one in enumerate(clauses):
        yield f"SELECT u32 FROM t {one} {one}"
        for other in clauses[:i]:
            yield f"SELECT u32 FROM t {one} {other}"
        yield f"SELECT u32 FROM t {one.split()[0]}"
    for word in ("DISTINCT", "ALL", "TOP 3", "VALUES (4)"):
        yield GOOD.replace("SELECT", f"SELECT {word}")
    for join in ("LEFT", "RIGHT", "FULL", "FULL OUTER", "NATURAL", "LEFT SEMI"):
        yield f"SELECT s.* FROM s {join} JOIN t ON s.u32 = t.u32"
    for op in ("+", "-", "*", "/", "%", "||", "->", "->>", "<=>", "==", "~", "&", "IN", "LIKE", "BETWEEN", "MATCH", "IS", "NOT"):
        yield f"SELECT label FROM s WHERE u32 {op} (4)"
        yield f"SELECT label FROM s WHERE u32 {op} 4 = 8"
    for f in ("UPPER", "ABS", "MAX", "AVG", "COALESCE", "NOW", "ROW_NUMBER"):
        yield f"SELECT {f}(u32) AS x FROM s"
        yield f"SELECT label FROM s WHERE {f}(u32) = 1"
    for tail in ("GROUP BY label", "HAVING u32 > 1", "WINDOW w AS ()", "FETCH FIRST 2 ROWS ONLY", "FOR UPDATE", "TABLESAMPLE (3)", "LIMIT 1, 2", "ORDER BY 1 + 1", "; SELECT label FROM s"):
        yield f"SELECT label FROM s {tail}"
    for glue in ("UNION", "UNION ALL", "EXCEPT", "INTERSECT", "MINUS"):
        yield f"SELECT label FROM s {glue} SELECT name FROM t"
    for start in ("WITH q AS (SELECT label FROM s) SELECT label FROM q", "SELECT label FROM (SELECT label FROM s) q", "SELECT label FROM s, t", "SELECT label", "FROM s", "TABLE s", "EXPLAIN SELECT label FROM s", "(SELECT label FROM s)"):
        yield start
    for verb in ("INSERT INTO s VALUES (1, 2, 'x')", "UPDATE s SET u32 = 5", "DELETE FROM s WHERE u32 = 5", "MERGE INTO s USING t ON TRUE", "TRUNCATE s", "DROP TABLE s", "CREATE TABLE q (id INT)", "ALTER TABLE s ADD q INT", "START TRANSACTION", "USE s", "DESCRIBE s", "EXECUTE q"):
        yield verb
    for text in ("SELECT label FROM s WHERE label = 'never closed", 'SELECT label FROM ""', "SELECT label FROM s WHERE u32 = 7e", "SELECT label FROM s WHERE u32 = 0X", "SELECT SUM(DISTINCT u32) AS x FROM s", "SELECT COUNT(*) FROM s", "SELECT label, COUNT(*) AS n FROM s", "SELECT label FROM s WHERE label = NULL", "SELECT label FROM s WHERE u32 = u32", "", ";"):
        yield text
    yield "SELECT label FROM s WHERE " + "(" * 130 + "TRUE" + ")" * 130
    yield "SELECT label FROM s WHERE label = '" + "y" * 50_001 + "'"


REFUSED = sorted(set(refusals()), key=lambda x: (len(x), x))


def test_the_statement_that_refusals_are_made_of_is_good():
    assert plan(GOOD).limit == 4


@pytest.mark.parametrize("sql", REFUSED)
def test_other_sql_is_refused(sql):
    with pytest.raises(DialectError) as e:
        plan(sql)
    assert "nsupported" in str(e.value) or "Non-inner" in str(e.value)


@pytest.mark.parametrize(("sql", "text"), [
    ("SELECT * FROM t WHERE on_ = 1", "The literal expression `1` cannot be parsed as type `Bool`"), ("SELECT * FROM t WHERE id = TRUE", "Unexpected type: (expected) Bool != U32 (inferred)"),
    ("SELECT * FROM t WHERE id = -1", "The literal expression `-1` cannot be parsed as type `U32`"), ("SELECT * FROM t WHERE id = 1.5", "The literal expression `1.5` cannot be parsed as type `U32`"),
    ("SELECT * FROM t WHERE nope = 1", "`nope` is not in scope"), ("SELECT x.* FROM t", "`x` is not in scope"), ("SELECT ID FROM t", "`ID` is not in scope"), ("SELECT id, u32 AS id FROM t", "Duplicate name `id`"),
    ("SELECT a.* FROM t a JOIN s a ON a.id = a.id", "Duplicate name `a`"), ("SELECT * FROM T", "no such table: `T`. If the table exists, it may be marked private."),
    ("SELECT * FROM hidden", "no such table: `hidden`. If the table exists, it may be marked private."), ("SELECT * FROM team", "no such table: `team`. If the table exists, it may be marked private."),
    ("SELECT * FROM t JOIN s ON t.id = s.id", "SELECT * is not supported for joins"), ("SELECT t.* FROM t JOIN s ON t.name = s.id", "Unexpected type: (expected) String != U32 (inferred)"),
    ("SELECT a.* FROM t a JOIN t b ON a.tags = b.tags", "Invalid binary operator `=` for type `Array<String>`"), ("SELECT t.* FROM t JOIN s ON t.id = s.id WHERE id = 1", "Names must be qualified when using joins"),
    ("SELECT t.* FROM t JOIN s ON t.id < s.id", "Non-inner joins are not supported"), ("SELECT t.* FROM t JOIN s ON t.id = s.id AND t.u32 = s.u32", "Non-inner joins are not supported"), ("SELECT t.* FROM t FULL JOIN s ON t.id = s.id", "Non-inner joins are not supported"),
    ("SELECT SUM(name) AS x FROM t", "SUM aggregate only supports integer and float columns"), ("SELECT SUM(big) AS x FROM t", "SUM aggregate only supports integer and float columns"),
    ("SELECT COUNT(*) AS n FROM t ORDER BY id", "ORDER BY with aggregate projections only supports the aggregate output alias"), ("SELECT t.* FROM t JOIN s ON t.id = s.id ORDER BY s.label", "ORDER BY only supports columns from the projected table"),
    ("SELECT t.* FROM t JOIN s WHERE t.id = 1", "cross join WHERE only supports qualified column equality"), ("SELECT t.* FROM t JOIN s WHERE t.id = s.id AND t.u32 = s.u32", "cross join WHERE supports exactly one qualified column equality"),
    ("SELECT * FROM t LIMIT -1", "The literal expression `-1` cannot be parsed as type `U64`"), ("SELECT * FROM t LIMIT 18446744073709551616", "The literal expression `18446744073709551616` cannot be parsed as type `U64`"),
    ("SELECT * FROM t WHERE id = :p", "Unsupported expression: :p"), ("SELECT DISTINCT id FROM t", "Unsupported: SELECT DISTINCT id FROM t"),
    ("SELECT * FROM t WHERE key = '00000000-0000-0000-0000-00000000000G'", "The literal expression `00000000-0000-0000-0000-00000000000G` cannot be parsed as type `UUID`"),
    ("SELECT nope FROM nowhere WHERE TRUE OR bad = 1", "no such table: `nowhere`. If the table exists, it may be marked private."), ("SELECT nope FROM t WHERE TRUE OR bad = 1", "`bad` is not in scope"),
])
def test_error_texts(sql, text):
    with pytest.raises(DialectError) as e:
        plan(sql)
    assert str(e.value) == text
    assert explain_error_text(e.value, sql) == text


def test_surfaces():
    for sql in ("SELECT id FROM t", "SELECT COUNT(*) AS n FROM t", "SELECT * FROM t LIMIT 1", "SELECT * FROM t ORDER BY id"):
        with pytest.raises(DialectError, match="Unsupported: "):
            plan(sql, surface="raw_view")
    with pytest.raises(DialectError, match="Subscriptions require indexes on join columns"):
        plan("SELECT a.* FROM t a JOIN t b ON a.u32 = b.u32", surface="raw_view")
    assert plan("SELECT t.* FROM t JOIN s ON t.u32 = s.u32", surface="raw_view").emitted == 0
    with pytest.raises(DialectError, match="one relation"):
        plan("SELECT t.id, s.label FROM t JOIN s ON t.u32 = s.u32", surface="declared_view")
    with pytest.raises(DialectError, match="Unsupported: "):
        plan("SELECT t.* FROM t JOIN s ON t.u32 = s.u32 LIMIT 3", surface="declared_view")
    assert plan("SELECT * FROM hidden", caller=Caller(allow_all=True)) and plan("SELECT * FROM team", caller=Caller(permissions=frozenset({"staff"})))
    assert explain_error_text(UnsupportedSQL("x"), "q", True) == "parse: unsupported SQL: x, executing: `q`"


def test_parameters_are_exact_and_used():
    given = {"p": (KINDS["Uint32"], False, 3)}
    assert plan("SELECT * FROM t WHERE id = :p", surface="declared_query", parameters=given).where.value == 3
    for sql in ("SELECT * FROM t", "SELECT * FROM t WHERE name = :p", "SELECT * FROM t WHERE id = :p LIMIT :p"):
        with pytest.raises(DialectError):
            plan(sql, surface="declared_query", parameters=given)


def test_equal_meanings_have_equal_keys():
    same = ["SELECT * FROM t WHERE id = 1 AND u32 = 2", "select * from t where (u32 = 2) AND id = 1e0 and TRUE;", "SELECT * FROM t WHERE id = 1 AND u32 = 2 AND (id = 1 OR name = 'x')", "SELECT t.* FROM t WHERE t.u32 = 2 AND t.id = 1 OR FALSE"]
    assert len({plan(q).key() for q in same}) == 1
    assert plan("SELECT * FROM t WHERE id = 2 AND u32 = 1").key() != plan(same[0]).key()


def test_identifiers_are_exact_and_keywords_are_not():
    s = parse('sElEcT "a b"."x""y" AS "select" fRoM t "a b" wHeRe "a b".id = 1')
    assert (s.items[0].ref.name, s.items[0].name, s.relations[0].alias) == ('x"y', "select", "a b")


@pytest.mark.parametrize(("text", "value"), [("1e3", 1000), ("1.0", 1), ("-2.50e1", -25), ("99999999999999999999", 99999999999999999999), (".5e1", 5)])
def test_integral_numbers_are_integers(text, value):
    assert number(text) == Literal("int", value, text)
    assert number("1.25").kind == "float" and number("0x1") is None and number("1e999999") is None


@pytest.mark.parametrize(("literal", "kind", "value"), [
    (Literal("int", 7, "7"), "String", "7"), (Literal("string", "7", "7"), "Int8", 7), (Literal("int", 10, "0010"), "Bytes", b"\x00\x10"), (Literal("string", "0xff", "0xff"), "Bytes", b"\xff"),
    (Literal("string", "1h30m", ""), "Duration", 5_400_000_000), (Literal("string", "2020-01-01 02:00:00.123456789+02:00", ""), "Timestamp", datetime.datetime(2020, 1, 1, 0, 0, 0, 123456)),
    (Literal("string", '{"b":1, "a":[ 1.50 ]}', ""), "JSON", '{"a":[1.50],"b":1}'), (Literal("sender", "sender", ":sender"), "String", "01" * 32), (Literal("sender", "sender", ":sender"), "Bytes", b"\x01" * 32),
    (Literal("int", 1, "1"), "Uint256", (1).to_bytes(32, "big")), (Literal("int", -1, "-1"), "Int128", b"\x7f" + b"\xff" * 15),
])
def test_literals_in_columns(literal, kind, value):
    assert coerce(literal, KINDS[kind], b"\x01" * 32) == value


@pytest.mark.parametrize(("kind", "bad"), [("Int8", 128), ("Uint64", -1), ("Float64", float("nan")), ("String", "\ud800"), ("JSON", '{"a":1,"a":2}'), ("JSON", "NaN"), ("UUID", "00000000-0000-0000-0000-00000000000A"), ("Bool", 1), ("Uint128", 1 << 128), ("ArrayString", [1]), ("Int32", None)])
def test_values_outside_a_kind(kind, bad):
    with pytest.raises(KindError):
        check(bad, KINDS[kind])


def test_wide_integers_order_as_bytes():
    kind = KINDS["Int256"]
    values = [-(1 << 255), -5, -1, 0, 1, 7, (1 << 255) - 1]
    coded = [wide_bytes(v, kind) for v in values]
    assert coded == sorted(coded) and [wide_int(b, kind) for b in coded] == values
    assert parse_duration("-1.5us") == -1 and parse_duration("1") is None and parse_duration("0") == 0 and parse_timestamp("2020-02-30T00:00:00Z") is None
    assert canonical_json(' {"z" : [1, 2.0] , "é":null, "a": "<\\u00e9>" } ') == '{"a":"\\u003cé\\u003e","z":[1,2.0],"é":null}'


NULLS = [(1, None, None), (2, "a", 7), (3, "b", 7), (4, None, 9), (5, "c", None)]


@pytest.mark.parametrize(("where", "ids"), [
    ("points = 7", [2, 3]), ("points != 7", [1, 4, 5]), ("points < 9", [1, 2, 3, 5]), ("points <= 9", [1, 2, 3, 4, 5]), ("points > 7", [4]), ("points >= 7", [2, 3, 4]), ("points IS NULL", [1, 5]),
    ("points IS NOT NULL AND name IS NULL", [4]), ("name < 'b'", [1, 2, 4]), ("points != 7 OR name = 'a'", [1, 2, 4, 5]), ("TRUE", [1, 2, 3, 4, 5]), ("points = 7 AND FALSE", []),
])
def test_predicates_have_two_values(spark, where, ids):
    table = TableDef("n", columns(id="Uint32 primary", name="String?", points="Uint32?"), policy="public")
    rows = spark.createDataFrame(NULLS, "id long, name string, points long")
    got = lower.run(Analyzer(Catalog.of(table)).plan(f"SELECT id FROM n WHERE {where}"), lambda _: rows).collect()
    assert sorted(r["id"] for r in got) == ids


def test_aggregates_of_nullable_columns(spark):
    table = TableDef("n", columns(id="Uint32 primary", name="String?", points="Uint32?"), policy="public")
    rows = spark.createDataFrame(NULLS, "id long, name string, points long")
    one = lambda q: lower.run(Analyzer(Catalog.of(table)).plan(q), lambda _: rows).collect()[0][0]
    assert [one(f"SELECT {a} AS x FROM n") for a in ("COUNT(*)", "COUNT(points)", "COUNT(DISTINCT points)", "SUM(points)", "SUM(id)")] == [5, 3, 2, 23, 15]
    assert [one(f"SELECT {a} AS x FROM n WHERE id > 9") for a in ("COUNT(*)", "COUNT(points)", "SUM(points)", "SUM(id)")] == [0, 0, None, 0]


def test_sums_that_overflow_are_errors(spark):
    table = TableDef("n", columns(a="Int64", b="Uint64"), policy="public")
    rows = spark.createDataFrame([((1 << 63) - 1, str((1 << 64) - 1)), (5, "1")], "a long, b string").selectExpr("a", "cast(b as decimal(20,0)) b")
    for c in "ab":
        with pytest.raises(Exception, match="(?i)overflow"):
            lower.run(Analyzer(Catalog.of(table)).plan(f"SELECT SUM({c}) AS x FROM n"), lambda _: rows).collect()


def test_joins_keep_nulls_and_multiplicity_and_stay_equi_joins(spark):
    left = TableDef("l", columns(id="Uint32 primary", k="Uint32?"), policy="public")
    right = TableDef("r", columns(id="Uint32 primary", k="Uint32?"), policy="public")
    data = {"l": spark.createDataFrame([(1, None), (2, 5), (3, 6)], "id long, k long"), "r": spark.createDataFrame([(7, None), (8, 5), (9, 5), (10, None)], "id long, k long")}
    p = Analyzer(Catalog.of(left, right)).plan("SELECT l.* FROM l JOIN r ON l.k = r.k")
    out = lower.run(p, data.__getitem__)
    assert sorted(r["id"] for r in out.collect()) == [1, 1, 2, 2]
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_canonical_order_of_ties(spark):
    table = TableDef("n", columns(i="Int32", s="String?", f="Float64", b="Int128"), policy="public")
    rows = [(-1, "b", 1.0), (3, "aa", 1.0), (3, "b", -2.0), (3, "b", -0.0), (3, None, 9.0), (-5, "b", 1.0)]
    frame = spark.createDataFrame([(*r, bytearray(wide_bytes(0, KINDS["Int128"]))) for r in rows], "i int, s string, f double, b binary")
    got = lower.run(Analyzer(Catalog.of(table)).plan("SELECT i, s, f FROM n LIMIT 6"), lambda _: frame).collect()
    assert [tuple(r) for r in got] == [(3, None, 9.0), (3, "b", -0.0), (3, "b", -2.0), (3, "aa", 1.0), (-5, "b", 1.0), (-1, "b", 1.0)]


def test_schemas_are_checked():
    for bad in (dict(a="Uint32? primary"), dict(a="Uint32 primary", b="Uint32 primary"), dict(a="String primary autoincrement"), dict(a="Uint32 autoincrement")):
        with pytest.raises(SchemaError):
            TableDef("x", columns(**bad))
    with pytest.raises(SchemaError):
        TableDef("x", columns(a="Uint32 primary"), (IndexDef("i", ("a",)),))
    import dataclasses

    @dataclasses.dataclass
    class Player:
        id: int = dataclasses.field(metadata={"kind": "Uint64", "primary": True, "autoincrement": True})
        name: str | None = dataclasses.field(metadata={"index": "by_name"})
        tags: list[str] = dataclasses.field(metadata={"name": "labels"})
        skipped: object = dataclasses.field(metadata={"skip": True})

    t = from_dataclass(Player, table="players")
    assert t.columns == (ColumnDef("id", KINDS["Uint64"], False, True, False, True), ColumnDef("name", KINDS["String"], True), ColumnDef("labels", KINDS["ArrayString"])) and t.indexes == (IndexDef("by_name", ("name",)),)
    a, b = Catalog.of(t), Catalog.of(t, S)
    import json

    old, new = json.loads(a.contract()), json.loads(b.contract())
    assert incompatible(old, new) == [] and incompatible(new, old) == ["table s was dropped"]


def test_row_limits_are_errors(spark):
    with pytest.raises(RuntimeError):
        lower.bounded(spark.range(11), 10)
    assert len(lower.bounded(spark.range(10), 10)) == 10


def test_joins_and_visibility_take_whole_tables(spark):
    base = "/root/testdata/sf0.01"
    read = lambda t, *c: [tuple(r) for r in spark.read.parquet(f"{base}/{t}.parquet").select(*c).collect()]
    got = lambda q: sorted(map(tuple, queries.QUERIES[q](spark, base).collect()))
    orders = read("orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    seen = sorted((k, s) for k, _, s, price in orders if s == "F" or price < 20000)
    assert got("visibility_union") == seen
    assert [r[0] for r in got("visibility_join")] == [k for k, _ in seen]
    by = {}
    for k, n in read("customer", "c_custkey", "c_nationkey"):
        by.setdefault(k if k % 300 else None, []).append(n)
    assert got("join_null_keys") == sorted((k, n) for k, c, _, _ in orders for n in by.get(c if k % 7 else None, []))
    nations = {k: (name, region) for k, name, region in read("nation", "n_nationkey", "n_name", "n_regionkey")}
    regions = dict(read("region", "r_regionkey", "r_name"))
    assert got("multi_cross_edge") == sorted((regions[nations[n][1]], s, nations[n][0]) for s, n in read("supplier", "s_suppkey", "s_nationkey"))
