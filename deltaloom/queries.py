"""The registered queries of the dialect, live views and transactions over the test tables, with the SQL that
gives the same rows."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.functions.kinds import KINDS
from deltaloom.operators import live, lower
from deltaloom.plans.analyzer import Analyzer
from deltaloom.plans.errors import ConstraintError, DialectError
from deltaloom.plans.schema import Caller, Catalog, IndexDef, TableDef, columns
from deltaloom.runtime import Module, Parameter, Runtime
from deltaloom.sources.folders import shared_folder
from deltaloom.sources.store import Store, scan_range, seek
from deltaloom.streaming.views import Views

Query = Callable[[SparkSession, str], DataFrame]

TABLES = [
    TableDef("region", columns(r_regionkey="Int32 primary", r_name="String"), policy="public"),
    TableDef("nation", columns(n_nationkey="Int32 primary", n_name="String", n_regionkey="Int32"), policy="public"),
    TableDef("customer", columns(c_custkey="Int64 primary", c_name="String", c_nationkey="Int32", c_acctbal="Float64", c_mktsegment="String"), policy="public"),
    TableDef("supplier", columns(s_suppkey="Int64 primary", s_name="String", s_nationkey="Int32", s_acctbal="Float64"), policy="public"),
    TableDef("part", columns(p_partkey="Int64 primary", p_name="String", p_brand="String", p_type="String", p_size="Int32", p_retailprice="Float64"), policy="public"),
    TableDef("orders", columns(o_orderkey="Int64 primary", o_custkey="Int64", o_orderstatus="String", o_totalprice="Float64", o_orderdate="Timestamp", o_orderpriority="String"), policy="public"),
    TableDef("lineitem", columns(l_orderkey="Int64", l_partkey="Int64", l_suppkey="Int64", l_linenumber="Int32", l_quantity="Float64", l_extendedprice="Float64", l_discount="Float64", l_tax="Float64", l_returnflag="String", l_linestatus="String", l_shipdate="Timestamp"), policy="public"),
    TableDef("events", columns(event_id="Int64 primary", ts="Timestamp", user_id="Int64", event_type="String", value="Float64", props="String"), policy="public"),
    # Tables with nulls, derived from those above.
    TableDef("orders_n", columns(o_orderkey="Int64 primary", o_custkey="Int64?", o_units="Uint32?", o_totalprice="Float64"), policy="public"),
    TableDef("customer_n", columns(c_custkey="Int64?", c_name="String?", c_nationkey="Int32"), policy="public"),
    # Histories: rows come and go in transactions 1 to 20.
    TableDef("ev", columns(event_id="Int64 primary", user_id="Int64", event_type="String", amount="Int64?"), (IndexDef("by_user", ("user_id",)),), policy="public"),
    TableDef("usr", columns(c_custkey="Int64 primary", c_nationkey="Int32"), (IndexDef("by_nation", ("c_nationkey",)),), policy="public"),
    TableDef("nat", columns(n_nationkey="Int32 primary", n_name="String"), policy="public"),
    TableDef("ping", columns(user_id="Int64", event_type="String"), (IndexDef("by_user", ("user_id",)),), event=True, policy="public"),
]

#: Derived tables, in words both Spark and the test database read.
DERIVED = {
    "orders_n": "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 50 END AS o_units, o_totalprice FROM orders",
    "customer_n": "SELECT CASE WHEN c_custkey % 300 = 0 THEN NULL ELSE c_custkey END AS c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS c_name, c_nationkey FROM customer",
}
#: Histories of whole tables: columns, first transaction, and the one that ends the row (null: none).
HISTORIES = {
    "ev": ("SELECT event_id, user_id, event_type, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 100 END AS amount, event_id % 16 + 1 AS f, CASE WHEN event_id % 5 = 0 THEN 17 + event_id % 4 END AS t FROM events"),
    "usr": ("SELECT c_custkey, c_nationkey, c_custkey % 8 + 1 AS f, CASE WHEN c_custkey % 9 = 0 THEN 18 END AS t FROM customer"),
    "nat": ("SELECT n_nationkey, n_name, n_nationkey % 5 + 2 AS f, CASE WHEN n_nationkey % 6 = 0 THEN 19 END AS t FROM nation"),
    "ping": ("SELECT user_id, event_type, event_id % 16 + 1 AS f, event_id % 16 + 2 AS t FROM events"),
}


@functools.cache
def catalog() -> Catalog:
    out = Catalog.of(*TABLES)
    out.add_filter("orders", "o_orderstatus = 'F'")
    out.add_filter("orders", "o_totalprice < 20000.0")
    return out


def _base(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A derived table's text over the files it names."""
    words = text.split()
    table = words[words.index("FROM") + 1]
    select = text[len("SELECT ") : text.index(" FROM ")]
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if " WHERE " in text:
        rows = rows.where(text.split(" WHERE ")[1])
    cols, depth, at = [], 0, 0
    for i, c in enumerate(select + ","):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            cols.append(select[at:i])
            at = i + 1
    return rows.selectExpr(*cols)


def source(spark: SparkSession, sf_dir: str) -> Callable[[str], DataFrame]:
    def get(name: str) -> DataFrame:
        if name in DERIVED:
            return _base(spark, sf_dir, DERIVED[name])
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    return get


def histories(spark: SparkSession, sf_dir: str) -> live.Histories:
    def get(name: str) -> DataFrame:
        rows = _base(spark, sf_dir, HISTORIES[name])
        kinds = catalog().tables[name].columns
        return rows.select(*(F.col(c.name).cast(c.kind.spark).alias(c.name) for c in kinds), F.col("f").cast("long").alias("_from"), F.coalesce(F.col("t").cast("long"), F.lit(live.END)).alias("_to"))

    return get


ME = Caller(bytes(range(32)), frozenset())


def sql(text: str, caller: Caller | None = None, surface: str = "query", parameters: dict | None = None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return lower.run(Analyzer(catalog(), caller, surface, parameters).plan(text), source(spark, sf_dir))

    return run


def delta(text: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        plan = Analyzer(catalog(), None, "declared_view").plan(text)
        return live.deltas(plan, histories(spark, sf_dir)).withColumnsRenamed({"_tx": "tx", "_op": "op", "_n": "n"})

    return run


QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def with_tables(text: str, *names: str) -> str:
    """The text with derived tables before it."""
    return ("WITH " + ", ".join(f"{n} AS ({DERIVED[n]})" for n in names) + " " + text) if names else text


def register(name: str, query: Query, oracle: str | None) -> None:
    QUERIES[name] = query
    if oracle:
        ORACLE[name] = oracle


def both(name: str, text: str, oracle: str | None = None, *derived: str, **options) -> None:
    """A statement and its equal; without one the statement is its own."""
    register(name, sql(text, **options), with_tables(oracle or text, *derived))


# --- scans, projections, filters

both("scan_star_nation", "SELECT * FROM nation")
both("scan_alias_star", "SELECT r.* FROM region r")
both("project_alias_customer", "SELECT c_custkey AS id, c_mktsegment segment, c_name FROM customer")
both("filter_eq_str", "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'")
both("filter_eq_num_text", "SELECT * FROM part WHERE p_size = '7'", "SELECT * FROM part WHERE p_size = 7")
both("filter_ne", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F' AND o_orderstatus != 'P'")
both("filter_range", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 45 AND l_quantity < 4.9e1 AND l_discount > 0.05")
both("filter_ts", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= '1995-01-01T00:00:00Z' AND o_orderdate < '1996-07-01 02:00:00+02:00'",
     "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-07-01'")
both("filter_and_or", "SELECT p_partkey FROM part WHERE p_size < 5 OR p_size > 45 AND (p_retailprice > 1000.0 OR p_brand = 'Brand#11')")
both("filter_true_false", "SELECT n_name FROM nation WHERE TRUE AND (FALSE OR n_regionkey = 1)")
both("filter_nothing", "SELECT n_name FROM nation WHERE n_regionkey = 1 AND FALSE")
both("filter_is_null", "SELECT o_orderkey FROM orders_n WHERE o_custkey IS NULL OR o_units IS NOT NULL", None, "orders_n")
both("filter_null_eq", "SELECT o_orderkey FROM orders_n WHERE o_units = 7", None, "orders_n")
both("filter_null_ne", "SELECT o_orderkey, o_units FROM orders_n WHERE o_units != 7", "SELECT o_orderkey, o_units FROM orders_n WHERE o_units IS DISTINCT FROM 7", "orders_n")
both("filter_null_lt", "SELECT o_orderkey, o_units FROM orders_n WHERE o_units < 10", "SELECT o_orderkey, o_units FROM orders_n WHERE o_units < 10 OR o_units IS NULL", "orders_n")
both("filter_null_le", "SELECT o_orderkey FROM orders_n WHERE o_units <= 10", "SELECT o_orderkey FROM orders_n WHERE o_units <= 10 OR o_units IS NULL", "orders_n")
both("filter_null_gt", "SELECT o_orderkey FROM orders_n WHERE o_units > 10", None, "orders_n")
for _op, _same in (("=", "IS NULL"), ("!=", "IS NOT NULL"), (">", "IS NOT NULL"), (">=", "IS NULL OR TRUE"), ("<", "IS NULL AND FALSE"), ("<=", "IS NULL")):
    both({"=": "param_null_eq", "!=": "param_null_ne", ">": "param_null_gt", ">=": "param_null_ge", "<": "param_null_lt", "<=": "param_null_le"}[_op], f"SELECT o_orderkey FROM orders_n WHERE o_units {_op} :u",
         f"SELECT o_orderkey FROM orders_n WHERE o_units {_same}", "orders_n", surface="declared_query", parameters={"u": (KINDS["Uint32"], True, None)})
both("param_filter", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = :nation AND c_acctbal > :least", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 7 AND c_acctbal > 1000",
     surface="declared_query", parameters={"nation": (KINDS["Int32"], False, 7), "least": (KINDS["Float64"], False, 1000.0)})
both("sender_filter", "SELECT n_name FROM nation WHERE n_name != :sender", f"SELECT n_name FROM nation WHERE n_name <> '{ME.identity.hex()}'", caller=ME)
both("visibility_union", "SELECT o_orderkey, o_orderstatus FROM orders", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' OR o_totalprice < 20000", caller=ME)
both("visibility_join", "SELECT a.* FROM orders a JOIN orders b ON a.o_orderkey = b.o_orderkey",
     "SELECT * FROM orders WHERE o_orderstatus = 'F' OR o_totalprice < 20000", caller=ME)


def _point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seek(source(spark, sf_dir)("orders_n"), catalog().tables["orders_n"], {"o_custkey": None})


register("index_seek_null", _point, with_tables("SELECT * FROM orders_n WHERE o_custkey IS NULL", "orders_n"))


def _range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = source(spark, sf_dir)("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return scan_range(rows, catalog().tables["lineitem"], ["l_orderkey", "l_linenumber"], (100, 3), (200,), low_open=True)


register("index_range_prefix", _range, "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_orderkey > 100 OR (l_orderkey = 100 AND l_linenumber > 3)) AND l_orderkey <= 200")

# --- order, limit, offset

both("order_limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 1e1")
both("order_multi", "SELECT c_custkey, c_mktsegment, c_nationkey FROM customer ORDER BY c_mktsegment, c_nationkey DESC, c_custkey LIMIT 70")
both("order_alias", "SELECT p_partkey AS k, p_retailprice AS price FROM part ORDER BY price DESC, k LIMIT 25")
both("order_nulls", "SELECT o_orderkey, o_units FROM orders_n ORDER BY o_units, o_orderkey DESC LIMIT 40", "SELECT o_orderkey, o_units FROM orders_n ORDER BY o_units NULLS FIRST, o_orderkey DESC LIMIT 40", "orders_n")
both("order_nulls_desc", "SELECT o_orderkey, o_units FROM orders_n ORDER BY o_units DESC, o_orderkey LIMIT 30 OFFSET 5000", "SELECT o_orderkey, o_units FROM orders_n ORDER BY o_units DESC NULLS LAST, o_orderkey LIMIT 30 OFFSET 5000", "orders_n")
both("order_canonical_ties", "SELECT n_name, n_regionkey FROM nation ORDER BY n_regionkey LIMIT 7", "SELECT n_name, n_regionkey FROM nation ORDER BY n_regionkey, n_nationkey LIMIT 7")
both("limit_canonical", "SELECT c_custkey FROM customer LIMIT 10", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 10")
both("offset_alone", "SELECT n_nationkey FROM nation OFFSET 20", "SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 20")
both("limit_zero", "SELECT n_nationkey FROM nation LIMIT 0")
both("offset_huge", "SELECT n_nationkey FROM nation OFFSET 18446744073709551615", "SELECT n_nationkey FROM nation WHERE FALSE")

# --- joins

both("join_equi_proj", "SELECT o.o_orderkey AS k, c.c_name AS who, o.o_totalprice FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'BUILDING'")
both("join_right_star", "SELECT n.* FROM region r INNER JOIN nation n ON r.r_regionkey = n.n_regionkey")
both("join_multiplicity", "SELECT r.* FROM region r JOIN nation n ON r.r_regionkey = n.n_regionkey")
both("join_filter_or", "SELECT o.o_orderkey, c.c_custkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 150000.0 OR c.c_acctbal < 0.0")
both("join_null_keys", "SELECT o.o_orderkey, c.c_nationkey FROM orders_n o JOIN customer_n c ON o.o_custkey = c.c_custkey",
     "SELECT o.o_orderkey, c.c_nationkey FROM orders_n o JOIN customer_n c ON o.o_custkey IS NOT DISTINCT FROM c.c_custkey", "orders_n", "customer_n")
both("join_where_eq", "SELECT s.* FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey WHERE n.n_regionkey = s.s_nationkey")
both("join_order_limit", "SELECT c.c_name, o.o_orderkey FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey ORDER BY o.o_orderkey DESC LIMIT 64")
both("cross_join", "SELECT n.* FROM nation n CROSS JOIN region r")
both("cross_join_where", "SELECT n.n_name, r.r_name FROM nation n JOIN region r WHERE n.n_regionkey = r.r_regionkey AND r.r_name != 'ASIA'", "SELECT n.n_name, r.r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey AND r.r_name <> 'ASIA'")
both("self_join", "SELECT a.n_name AS one, b.n_name AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < 10")
both("self_cross", "SELECT a.* FROM region a CROSS JOIN region b")
both("multi3", "SELECT l.l_orderkey, l.l_linenumber, c.c_name, o.o_orderdate FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey WHERE l.l_quantity > 48")
both("multi4", "SELECT n.n_name, c.c_custkey, o.o_orderkey, l.l_linenumber FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey JOIN orders o ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE n.n_regionkey = 2 AND l.l_returnflag = 'R'")
both("multi_self_alias", "SELECT a.n_name AS x, b.n_name AS y, r.r_name FROM nation a JOIN region r ON a.n_regionkey = r.r_regionkey JOIN nation b ON b.n_regionkey = r.r_regionkey WHERE a.n_name != 'CHINA'")
both("multi_cross_edge", "SELECT r.r_name, s.s_suppkey, n.n_name FROM region r CROSS JOIN supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey WHERE n.n_regionkey = r.r_regionkey",
     "SELECT r.r_name, s.s_suppkey, n.n_name FROM region r, supplier s, nation n WHERE n.n_nationkey = s.s_nationkey AND n.n_regionkey = r.r_regionkey")
both("multi_star", "SELECT c.* FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name = 'EUROPE'")

# --- aggregates

both("count_star", "SELECT COUNT(*) AS n FROM lineitem WHERE l_quantity > 10")
both("count_col", "SELECT COUNT(o_units) AS n FROM orders_n", None, "orders_n")
both("count_distinct", "SELECT COUNT(DISTINCT o_units) AS n FROM orders_n", None, "orders_n")
both("sum_int", "SELECT SUM(l_linenumber) AS total FROM lineitem", "SELECT CAST(SUM(l_linenumber) AS BIGINT) AS total FROM lineitem")
both("sum_long", "SELECT SUM(l_partkey) AS total FROM lineitem WHERE l_tax > 0.02", "SELECT CAST(SUM(l_partkey) AS BIGINT) AS total FROM lineitem WHERE l_tax > 0.02")
both("sum_float", "SELECT SUM(l_quantity) AS total FROM lineitem")


def _unsigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql("SELECT SUM(o_units) AS total FROM orders_n")(spark, sf_dir).select(F.col("total").cast("bigint").alias("total"))


register("sum_uint", _unsigned, with_tables("SELECT CAST(SUM(o_units) AS BIGINT) AS total FROM orders_n", "orders_n"))
both("sum_empty_notnull", "SELECT SUM(l_linenumber) AS total FROM lineitem WHERE FALSE", "SELECT CAST(0 AS BIGINT) AS total")
both("sum_empty_float", "SELECT SUM(l_quantity) AS total FROM lineitem WHERE FALSE", "SELECT CAST(0 AS DOUBLE) AS total")
register("sum_empty_nullable", lambda s, d: sql("SELECT SUM(o_units) AS total FROM orders_n WHERE o_orderkey < 0")(s, d).select(F.col("total").cast("bigint").alias("total")), "SELECT CAST(NULL AS BIGINT) AS total")
both("agg_limit0", "SELECT COUNT(*) AS n FROM nation LIMIT 0", "SELECT CAST(0 AS BIGINT) AS n WHERE FALSE")
both("agg_offset1", "SELECT COUNT(*) AS n FROM nation OFFSET 1", "SELECT CAST(0 AS BIGINT) AS n WHERE FALSE")
both("agg_order_alias", "SELECT COUNT(*) AS n FROM nation ORDER BY n DESC LIMIT 5")
both("agg_join", "SELECT SUM(l.l_linenumber) AS total FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE o.o_orderstatus = 'F'", "SELECT CAST(SUM(l.l_linenumber) AS BIGINT) AS total FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE o.o_orderstatus = 'F'")
both("agg_cross", "SELECT COUNT(*) AS n FROM orders o CROSS JOIN customer c", "SELECT (SELECT COUNT(*) FROM orders) * (SELECT COUNT(*) FROM customer) AS n")
both("agg_multi", "SELECT COUNT(*) AS n FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_nationkey = 3")
both("agg_multi_distinct", "SELECT COUNT(DISTINCT c.c_custkey) AS n FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey WHERE l.l_returnflag = 'R'")

# --- live views: the difference of every version to the one before, by its definition


def _states(select: str, tables: list[tuple[str, str]], on: str = "TRUE", where: str = "TRUE") -> str:
    """Rows of a query at each version v, with how often; tables are (history, alias)."""
    alive = " AND ".join(f"{a}.f <= v AND (v < {a}.t OR {a}.t IS NULL)" for _, a in tables)
    return f"SELECT v, {select}, COUNT(*) AS k FROM versions CROSS JOIN {' CROSS JOIN '.join(f'h_{n} {a}' for n, a in tables)} WHERE {alive} AND ({on}) AND ({where}) GROUP BY ALL"


def _difference(states: str, names: list[str], tables: list[str], event: bool = False) -> str:
    head = "WITH versions AS (SELECT CAST(range AS BIGINT) AS v FROM range(0, 22)), " + ", ".join(f"h_{n} AS ({HISTORIES[n]})" for n in dict.fromkeys(tables))
    cols = ", ".join(names)
    rows = f"{head}, states AS ({states}), ends AS (SELECT v AS tx, {cols}, k AS w FROM states UNION ALL SELECT v + 1 AS tx, {cols}, -k AS w FROM states WHERE v < 21), net AS (SELECT tx, {cols}, SUM(w) AS w FROM ends GROUP BY ALL HAVING SUM(w) <> 0)"
    if event:
        return f"{head}, states AS ({states}) SELECT v AS tx, 'insert' AS op, CAST(k AS BIGINT) AS n, {cols} FROM states"
    return f"{rows} SELECT tx, CASE WHEN w > 0 THEN 'insert' ELSE 'delete' END AS op, CAST(ABS(w) AS BIGINT) AS n, {cols} FROM net WHERE tx > 0 AND tx < 22"


def view(name: str, text: str, select: str, names: list[str], tables: list[tuple[str, str]], on: str = "TRUE", where: str = "TRUE", event: bool = False) -> None:
    register(name, delta(text), _difference(_states(select, tables, on, where), names, [n for n, _ in tables], event))


view("live_single", "SELECT event_id, amount FROM ev WHERE event_type = 'click' AND amount < 60", "event_id, CAST(amount AS BIGINT) AS amount", ["event_id", "amount"], [("ev", "e")], where="event_type = 'click' AND (amount < 60 OR amount IS NULL)")
view("live_projection_merges", "SELECT event_type FROM ev", "event_type", ["event_type"], [("ev", "e")])
view("live_join", "SELECT e.* FROM ev e JOIN usr u ON e.user_id = u.c_custkey WHERE u.c_nationkey < 12", "e.event_id, e.user_id, e.event_type, CAST(e.amount AS BIGINT) AS amount", ["event_id", "user_id", "event_type", "amount"], [("ev", "e"), ("usr", "u")], "e.user_id = u.c_custkey", "u.c_nationkey < 12")
view("live_cross", "SELECT n.* FROM nat n CROSS JOIN usr u", "n.n_nationkey, n.n_name", ["n_nationkey", "n_name"], [("nat", "n"), ("usr", "u")])
view("live_self_join", "SELECT a.* FROM usr a JOIN usr b ON a.c_nationkey = b.c_nationkey", "a.c_custkey, a.c_nationkey", ["c_custkey", "c_nationkey"], [("usr", "a"), ("usr", "b")], "a.c_nationkey = b.c_nationkey")
view("live_multi", "SELECT e.event_id, u.c_custkey, n.n_name FROM ev e JOIN usr u ON e.user_id = u.c_custkey JOIN nat n ON u.c_nationkey = n.n_nationkey", "e.event_id, u.c_custkey, n.n_name", ["event_id", "c_custkey", "n_name"], [("ev", "e"), ("usr", "u"), ("nat", "n")], "e.user_id = u.c_custkey AND u.c_nationkey = n.n_nationkey")
view("live_event", "SELECT p.* FROM ping p JOIN usr u ON p.user_id = u.c_custkey", "p.user_id, p.event_type", ["user_id", "event_type"], [("ping", "p"), ("usr", "u")], "p.user_id = u.c_custkey", event=True)


def _values(aggregate: str, tables: list[tuple[str, str]], on: str = "TRUE", where: str = "TRUE") -> str:
    alive = " AND ".join(f"{a}.f <= v AND (v < {a}.t OR {a}.t IS NULL)" for _, a in tables)
    head = "WITH versions AS (SELECT CAST(range AS BIGINT) AS v FROM range(0, 22)), " + ", ".join(f"h_{n} AS ({HISTORIES[n]})" for n in dict.fromkeys(n for n, _ in tables))
    per = f"SELECT v, (SELECT {aggregate} FROM {' CROSS JOIN '.join(f'h_{n} {a}' for n, a in tables)} WHERE {alive} AND ({on}) AND ({where})) AS x FROM versions"
    return f"{head}, per AS ({per}), steps AS (SELECT v AS tx, x, LAG(x) OVER (ORDER BY v) AS was, ROW_NUMBER() OVER (ORDER BY v) AS i FROM per), moved AS (SELECT * FROM steps WHERE i > 1 AND x IS DISTINCT FROM was) SELECT tx, 'insert' AS op, CAST(1 AS BIGINT) AS n, x FROM moved UNION ALL SELECT tx, 'delete' AS op, CAST(1 AS BIGINT) AS n, was AS x FROM moved"


register("live_count", delta("SELECT COUNT(*) AS x FROM ev WHERE event_type = 'view'"), _values("COUNT(*)", [("ev", "e")], where="event_type = 'view'"))
register("live_count_col", delta("SELECT COUNT(amount) AS x FROM ev"), _values("COUNT(amount)", [("ev", "e")]))
register("live_sum", delta("SELECT SUM(amount) AS x FROM ev WHERE user_id = 7"), _values("CAST(SUM(amount) AS BIGINT)", [("ev", "e")], where="user_id = 7"))
register("live_sum_notnull", delta("SELECT SUM(u.c_custkey) AS x FROM ev e JOIN usr u ON e.user_id = u.c_custkey"), _values("CAST(COALESCE(SUM(u.c_custkey), 0) AS BIGINT)", [("ev", "e"), ("usr", "u")], "e.user_id = u.c_custkey"))
register("live_distinct", delta("SELECT COUNT(DISTINCT user_id) AS x FROM ev WHERE amount > 90"), _values("COUNT(DISTINCT user_id)", [("ev", "e")], where="amount > 90"))
register("live_window", delta("SELECT event_id, amount FROM ev WHERE event_type = 'purchase' ORDER BY amount DESC, event_id LIMIT 5 OFFSET 2"), _difference(
    "SELECT v, event_id, amount, CAST(1 AS BIGINT) AS k FROM (SELECT v, event_id, CAST(amount AS BIGINT) AS amount, ROW_NUMBER() OVER (PARTITION BY v ORDER BY amount DESC NULLS LAST, event_id) AS i FROM versions CROSS JOIN h_ev e WHERE e.f <= v AND (v < e.t OR e.t IS NULL) AND event_type = 'purchase') WHERE i > 2 AND i <= 7", ["event_id", "amount"], ["ev"]))


def _initial(spark: SparkSession, sf_dir: str, op: str, at: int) -> DataFrame:
    plan = Analyzer(catalog(), None, "declared_view").plan("SELECT u.* FROM usr u JOIN nat n ON u.c_nationkey = n.n_nationkey")
    return live.snapshot(plan, histories(spark, sf_dir), at, op).withColumnsRenamed({"_tx": "tx", "_op": "op", "_n": "n"})


for _name, _op, _at in (("live_initial", "insert", 6), ("live_final", "delete", 19)):
    register(_name, functools.partial(_initial, op=_op, at=_at), f"WITH h_usr AS ({HISTORIES['usr']}), h_nat AS ({HISTORIES['nat']}) SELECT CAST({_at} AS BIGINT) AS tx, '{_op}' AS op, COUNT(*) AS n, u.c_custkey, u.c_nationkey FROM h_usr u JOIN h_nat n ON u.c_nationkey = n.n_nationkey WHERE u.f <= {_at} AND ({_at} < u.t OR u.t IS NULL) AND n.f <= {_at} AND ({_at} < n.t OR n.t IS NULL) GROUP BY ALL")


def _net_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw changes with rows that one transaction inserts and deletes, as net changes per transaction."""
    e = source(spark, sf_dir)("events").select("event_id", "user_id", (F.col("event_id") % 16 + 1).alias("_tx"))
    undone = e.where("event_id % 6 = 0").withColumn("_w", F.lit(-1))
    later = e.where("event_id % 6 = 1").select("event_id", "user_id", F.lit(17).cast("long").alias("_tx"), F.lit(-1).alias("_w"))
    every = e.withColumn("_w", F.lit(1)).unionByName(undone).unionByName(later)
    return live.netted(every, ["event_id", "user_id"]).select(F.col("_tx").alias("tx"), "event_id", "user_id", F.col("_w").cast("long").alias("w"))


register("tx_net_effect", _net_effect, "SELECT event_id % 16 + 1 AS tx, event_id, user_id, CAST(1 AS BIGINT) AS w FROM events WHERE event_id % 6 <> 0 UNION ALL SELECT CAST(17 AS BIGINT), event_id, user_id, CAST(-1 AS BIGINT) FROM events WHERE event_id % 6 = 1")


def _own_folder(spark: SparkSession) -> str:
    """A folder for one store, which is deleted when the application ends."""
    name = f"{shared_folder(spark)}/deltaloom-store-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return name


def _replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulk inserts in three transactions, deletes, a snapshot, more changes; then the rows of a store that was
    opened anew."""
    root = _own_folder(spark)
    own = Catalog.of(TableDef("kept", columns(event_id="Int64 primary", user_id="Int64")))
    store = Store(spark, root, own)
    e = source(spark, sf_dir)("events").select("event_id", "user_id")
    for k in range(3):
        tx = store.begin()
        tx.insert_many("kept", e.where(f"event_id % 3 = {k}"))
        if k == 2:
            for r in store.seek("kept", event_id=3).collect():
                tx.delete("kept", r["_rid"])
        tx.commit()
        if k == 1:
            store.snapshot()
            store.compact()
    return Store(spark, root, own).table("kept")


register("recover_replay", _replay, "SELECT event_id, user_id FROM events WHERE event_id <> 3")

# --- transactions, run by the engine over whole tables

PEOPLE = TableDef("people", columns(id="Int64 primary autoincrement", c_custkey="Int64", c_nationkey="Int32", c_acctbal="Float64"), (IndexDef("by_key", ("c_custkey",), True),), policy="public")
TAGS = TableDef("tags", columns(o_custkey="Int64?", o_units="Uint32?"), policy="public")
UNITS = TableDef("units", columns(o_orderkey="Int64 primary", o_units="Uint32?"), (IndexDef("by_units", ("o_units",), True),), policy="public")
PINGS = TableDef("pings", columns(user_id="Int64", event_type="String"), event=True, policy="public")


def _people(spark: SparkSession, sf_dir: str, more: str = "TRUE") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").where(more).selectExpr("0L AS id", "c_custkey", "c_nationkey", "c_acctbal")


def _store(spark: SparkSession, *tables: TableDef) -> Store:
    return Store(spark, _own_folder(spark), Catalog.of(*tables))


def _refused(work: Callable[[], object]) -> bool:
    try:
        work()
    except ConstraintError:
        return True
    return False


def _sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence values of two bulk inserts: all numbers from one on, each once, in the order of transactions."""
    store = _store(spark, PEOPLE)
    for rest in (0, 1):
        tx = store.begin()
        tx.insert_many("people", _people(spark, sf_dir, f"c_custkey % 2 = {rest}"))
        tx.commit()
    return store.table("people").groupBy((F.col("c_custkey") % 2).alias("rest")).agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count_distinct("id").alias("n"))


register("tx_sequence", _sequence, "WITH s AS (SELECT c_custkey % 2 AS rest, COUNT(*) AS n FROM customer GROUP BY 1) SELECT rest, CASE WHEN rest = 0 THEN 1 ELSE 1 + (SELECT n FROM s WHERE rest = 0) END AS low, CASE WHEN rest = 0 THEN n ELSE (SELECT SUM(n)::BIGINT FROM s) END AS high, n FROM s")


def _updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An update of every customer of five nations, a delete of another's, and one update that is refused."""
    store = _store(spark, PEOPLE)
    tx = store.begin()
    tx.insert_many("people", _people(spark, sf_dir))
    tx.commit()
    tx = store.begin()
    tx.update_many("people", tx.rows("people").where("c_nationkey < 5").withColumn("c_acctbal", F.lit(0.5)))
    tx.delete_many("people", tx.seek("people", c_nationkey=9))
    if not _refused(lambda: tx.update_many("people", tx.seek("people", c_nationkey=8).withColumn("c_custkey", F.lit(-1)))):
        raise AssertionError("equal keys were taken")
    tx.commit()
    return store.table("people").select("c_custkey", "c_nationkey", "c_acctbal")


register("tx_update", _updated, "SELECT c_custkey, c_nationkey, CASE WHEN c_nationkey < 5 THEN 0.5 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_nationkey <> 9")


def _undeleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a nation's customers that are deleted and partly given again, alike or changed, the net changes."""
    store = _store(spark, PEOPLE)
    tx = store.begin()
    tx.insert_many("people", _people(spark, sf_dir))
    tx.commit()
    tx = store.begin()
    rows = tx.seek("people", c_nationkey=3)
    tx.delete_many("people", rows)
    given = rows.where("c_custkey % 3 <> 0").withColumn("c_acctbal", F.expr("CASE WHEN c_custkey % 3 = 1 THEN c_acctbal ELSE -1.0D END"))
    tx.insert_many("people", store.rows("people").join(given.select("_rid", F.col("c_acctbal").alias("b")), "_rid").withColumn("c_acctbal", F.col("b")).drop("_rid", "b"))
    tx.commit()
    return store.changes("people", 1).select("c_custkey", "c_acctbal", F.col("_w").cast("long").alias("w"))


register("tx_undelete", _undeleted, "SELECT c_custkey, c_acctbal, CAST(-1 AS BIGINT) AS w FROM customer WHERE c_nationkey = 3 AND c_custkey % 3 <> 1 UNION ALL SELECT c_custkey, -1.0::DOUBLE, CAST(1 AS BIGINT) FROM customer WHERE c_nationkey = 3 AND c_custkey % 3 = 2")


def _violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys, nulls among them, that a unique index refuses, by the check that transactions make."""
    store = _store(spark, UNITS)
    tx = store.begin()
    rows = source(spark, sf_dir)("orders_n").select("o_orderkey", "o_units")
    if not _refused(lambda: tx.insert_many("units", rows)):
        raise AssertionError("equal keys were taken")
    return tx.refused("units", rows, ("o_units",)).select(F.col("o_units").cast("bigint").alias("o_units"), "n")


register("tx_unique", _violations, with_tables("SELECT CAST(o_units AS BIGINT) AS o_units, COUNT(*) AS n FROM orders_n GROUP BY o_units HAVING COUNT(*) > 1", "orders_n"))


def _set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table without a key is a set: different rows are taken, and none of them again."""
    store = _store(spark, TAGS)
    rows = source(spark, sf_dir)("orders_n").select("o_custkey", "o_units")
    tx = store.begin()
    if not _refused(lambda: tx.insert_many("tags", rows)):
        raise AssertionError("equal rows were taken")
    tx.insert_many("tags", rows.distinct())
    tx.commit()
    if not _refused(lambda: store.begin().insert_many("tags", rows.distinct().limit(1))):
        raise AssertionError("a row was taken again")
    return store.table("tags").select("o_custkey", F.col("o_units").cast("bigint").alias("o_units"))


register("tx_set", _set, with_tables("SELECT DISTINCT o_custkey, CAST(o_units AS BIGINT) AS o_units FROM orders_n", "orders_n"))


def _event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an event table, equal ones among them: in the changes of their transaction, never in the table."""
    store = _store(spark, PINGS)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type")
    for rest in (0, 1):
        tx = store.begin()
        tx.insert_many("pings", rows.where(f"user_id % 2 = {rest}").distinct())
        tx.commit()
    there = store.table("pings").select("user_id", "event_type", F.lit(0).cast("long").alias("tx"))
    return store.changes("pings").select("user_id", "event_type", F.col("_tx").alias("tx")).unionByName(there)


register("tx_event", _event_rows, "SELECT DISTINCT user_id, event_type, user_id % 2 + 1 AS tx FROM events")


def _crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three writers that began at one version: the first commits, the second has a key of it and is refused,
    the third is numbered anew. n_ids and n_rids show that nothing stands twice."""
    store = _store(spark, PEOPLE)
    writers = [store.begin() for _ in range(3)]
    for tx, part in zip(writers, ("c_nationkey < 10", "c_nationkey between 9 and 12", "c_nationkey > 15"), strict=True):
        tx.insert_many("people", _people(spark, sf_dir, part))
    writers[0].commit()
    if not _refused(writers[1].commit):
        raise AssertionError("equal keys were committed")
    writers[1].rollback()
    writers[2].commit()
    return store.rows("people").agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"), F.count_distinct("_rid").alias("n_rids"), F.count_distinct("c_custkey").alias("n_keys"))


register("tx_bulk_conflict", _crossing, "SELECT COUNT(*) AS n, COUNT(*) AS n_ids, COUNT(*) AS n_rids, COUNT(*) AS n_keys FROM customer WHERE c_nationkey < 10 OR c_nationkey > 15")


def _transaction_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a transaction sees before it commits: the committed rows without the deleted, with the inserted ones,
    through an index seek and a range scan; and the table after it is rolled back."""
    store = _store(spark, PEOPLE)
    tx = store.begin()
    tx.insert_many("people", _people(spark, sf_dir, "c_nationkey <> 4"))
    tx.commit()
    tx = store.begin()
    tx.delete_many("people", tx.seek("people", c_nationkey=7))
    tx.insert_many("people", _people(spark, sf_dir, "c_nationkey = 4"))
    seen = tx.scan_range("people", ["c_custkey"], (100,), (900,)).unionByName(tx.seek("people", c_nationkey=4).where("c_custkey > 900"))
    kept = seen.select("c_custkey", F.lit("seen").alias("at")).checkpoint()
    tx.rollback()
    return kept.unionByName(store.seek("people", c_nationkey=7).select("c_custkey", F.lit("after").alias("at")))


register("tx_view", _transaction_view, "SELECT c_custkey, 'seen' AS at FROM customer WHERE c_nationkey <> 7 AND c_custkey BETWEEN 100 AND 900 OR c_nationkey = 4 AND c_custkey > 900 UNION ALL SELECT c_custkey, 'after' FROM customer WHERE c_nationkey = 7")

# --- views over a store, and reads through the runtime


def _after_snapshot(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A subscription's changes over a delete, a snapshot, a compaction, more changes and a new process."""
    root, own = _own_folder(spark), Catalog.of(PEOPLE)
    store = Store(spark, root, own)
    tx = store.begin()
    tx.insert_many("people", _people(spark, sf_dir, "c_custkey % 4 <> 0"))
    tx.commit()
    plan = Analyzer(own, None, "declared_view").plan(text)
    Views(store).subscribe("one", "s", [plan])
    tx = store.begin()
    tx.delete_many("people", tx.rows("people").where("c_custkey % 4 = 1"))
    tx.commit()
    store.snapshot()
    store.compact()
    tx = store.begin()
    tx.insert_many("people", _people(spark, sf_dir, "c_custkey % 4 = 0"))
    tx.commit()
    later = Views(Store(spark, root, own))
    later.store.snapshot()
    later.store.compact()
    return later.pending()[plan.key()].withColumnsRenamed({"_tx": "tx", "_op": "op", "_n": "n"})


register("live_after_snapshot", lambda s, d: _after_snapshot(s, d, "SELECT c_custkey, c_nationkey FROM people"),
         "SELECT CAST(2 AS BIGINT) AS tx, 'delete' AS op, CAST(1 AS BIGINT) AS n, c_custkey, c_nationkey FROM customer WHERE c_custkey % 4 = 1 UNION ALL SELECT CAST(3 AS BIGINT), 'insert', CAST(1 AS BIGINT), c_custkey, c_nationkey FROM customer WHERE c_custkey % 4 = 0")
register("live_after_snapshot_count", lambda s, d: _after_snapshot(s, d, "SELECT COUNT(*) AS k FROM people"),
         "WITH c AS (SELECT COUNT(*) FILTER (c_custkey % 4 <> 0) AS a, COUNT(*) FILTER (c_custkey % 4 > 1) AS b, COUNT(*) FILTER (c_custkey % 4 <> 1) AS e FROM customer) SELECT CAST(2 AS BIGINT) AS tx, 'delete' AS op, CAST(1 AS BIGINT) AS n, a AS k FROM c UNION ALL SELECT CAST(2 AS BIGINT), 'insert', CAST(1 AS BIGINT), b FROM c UNION ALL SELECT CAST(3 AS BIGINT), 'delete', CAST(1 AS BIGINT), b FROM c UNION ALL SELECT CAST(3 AS BIGINT), 'insert', CAST(1 AS BIGINT), e FROM c")
register("live_since_join", lambda s, d: live.deltas(Analyzer(catalog(), None, "declared_view").plan("SELECT e.* FROM ev e JOIN usr u ON e.user_id = u.c_custkey"), histories(s, d), 16).withColumnsRenamed({"_tx": "tx", "_op": "op", "_n": "n"}),
         _difference(_states("e.event_id, e.user_id, e.event_type, CAST(e.amount AS BIGINT) AS amount", [("ev", "e"), ("usr", "u")], "e.user_id = u.c_custkey"), ["event_id", "user_id", "event_type", "amount"], ["ev", "usr"]).replace("WHERE tx > 0", "WHERE tx > 16"))
register("live_event_count", delta("SELECT COUNT(*) AS x FROM ping WHERE event_type = 'click'"),
         "WITH c AS (SELECT event_id % 16 + 1 AS tx, COUNT(*) AS k FROM events WHERE event_type = 'click' GROUP BY 1) SELECT tx, 'insert' AS op, CAST(1 AS BIGINT) AS n, k AS x FROM c UNION ALL SELECT tx, 'delete', CAST(1 AS BIGINT), CAST(0 AS BIGINT) FROM c")


def _fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two subscribers of one view in different words, three subscriptions, one computation; and another view."""
    own = Catalog.of(PEOPLE)
    store = Store(spark, _own_folder(spark), own)
    views = Views(store)
    plan = lambda text: Analyzer(own, None, "declared_view").plan(text)
    views.subscribe("one", "s1", [plan("SELECT * FROM people")])
    views.subscribe("two", "s2", [plan("select people.* from people"), plan("SELECT c_custkey FROM people WHERE c_nationkey = 2")])
    views.subscribe("two", "s3", [plan("SELECT * FROM people")])
    tx = store.begin()
    tx.insert_many("people", _people(spark, sf_dir))
    tx.commit()
    rows = views.fan_out(views.pending())
    return rows.groupBy("subscriber", "subscription", "view").agg(F.sum("_n").alias("n"), F.count_distinct("row").alias("rows")).drop("view")


register("live_fan_out", _fan_out, "SELECT s.a AS subscriber, s.b AS subscription, COUNT(*) AS n, COUNT(*) AS rows FROM customer, (VALUES ('one', 's1'), ('two', 's2'), ('two', 's3')) AS s(a, b) GROUP BY s.a, s.b UNION ALL SELECT 'two', 's2', COUNT(*), COUNT(*) FROM customer WHERE c_nationkey = 2")


def _runtime(spark: SparkSession, sf_dir: str) -> Runtime:
    hidden = TableDef("hidden", columns(id="Int64 primary"))
    staff = TableDef("staff", columns(id="Int64 primary"), policy="permissioned", permissions=("staff",))
    module = Module(Catalog.of(PEOPLE, hidden, staff))
    module.read("of_nation", "SELECT c_custkey, c_acctbal FROM people WHERE c_nationkey = :nation", (Parameter("nation", KINDS["Int32"]),))
    module.read("rich", "SELECT c_custkey, c_nationkey FROM people WHERE c_acctbal > :least", (Parameter("least", KINDS["Float64"]),), live=True)
    runtime = Runtime(spark, _own_folder(spark), module)
    tx = runtime.store.begin()
    tx.insert_many("people", _people(spark, sf_dir))
    tx.commit()
    return runtime


register("sec_declared_query", lambda s, d: _runtime(s, d).call_query("of_nation", nation=11), "SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey = 11")
register("sec_declared_view", lambda s, d: _runtime(s, d).subscribe_view("rich", "me", "s", least=5000.0).select(F.col("_op").alias("op"), F.col("_n").alias("n"), "c_custkey", "c_nationkey"), "SELECT 'insert' AS op, CAST(1 AS BIGINT) AS n, c_custkey, c_nationkey FROM customer WHERE c_acctbal > 5000")


def _policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which tables raw SQL of three callers can read, and how many rows it then counts."""
    runtime = _runtime(spark, sf_dir)
    out = []
    for who, caller in (("anyone", Caller()), ("staff", Caller(permissions=frozenset({"staff"}))), ("host", Caller(allow_all=True))):
        for table in ("people", "hidden", "staff", "nowhere"):
            try:
                out.append(runtime.query(f"SELECT COUNT(*) AS n FROM {table}", caller).select(F.lit(who).alias("who"), F.lit(table).alias("name"), "n"))
            except DialectError:
                out.append(spark.range(1).select(F.lit(who).alias("who"), F.lit(table).alias("name"), F.lit(None).cast("long").alias("n")))
    return functools.reduce(DataFrame.unionByName, out)


register("sec_policies", _policies, "WITH c AS (SELECT COUNT(*) AS n FROM customer) SELECT who, name, CASE WHEN name = 'people' THEN n WHEN name = 'staff' AND who <> 'anyone' OR name = 'hidden' AND who = 'host' THEN 0 END AS n FROM c, (VALUES ('anyone'), ('staff'), ('host')) AS w(who), (VALUES ('people'), ('hidden'), ('staff'), ('nowhere')) AS t(name)")

FLAGSHIP = "SELECT o.o_orderkey, c.c_name, o.o_totalprice FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'BUILDING' ORDER BY o.o_totalprice DESC LIMIT 100"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(FLAGSHIP)(spark, sf_dir)
