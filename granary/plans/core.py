"""The relational queries; QUERIES and SQL share their keys."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.dialect import int_avg, int_div, strict_and, strict_or
from granary.operators import changes, relational as rel
from granary.operators.snapshots import Snapshot, snapshot_read
from granary.sources import catalog
from granary.session import shared_folder
from granary.sources.parquet import RELATIONAL, TABLES, clustered, register, scan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def register(f):
        QUERIES[f.__name__.rstrip("_")], SQL[f.__name__.rstrip("_")] = f, sql
        return f

    return register


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def scan_all(spark, d):
    return scan(spark, d, "customer")


@query("SELECT c_name AS name, c_nationkey AS nation FROM customer")
def project(spark, d):
    return rel.project(scan(spark, d, "customer"), name=F.col("c_name"), nation=F.col("c_nationkey"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey > 700 AND o_orderkey <> 100")
def filter_cmp(spark, d):
    o = scan(spark, d, "orders")
    return rel.keep(o, (o.o_custkey > 700) & (o.o_orderkey != 100)).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey FROM orders WHERE (o_custkey < 100 OR o_custkey >= 1400) AND NOT o_orderstatus = 'F'")
def filter_and_or_not(spark, d):
    o = scan(spark, d, "orders")
    return rel.keep(o, ((o.o_custkey < 100) | (o.o_custkey >= 1400)) & ~(o.o_orderstatus == "F")).select("o_orderkey")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment >= 'BUILDING' AND c_mktsegment < 'HOUSEHOLD'")
def filter_string(spark, d):
    c = scan(spark, d, "customer")
    return rel.range_scan(c, "c_mktsegment", "BUILDING", "HOUSEHOLD").select("c_custkey", "c_mktsegment")


@query("SELECT l_orderkey, l_linenumber * 2 - 1 AS odd, -l_linenumber AS negative, (l_linenumber + 3) * l_linenumber AS product FROM lineitem")
def arith(spark, d):
    n = F.col("l_linenumber")
    return rel.project(scan(spark, d, "lineitem"), l_orderkey=F.col("l_orderkey"), odd=n * 2 - 1, negative=-n, product=(n + 3) * n)


@query("SELECT l_orderkey, l_linenumber, (l_partkey // nullif(l_linenumber - 1, 0))::BIGINT AS quotient, (-l_partkey // 7)::BIGINT AS toward_zero FROM lineitem")
def integer_division(spark, d):
    n = F.col("l_linenumber")
    return rel.project(
        scan(spark, d, "lineitem"), l_orderkey=F.col("l_orderkey"), l_linenumber=n,
        quotient=int_div(F.col("l_partkey"), n - 1), toward_zero=int_div(-F.col("l_partkey"), 7),
    )


_STRICT = """WITH t AS (SELECT p_partkey, s_suppkey > 10 AS a, p_size > 25 AS b FROM part LEFT JOIN supplier ON p_partkey = s_suppkey)
SELECT p_partkey, CASE WHEN a IS NULL OR b IS NULL THEN NULL ELSE a {0} b END AS verdict FROM t"""


def _nullable_sides(spark, d):
    p, s = scan(spark, d, "part"), scan(spark, d, "supplier")
    j = rel.join(p, s, p.p_partkey == s.s_suppkey, "left")
    return j.select("p_partkey", (F.col("s_suppkey") > 10).alias("a"), (F.col("p_size") > 25).alias("b"))


@query(_STRICT.format("OR"))
def null_strict_or(spark, d):
    return rel.project(_nullable_sides(spark, d), p_partkey=F.col("p_partkey"), verdict=strict_or(F.col("a"), F.col("b")))


@query(_STRICT.format("AND"))
def null_strict_and(spark, d):
    return rel.project(_nullable_sides(spark, d), p_partkey=F.col("p_partkey"), verdict=strict_and(F.col("a"), F.col("b")))


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark, d):
    o, c = scan(spark, d, "orders"), scan(spark, d, "customer")
    return rel.join(o, c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_name")


@query("""SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey WHERE o_orderkey < 5000""")
def join_3way(spark, d):
    o, c, n = (scan(spark, d, t) for t in ("orders", "customer", "nation"))
    j = rel.join(rel.join(o, c, o.o_custkey == c.c_custkey), n, c.c_nationkey == n.n_nationkey)
    return rel.keep(j, o.o_orderkey < 5000).select("o_orderkey", "c_name", "n_name")


@query("SELECT p_partkey, s_suppkey, s_name FROM part LEFT JOIN supplier ON p_partkey = s_suppkey")
def join_left(spark, d):
    p, s = scan(spark, d, "part"), scan(spark, d, "supplier")
    return rel.join(p, s, p.p_partkey == s.s_suppkey, "left").select("p_partkey", "s_suppkey", "s_name")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey < r_regionkey")
def join_theta(spark, d):
    n, r = scan(spark, d, "nation"), scan(spark, d, "region")
    return rel.join(n, r, n.n_regionkey < r.r_regionkey).select("n_name", "r_name")


@query("SELECT n_name, r_name FROM nation LEFT JOIN region ON n_regionkey < r_regionkey AND r_regionkey <> 3")
def join_left_theta(spark, d):
    n, r = scan(spark, d, "nation"), scan(spark, d, "region")
    return rel.join(n, r, (n.n_regionkey < r.r_regionkey) & (r.r_regionkey != 3), "left").select("n_name", "r_name")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000")
def join_left_residual(spark, d):
    c, o = scan(spark, d, "customer"), scan(spark, d, "orders")
    return rel.join(c, o, (c.c_custkey == o.o_custkey) & (o.o_totalprice > 300000), "left").select("c_custkey", "o_orderkey")


@query("SELECT a.n_name AS left_name, b.n_name AS right_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_self(spark, d):
    a, b = scan(spark, d, "nation").alias("a"), scan(spark, d, "nation").alias("b")
    on = (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))
    return rel.project(rel.join(a, b, on), left_name=F.col("a.n_name"), right_name=F.col("b.n_name"))


@query("SELECT p_partkey FROM part LEFT JOIN supplier ON p_partkey = s_suppkey WHERE s_nationkey < 12")
def where_over_left_join(spark, d):
    p, s = scan(spark, d, "part"), scan(spark, d, "supplier")
    return rel.keep(rel.join(p, s, p.p_partkey == s.s_suppkey, "left"), s.s_nationkey < 12).select("p_partkey")


_TOTALS = "COUNT(*) AS n, COUNT(l_linenumber) AS n_lines, SUM(l_linenumber)::BIGINT AS total, (SUM(l_linenumber) // nullif(COUNT(l_linenumber), 0))::BIGINT AS mean, MIN(l_linenumber) AS least, MAX(l_returnflag) AS most, MIN(l_linenumber > 3) AS all_over"


def _totals(df):
    n = F.col("l_linenumber")
    return rel.aggregate(df, n=F.count("*"), n_lines=F.count(n), total=F.sum(n), mean=int_avg(n), least=F.min(n), most=F.max("l_returnflag"), all_over=F.min(n > 3))


@query(f"SELECT {_TOTALS} FROM lineitem")
def agg_scalar(spark, d):
    return _totals(scan(spark, d, "lineitem"))


@query(f"SELECT {_TOTALS} FROM lineitem WHERE l_linenumber < 0")
def agg_empty(spark, d):
    return _totals(rel.keep(scan(spark, d, "lineitem"), F.col("l_linenumber") < 0))


@query("SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus")
def group_one(spark, d):
    return rel.aggregate(scan(spark, d, "orders"), [F.col("o_orderstatus")], n=F.count("*"))


@query("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_linenumber)::BIGINT AS total FROM lineitem GROUP BY l_returnflag, l_linestatus")
def group_multi(spark, d):
    by = [F.col("l_returnflag"), F.col("l_linestatus")]
    return rel.aggregate(scan(spark, d, "lineitem"), by, n=F.count("*"), total=F.sum("l_linenumber"))


@query("SELECT (o_custkey // 100)::BIGINT AS bucket, COUNT(*) AS n FROM orders GROUP BY 1")
def group_expr(spark, d):
    return rel.aggregate(scan(spark, d, "orders"), [int_div(F.col("o_custkey"), 100).alias("bucket")], n=F.count("*"))


@query("SELECT s_nationkey AS nation, COUNT(*) AS n FROM part LEFT JOIN supplier ON p_partkey = s_suppkey GROUP BY s_nationkey")
def group_null_key(spark, d):
    p, s = scan(spark, d, "part"), scan(spark, d, "supplier")
    return rel.aggregate(rel.join(p, s, p.p_partkey == s.s_suppkey, "left"), [s.s_nationkey.alias("nation")], n=F.count("*"))


@query("SELECT l_suppkey, SUM(l_linenumber)::BIGINT AS total FROM lineitem GROUP BY l_suppkey HAVING COUNT(*) > 550")
def having(spark, d):
    out = rel.aggregate(scan(spark, d, "lineitem"), [F.col("l_suppkey")], F.col("n") > 550, total=F.sum("l_linenumber"), n=F.count("*"))
    return out.drop("n")


@query("""SELECT n_name, COUNT(*) AS n, SUM(o_orderkey)::BIGINT AS order_keys, SUM(c_custkey)::BIGINT AS customer_keys
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def agg_over_join(spark, d):
    o, c, n = (scan(spark, d, t) for t in ("orders", "customer", "nation"))
    j = rel.join(rel.join(o, c, o.o_custkey == c.c_custkey), n, c.c_nationkey == n.n_nationkey)
    return rel.aggregate(j, [n.n_name], n=F.count("*"), order_keys=F.sum("o_orderkey"), customer_keys=F.sum("c_custkey"))


@query("""SELECT l_returnflag, SUM(l_linenumber * l_suppkey)::BIGINT AS weighted, (SUM(l_linenumber * l_suppkey) // COUNT(*))::BIGINT AS per_row
FROM lineitem GROUP BY l_returnflag""")
def agg_expr(spark, d):
    product = F.col("l_linenumber") * F.col("l_suppkey")
    per_row = int_div(F.sum(product), F.count("*"))
    return rel.aggregate(scan(spark, d, "lineitem"), [F.col("l_returnflag")], weighted=F.sum(product), per_row=per_row)


@query("""SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_quantity)::BIGINT AS quantity FROM lineitem
WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus HAVING COUNT(*) > 10""")
def flagship(spark, d):
    li = scan(spark, d, "lineitem")
    rows = rel.keep(li, li.l_shipdate <= F.lit("1998-09-02").cast("timestamp_ntz"))
    by = [F.col("l_returnflag"), F.col("l_linestatus")]
    return rel.aggregate(rows, by, F.col("n") > 10, n=F.count("*"), quantity=F.sum("l_quantity").cast("bigint"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 4242")
def index_lookup(spark, d):
    return rel.lookup(scan(spark, d, "orders"), "o_orderkey", 4242).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200")
def range_scan(spark, d):
    return rel.range_scan(scan(spark, d, "orders"), "o_orderkey", 100, 200).select("o_orderkey", "o_custkey")


@query("SELECT * FROM (SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 25, 'ATLANTIS', 4)")
def insert(spark, d):
    return changes.insert(scan(spark, d, "nation"), (25, "ATLANTIS", 4))


@query("""SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'AMERICAS' ELSE n_name END AS n_name,
CASE WHEN n_regionkey = 1 THEN n_nationkey + n_regionkey ELSE n_regionkey END AS n_regionkey FROM nation""")
def update(spark, d):
    n = scan(spark, d, "nation")
    return changes.update(n, {"n_name": F.lit("AMERICAS"), "n_regionkey": n.n_nationkey + n.n_regionkey}, n.n_regionkey == 1)


@query("SELECT p_partkey, s_suppkey FROM part LEFT JOIN supplier ON p_partkey = s_suppkey WHERE NOT coalesce(s_suppkey < 50, FALSE)")
def delete(spark, d):
    p, s = scan(spark, d, "part"), scan(spark, d, "supplier")
    rows = rel.join(p, s, p.p_partkey == s.s_suppkey, "left").select("p_partkey", "s_suppkey")
    return changes.delete(rows, F.col("s_suppkey") < 50)


@query("SELECT COUNT(*) AS affected FROM orders WHERE o_custkey < 40")
def affected_count(spark, d):
    return changes.affected(scan(spark, d, "orders"), F.col("o_custkey") < 40)


@query("""WITH v AS (SELECT o_orderkey, o_orderkey % 97 + 1 AS xmin, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 89 + 2 ELSE 0 END AS xmax FROM orders),
s AS (SELECT CAST(range AS BIGINT) AS xid, range % 5 <> 0 AS committed FROM range(1, 100))
SELECT o_orderkey FROM v LEFT JOIN s c ON c.xid = xmin LEFT JOIN s e ON e.xid = xmax
WHERE (xmin = 50 OR (xmin < 80 AND xmin NOT IN (10, 20, 33) AND coalesce(c.committed, FALSE)))
AND (xmax = 0 OR (xmax <> 50 AND (xmax >= 80 OR xmax IN (10, 20, 33) OR NOT coalesce(e.committed, FALSE))))""")
def mvcc_snapshot(spark, d):
    o = scan(spark, d, "orders")
    xmax = F.when(o.o_orderkey % 3 == 0, o.o_custkey % 89 + 2).otherwise(F.lit(0))
    rows = o.select("o_orderkey", (o.o_orderkey % 97 + 1).alias("xmin"), xmax.alias("xmax"))
    status = spark.range(1, 100).select(F.col("id").alias("xid"), (F.col("id") % 5 != 0).alias("committed"))
    return snapshot_read(rows, status, Snapshot(50, 80, (10, 20, 33)))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 4242")
def clustered_lookup(spark, d):
    return rel.lookup(clustered(scan(spark, d, "orders"), ["o_orderkey"], 8), "o_orderkey", 4242).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey >= 500 AND l_orderkey < 800")
def clustered_range(spark, d):
    return rel.range_scan(clustered(scan(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], 8), "l_orderkey", 500, 800).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 100, 'ATLANTIS'")
def create_table(spark, d):
    name = f"granary_{uuid.uuid4().hex}"
    table = catalog.create_table(spark, name, "id INT, name STRING", f"{shared_folder(spark)}/granary/{name}")
    rows = scan(spark, d, "nation").filter("n_regionkey = 2").select("n_nationkey", "n_name")
    changes.insert(rows, (100, "ATLANTIS")).write.insertInto(name)
    return table


@query("""SELECT a.n_nationkey AS a_n_nationkey, a.n_name AS a_n_name, a.n_regionkey AS a_n_regionkey,
b.n_nationkey AS b_n_nationkey, b.n_name AS b_n_name, b.n_regionkey AS b_n_regionkey FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey""")
def star_over_join(spark, d):
    a, b = scan(spark, d, "nation").alias("a"), scan(spark, d, "nation").alias("b")
    both = rel.join(a, b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey")))
    return rel.star(both, a=a, b=b)


#: SQL text that spark.sql runs on the registered views and that gives the same rows elsewhere.
STATEMENTS = {
    "sql_inner_join": "SELECT c.c_custkey AS custkey, c.c_name AS name, o.o_orderkey AS orderkey FROM customer c INNER JOIN orders o ON c.c_custkey = o.o_custkey",
    "sql_left_join": "SELECT p.p_partkey AS partkey, s.s_name AS name FROM part p LEFT JOIN supplier s ON p.p_partkey = s.s_suppkey",
    "sql_three_tables": """SELECT o.o_orderkey AS orderkey, c.c_name AS customer, n.n_name AS nation FROM orders o INNER JOIN customer c ON o.o_custkey = c.c_custkey
INNER JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE n.n_regionkey = 1""",
    "sql_aggregates": "SELECT COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS total, MIN(l_linenumber) AS least, MAX(l_linenumber) AS most FROM lineitem",
    "sql_group_by": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS total FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "sql_having": "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 14",
    "sql_lookup": "SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey = 142",
    "sql_predicates": "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_custkey < 100) AND o_orderkey * 2 - 1 > 301 AND o_orderstatus <> 'P'",
}


def _statement(name: str, text: str) -> None:
    def run(spark, d):
        register(spark, d, RELATIONAL)
        return spark.sql(text)

    QUERIES[name], SQL[name] = run, text


for _name, _text in STATEMENTS.items():
    _statement(_name, _text)


#: The columns of the folder's tables with the dialect's type codes (int 0, string 1; "-" and -1 for types that it lacks).
COLUMNS = {
    "region": "r_regionkey 0 r_name 1", "nation": "n_nationkey 0 n_name 1 n_regionkey 0",
    "customer": "c_custkey - c_name 1 c_nationkey 0 c_acctbal - c_mktsegment 1", "supplier": "s_suppkey - s_name 1 s_nationkey 0 s_acctbal -",
    "part": "p_partkey - p_name 1 p_brand 1 p_type 1 p_size 0 p_retailprice -",
    "orders": "o_orderkey - o_custkey - o_orderstatus 1 o_totalprice - o_orderdate - o_orderpriority 1",
    "lineitem": "l_orderkey - l_partkey - l_suppkey - l_linenumber 0 l_quantity - l_extendedprice - l_discount - l_tax - l_returnflag 1 l_linestatus 1 l_shipdate -",
    "events": "event_id - ts - user_id - event_type 1 value - props 1", "documents": "doc_id - text 1 lang 1 source 1 n_chars -",
    "embeddings": "vec_id - embedding - label 0", "pages": "page_id - url 1 html 1", "benchmark": "item_id - text 1",
    "labels": "doc_id - quality 0 toxic 0", "conversations": "conv_id - turn - role 1 text 1",
}


def _schemas(spark, d):
    return {t: scan(spark, d, t).schema for t in TABLES}


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(TABLES)) + ") AS t(table_id, name)")
def catalog_tables(spark, d):
    return catalog.pg_class(spark, _schemas(spark, d)).drop("first_page_id")


@query(
    "SELECT table_id, column_name, CAST(data_type AS INTEGER) AS data_type, TRUE AS nullable, ordinal_position FROM (VALUES "
    + ", ".join(f"({i}, '{c}', {code.replace('-', '-1')}, {k})" for i, t in enumerate(TABLES) for k, (c, code) in enumerate(zip(COLUMNS[t].split()[::2], COLUMNS[t].split()[1::2], strict=True)))
    + ") AS t(table_id, column_name, data_type, ordinal_position)"
)
def catalog_attributes(spark, d):
    return catalog.pg_attribute(spark, _schemas(spark, d)).fillna(-1, ["data_type"])


@query("SELECT 0 AS index_id, 'nation_key' AS index_name, 1 AS table_id, '2,0' AS column_ids")
def catalog_indexes(spark, d):
    return catalog.pg_index(spark, _schemas(spark, d), {"nation_key": ("nation", ["n_regionkey", "n_nationkey"])}).drop("root_page_id")
