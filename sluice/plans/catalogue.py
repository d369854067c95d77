"""The registered queries of the engine's own operators, each with SQL for DuckDB over the same tables.

A query is a function of (spark, folder); its SQL gives the same columns and rows. Ids in comments are those of
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sluice import functions as own
from sluice import operators as op
from sluice.engine import Engine
from sluice.sources import ipc_bytes, ipc_frame, parquet_schema, read_encrypted, read_parquet, write_encrypted, write_parquet
from sluice.store.keyvalue import survivors, visible
from sluice.udf import Aggregate, AggregateUDF, ScalarUDF, Signature, TableUDF

Run = Callable[[SparkSession, str], DataFrame]

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

QUERIES: dict[str, Run] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def engine(spark: SparkSession, folder: str, *names: str) -> Engine:
    """An engine whose own tables lie in a folder that executors share."""
    e = Engine(spark, scratch(spark, "engine"))
    e.register_parquet(folder, names)
    return e


def query(sql: str):
    def put(f: Run) -> Run:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return put


def same_sql(name: str, sql: str, *tables: str, oracle: str | None = None) -> None:
    """A query that is the same text in both dialects (or nearly), run through the engine."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return engine(spark, folder, *tables).sql(sql)

    run.__name__ = name
    QUERIES[name], ORACLE_SQL[name] = run, oracle or sql


# -- flagship -------------------------------------------------------------------------------------------------------------


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
  round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
  round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
  FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
def pricing_summary(spark, folder):  # AGG-01, SRT-01
    li = table(spark, folder, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    disc = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    out = op.hash_aggregate(li, ["l_returnflag", "l_linestatus"], {
        "sum_qty": F.round(F.sum("l_quantity"), 2), "sum_base": F.round(F.sum("l_extendedprice"), 2), "sum_disc": F.round(F.sum(disc), 2),
        "sum_charge": F.round(F.sum(disc * (1 + F.col("l_tax"))), 2), "avg_qty": F.round(F.avg("l_quantity"), 4),
        "avg_price": F.round(F.avg("l_extendedprice"), 4), "avg_disc": F.round(F.avg("l_discount"), 6), "n": F.count("*"),
    })
    return op.sort(out, [("l_returnflag", True), ("l_linestatus", True)])


# -- sources, projection, predicates ----------------------------------------------------------------------------------------

same_sql("scan_project", "SELECT c_custkey, c_name, c_acctbal * 2 AS double_bal FROM customer", "customer")  # SRC-01, PRJ-01, PRJ-03
same_sql("select_star", "SELECT * FROM nation", "nation")  # PRJ-02
same_sql("qualified_columns", "SELECT c.c_custkey, n.n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey", "customer", "nation")  # PRJ-05
same_sql("alias_where", "SELECT c_custkey, c_acctbal * 2 AS double_bal FROM customer WHERE double_bal > 10000 ORDER BY double_bal, c_custkey", "customer")  # PRJ-04, R-5
same_sql("select_without_from", "SELECT 1 + 2 AS three, 'a' AS letter")  # Q-25
same_sql("filter_cmp", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 150000 AND o_orderkey <> 7 AND o_custkey < 1000", "orders")  # EXP-01
same_sql("filter_and_or", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 200000) AND o_custkey > 10", "orders")  # EXP-02, EXP-06
same_sql("filter_not", "SELECT p_partkey FROM part WHERE NOT (p_size > 10) AND -p_size < -2", "part")  # EXP-10
same_sql("filter_in", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('P')", "orders")  # EXP-07
same_sql("filter_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%' AND p_brand NOT LIKE '%1'", "part")  # EXP-08
same_sql("filter_between", "SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 15 AND p_retailprice NOT BETWEEN 0 AND 950", "part")  # EXP-09
same_sql("null_tests", "SELECT id, a IS NULL AS no_a, a IS NOT NULL AS has_a FROM (VALUES (1, 2), (2, NULL), (3, 1)) AS t(id, a)")  # EXP-04
same_sql("three_valued_logic", """SELECT a, b, a AND b AS both_, a OR b AS either, NOT a AS neg FROM (VALUES (TRUE, TRUE), (TRUE, FALSE), (TRUE, NULL),
  (FALSE, TRUE), (FALSE, FALSE), (FALSE, NULL), (NULL, TRUE), (NULL, FALSE), (CAST(NULL AS BOOLEAN), NULL)) AS t(a, b)""")  # Q-09
same_sql("arith_float", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) + l_tax / 2, 4) AS v FROM lineitem", "lineitem")  # EXP-03
same_sql("arith_int_div_mod", "SELECT a, b, CAST(a div b AS BIGINT) AS q, CAST(a % b AS BIGINT) AS r FROM (VALUES (7, 2), (-7, 2), (7, -3)) AS t(a, b)",
         oracle="SELECT a, b, CAST(a // b AS BIGINT) AS q, CAST(a % b AS BIGINT) AS r FROM (VALUES (7, 2), (-7, 2), (7, -3)) AS t(a, b)")  # EXP-03, Q-10
same_sql("literals", "SELECT 1 AS i, CAST(2.5 AS DOUBLE) AS d, 'x''y' AS s, TRUE AS b, CAST(NULL AS INTEGER) AS n")  # EXP-05
same_sql("case_when", """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'some' ELSE 'rich' END AS class_,
  CASE c_mktsegment WHEN 'BUILDING' THEN 1 ELSE 0 END AS building FROM customer""", "customer")  # EXP-11
same_sql("cast_concat", "SELECT CAST(c_custkey AS VARCHAR) || '-' || c_name AS tag FROM customer", "customer",
         oracle="SELECT CAST(c_custkey AS VARCHAR) || '-' || c_name AS tag FROM customer")  # EXP-12
QUERIES["cast_concat"] = lambda s, d: engine(s, d, "customer").sql("SELECT CAST(c_custkey AS STRING) || '-' || c_name AS tag FROM customer")
same_sql("subquery_scalar", "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)", "customer")  # EXP-13
same_sql("subquery_from", "SELECT s.k, s.n FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey) s WHERE s.n > 2", "customer")  # EXP-13


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_quantity > 25 AS mask FROM lineitem")
def filter_gt_mask(spark, folder):  # AGG-19, QRY-11
    return op.filter_mask(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity", 25)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 25")
def filter_gt(spark, folder):  # AGG-19
    return op.filter_greater(table(spark, folder, "lineitem"), "l_quantity", 25).select("l_orderkey", "l_linenumber")


@query("SELECT n_nationkey, n_name, n_nationkey + 1 AS col_2 FROM nation")
def project_names(spark, folder):  # PRJ-01
    return op.project(table(spark, folder, "nation"), ["n_nationkey", "n_name", "n_nationkey + 1"])


@query("SELECT c_custkey, c_acctbal * 2 AS double_bal FROM customer WHERE c_acctbal * 2 > 10000")
def select_where_alias(spark, folder):  # R-5 by the DataFrame route
    return op.select_where(table(spark, folder, "customer"), {"c_custkey": "c_custkey", "double_bal": "c_acctbal * 2"}, "double_bal > 10000")


# -- joins ------------------------------------------------------------------------------------------------------------------

same_sql("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey", "orders", "customer")  # JON-01
same_sql("join_inner_multikey", """SELECT a.l_orderkey, a.l_linenumber, b.l_quantity FROM lineitem a JOIN lineitem b
  ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber""", "lineitem")  # JON-01
same_sql("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 150000", "customer", "orders")  # JON-02
same_sql("join_right", "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey", "customer", "orders")  # JON-03
same_sql("join_full", """SELECT s_suppkey, c_custkey FROM supplier FULL OUTER JOIN customer
  ON s_suppkey * 20 = c_custkey""", "supplier", "customer")  # JON-05
same_sql("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation", "region", "nation")  # JON-04
same_sql("join_theta", "SELECT a.r_regionkey AS lo, b.r_regionkey AS hi FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey", "region")  # JON-07
same_sql("join_using", "SELECT r_name, k FROM (SELECT r_regionkey AS k, r_name FROM region) a JOIN (SELECT n_regionkey AS k FROM nation) b USING (k)", "region", "nation")  # JON-08
same_sql("join_multiway", """SELECT r_name, n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM region JOIN nation ON n_regionkey = r_regionkey
  JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY r_name, n_name""", "region", "nation", "customer", "orders")  # JON-06
same_sql("filter_over_join", "SELECT o_orderkey, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > o_totalprice / 40", "orders", "customer")  # FLT-02
same_sql("join_null_keys", """SELECT l.k, v, w FROM (VALUES (1, 'a'), (NULL, 'b'), (2, 'c')) AS l(k, v) JOIN (VALUES (1, 'x'), (NULL, 'y'), (3, 'z')) AS r(k, w)
  ON l.k = r.k""")  # JON-10, Q-11
same_sql("join_left_null_keys", """SELECT l.k, v, w FROM (VALUES (1, 'a'), (NULL, 'b'), (2, 'c')) AS l(k, v) LEFT JOIN (VALUES (1, 'x'), (NULL, 'y'), (3, 'z')) AS r(k, w)
  ON l.k = r.k""")  # Q-13
same_sql("join_empty_side", "SELECT n_name, c_custkey FROM nation LEFT JOIN (SELECT * FROM customer WHERE 1 = 0) c ON n_nationkey = c_nationkey", "nation", "customer")  # Q-14


@query("SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def join_by_size(spark, folder):  # JON-11, JON-12, P-5: the broadcast is behind a check of its size
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return op.adaptive_join(table(spark, folder, "orders"), c, ["o_custkey"]).select("o_orderkey", "c_mktsegment")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_semi(spark, folder):
    return op.join(table(spark, folder, "customer"), table(spark, folder, "orders"), [("c_custkey", "o_custkey")], "semi").select("c_custkey")


# -- aggregation --------------------------------------------------------------------------------------------------------------

same_sql("agg_global", """SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s, round(avg(o_totalprice), 4) AS a, min(o_totalprice) AS lo, max(o_totalprice) AS hi
  FROM orders""", "orders")  # AGG-02..07, AGG-17..19
same_sql("agg_group_one", "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS s FROM customer GROUP BY c_mktsegment", "customer")  # AGG-01
same_sql("agg_group_multi", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, max(o_orderdate) AS last_ FROM orders GROUP BY o_orderstatus, o_orderpriority", "orders")  # AGG-01
same_sql("agg_count_nulls", "SELECT count(*) AS all_, count(a) AS some FROM (VALUES (1, 2), (2, NULL), (3, 1)) AS t(id, a)")  # AGG-03, AGG-04
same_sql("agg_count_distinct", "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem", "lineitem")  # AGG-08
same_sql("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12", "orders")  # AGG-09
same_sql("select_distinct", "SELECT DISTINCT p_brand, p_size FROM part", "part")  # AGG-10
same_sql("agg_group_expr", "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n FROM orders GROUP BY year(o_orderdate)", "orders")  # AGG-11
same_sql("agg_expr_arg", "SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY l_returnflag", "lineitem")  # AGG-13
same_sql("agg_empty_global", "SELECT count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS s, avg(c_acctbal) AS a, min(c_name) AS lo FROM customer WHERE 1 = 0", "customer")  # Q-03
same_sql("agg_empty_group", "SELECT c_nationkey, count(*) AS n FROM customer WHERE 1 = 0 GROUP BY c_nationkey", "customer")
same_sql("agg_null_group", "SELECT g, count(v) AS n, min(v) AS lo, max(v) AS hi, avg(v) AS a, CAST(sum(v) AS BIGINT) AS s FROM (VALUES ('p', NULL), ('p', NULL), ('q', 5)) AS t(g, v) GROUP BY g")  # AGG-14, Q-04
same_sql("agg_case_pivot", """SELECT l_returnflag, count(CASE WHEN l_linestatus = 'O' THEN 1 END) AS open_, count(CASE WHEN l_linestatus = 'F' THEN 1 END) AS done
  FROM lineitem GROUP BY l_returnflag""", "lineitem")  # EXP-11
same_sql("agg_key_value_count", "SELECT l_suppkey AS k, CAST(sum(l_linenumber) AS BIGINT) AS v, count(*) AS n, min(l_linenumber) AS lo, max(l_linenumber) AS hi FROM lineitem GROUP BY l_suppkey", "lineitem")  # AGG-20
same_sql("agg_min_max_text", "SELECT min(c_name) AS first_, max(c_name) AS last_ FROM customer", "customer")


@query("SELECT l_suppkey, round(sum(l_quantity), 2) AS s, count(*) AS n FROM lineitem GROUP BY l_suppkey")
def two_tier_sum(spark, folder):  # AGG-16, AGG-21
    li = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    return op.tier_merge(li.where("l_orderkey % 2 = 0"), li.where("l_orderkey % 2 = 1"), {"s": F.round(F.sum("l_quantity"), 2), "n": F.count("*")}, ["l_suppkey"])


@query("SELECT abs(1.0) < 2.0 AS near_")
def agg_estimate(spark, folder):  # AGG-22: within 10 per cent of the exact number
    li = table(spark, folder, "lineitem")
    both = op.distinct_estimate(li, "l_partkey").crossJoin(li.agg(F.countDistinct("l_partkey").alias("n")))
    return both.select((F.abs(F.col("estimate") - F.col("n")) < 0.1 * F.col("n")).alias("near_"))


# -- windows, sorting, limits --------------------------------------------------------------------------------------------------

same_sql("win_row_number", "SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS BIGINT) AS rn FROM customer", "customer")  # WIN-01
same_sql("win_rank", "SELECT p_partkey, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS r FROM part", "part")  # WIN-02
same_sql("win_avg_partition", "SELECT c_custkey, round(avg(c_acctbal) OVER (PARTITION BY c_nationkey), 4) AS a FROM customer", "customer")  # WIN-03
same_sql("sort_multi", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderstatus ASC, o_totalprice DESC, o_orderkey", "orders")  # SRT-01
same_sql("sort_nulls_limit", "SELECT id, a FROM (VALUES (1, 2), (2, NULL), (3, 1)) AS t(id, a) ORDER BY a DESC NULLS FIRST LIMIT 2")  # SRT-02
same_sql("sort_nulls_last", "SELECT id, a FROM (VALUES (1, 2), (2, NULL), (3, 1)) AS t(id, a) ORDER BY a ASC NULLS LAST LIMIT 2")  # SRT-02
same_sql("sort_expression", "SELECT p_partkey FROM part ORDER BY p_size * -1, 1", "part")  # SRT-03
same_sql("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 10", "orders")  # LIM-01, LIM-03
same_sql("offset_only", "SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 20", "nation")  # LIM-02


@query("""SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey
  ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders) WHERE rank <= 3""")
def win_top_n_per_group(spark, folder):  # WIN-04
    return op.top_n_per_group(table(spark, folder, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@query("SELECT id, a FROM (VALUES (1, 2), (2, NULL), (3, 1)) AS t(id, a) ORDER BY a DESC NULLS FIRST LIMIT 2")
def sort_default_nulls(spark, folder):  # SRT-02 by the DataFrame route
    df = spark.sql("SELECT * FROM (VALUES (1, 2), (2, NULL), (3, 1)) AS t(id, a)")
    return op.limit_offset(op.sort(df, [("a", False)]), 2)


# -- scalar functions ------------------------------------------------------------------------------------------------------------

same_sql("fn_upper", "SELECT c_custkey, upper(c_name) AS v FROM customer", "customer")  # FN-01
same_sql("fn_lower", "SELECT c_custkey, lower(c_mktsegment) AS v FROM customer", "customer")  # FN-02
same_sql("fn_substring", "SELECT p_partkey, substring(p_name, 2, 4) AS v, substr(p_brand, 3) AS w FROM part", "part")  # FN-05
same_sql("fn_abs", "SELECT c_custkey, abs(c_acctbal) AS v, abs(-c_nationkey) AS w FROM customer", "customer")  # FN-07
same_sql("fn_round", "SELECT x, round(x) AS r, round(x * 1.25, 1) AS r1 FROM (SELECT CAST(x AS DOUBLE) AS x FROM (VALUES (0.5), (1.5), (2.5), (-2.5)) AS t(x)) u")  # FN-08
same_sql("fn_ceil", "SELECT p_partkey, CAST(ceil(p_retailprice) AS BIGINT) AS v FROM part", "part")  # FN-09
same_sql("fn_floor", "SELECT p_partkey, CAST(floor(p_retailprice) AS BIGINT) AS v FROM part", "part")  # FN-10
same_sql("fn_sqrt", "SELECT p_partkey, round(sqrt(p_retailprice), 6) AS v FROM part", "part")  # FN-11
same_sql("fn_power", "SELECT p_partkey, round(power(p_size, 2), 3) AS v FROM part", "part")  # FN-12
same_sql("fn_date_parts", """SELECT event_id, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS mo, CAST(day(ts) AS INTEGER) AS d,
  CAST(hour(ts) AS INTEGER) AS h, CAST(minute(ts) AS INTEGER) AS mi, CAST(second(ts) AS INTEGER) AS s FROM events""", "events")  # FN-16..21
same_sql("fn_date_trunc", "SELECT event_id, date_trunc('hour', ts) AS v FROM events", "events", oracle="SELECT event_id, date_trunc('hour', ts) AS v FROM events")  # FN-23
QUERIES["fn_date_trunc"] = lambda s, d: engine(s, d, "events").sql("SELECT event_id, CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ) AS v FROM events")
same_sql("fn_extract", "SELECT o_orderkey, CAST(extract(YEAR FROM o_orderdate) AS INTEGER) AS y FROM orders", "orders")  # FN-24
same_sql("fn_length_chars", "SELECT doc_id, CAST(length(text) AS BIGINT) AS n FROM documents", "documents")  # FN-04, as Spark has it


@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n FROM documents")
def fn_length_bytes(spark, folder):  # FN-04, in bytes
    return table(spark, folder, "documents").select("doc_id", own.byte_length("text").cast("bigint").alias("n"))


@query("SELECT s, trim(s, ' ' || chr(9) || chr(10) || chr(13)) AS v FROM (VALUES (' a '), (chr(9) || 'a' || chr(10)), ('')) AS t(s)")
def fn_trim(spark, folder):  # FN-03
    return spark.createDataFrame([(" a ",), ("\ta\n",), ("",)], "s string").select("s", own.trim_space("s").alias("v"))


@query("SELECT a, concat(a, b) AS v FROM (VALUES ('abc', 'x'), (NULL, 'y'), ('z', NULL)) AS t(a, b)")
def fn_concat(spark, folder):  # FN-06
    return spark.createDataFrame([("abc", "x"), (None, "y"), ("z", None)], "a string, b string").select("a", own.concat_skip_null("a", "b").alias("v"))


@query("SELECT TRUE AS epoch, TRUE AS day_, TRUE AS time_")
def fn_clock(spark, folder):  # FN-13..15, FN-22: the clock's values are plausible, not equal
    return spark.range(1).select(
        (own.epoch_now() > 1_500_000_000).alias("epoch"), (F.current_date() > F.lit("2020-01-01").cast("date")).alias("day_"),
        (F.date_format(F.current_timestamp(), "HH:mm:ss").rlike("^[0-9:]{8}$")).alias("time_"),
    )


# -- sources and sinks --------------------------------------------------------------------------------------------------------------


def scratch(spark: SparkSession, name: str) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{shared.rstrip('/') if shared else 'file://' + tempfile.mkdtemp(prefix='sluice-')}/{name}-{uuid.uuid4().hex}"


@query("SELECT n_nationkey, n_name FROM nation")
def parquet_round_trip(spark, folder):  # SRC-12, SNK-09, SNK-10
    path = scratch(spark, "parquet")
    write_parquet(table(spark, folder, "nation"), path, "zstd", 6)
    return read_parquet(spark, path, ["n_nationkey", "n_name"])


@query("SELECT column_name AS name FROM (DESCRIBE SELECT * FROM nation)")
def parquet_columns(spark, folder):  # SRC-13
    schema: StructType = parquet_schema(spark, f"{folder}/nation.parquet")
    return spark.createDataFrame([(f.name,) for f in schema.fields], "name string")


@query("SELECT r_regionkey, r_name FROM region")
def ipc_round_trip(spark, folder):  # SRC-15, SNK-12
    return ipc_frame(spark, ipc_bytes(table(spark, folder, "region")))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def encrypted_round_trip(spark, folder):  # SRC-14, SNK-11, PLT-04
    path = scratch(spark, "sealed")
    write_encrypted(table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal"), path, b"0123456789abcdef0123456789abcdef", "customer")
    return read_encrypted(spark, path, b"0123456789abcdef0123456789abcdef", "customer")


@query("SELECT * FROM nation")
def cached_scan(spark, folder):  # SRC-05, SRC-06
    return engine(spark, folder, "nation").cache("nation").where("n_nationkey >= 0")


@query("SELECT * FROM region UNION ALL SELECT * FROM region")
def append_rows(spark, folder):  # SRC-03, SRC-04
    e = engine(spark, folder, "region")
    e.append("region", table(spark, folder, "region"))
    return e.sql("SELECT * FROM region")


# -- key-value tables, snapshots --------------------------------------------------------------------------------------------------------
# events as a version log: user_id is the key, event_id the commit timestamp, one kind of event the tombstone

_LOG = "SELECT user_id AS key, event_type AS value, event_id AS commit_ts, CAST(0 AS BIGINT) AS seq, event_type = (SELECT min(event_type) FROM events) AS deleted FROM events"


def _log(spark: SparkSession, folder: str) -> DataFrame:
    ev = table(spark, folder, "events")
    first = ev.agg(F.min("event_type").alias("_t"))
    return ev.crossJoin(F.broadcast(first)).select(  # the broadcast is one row
        F.col("user_id").alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("commit_ts"), F.lit(0).cast("bigint").alias("seq"), (F.col("event_type") == F.col("_t")).alias("deleted")
    )


_VISIBLE = """SELECT key, value, commit_ts FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY commit_ts DESC, seq DESC) AS rn FROM log {where})
  WHERE rn = 1 AND NOT deleted"""


@query(f"WITH log AS ({_LOG}) " + _VISIBLE.format(where="WHERE commit_ts <= 500"))
def snapshot_at_ts(spark, folder):  # TXN-05, TXN-09
    return visible(_log(spark, folder), 500)


@query(f"WITH log AS ({_LOG}) " + _VISIBLE.format(where=""))
def snapshot_after_delete(spark, folder):  # TXN-06, SRC-08
    return visible(_log(spark, folder))


@query(f"WITH log AS ({_LOG}) SELECT * FROM (" + _VISIBLE.format(where="") + ") WHERE key >= 10 AND key < 40")
def kv_range(spark, folder):  # SRC-09
    return visible(_log(spark, folder).where("key >= 10 AND key < 40"))


@query(f"""WITH log AS ({_LOG}), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY commit_ts DESC, seq DESC) AS n,
  max(CASE WHEN commit_ts <= 600 THEN commit_ts END) OVER (PARTITION BY key) AS base FROM log)
  SELECT key, value, commit_ts, seq, deleted FROM r
  WHERE NOT (commit_ts <= 600 AND commit_ts < base AND n > 1) AND NOT (commit_ts <= 600 AND commit_ts = base AND deleted AND n = 1)""")
def gc_survivors(spark, folder):  # TXN-07
    return survivors(_log(spark, folder), 600)


@query("SELECT * FROM (VALUES ('a', 'v2'), ('c', 'v2'), ('d', 'own')) AS t(key, value)")
def kv_transaction(spark, folder):  # SNK-05..07, TXN-01, TXN-02, TXN-04, Q-22, Q-23
    e = engine(spark, folder)
    e.insert_batch("kv", [(b"a", b"v1"), (b"b", b"v1"), (b"c", b"v1")])
    e.flush("kv")
    e.insert("kv", b"a", b"v2")
    e.delete("kv", b"b")
    with e.begin() as t:
        t.insert("kv", b"c", b"v1")
        t.insert("kv", b"c", b"v2")
        t.insert("kv", b"d", b"own")
    return e.scan("kv").select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


# -- statements that change tables --------------------------------------------------------------------------------------------------------


def _nation(spark: SparkSession, folder: str) -> Engine:
    e = engine(spark, folder, "nation")
    e.sql("CREATE TABLE n2 (k INT PRIMARY KEY, name TEXT NOT NULL, region INT)")
    e.sql("INSERT INTO n2 SELECT n_nationkey, n_name, n_regionkey FROM nation")
    return e


@query("SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation UNION ALL VALUES (100, 'X', 1), (101, 'Y', NULL)")
def dml_insert_state(spark, folder):  # SNK-01, SNK-02, DDL-01, Q-17
    e = _nation(spark, folder)
    e.sql("INSERT INTO n2 (k, name, region) VALUES (100, 'X', 1), (101, 'Y', NULL)")
    return e.sql("SELECT * FROM n2")


@query("""SELECT CAST(n_nationkey AS BIGINT) AS k, CASE WHEN n_regionkey = 2 THEN upper(n_name) || '!' ELSE n_name END AS name,
  CAST(CASE WHEN n_regionkey = 2 THEN 20 ELSE n_regionkey END AS BIGINT) AS region FROM nation""")
def dml_update_state(spark, folder):  # SNK-03, Q-18
    e = _nation(spark, folder)
    e.sql("UPDATE n2 SET name = concat(upper(name), '!'), region = 20 WHERE region = 2")
    return e.sql("SELECT * FROM n2")


@query("SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation WHERE NOT (n_regionkey = 3 OR n_nationkey < 4)")
def dml_delete_state(spark, folder):  # SNK-04
    e = _nation(spark, folder)
    e.sql("DELETE FROM n2 WHERE region = 3 OR k < 4")
    return e.sql("SELECT * FROM n2")


@query("SELECT CAST(25 AS BIGINT) AS inserted, CAST((SELECT count(*) FROM nation WHERE n_regionkey = 1) AS BIGINT) AS updated, CAST((SELECT count(*) FROM nation WHERE n_regionkey = 2) AS BIGINT) AS deleted")
def dml_counts(spark, folder):  # SNK-01, SNK-03, SNK-04, QRY-05
    e = engine(spark, folder, "nation")
    e.sql("CREATE TABLE n3 (k INT, name TEXT, region INT)")
    ins = e.execute("INSERT INTO n3 SELECT n_nationkey, n_name, n_regionkey FROM nation").run()
    upd = e.execute("UPDATE n3 SET name = $1 WHERE region = $2").bind("it's").bind(1).run()
    dele = e.execute("DELETE FROM n3 WHERE region = :r").param("r", 2).run()
    return spark.createDataFrame([(ins, upd, dele)], "inserted bigint, updated bigint, deleted bigint")


@query("SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name, CAST(n_regionkey AS BIGINT) AS region, CAST(NULL AS DOUBLE) AS score FROM nation UNION ALL VALUES (100, 'X', 1, 2.5)")
def alter_add_column(spark, folder):  # DDL-03
    e = _nation(spark, folder)
    e.sql("ALTER TABLE n2 ADD COLUMN score REAL")
    e.sql("INSERT INTO n2 VALUES (100, 'X', 1, 2.5)")
    return e.sql("SELECT * FROM n2")


@query("SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name FROM nation")
def alter_drop_column(spark, folder):  # DDL-04
    e = _nation(spark, folder)
    e.sql("ALTER TABLE n2 DROP COLUMN region")
    return e.sql("SELECT * FROM n2")


@query("SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS title, CAST(n_regionkey AS BIGINT) AS region FROM nation")
def alter_rename_column(spark, folder):  # DDL-05
    e = _nation(spark, folder)
    e.sql("ALTER TABLE n2 RENAME COLUMN name TO title")
    return e.sql("SELECT * FROM n2")


@query("SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation")
def schema_at_version(spark, folder):  # SV-01
    e = _nation(spark, folder)
    e.sql("ALTER TABLE n2 DROP COLUMN region")
    e.sql("ALTER TABLE n2 RENAME COLUMN name TO title")
    return e._sql_table("n2").df(1)


@query("SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation WHERE n_regionkey = 1")
def index_lookup(spark, folder):  # DDL-06, DDL-07, SRC-19
    e = _nation(spark, folder)
    e.sql("CREATE INDEX IF NOT EXISTS by_region ON n2 (region)")
    found = e.index_lookup("n2", "region", 1).select("k")
    e.sql("DROP INDEX n2.by_region")
    return found


@query("SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name FROM nation")
def dump_and_load(spark, folder):  # SNK-15, SRC-17
    e = _nation(spark, folder)
    path = scratch(spark, "dump")
    e.save_to(path)
    return Engine.load_from(path, spark).sql("SELECT k, name FROM n2")


# -- parameters, functions -----------------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'")
def bound_parameters(spark, folder):  # QRY-01, QRY-06
    return engine(spark, folder, "orders").query("SELECT o_orderkey FROM orders WHERE o_totalprice > $1 AND o_orderstatus = $2").bind(100000).bind("F").df()


@query("SELECT p_partkey, upper(p_brand) || '#' AS v FROM part")
def udf_scalar(spark, folder):  # UDF-01, UDF-05, UDF-07
    e = engine(spark, folder, "part")
    if "shout" not in e.functions.list():
        e.functions.register(ScalarUDF("shout", Signature(("string",), "string"), lambda s: None if s is None else s.upper() + "#"))
    return e.sql("SELECT p_partkey, shout(p_brand) AS v FROM part")


class _Span(Aggregate):
    def __init__(self):
        self.lo = self.hi = None

    def accumulate(self, x):
        if x is not None:
            self.lo = x if self.lo is None else min(self.lo, x)
            self.hi = x if self.hi is None else max(self.hi, x)

    def finalize(self):
        return None if self.lo is None else float(self.hi - self.lo)


@query("SELECT c_nationkey, max(c_acctbal) - min(c_acctbal) AS v FROM customer GROUP BY c_nationkey")
def udf_aggregate(spark, folder):  # UDF-02
    e = engine(spark, folder, "customer")
    e.functions.register(AggregateUDF("span", Signature(("float",), "float"), _Span))
    return e.sql("SELECT c_nationkey, span(c_acctbal) AS v FROM customer GROUP BY c_nationkey")


@query("SELECT n_nationkey, i, n_nationkey * i AS product FROM nation, (VALUES (1), (2), (3)) AS t(i)")
def udf_table(spark, folder):  # UDF-03
    e = engine(spark, folder, "nation")
    e.functions.register(TableUDF("multiples", Signature(("int", "int"), "table"), "i int, product int", lambda x, n: [(i, x * i) for i in range(1, n + 1)]))
    return e.sql("SELECT n_nationkey, m.i, m.product FROM nation, LATERAL multiples(n_nationkey, 3) m")


@query("SELECT p_partkey, p_size * 2 + 1 AS v FROM part")
def create_function(spark, folder):  # DDL-08
    e = engine(spark, folder, "part")
    e.sql("CREATE FUNCTION twice_one(x INT) RETURNS INT LANGUAGE SQL AS 'x * 2 + 1'")
    return e.sql("SELECT p_partkey, CAST(twice_one(p_size) AS INT) AS v FROM part")


@query("SELECT * FROM (VALUES ('rows', CAST(2 AS BIGINT)), ('row', 2)) AS t(kind, n)")
def trigger_log(spark, folder):  # AUT-01, AUT-02, AUT-04, AUT-05, DDL-09, Q-20
    e, seen = engine(spark, folder), []
    e.sql("CREATE TABLE watched (k INT, v TEXT)")
    e.functions.register(_plain("note_rows", lambda *a: seen.append("rows") or a))
    e.functions.register(_plain("note_row", lambda *a: seen.append("row") or a))
    e.sql("CREATE TRIGGER t1 AFTER INSERT ON watched EXECUTE FUNCTION note_rows")
    e.sql("CREATE TRIGGER t2 AFTER INSERT ON watched FOR EACH ROW EXECUTE FUNCTION note_row")
    e.sql("INSERT INTO watched VALUES (1, 'a')")
    e.sql("INSERT INTO watched VALUES (2, 'b')")
    return spark.createDataFrame([(k, seen.count(k)) for k in ("rows", "row")], "kind string, n bigint")


def _plain(name, body):
    """A driver-side function that SQL does not see."""
    f = ScalarUDF(name, Signature((), "any", True), body)
    f.register = lambda spark: None
    return f


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS s FROM events GROUP BY event_type")
def stream_totals(spark, folder):  # STR-03: a stream of files through foreachBatch, merged into totals
    from sluice.streaming import changes, to_batches

    schema = parquet_schema(spark, f"{folder}/events.parquet")
    parts, out = [], scratch(spark, "stream")

    def run(batch: DataFrame, batch_id: int) -> None:
        path = f"{out}/{batch_id}"
        op.hash_aggregate(batch, ["event_type"], {"n": F.count("*"), "s": F.sum("value")}).write.parquet(path)
        parts.append(path)

    source = f"{folder}/events.parquet"
    stream = changes(spark, source if os.path.isdir(source) else f"{folder}/event[s].parquet", schema)
    to_batches(stream, run, scratch(spark, "progress")).awaitTermination()
    both = spark.read.parquet(*parts)
    return op.hash_aggregate(both, ["event_type"], {"n": F.sum("n"), "s": F.round(F.sum("s"), 2)})


from sluice.plans import calls  # noqa: E402, F401  (it registers its queries here)
