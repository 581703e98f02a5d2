"""Validation rules over the driver's tables, with faults derived in the query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import validate as v
from ..plans.contract import Acyclic, Column, Contract, ForeignKey, Rule
from . import query, table


def _int(name: str) -> Column:
    return Column(name, "int", False, True)


def _table(rows: DataFrame, name: str, key: tuple[str, ...], columns: tuple[Column, ...], **facts) -> v.Table:
    return v.Table(rows, Contract(name, columns, key, **facts))


def _orders(rows: DataFrame, **facts) -> v.Table:
    columns = (_int("o_orderkey"), Column("o_custkey", "int", True, True), Column("o_orderstatus", "string", False, True), Column("o_totalprice", "number", False, True))
    return _table(rows.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), "orders", ("o_orderkey",), columns, **facts)


def _customers(rows: DataFrame, **facts) -> v.Table:
    columns = (_int("c_custkey"), Column("c_name", "string", False, True), _int("c_nationkey"))
    return _table(rows.select("c_custkey", "c_name", "c_nationkey"), "customer", ("c_custkey",), columns, **facts)


def _short(findings: DataFrame) -> DataFrame:
    return findings.select("severity", "code", "path", "pointer", "observed")


@query(
    """SELECT 'error' AS severity, 'PRIMARY_KEY_VIOLATION' AS code, 'part/' || k || '_' || n || '.json' AS path,
            '' AS pointer, '[' || k || ']' AS observed
        FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY 'part/' || k || '_' || n || '.json') AS rn
            FROM (SELECT p_partkey % 1500 AS k, p_partkey AS n FROM part)) WHERE rn > 1"""
)
def val_primary_key(spark: SparkSession, d: str) -> DataFrame:
    """Keys folded by a modulus collide; the first by path is kept."""
    rows = table(spark, d, "part").select((F.col("p_partkey") % 1500).alias("k"), F.col("p_partkey").alias("n"))
    rows = rows.withColumn("_path", F.concat(F.lit("part/"), F.col("k").cast("string"), F.lit("_"), F.col("n").cast("string"), F.lit(".json")))
    return _short(v.duplicates(_table(rows, "part", ("k",), (_int("k"), _int("n"))), ("k",), "PRIMARY_KEY_VIOLATION"))


@query(
    """SELECT 'error' AS severity, 'UNIQUE_VIOLATION' AS code, 'customer/' || c_custkey || '.json' AS path, '' AS pointer,
            '["' || c_mktsegment || '",' || c_nationkey || ']' AS observed
        FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey
            ORDER BY 'customer/' || c_custkey || '.json') AS rn FROM customer) WHERE rn > 1"""
)
def val_unique_composite(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    t = _table(c, "customer", ("c_custkey",), (_int("c_custkey"), Column("c_mktsegment", "string"), _int("c_nationkey")))
    return _short(v.duplicates(t, ("c_mktsegment", "c_nationkey"), "UNIQUE_VIOLATION"))


@query(
    """SELECT 'error' AS severity, 'FOREIGN_KEY_VIOLATION' AS code, 'orders/' || o_orderkey || '.json' AS path,
            '/o_custkey' AS pointer, '[' || o_custkey || ']' AS observed
        FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_nationkey <> 13)"""
)
def val_fk_dangling(spark: SparkSession, d: str) -> DataFrame:
    """The customers of one nation count as deleted."""
    state = {
        "customer": _customers(table(spark, d, "customer").where("c_nationkey <> 13")),
        "orders": _orders(table(spark, d, "orders"), foreign_keys=(ForeignKey("fk_customer", ("o_custkey",), ("customer",)),)),
    }
    return _short(v.dangling(state, state["orders"], state["orders"].contract.foreign_keys[0]))


@query(
    """WITH ps AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag <> 'R')
        SELECT 'error' AS severity, 'FOREIGN_KEY_VIOLATION' AS code, 'lineitem/' || l_orderkey || ',' || l_linenumber || '.json' AS path,
            '/l_partkey,/l_suppkey' AS pointer, '[' || l.l_partkey || ',' || l.l_suppkey || ']' AS observed
        FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM ps WHERE ps.l_partkey = l.l_partkey AND ps.l_suppkey = l.l_suppkey)"""
)
def val_fk_composite(spark: SparkSession, d: str) -> DataFrame:
    kept = table(spark, d, "lineitem").where("l_returnflag <> 'R'")
    lines = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey", "l_suppkey")
    pairs = kept.select("l_partkey", "l_suppkey").distinct()
    columns = tuple(map(_int, ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")))
    fk = ForeignKey("fk_pair", ("l_partkey", "l_suppkey"), ("partsupp",))
    state = {
        "partsupp": _table(pairs, "partsupp", ("l_partkey", "l_suppkey"), columns[2:]),
        "lineitem": _table(lines, "lineitem", ("l_orderkey", "l_linenumber"), columns, foreign_keys=(fk,)),
    }
    return _short(v.dangling(state, state["lineitem"], fk))


@query(
    """WITH e AS (SELECT o_custkey, o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p,
            row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders)
        SELECT 'error' AS severity, 'FOREIGN_KEY_VIOLATION' AS code, 'baskets/' || o_custkey || '.json' AS path,
            '/lines/' || i || '/ref' AS pointer, '[' || k || ']' AS observed FROM e WHERE s = 'P' AND p = '1-URGENT'"""
)
def val_fk_nested_path(spark: SparkSession, d: str) -> DataFrame:
    """``lines[?urgent=true].ref`` inside an array of objects; pending orders are gone."""
    o = table(spark, d, "orders")
    line = F.struct(F.col("o_orderkey").alias("ref"), (F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    baskets = o.groupBy("o_custkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    element = Column("", "object", properties=(_int("ref"), Column("urgent", "bool")))
    fk = ForeignKey("fk_lines", ("lines[?urgent=true].ref",), ("orders",))
    state = {
        "orders": _orders(o.where("o_orderstatus <> 'P'")),
        "baskets": _table(baskets, "baskets", ("o_custkey",), (_int("o_custkey"), Column("lines", "array", items=element)), foreign_keys=(fk,)),
    }
    return _short(v.dangling(state, state["baskets"], fk))


@query(
    """SELECT 'error' AS severity, 'DOMAIN_KEY_VIOLATION' AS code, 'supplier/' || s_suppkey || '.json' AS path, '' AS pointer,
            '[' || s_suppkey || ']' AS observed FROM supplier WHERE s_suppkey IN (SELECT c_custkey FROM customer)"""
)
def val_domain(spark: SparkSession, d: str) -> DataFrame:
    """Customers and suppliers share one key namespace here."""
    s = table(spark, d, "supplier").select("s_suppkey")
    members = [_customers(table(spark, d, "customer"), domain="party"), _table(s, "supplier", ("s_suppkey",), (_int("s_suppkey"),), domain="party")]
    return _short(v.domain_clashes(spark, "party", members))


@query(
    """SELECT 'error' AS severity, 'CHECK_VIOLATION' AS code, 'orders/' || o_orderkey || '.json' AS path, '' AS pointer,
            CAST(NULL AS VARCHAR) AS observed FROM orders WHERE NOT (o_totalprice < 450000 OR o_orderstatus = 'F')"""
)
def val_check(spark: SparkSession, d: str) -> DataFrame:
    rule = Rule("sane", "o_totalprice < 450000 OR o_orderstatus = 'F'")
    return _short(v.broken_checks(_orders(table(spark, d, "orders")), rule))


@query(
    """SELECT 'warning' AS severity, 'ASSERTION_VIOLATION' AS code, 'customer/' || c_custkey || '.json' AS path, '' AS pointer,
            '[' || c_custkey || ']' AS observed FROM customer c
        WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)"""
)
def val_assertion(spark: SparkSession, d: str) -> DataFrame:
    text = "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)"
    rule = Rule("buys_big", text, "warning", "no big order")
    state = {"customer": _customers(table(spark, d, "customer")), "orders": _orders(table(spark, d, "orders"))}
    return _short(v.broken_assertions(spark, state, state["customer"], rule))


@query(
    """WITH c AS (
            SELECT '[' || p_partkey || ']' AS a, '[' || (2 * p_partkey) || ']' AS b FROM part
            WHERE p_partkey % 64 = 1 AND 2 * p_partkey IN (SELECT p_partkey FROM part)
                AND '[' || (2 * p_partkey) || ']' < '[' || (p_partkey // 2) || ']'
            UNION ALL SELECT '[0]', '[0]' FROM part WHERE p_partkey = 0)
        SELECT 'error' AS severity, 'CYCLE_VIOLATION' AS code, 'part/' || replace(replace(least(a, b), '[', ''), ']', '') || '.json' AS path,
            '' AS pointer, CASE WHEN a = b THEN a ELSE least(a, b) || ', ' || greatest(a, b) END AS observed FROM c"""
)
def val_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Each part needs its half, and every 64th its double: pairs that need each other.

    From a part the least way on is followed, so a pair is met where the double's key
    comes before the half's as text; part 0 needs itself.
    """
    p = table(spark, d, "part").select("p_partkey", F.array(F.floor(F.col("p_partkey") / 2).cast("long"), F.when(F.col("p_partkey") % 64 == 1, F.col("p_partkey") * 2)).alias("needs"))
    t = _table(p, "part", ("p_partkey",), (_int("p_partkey"), Column("needs", "array", items=_int(""))), acyclic=(Acyclic("needs", ("needs[]",)),))
    return _short(v.cycles(t, "needs", ("needs[]",)))


@query(
    """WITH c AS (SELECT * FROM customer WHERE c_nationkey <> 17)
        SELECT code, count(*) AS n FROM (
            SELECT 'FOREIGN_KEY_VIOLATION' AS code FROM orders o WHERE o_custkey NOT IN (SELECT c_custkey FROM c)
            UNION ALL SELECT 'CHECK_VIOLATION' FROM orders WHERE NOT (o_totalprice < 480000)
            UNION ALL SELECT 'UNIQUE_VIOLATION' FROM (SELECT row_number() OVER (PARTITION BY c_name ORDER BY c_custkey) AS rn FROM c) WHERE rn > 1
        ) GROUP BY code"""
)
def val_whole_state(spark: SparkSession, d: str) -> DataFrame:
    """The verdict on two tables: all rules at once, counted by code."""
    state = {
        "customer": _customers(table(spark, d, "customer").where("c_nationkey <> 17"), unique=(("c_name",),)),
        "orders": _orders(
            table(spark, d, "orders"),
            foreign_keys=(ForeignKey("fk_customer", ("o_custkey",), ("customer",)),),
            checks=(Rule("sane", "o_totalprice < 480000"),),
        ),
    }
    return v.judge(spark, state).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT 'error' AS severity, 'FOREIGN_KEY_VIOLATION' AS code, 'orders/' || o_orderkey || '.json' AS path,
            '/o_custkey' AS pointer, '[' || o_custkey || ']' AS observed
        FROM orders o WHERE o_orderstatus = 'P'
            AND o_custkey NOT IN (SELECT c_custkey FROM customer c WHERE c.c_nationkey <> 13)"""
)
def val_scoped(spark: SparkSession, d: str) -> DataFrame:
    """Only the touched orders are judged again; their targets are whole tables."""
    fk = ForeignKey("fk_customer", ("o_custkey",), ("customer",))
    state = {
        "customer": _customers(table(spark, d, "customer").where("c_nationkey <> 13")),
        "orders": _orders(table(spark, d, "orders"), foreign_keys=(fk,)),
    }
    touched = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.concat(F.lit("["), F.col("o_orderkey").cast("string"), F.lit("]")).alias("key"))
    scope = v.scoped(state, "orders", touched)
    return _short(v.dangling(scope, scope["orders"], fk))


@query(
    """WITH n AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'NAME' ELSE 'Name' END || (c_custkey % 700) AS name FROM customer),
        g AS (SELECT lower('customer/' || name || '.json') AS fold, min('customer/' || name || '.json') AS first FROM n GROUP BY 1 HAVING count(*) > 1)
        SELECT 'warning' AS severity, 'PORTABILITY_COLLISION' AS code, 'customer/' || n.name || '.json' AS path, '' AS pointer, g.first AS observed
        FROM n JOIN g ON lower('customer/' || n.name || '.json') = g.fold WHERE 'customer/' || n.name || '.json' <> g.first"""
)
def val_portable_names(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.when(F.col("c_custkey") % 3 == 0, "NAME").otherwise("Name"), (F.col("c_custkey") % 700).cast("string"))
    rows = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("customer/"), name, F.lit(".json")).alias("_path"))
    return _short(v.folded_names(_table(rows, "customer", ("c_custkey",), (_int("c_custkey"),))))
