"""Row validation, statements, migrations and transfers over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import doctor, profile, validate
from ..operators.validate import Table
from ..plans import jsonschema, migrate, statements
from ..plans.contract import Column, Contract, ForeignKey
from ..sources import transfer
from . import query, table


def _int(name: str) -> Column:
    return Column(name, "int", False, True)


def _orders(spark: SparkSession, d: str, **facts) -> Table:
    """Orders with their price as exact decimal text."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("total"))
    columns = (_int("o_orderkey"), Column("o_custkey", "int", True, False), Column("o_orderstatus", "string", False, True), Column("total", "decimal", False, True))
    return Table(rows, Contract("orders", columns, ("o_orderkey",), **facts))


def _customer(spark: SparkSession, d: str) -> Table:
    rows = table(spark, d, "customer").select("c_custkey", "c_name")
    return Table(rows, Contract("customer", (_int("c_custkey"), Column("c_name", "string", False, True)), ("c_custkey",)))


@query(
    """SELECT 'events/' || event_id || '.json' AS path, 'SCHEMA_VIOLATION' AS code, '/k' AS pointer FROM events
        WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 90"""
)
def row_judge(spark: SparkSession, d: str) -> DataFrame:
    """Every event's properties against a schema."""
    schema = {"type": "object", "properties": {"k": {"type": "integer", "x-c-type": "int", "maximum": 90}}, "required": ["k"], "additionalProperties": False}
    rows = table(spark, d, "events").select(F.concat(F.lit("events/"), F.col("event_id").cast("string"), F.lit(".json")).alias("_path"), F.col("props").alias("_text"))
    return jsonschema.judge_rows(rows, schema).select("path", "code", "pointer")


@query("SELECT p_partkey, 'maximum' AS keyword FROM part WHERE p_size > 45 UNION ALL SELECT p_partkey, 'pattern' FROM part WHERE NOT regexp_matches(p_brand, '^Brand#[1-4]')")
def row_column_rules(spark: SparkSession, d: str) -> DataFrame:
    """Flat rules of typed columns as conditions in generated code."""
    p = table(spark, d, "part")
    rules = jsonschema.column_rules("p_size", {"maximum": 45}) + jsonschema.column_rules("p_brand", {"pattern": "^Brand#[1-4]"})
    broken = F.filter(F.array(*(F.when(~c, F.lit(k)) for k, c in rules)), lambda k: k.isNotNull())
    return p.select("p_partkey", F.explode(broken).alias("keyword"))


@query(
    """SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2))::VARCHAR AS total FROM orders
        WHERE o_totalprice > 100000.50 AND o_totalprice <= 350000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 50"""
)
def sql_exact_compare(spark: SparkSession, d: str) -> DataFrame:
    """A statement compares and orders a decimal text by value."""
    sql = "SELECT o_orderkey, total FROM orders WHERE total > 100000.50 AND total <= '350000.0' ORDER BY total DESC, o_orderkey LIMIT 50"
    return statements.select(spark, {"orders": _orders(spark, d)}, sql)


@query("SELECT o_orderkey, 'X' AS o_orderstatus FROM orders WHERE o_totalprice < 5000 OR o_totalprice > 495000")
def sql_update(spark: SparkSession, d: str) -> DataFrame:
    sql = "UPDATE orders SET o_orderstatus = 'X' WHERE total < 5000 OR total > 495000 RETURNING o_orderkey, o_orderstatus"
    return statements.run(spark, {"orders": _orders(spark, d)}, sql).returning


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def sql_delete_subquery(spark: SparkSession, d: str) -> DataFrame:
    state = {"customer": _customer(spark, d), "orders": _orders(spark, d)}
    sql = "DELETE FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE total > 400000)"
    return statements.run(spark, state, sql).state["customer"].rows


@query("SELECT o_orderkey + 50000000 AS o_orderkey, o_custkey, 'N' AS o_orderstatus, '1.5' AS total FROM orders")
def sql_insert_select(spark: SparkSession, d: str) -> DataFrame:
    sql = "INSERT INTO orders (o_orderkey, o_custkey, o_orderstatus, total) SELECT o_orderkey + 50000000, o_custkey, 'N', '1.5' FROM orders RETURNING *"
    return statements.run(spark, {"orders": _orders(spark, d)}, sql).returning


@query("SELECT c_custkey, c_name || '' AS c_name, upper(c_name) AS full_name FROM customer")
def migrate_columns(spark: SparkSession, d: str) -> DataFrame:
    state = {"customer": _customer(spark, d)}
    state = migrate.add_column(state, "customer", Column("loud", "string", True, False), F.upper("c_name"))
    state = migrate.rename_column(state, "customer", "loud", "full_name")
    return state["customer"].rows


@query("SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS code FROM orders")
def migrate_change_type(spark: SparkSession, d: str) -> DataFrame:
    """int to decimal to string, each step lossless or refused."""
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").alias("code"))
    state = {"orders": Table(rows, Contract("orders", (_int("o_orderkey"), _int("code")), ("o_orderkey",)))}
    state = migrate.change_type(state, "orders", "code", "decimal")
    return migrate.change_type(state, "orders", "code", "string")["orders"].rows


@query("SELECT o_orderkey, 9007199254740992 + o_orderkey AS big FROM orders WHERE (9007199254740992 + o_orderkey) % 2 <> 0")
def export_exactness(spark: SparkSession, d: str) -> DataFrame:
    """Integers beyond 2^53 that a double would round."""
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") + F.lit(1 << 53)).alias("big"))
    return transfer.inexact(Table(rows, Contract("orders", (_int("o_orderkey"), _int("big")), ("o_orderkey",))), "big")


@query(
    """SELECT 'error' AS severity, 'SCHEMA_TARGET_KEYS_OVERLAP' AS code, 'supplier/' || s_suppkey || '.json' AS path
        FROM supplier WHERE s_suppkey IN (SELECT c_custkey FROM customer)"""
)
def val_overlap(spark: SparkSession, d: str) -> DataFrame:
    """A reference to customers or suppliers needs their keys apart."""
    s = Table(table(spark, d, "supplier").select("s_suppkey"), Contract("supplier", (_int("s_suppkey"),), ("s_suppkey",)))
    both = {"customer": _customer(spark, d), "supplier": s}
    fk = ForeignKey("fk_party", ("party",), ("customer", "supplier"))
    return validate.domain_clashes(spark, ", ".join(fk.tables), [both[n] for n in fk.tables], "SCHEMA_TARGET_KEYS_OVERLAP").select("severity", "code", "path")


@query("SELECT o_orderkey, CASE WHEN c_nationkey = 13 THEN NULL ELSE o_custkey END AS o_custkey FROM orders JOIN customer ON c_custkey = o_custkey")
def doctor_set_null(spark: SparkSession, d: str) -> DataFrame:
    """Dangling references set to null."""
    state = {
        "customer": Table(table(spark, d, "customer").where("c_nationkey <> 13").select("c_custkey", "c_name"), _customer(spark, d).contract),
        "orders": _orders(spark, d, foreign_keys=(ForeignKey("fk_customer", ("o_custkey",), ("customer",)),)),
    }
    return doctor.without_dangling(state, "orders", "set_null")["orders"].rows.select("o_orderkey", "o_custkey")


@query("SELECT p_partkey % 1500 AS k, min(p_partkey) AS n FROM (SELECT * FROM part ORDER BY p_partkey) GROUP BY 1")
def doctor_drop_duplicates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select((F.col("p_partkey") % 1500).alias("k"), F.col("p_partkey").alias("n"))
    rows = rows.withColumn("_path", F.format_string("part/%d-%08d.json", "k", "n"))
    return doctor.without_duplicates(Table(rows, Contract("part", (_int("k"), _int("n")), ("k",)))).rows.select("k", "n")


@query("SELECT 'orders' AS \"table\", 'total' AS \"column\", 'decimal' AS detail UNION ALL SELECT 'orders', 'day', 'date'")
def lint_wider_types(spark: SparkSession, d: str) -> DataFrame:
    """Text columns whose every value is written as a narrower type."""
    rows = table(spark, d, "orders").select(
        "o_orderkey", F.regexp_replace(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), r"\.?0+$", "").alias("total"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderstatus",
    )
    columns = (_int("o_orderkey"), Column("total", "string"), Column("day", "string"), Column("o_orderstatus", "string"))
    return profile.wider_types(spark, Table(rows, Contract("orders", columns, ("o_orderkey",)))).select("table", "column", "detail")
