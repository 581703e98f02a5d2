"""The operations whose published targets the benchmark is read against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.validate import Table
from ..plans import statements
from ..plans.contract import Column, Contract, ForeignKey
from ..plans.database import Database
from . import query, table


def _state(spark: SparkSession, d: str) -> dict[str, Table]:
    i = lambda n: Column(n, "int", False, True)
    users = table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_nationkey").cast("long").alias("c_nationkey"))
    posts = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    text = lambda n: Column(n, "string", False, True)
    return {
        "customer": Table(users, Contract("customer", (i("c_custkey"), text("c_name"), i("c_nationkey")), ("c_custkey",))),
        "orders": Table(
            posts,
            Contract(
                "orders", (i("o_orderkey"), i("o_custkey"), text("o_orderstatus"), text("o_orderpriority")), ("o_orderkey",),
                foreign_keys=(ForeignKey("fk_customer", ("o_custkey",), ("customer",), on_update="cascade"),),
            ),
        ),
    }


@query("SELECT count(*) AS n FROM orders")
def base_count(spark: SparkSession, d: str) -> DataFrame:
    return statements.select(spark, _state(spark, d), "SELECT count(*) AS n FROM orders")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey = 7")
def base_select_by_key(spark: SparkSession, d: str) -> DataFrame:
    return statements.select(spark, _state(spark, d), "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey = ?", [7])


@query("SELECT c_custkey, CAST(c_nationkey + 1 AS BIGINT) AS c_nationkey FROM customer WHERE c_custkey = 5")
def base_update_one(spark: SparkSession, d: str) -> DataFrame:
    sql = "UPDATE customer SET c_nationkey = c_nationkey + 1 WHERE c_custkey = 5 RETURNING c_custkey, c_nationkey"
    return Database(spark, _state(spark, d)).execute(sql)[0]


@query("SELECT o_orderkey, 'X' AS o_orderstatus FROM orders WHERE o_orderpriority = '1-URGENT'")
def base_update_many(spark: SparkSession, d: str) -> DataFrame:
    """Tens of thousands of rows at scale factor 0.1."""
    sql = "UPDATE orders SET o_orderstatus = 'X' WHERE o_orderpriority = '1-URGENT' RETURNING o_orderkey, o_orderstatus"
    return Database(spark, _state(spark, d)).execute(sql)[0]
