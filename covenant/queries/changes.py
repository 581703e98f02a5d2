"""Changes over the driver's tables: statements, imports, referential actions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes, referential
from ..operators.validate import Table
from ..plans.contract import Column, Contract, ForeignKey
from . import query, table


def _int(name: str) -> Column:
    return Column(name, "int", False, True)


def _orders(spark: SparkSession, d: str, **facts) -> Table:
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    columns = (_int("o_orderkey"), Column("o_custkey", "int", True, True, 1, True), Column("o_orderstatus", "string", False, True), Column("o_totalprice", "number", False, True))
    return Table(rows, Contract("orders", columns, ("o_orderkey",), **facts))


def _customers(spark: SparkSession, d: str, **facts) -> Table:
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("c_nationkey"))
    return Table(rows, Contract("customer", (_int("c_custkey"), _int("c_nationkey")), ("c_custkey",), **facts))


@query(
    """SELECT o_orderkey, 'X' AS o_orderstatus, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_totalprice < 5000"""
)
def dml_update_returning(spark: SparkSession, d: str) -> DataFrame:
    c = changes.update(_orders(spark, d), F.col("o_totalprice") < 5000, {"o_orderstatus": F.lit("X"), "o_totalprice": F.col("o_totalprice") + 1})
    return c.returning("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT o_orderstatus, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS same FROM (SELECT CASE WHEN o_custkey % 2 = 0 THEN 'F' ELSE o_orderstatus END AS o_orderstatus FROM orders) GROUP BY 1")
def dml_update_after(spark: SparkSession, d: str) -> DataFrame:
    c = changes.update(_orders(spark, d), F.col("o_custkey") % 2 == 0, {"o_orderstatus": F.lit("F")})
    return c.after.rows.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("same"))


@query("SELECT 'delete' AS op, '[' || o_orderkey || ']' AS key FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 200000")
def dml_delete(spark: SparkSession, d: str) -> DataFrame:
    return changes.delete(_orders(spark, d), (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 200000)).rows.select("op", "key")


def _incoming(spark: SparkSession, d: str) -> DataFrame:
    """A second version of the open and done orders, urgent ones dearer, and done ones again under new keys."""
    o = table(spark, d, "orders").where("o_orderstatus <> 'P'")
    price = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") + 10).otherwise(F.col("o_totalprice"))
    old = o.select("o_orderkey", "o_custkey", "o_orderstatus", price.alias("o_totalprice"))
    return old.union(old.where("o_orderstatus = 'F'").withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000))


INCOMING = """WITH old AS (SELECT o_orderkey, o_custkey, o_orderstatus,
            CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice + 10 ELSE o_totalprice END AS o_totalprice
        FROM orders WHERE o_orderstatus <> 'P'),
    inc AS (SELECT * FROM old UNION ALL SELECT o_orderkey + 10000000, o_custkey, o_orderstatus, o_totalprice FROM old WHERE o_orderstatus = 'F')"""


@query(
    INCOMING
    + """ SELECT CASE WHEN o.o_orderkey IS NULL THEN 'insert' WHEN i.o_totalprice = o.o_totalprice THEN 'unchanged' ELSE 'update' END AS op,
            count(*) AS n FROM inc i LEFT JOIN orders o ON o.o_orderkey = i.o_orderkey GROUP BY 1"""
)
def import_upsert(spark: SparkSession, d: str) -> DataFrame:
    return changes.import_rows(_orders(spark, d), _incoming(spark, d), "upsert")[1]


@query(
    INCOMING
    + """ SELECT CASE WHEN o.o_orderkey IS NULL THEN 'insert' WHEN i.o_orderkey IS NULL THEN 'delete'
            WHEN i.o_totalprice = o.o_totalprice THEN 'unchanged' ELSE 'update' END AS op,
            count(*) AS n FROM inc i FULL JOIN orders o ON o.o_orderkey = i.o_orderkey GROUP BY 1"""
)
def import_replace(spark: SparkSession, d: str) -> DataFrame:
    return changes.import_rows(_orders(spark, d), _incoming(spark, d), "replace")[1]


@query(
    INCOMING
    + """ SELECT i.o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN i.o_totalprice ELSE o.o_totalprice + i.o_totalprice END AS o_totalprice
        FROM inc i LEFT JOIN orders o ON o.o_orderkey = i.o_orderkey"""
)
def dml_insert_on_conflict_update(spark: SparkSession, d: str) -> DataFrame:
    c = changes.insert(_orders(spark, d), _incoming(spark, d), "update", {"o_totalprice": F.col("old.o_totalprice") + F.col("excluded.o_totalprice")})
    return c.returning("o_orderkey", "o_totalprice")


@query(INCOMING + " SELECT '[' || i.o_orderkey || ']' AS key, 'insert' AS op FROM inc i WHERE i.o_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def dml_insert_on_conflict_nothing(spark: SparkSession, d: str) -> DataFrame:
    return changes.insert(_orders(spark, d), _incoming(spark, d), "nothing").rows.select("key", "op")


@query("SELECT 15000000 + row_number() OVER (ORDER BY o_orderkey) AS n FROM orders")
def dml_insert_sequence(spark: SparkSession, d: str) -> DataFrame:
    """New rows continue a sequence from its greatest value."""
    held = spark.range(14_999_000, 15_000_001).withColumnRenamed("id", "n").withColumn("what", F.lit("old"))
    t = Table(held, Contract("tickets", (Column("n", "int", False, True, generated="sequence"), Column("what", "string")), ("n",)))
    new = table(spark, d, "orders").select(F.col("o_orderstatus").alias("what"))
    return changes.insert(t, new).returning("n")


def _state(spark: SparkSession, d: str, action: str) -> dict[str, Table]:
    """nation <- customer <- orders, with the given action on deletes of customers."""
    nations = Table(
        table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name"),
        Contract("nation", (_int("n_nationkey"), Column("n_name", "string")), ("n_nationkey",)),
    )
    return {
        "nation": nations,
        "customer": _customers(spark, d, foreign_keys=(ForeignKey("fk_nation", ("c_nationkey",), ("nation",), on_delete="cascade", on_update="cascade"),)),
        "orders": _orders(spark, d, foreign_keys=(ForeignKey("fk_customer", ("o_custkey",), ("customer",), on_delete=action, on_update="cascade"),)),
    }


@query(
    """SELECT 'customer' AS name, count(*) AS n FROM customer WHERE c_nationkey <> 3 UNION ALL
        SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)
        UNION ALL SELECT 'induced', (SELECT count(*) FROM customer WHERE c_nationkey = 3)
            + (SELECT count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3))"""
)
def dml_delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    """A nation goes, its customers with it, their orders with them."""
    e = referential.delete_rows(spark, _state(spark, d, "cascade"), "nation", F.col("n_nationkey") == 3)
    count = lambda df, name: df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
    return count(e.state["customer"].rows, "customer").union(count(e.state["orders"].rows, "orders")).union(count(e.induced, "induced"))


@query("SELECT o_orderkey, CASE WHEN c_nationkey = 7 THEN NULL ELSE o_custkey END AS o_custkey FROM orders JOIN customer ON c_custkey = o_custkey")
def dml_set_null(spark: SparkSession, d: str) -> DataFrame:
    e = referential.delete_rows(spark, _state(spark, d, "set_null"), "customer", F.col("c_nationkey") == 7)
    return e.state["orders"].rows.select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, CASE WHEN c_nationkey = 7 THEN 1 ELSE o_custkey END AS o_custkey FROM orders JOIN customer ON c_custkey = o_custkey")
def dml_set_default(spark: SparkSession, d: str) -> DataFrame:
    e = referential.delete_rows(spark, _state(spark, d, "set_default"), "customer", F.col("c_nationkey") == 7)
    return e.state["orders"].rows.select("o_orderkey", "o_custkey")


@query("SELECT 'orders/' || o_orderkey || '.json' AS path, 'restrict' AS action, '[' || o_custkey || ']' AS key FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 5")
def dml_restrict(spark: SparkSession, d: str) -> DataFrame:
    e = referential.delete_rows(spark, _state(spark, d, "restrict"), "customer", F.col("c_nationkey") == 5)
    return e.refused.select("path", "action", "key")


@query("SELECT o_orderkey, CASE WHEN c_nationkey = 3 THEN o_custkey + 5000000 ELSE o_custkey END AS o_custkey FROM orders JOIN customer ON c_custkey = o_custkey")
def dml_update_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Customers get new keys; their orders follow."""
    e = referential.rekey_rows(spark, _state(spark, d, "restrict"), "customer", F.col("c_nationkey") == 3, {"c_custkey": F.col("c_custkey") + 5_000_000})
    return e.state["orders"].rows.select("o_orderkey", "o_custkey")


@query(
    """SELECT o_custkey, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) FILTER (WHERE o_orderstatus <> 'P'), '') AS refs
        FROM orders GROUP BY o_custkey"""
)
def dml_remove_element(spark: SparkSession, d: str) -> DataFrame:
    """Deleted orders are taken out of the arrays that list them."""
    o = _orders(spark, d)
    baskets = o.rows.groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("refs"))
    fk = ForeignKey("fk_refs", ("refs[]",), ("orders",), on_delete="remove")
    holder = Table(baskets, Contract("baskets", (_int("o_custkey"), Column("refs", "array", items=_int(""))), ("o_custkey",), foreign_keys=(fk,)))
    e = referential.delete_rows(spark, {"orders": o, "baskets": holder}, "orders", F.col("o_orderstatus") == "P")
    return e.state["baskets"].rows.select("o_custkey", F.array_join(F.transform("refs", lambda x: x.cast("string")), ",").alias("refs"))
