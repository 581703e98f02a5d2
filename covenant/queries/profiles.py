"""Lint proposals and reference discovery over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import profile
from ..operators.validate import Table
from ..plans.contract import Column, Contract
from . import query, table


def _customer(spark: SparkSession, d: str) -> Table:
    rows = table(spark, d, "customer").withColumn("note", F.lit(None).cast("string"))
    columns = (
        Column("c_custkey", "int", False, True), Column("c_name", "string", True, True), Column("c_nationkey", "int", False, True),
        Column("c_acctbal", "number", False, True), Column("c_mktsegment", "string", False, True), Column("note", "string"),
    )
    return Table(rows, Contract("customer", columns, ("c_custkey",)))


@query(
    """SELECT 'LINT_NULLABLE_NEVER_NULL' AS code, 'c_name' AS "column" FROM customer WHERE c_name IS NULL HAVING count(*) = 0
        UNION ALL SELECT 'LINT_COLUMN_NEVER_POPULATED', 'note'
        UNION ALL SELECT 'LINT_ENUM_CANDIDATE', 'c_mktsegment' FROM customer HAVING count(DISTINCT c_mktsegment) <= 20 AND count(*) >= 3 * count(DISTINCT c_mktsegment)
        UNION ALL SELECT 'LINT_UNIQUE_CANDIDATE', 'c_name' FROM customer HAVING count(DISTINCT c_name) = count(*)
        UNION ALL SELECT 'LINT_CHECK_CANDIDATE', 'c_custkey' FROM customer HAVING min(c_custkey) >= 0
        UNION ALL SELECT 'LINT_CHECK_CANDIDATE', 'c_nationkey' FROM customer HAVING min(c_nationkey) >= 0
        UNION ALL SELECT 'LINT_CHECK_CANDIDATE', 'c_acctbal' FROM customer HAVING min(c_acctbal) >= 0
        UNION ALL SELECT 'LINT_NO_DESCRIPTION', ''"""
)
def lint_proposals(spark: SparkSession, d: str) -> DataFrame:
    return profile.lint(spark, _customer(spark, d)).select("code", "column")


@query(
    """SELECT 'c_mktsegment' AS "column", count(*) AS n_rows, count(c_mktsegment) AS n_values, count(DISTINCT c_mktsegment) AS n_distinct FROM customer
        UNION ALL SELECT 'c_name', count(*), count(c_name), count(DISTINCT c_name) FROM customer
        UNION ALL SELECT 'note', count(*), 0, 0 FROM customer"""
)
def lint_column_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile.column_profile(_customer(spark, d)).where(F.col("column").isin("c_mktsegment", "c_name", "note")).select("column", "n_rows", "n_values", "n_distinct")


@query(
    """WITH columns AS (
            SELECT 'nation' AS "table", 'n_regionkey' AS "column", n_regionkey + 1000000 AS v FROM nation
            UNION ALL SELECT 'customer', 'c_nationkey', c_nationkey FROM customer
        ), keys AS (
            SELECT 'region' AS target, r_regionkey + 1000000 AS k FROM region UNION ALL SELECT 'nation', n_nationkey FROM nation
            UNION ALL SELECT 'customer', c_custkey + 2000000 FROM customer
        ), counted AS (SELECT "table", "column", count(DISTINCT v) AS n FROM columns GROUP BY ALL)
        SELECT c."table", c."column", 'LINT_FK_CANDIDATE' AS code, k.target AS detail
        FROM columns c JOIN keys k ON c.v = k.k AND c."table" <> k.target JOIN counted t ON t."table" = c."table" AND t."column" = c."column"
        GROUP BY c."table", c."column", k.target, t.n HAVING count(DISTINCT c.v) = t.n"""
)
def ref_discovery(spark: SparkSession, d: str) -> DataFrame:
    """nation names region, customer names nation; region's keys are shifted apart from nation's."""
    i = lambda n: Column(n, "int", False, True)
    shift = 1_000_000
    nation = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), (F.col("n_regionkey").cast("long") + shift).alias("n_regionkey"))
    region = table(spark, d, "region").select((F.col("r_regionkey").cast("long") + shift).alias("r_regionkey"))
    customer = table(spark, d, "customer").select((F.col("c_custkey") + 2 * shift).alias("c_custkey"), F.col("c_nationkey").cast("long").alias("c_nationkey"), "c_mktsegment")
    state = {
        "region": Table(region, Contract("region", (i("r_regionkey"),), ("r_regionkey",))),
        "nation": Table(nation, Contract("nation", (i("n_nationkey"), i("n_regionkey")), ("n_nationkey",))),
        "customer": Table(customer, Contract("customer", (i("c_custkey"), i("c_nationkey"), Column("c_mktsegment", "string")), ("c_custkey",))),
    }
    return profile.discover_references(spark, state)
