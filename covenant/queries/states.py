"""State comparison over two or three derived versions of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import states
from ..operators.validate import Table
from ..plans.contract import Column, Contract
from . import query, table

CONTRACT = Contract(
    "orders",
    (Column("o_orderkey", "int", False, True), Column("o_orderstatus", "string"), Column("o_totalprice", "number"), Column("o_orderpriority", "string")),
    ("o_orderkey",),
)


def _base(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


def _edit(df: DataFrame, status: int | None, price: int | None, gone: int | None, bump: float = 1.0) -> Table:
    """Changes, deletes and leaves rows by remainders of their keys."""
    k = F.col("o_orderkey")
    if status:
        df = df.withColumn("o_orderstatus", F.when(k % status == 0, "Z").otherwise(F.col("o_orderstatus")))
    if price:
        df = df.withColumn("o_totalprice", F.when(k % price == 0, F.col("o_totalprice") + bump).otherwise(F.col("o_totalprice")))
    return Table(df.where(k % gone != 0) if gone else df, CONTRACT)


@query(
    """SELECT 'orders/' || o_orderkey || '.json' AS path,
            CASE WHEN o_orderkey % 31 = 0 THEN 'removed' ELSE 'changed' END AS kind
        FROM orders WHERE o_orderkey % 31 = 0 OR o_orderkey % 7 = 0 AND o_orderstatus <> 'Z'
        UNION ALL SELECT 'orders/' || (o_orderkey + 90000000) || '.json', 'added' FROM orders WHERE o_orderkey % 101 = 0"""
)
def diff_states(spark: SparkSession, d: str) -> DataFrame:
    base = _base(spark, d)
    new = base.where("o_orderkey % 101 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 90_000_000)
    after = _edit(base, 7, None, 31)
    return states.diff(Table(base, CONTRACT), Table(after.rows.union(new), CONTRACT)).select("path", "kind")


@query(
    """SELECT 'orders/' || o_orderkey || '.json' AS path, '/o_totalprice' AS pointer FROM orders WHERE o_orderkey % 9 = 0
        UNION ALL SELECT 'orders/' || o_orderkey || '.json', '/o_orderstatus' FROM orders WHERE o_orderkey % 6 = 0 AND o_orderstatus <> 'Z'"""
)
def diff_values(spark: SparkSession, d: str) -> DataFrame:
    base = _base(spark, d)
    return states.value_changes(Table(base, CONTRACT), _edit(base, 6, 9, None)).select("path", "pointer")


@query(
    """SELECT 'parts/new' || p_partkey || '.json' AS path, 'renamed' AS kind, 'parts/old' || p_partkey || '.json' AS from_path
        FROM part WHERE p_partkey % 4 = 0"""
)
def diff_renames(spark: SparkSession, d: str) -> DataFrame:
    """The file name is no part of the row: a new name for the same row is a rename."""
    p = table(spark, d, "part").select("p_partkey", "p_name")
    c = Contract("parts", (Column("p_partkey", "int", False, True), Column("p_name", "string")), ("p_partkey",))
    at = lambda new: F.concat(F.lit("parts/"), F.when(F.lit(new) & (F.col("p_partkey") % 4 == 0), "new").otherwise("old"), F.col("p_partkey").cast("string"), F.lit(".json"))
    before, after = (Table(p.withColumn("_path", at(new)), c) for new in (False, True))
    return states.diff(before, after).select("path", "kind", "from_path")


MERGE = """WITH b AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS p FROM orders),
    o AS (SELECT k, CASE WHEN k % 5 = 0 THEN 'Z' ELSE s END AS s, CASE WHEN k % 7 = 0 THEN p + 1 ELSE p END AS p FROM b WHERE k % 23 <> 0),
    t AS (SELECT k, s, CASE WHEN k % 3 = 0 THEN p + 2 ELSE p END AS p FROM b WHERE k % 29 <> 0)"""


@query(
    MERGE
    + """ SELECT coalesce(o.k, t.k) AS o_orderkey, coalesce(o.s, t.s) AS o_orderstatus,
            CASE WHEN o.k IS NULL THEN t.p WHEN t.k IS NULL THEN o.p WHEN o.p <> b.p THEN o.p ELSE t.p END AS o_totalprice
        FROM b LEFT JOIN o ON o.k = b.k LEFT JOIN t ON t.k = b.k
        WHERE (o.k IS NOT NULL AND t.k IS NOT NULL) OR (t.k IS NULL AND (o.s <> b.s OR o.p <> b.p))"""
)
def merge3(spark: SparkSession, d: str) -> DataFrame:
    """Ours changes status and price, theirs price; each removes some rows."""
    base = _base(spark, d)
    merged, _ = states.merge3(Table(base, CONTRACT), _edit(base, 5, 7, 23, 1.0), _edit(base, None, 3, 29, 2.0))
    return merged.rows.select("o_orderkey", "o_orderstatus", "o_totalprice")


@query(
    MERGE
    + """ SELECT 'orders/' || b.k || '.json' AS path, '/o_totalprice' AS pointer FROM b JOIN o ON o.k = b.k JOIN t ON t.k = b.k
            WHERE o.p <> b.p AND t.p <> b.p AND o.p <> t.p
        UNION ALL SELECT 'orders/' || b.k || '.json', '' FROM b LEFT JOIN o ON o.k = b.k LEFT JOIN t ON t.k = b.k
            WHERE (o.k IS NULL AND t.k IS NOT NULL AND t.p <> b.p) OR (t.k IS NULL AND o.k IS NOT NULL AND (o.s <> b.s OR o.p <> b.p))"""
)
def merge3_conflicts(spark: SparkSession, d: str) -> DataFrame:
    base = _base(spark, d)
    _, conflicts = states.merge3(Table(base, CONTRACT), _edit(base, 5, 7, 23, 1.0), _edit(base, None, 3, 29, 2.0))
    return conflicts.select("path", "pointer")


@query(
    """WITH RECURSIVE p AS (SELECT p_partkey AS id, p_partkey // 2 AS parent FROM part WHERE p_partkey > 1),
        up(node, origin) AS (SELECT 25, 25 UNION SELECT 27, 27 UNION SELECT p.parent, up.origin FROM up JOIN p ON p.id = up.node),
        common AS (SELECT node FROM up GROUP BY node HAVING count(DISTINCT origin) = 2)
        SELECT CAST(node AS VARCHAR) AS id FROM common WHERE node NOT IN (SELECT p.parent FROM p JOIN common ON p.id = common.node)"""
)
def dag_merge_base(spark: SparkSession, d: str) -> DataFrame:
    """A heap-shaped history: the base of nodes 25 and 27 is 6."""
    p = table(spark, d, "part").where("p_partkey > 1").select(
        F.col("p_partkey").cast("string").alias("id"), F.floor(F.col("p_partkey") / 2).cast("string").alias("parent")
    )
    return states.merge_bases(p, "25", "27")
