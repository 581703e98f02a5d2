"""Scans, filters, joins, aggregates, windows, sorts, set operations and CTEs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import dialect
from . import query, table

def revenue() -> Column:
    return F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))


REVENUE_SQL = "CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))"


@query(
    f"""SELECT n.n_name, o.o_orderpriority, count(*) AS n_lines,
            CAST(sum({REVENUE_SQL}) AS DOUBLE) AS revenue
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
        JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
        WHERE o.o_orderdate >= TIMESTAMP '1996-01-01' AND o.o_orderdate < TIMESTAMP '1998-01-01'
        GROUP BY n.n_name, o.o_orderpriority"""
)
def flagship_revenue(spark: SparkSession, d: str) -> DataFrame:
    """A star join with a date range, pruned and pushed to the scans."""
    orders = table(spark, d, "orders").where(
        (F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp"))
        & (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp"))
    )
    named = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return (
        table(spark, d, "lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(named, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("n_name", "o_orderpriority")
        .agg(F.count(F.lit(1)).alias("n_lines"), F.sum(revenue()).cast("double").alias("revenue"))
    )


@query(
    """SELECT l_orderkey, l_linenumber, l_quantity * 2 AS doubled, upper(l_returnflag) AS flag
        FROM lineitem WHERE l_quantity > 45 AND l_discount BETWEEN 0.05 AND 0.07 AND l_shipdate < TIMESTAMP '1998-06-01'"""
)
def scan_filter_project(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "lineitem")
        .where(
            (F.col("l_quantity") > 45)
            & F.col("l_discount").between(0.05, 0.07)
            & (F.col("l_shipdate") < F.lit("1998-06-01").cast("timestamp"))
        )
        .select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 2).alias("doubled"), F.upper("l_returnflag").alias("flag"))
    )


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 42")
def point_get(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").where(F.col("c_custkey") == 42).select("c_custkey", "c_name", "c_acctbal")


@query(
    """SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'
        ORDER BY o_totalprice DESC, o_orderkey LIMIT 25"""
)
def list_where_order_limit(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "orders")
        .where(F.col("o_orderstatus") == "F")
        .orderBy(F.col("o_totalprice").desc(), "o_orderkey")
        .limit(25)
        .select("o_orderkey", "o_totalprice")
    )


@query("SELECT c_custkey, c_name FROM customer WHERE c_name LIKE 'customer%7' AND c_mktsegment <> 'x'")
def filter_like_glob(spark: SparkSession, d: str) -> DataFrame:
    """LIKE ignores the case of ASCII letters; GLOB doesn't."""
    c = table(spark, d, "customer")
    return c.where(dialect.like("c_name", "customer%7")).where(
        ~dialect.glob("c_mktsegment", "[^A-Z]*")
    ).select("c_custkey", "c_name")


filter_like_glob_sql = """SELECT c_custkey, c_name FROM customer
    WHERE lower(c_name) LIKE 'customer%7' AND NOT regexp_matches(c_mktsegment, '^[^A-Z]')"""
query(filter_like_glob_sql)(filter_like_glob)


@query(
    """SELECT p_partkey, p_brand, p_size FROM part
        WHERE (p_size = (SELECT max(p_size) FROM part) AND p_brand = (SELECT min(p_brand) FROM part))
            OR (p_size, p_brand) = (10, 'Brand#12') OR (p_size, p_partkey) < (2, 50)"""
)
def filter_row_values(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    most = p.agg(F.max("p_size").alias("s"), F.min("p_brand").alias("b"))
    pair = F.struct(F.col("p_size").alias("a"), F.col("p_brand").alias("b"))
    listed = F.coalesce((pair == F.struct(F.lit(10).alias("a"), F.lit("Brand#12").alias("b"))), F.lit(False))
    below = F.struct(F.col("p_size").cast("long").alias("a"), F.col("p_partkey").alias("b")) < F.struct(
        F.lit(2).cast("long").alias("a"), F.lit(50).cast("long").alias("b")
    )
    return (
        p.join(F.broadcast(most), (F.col("p_size") == F.col("s")) & (F.col("p_brand") == F.col("b")), "left")
        .where(F.col("s").isNotNull() | listed | below)
        .select("p_partkey", "p_brand", "p_size")
    )


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'O'")
def bound_parameters(spark: SparkSession, d: str) -> DataFrame:
    """Named parameters are bound as values, never spliced into the text."""
    return spark.sql(
        "SELECT o_orderkey, o_custkey FROM {orders} WHERE o_custkey = :customer AND o_orderstatus = :status",
        args={"customer": 7, "status": "O"},
        orders=table(spark, d, "orders"),
    )


# ---- joins ------------------------------------------------------------------


@query("SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal < 0")
def join_inner(spark: SparkSession, d: str) -> DataFrame:
    poor = table(spark, d, "customer").where("c_acctbal < 0").select("c_custkey", "c_name")
    return table(spark, d, "orders").join(poor, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query(
    """SELECT c.c_custkey, count(o.o_orderkey) AS n_orders FROM customer c
        LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 300000 GROUP BY c.c_custkey"""
)
def join_left(spark: SparkSession, d: str) -> DataFrame:
    big = table(spark, d, "orders").where("o_totalprice > 300000")
    return (
        table(spark, d, "customer")
        .join(big, F.col("o_custkey") == F.col("c_custkey"), "left")
        .groupBy("c_custkey")
        .agg(F.count("o_orderkey").alias("n_orders"))
    )


@query(
    """SELECT s.s_suppkey, p.p_partkey FROM supplier s RIGHT JOIN part p ON s.s_suppkey = p.p_partkey"""
)
def join_right(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey")
    p = table(spark, d, "part").select("p_partkey")
    return s.join(p, F.col("s_suppkey") == F.col("p_partkey"), "right")


@query(
    """SELECT s.s_suppkey, p.p_partkey FROM supplier s FULL JOIN part p ON s.s_suppkey = p.p_partkey"""
)
def join_full(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey")
    p = table(spark, d, "part").select("p_partkey")
    return s.join(p, F.col("s_suppkey") == F.col("p_partkey"), "full")


@query(
    """SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o
        WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')"""
)
def join_semi(spark: SparkSession, d: str) -> DataFrame:
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return table(spark, d, "customer").join(urgent, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
def join_anti(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "customer")
        .join(table(spark, d, "orders").where("o_totalprice > 300000"), F.col("o_custkey") == F.col("c_custkey"), "left_anti")
        .select("c_custkey")
    )


@query("SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n")
def join_cross(spark: SparkSession, d: str) -> DataFrame:
    """Two dimension tables whose sizes are fixed by the schema."""
    return table(spark, d, "region").select("r_name").crossJoin(table(spark, d, "nation").select("n_name"))


@query(
    """SELECT a.n_name AS first_name, b.n_name AS second_name FROM nation a JOIN nation b
        ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"""
)
def join_self_theta(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    a, b = n.alias("a"), n.alias("b")
    on = (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))
    return a.join(b, on).select(F.col("a.n_name").alias("first_name"), F.col("b.n_name").alias("second_name"))


@query("SELECT r_regionkey, r_name, n_name FROM region JOIN (SELECT n_regionkey AS r_regionkey, n_name FROM nation) USING (r_regionkey)")
def join_using(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("r_regionkey"), "n_name")
    return table(spark, d, "region").join(n, "r_regionkey")


@query(
    """SELECT e.event_id, CAST(json_extract_string(e.props, '$.k') AS BIGINT) AS k FROM events e
        WHERE json_extract_string(e.props, '$.k') IS NOT NULL"""
)
def join_lateral_json(spark: SparkSession, d: str) -> DataFrame:
    """``FROM events, json_each(events.props)``: one row a member."""
    e = table(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return e.where(F.col("key") == "k").select("event_id", F.col("value").cast("long").alias("k"))


# ---- aggregates -------------------------------------------------------------


@query(
    f"""SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty,
            CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_price,
            CAST(sum({REVENUE_SQL}) AS DOUBLE) AS sum_disc_price,
            round(avg(l_quantity), 6) AS avg_qty, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship, count(*) AS n
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus"""
)
def agg_group(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "lineitem")
        .where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("sum_qty"),
            F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("sum_price"),
            F.sum(revenue()).cast("double").alias("sum_disc_price"),
            F.round(F.avg("l_quantity"), 6).alias("avg_qty"),
            F.min("l_shipdate").alias("first_ship"),
            F.max("l_shipdate").alias("last_ship"),
            F.count(F.lit(1)).alias("n"),
        )
    )


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def agg_having(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where("n > 12")


@query(
    """SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_done,
            count(*) FILTER (WHERE o_totalprice > 200000) AS n_big FROM orders GROUP BY o_orderpriority"""
)
def agg_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("n_done"), F.count_if(F.col("o_totalprice") > 200000).alias("n_big")
    )


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS n_parts, count(DISTINCT l_returnflag) AS n_flags FROM lineitem GROUP BY l_suppkey")
def agg_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.countDistinct("l_partkey").alias("n_parts"), F.countDistinct("l_returnflag").alias("n_flags")
    )


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def agg_group_concat(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    return n.groupBy("n_regionkey").agg(dialect.group_concat("n_name", ", ", order="n_name").alias("names"))


@query(
    """SELECT c_mktsegment, coalesce(sum(CASE WHEN c_acctbal > 1e9 THEN c_acctbal END), 0.0) AS total_rich,
            CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS total_all FROM customer GROUP BY c_mktsegment"""
)
def agg_total(spark: SparkSession, d: str) -> DataFrame:
    """``total`` is 0.0 over no value, where ``sum`` is null."""
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(
        dialect.total(F.when(F.col("c_acctbal") > 1e9, F.col("c_acctbal"))).alias("total_rich"),
        F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("total_all"),
    )


@query(
    """SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS o_orderkey, max(o_totalprice) AS top_price
        FROM orders GROUP BY o_custkey"""
)
def agg_bare_column(spark: SparkSession, d: str) -> DataFrame:
    """A bare column beside ``max`` takes the row of the maximum (ties: the greatest key)."""
    return table(spark, d, "orders").groupBy("o_custkey").agg(
        F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("o_orderkey"), F.max("o_totalprice").alias("top_price")
    )


@query(
    """SELECT n_regionkey, string_agg('"' || n_name || '"', ',' ORDER BY n_name) AS members,
            string_agg('"' || n_name || '":' || n_nationkey, ',' ORDER BY n_name) AS pairs FROM nation GROUP BY n_regionkey"""
)
def agg_json_group(spark: SparkSession, d: str) -> DataFrame:
    """``json_group_array`` and ``json_group_object``, without their brackets."""
    inner = lambda c: F.expr(f"substring({c}, 2, length({c}) - 2)")
    found = table(spark, d, "nation").groupBy("n_regionkey").agg(
        dialect.json_group_array("n_name").alias("a"), dialect.json_group_object("n_name", "n_nationkey").alias("o")
    )
    return found.select("n_regionkey", inner("a").alias("members"), inner("o").alias("pairs"))


@query(
    """SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus) AS g1, grouping(o_orderpriority) AS g2
        FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)"""
)
def agg_rollup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"),
        F.grouping("o_orderstatus").cast("long").alias("g1"),
        F.grouping("o_orderpriority").cast("long").alias("g2"),
    )


# ---- windows ----------------------------------------------------------------

def by_customer() -> WindowSpec:
    return Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")


W_SQL = "PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey"


@query(
    """SELECT o_orderkey, CAST(row_number() OVER w AS INTEGER) AS rn, CAST(rank() OVER p AS INTEGER) AS rk,
            CAST(dense_rank() OVER p AS INTEGER) AS dr, round(percent_rank() OVER p, 9) AS pr, round(cume_dist() OVER p, 9) AS cd,
            CAST(ntile(3) OVER w AS INTEGER) AS nt
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey),
            p AS (PARTITION BY o_custkey ORDER BY o_orderpriority)"""
)
def win_rank_family(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    p = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return table(spark, d, "orders").select(
        "o_orderkey", F.row_number().over(w).alias("rn"), F.rank().over(p).alias("rk"), F.dense_rank().over(p).alias("dr"),
        F.round(F.percent_rank().over(p), 9).alias("pr"), F.round(F.cume_dist().over(p), 9).alias("cd"), F.ntile(3).over(w).alias("nt"),
    )


@query(
    f"""SELECT o_orderkey, lag(o_totalprice) OVER ({W_SQL}) AS before, lead(o_totalprice, 2, -1.0) OVER ({W_SQL}) AS after,
            first_value(o_orderkey) OVER ({W_SQL}) AS first_key,
            last_value(o_orderkey) OVER ({W_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_key,
            nth_value(o_orderkey, 2) OVER ({W_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second_key
        FROM orders"""
)
def win_lag_lead_nth(spark: SparkSession, d: str) -> DataFrame:
    whole = by_customer().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, d, "orders").select(
        "o_orderkey", F.lag("o_totalprice").over(by_customer()).alias("before"),
        F.lead("o_totalprice", 2, -1.0).over(by_customer()).alias("after"),
        F.first("o_orderkey").over(by_customer()).alias("first_key"), F.last("o_orderkey").over(whole).alias("last_key"),
        F.nth_value("o_orderkey", 2).over(whole).alias("second_key"),
    )


@query(
    """SELECT o_orderkey,
            count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS near_rows,
            count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 500 PRECEDING AND CURRENT ROW) AS near_keys
        FROM orders"""
)
def win_frames_rows_range(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, d, "orders").select(
        "o_orderkey", F.count(F.lit(1)).over(w.rowsBetween(-2, 1)).alias("near_rows"),
        F.count(F.lit(1)).over(w.rangeBetween(-500, 0)).alias("near_keys"),
    )


@query(
    """SELECT o_orderkey,
            count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS in_groups,
            count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority
                RANGE BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW) AS others
        FROM orders"""
)
def win_frame_groups_exclude(spark: SparkSession, d: str) -> DataFrame:
    """GROUPS is a range over dense ranks; EXCLUDE CURRENT ROW is the total less the row."""
    orders = table(spark, d, "orders")
    return dialect.groups_frame(
        orders, ["o_custkey"], ["o_orderpriority"], -1, 0, in_groups=F.count(F.lit(1))
    ).select("o_orderkey", "in_groups", (F.count(F.lit(1)).over(Window.partitionBy("o_custkey")) - 1).alias("others"))


@query(
    """SELECT o_orderkey, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)
            OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::BIGINT AS done_so_far FROM orders"""
)
def win_agg_filter(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, d, "orders").select(
        "o_orderkey", F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).over(w).alias("done_so_far")
    )


# ---- sorts, sets, subqueries, CTEs ------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100")
def sort_topk(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "lineitem")
        .orderBy(F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber")
        .limit(100)
        .select("l_orderkey", "l_linenumber", "l_extendedprice")
    )


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40")
def paging(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").orderBy("o_orderkey").offset(40).limit(20).select("o_orderkey", "o_custkey")


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(
        table(spark, d, "supplier").select("s_nationkey")
    ).distinct()


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def set_union_all(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey"))


@query("SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 5000")
def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    rich = table(spark, d, "customer").where("c_acctbal > 5000").select("c_custkey")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("k")).intersect(rich)


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def set_except(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(
        table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey")
    )


@query("SELECT * FROM (VALUES (1, 'one'), (2, 'two'), (3, NULL)) AS v(n, word)")
def values_rows(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql("SELECT * FROM (VALUES (1, 'one'), (2, 'two'), (3, NULL)) AS v(n, word)")


@query(
    """WITH spend AS (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spent FROM orders GROUP BY o_custkey),
        top AS (SELECT * FROM spend WHERE spent > 2000000)
        SELECT c.c_name, t.spent FROM top t JOIN customer c ON c.c_custkey = t.o_custkey"""
)
def cte_plain(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(
        """WITH spend AS (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spent
               FROM {orders} GROUP BY o_custkey),
           top AS (SELECT * FROM spend WHERE spent > 2000000)
           SELECT c.c_name, t.spent FROM top t JOIN {customer} c ON c.c_custkey = t.o_custkey""",
        orders=table(spark, d, "orders"), customer=table(spark, d, "customer"),
    )


@query(
    """WITH RECURSIVE up(part, node, depth) AS (
            SELECT p_partkey, p_partkey, 0 FROM part
            UNION ALL SELECT up.part, p.p_partkey, up.depth + 1 FROM up JOIN part p ON p.p_partkey = up.node // 2
                WHERE up.node > 1 AND up.depth < 20)
        SELECT part, count(*) AS n, max(depth) AS depth FROM up GROUP BY part"""
)
def cte_recursive(spark: SparkSession, d: str) -> DataFrame:
    """Ancestors by halving: the recursion is bounded by its depth.

    Each round joins by a shuffle: a broadcast would send the parts to the driver anew in every round.
    """
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    return spark.sql(
        """WITH RECURSIVE up(part, node, depth) AS (
               SELECT p_partkey, p_partkey, 0 FROM {part}
               UNION ALL SELECT up.part, p.p_partkey, up.depth + 1 FROM up JOIN {part} p ON p.p_partkey = up.node div 2
                   WHERE up.node > 1 AND up.depth < 20)
           SELECT part, count(*) AS n, max(depth) AS depth FROM up GROUP BY part""",
        part=table(spark, d, "part").select("p_partkey").hint("merge"),
    )


@query(
    """SELECT o_orderkey, o_totalprice FROM orders o
        WHERE o_totalprice > (SELECT 1.5 * avg(o2.o_totalprice) FROM orders o2 WHERE o2.o_custkey = o.o_custkey)"""
)
def subq_correlated(spark: SparkSession, d: str) -> DataFrame:
    """Decorrelated by hand: one aggregate, one equi-join."""
    orders = table(spark, d, "orders")
    mean = orders.groupBy(F.col("o_custkey").alias("k")).agg((1.5 * F.avg("o_totalprice")).alias("limit"))
    return orders.join(mean, F.col("o_custkey") == F.col("k")).where("o_totalprice > limit").select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey FROM part WHERE p_retailprice = (SELECT max(p_retailprice) FROM part)")
def subq_scalar(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.join(p.agg(F.max("p_retailprice").alias("top")), F.col("p_retailprice") == F.col("top")).select("p_partkey")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_tax > 0.07)")
def subq_not_in(spark: SparkSession, d: str) -> DataFrame:
    heavy = table(spark, d, "lineitem").where("l_quantity > 49 and l_tax > 0.07").select("l_suppkey")
    return table(spark, d, "supplier").join(heavy, F.col("s_suppkey") == F.col("l_suppkey"), "left_anti").select("s_suppkey")
