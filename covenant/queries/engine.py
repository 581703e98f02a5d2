"""Queries through ``Database``: the dialect's SQL over contracts with exact types, and judged changes.

Prices are decimals written with varying zeros, and moments are written in varying
offsets, so that only comparison by value gives the right rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes
from ..operators.changes import ChangeRefused
from ..operators.validate import Table
from ..plans import rowtext
from ..plans.contract import decode
from ..plans.database import Database
from . import ORACLES, QUERIES, query, table

SALES = {
    "type": "object",
    "properties": {
        "id": {"type": "integer", "x-rel-type": "int"}, "buyer": {"type": "integer", "x-rel-type": "int"}, "price": {"type": "string", "x-rel-type": "decimal"},
        "placed": {"type": "string", "format": "date-time"}, "urgency": {"type": "string", "minLength": 1}, "status": {"enum": ["F", "O", "P"], "type": "string"},
        "remark": {"type": ["string", "null"]},
    },
    "required": ["id", "buyer", "price", "placed", "urgency"],
    "x-rel": {"table": "sales", "identity": {"source": "body", "columns": ["id"], "naming": {"rule": "percent"}}, "foreignKeys": [{"from": ["buyer"], "to": {"table": "buyers"}}]},
}
BUYERS = {
    "type": "object",
    "properties": {"id": {"type": "integer", "x-rel-type": "int"}, "label": {"type": "string"}, "segment": {"type": "string"}},
    "required": ["id", "label", "segment"],
    "x-rel": {"table": "buyers", "identity": {"source": "body", "columns": ["id"], "naming": {"rule": "percent"}}},
}
CLICKS = {
    "type": "object",
    "properties": {"id": {"type": "integer", "x-rel-type": "int"}, "person": {"type": "integer", "x-rel-type": "int"}, "kind": {"type": "string"}, "at": {"type": "string"}, "props": {"type": "string"}},
    "required": ["id", "person", "kind", "at", "props"],
    "x-rel": {"table": "clicks", "identity": {"source": "body", "columns": ["id"], "naming": {"rule": "percent"}}},
}


def shop(spark: SparkSession, d: str, plain: bool = False) -> Database:
    """Orders, customers and events under contracts; ``plain`` writes prices in their shortest form."""
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    short = F.regexp_replace(F.regexp_replace(price, "0+$", ""), r"\.$", "")
    price = short if plain else F.when(F.col("o_orderkey") % 3 == 0, F.concat(price, F.lit("0"))).when(F.col("o_orderkey") % 3 == 1, short).otherwise(price)
    east = F.concat(F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
    placed = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(east)
    sales = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("buyer"), price.alias("price"), placed.alias("placed"),
        F.col("o_orderpriority").alias("urgency"), F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit("gift")).alias("remark"),
    )
    buyers = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label"), F.col("c_mktsegment").alias("segment"))
    clicks = table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("person"), F.col("event_type").alias("kind"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "props",
    )
    return Database(spark, {n: Table(df, decode(c)) for n, df, c in (("sales", sales, SALES), ("buyers", buyers, BUYERS), ("clicks", clicks, CLICKS))})


#: What the tables are in plain SQL.
HEAD = """WITH sales AS (
    SELECT o_orderkey AS id, o_custkey AS buyer, CAST(o_totalprice AS DECIMAL(18,2)) AS price, o_orderdate AS placed, o_orderpriority AS urgency,
        o_orderstatus AS status, CASE WHEN o_orderkey % 5 = 0 THEN 'gift' END AS remark FROM orders
), buyers AS (SELECT c_custkey AS id, c_name AS label, c_mktsegment AS segment FROM customer),
clicks AS (SELECT event_id AS id, user_id AS person, event_type AS kind, ts AS moment, props, value FROM events) """

# name: the dialect's SQL, the same in plain SQL, parameters
STATEMENTS: dict[str, tuple[str, str, list | dict | None]] = {
    "sql_exact_between": ("SELECT id FROM sales WHERE price BETWEEN '20000.5' AND '60000.00'", "SELECT id FROM sales WHERE price BETWEEN 20000.5 AND 60000", None),
    "sql_exact_in": ("SELECT id FROM sales WHERE price IN (SELECT price FROM sales WHERE buyer < 20)", "SELECT id FROM sales WHERE price IN (SELECT price FROM sales WHERE buyer < 20)", None),
    "sql_exact_extremes": (
        "SELECT buyer, max(price) + 0 AS top, min(price) + 0 AS low, count(DISTINCT price) AS n FROM sales GROUP BY buyer",
        "SELECT buyer, CAST(max(price) AS DOUBLE) AS top, CAST(min(price) AS DOUBLE) AS low, count(DISTINCT price) AS n FROM sales GROUP BY buyer", None,
    ),
    "sql_exact_group": (
        "SELECT n, count(*) AS groups FROM (SELECT price, count(*) AS n FROM sales GROUP BY price) AS g GROUP BY n",
        "SELECT n, count(*) AS groups FROM (SELECT price, count(*) AS n FROM sales GROUP BY price) AS g GROUP BY n", None,
    ),
    "sql_exact_distinct": ("SELECT count(*) AS n FROM (SELECT DISTINCT price FROM sales) AS p", "SELECT count(DISTINCT price) AS n FROM sales", None),
    "sql_exact_rank": (
        "SELECT id, rank() OVER (PARTITION BY status ORDER BY price DESC) AS place FROM sales",
        "SELECT id, rank() OVER (PARTITION BY status ORDER BY price DESC) AS place FROM sales", None,
    ),
    "sql_exact_join": (
        "SELECT a.id AS a, b.id AS b FROM sales a JOIN sales b ON a.price = b.price AND a.id < b.id",
        "SELECT a.id AS a, b.id AS b FROM sales a JOIN sales b ON a.price = b.price AND a.id < b.id", None,
    ),
    "sql_exact_arithmetic": (
        "SELECT id, round(price * 2 + 1, 2) AS twice FROM sales WHERE price + 0 > 100000 AND price - 1 < 150000",
        "SELECT id, round(CAST(price AS DOUBLE) * 2 + 1, 2) AS twice FROM sales WHERE price > 100000 AND price - 1 < 150000", None,
    ),
    "sql_exact_parameters": (
        "SELECT id FROM sales WHERE price >= ? AND (price < ? OR buyer = ?)",
        "SELECT id FROM sales WHERE price >= 50000 AND (price < 70000.25 OR buyer = 7)", ["50000.000", "70000.25", 7],
    ),
    "sql_named_parameters": ("SELECT id FROM sales WHERE price < :top AND status = :s", "SELECT id FROM sales WHERE price < 9000.1 AND status = 'O'", {"top": "9000.10", "s": "O"}),
    "sql_instants": (
        "SELECT id, placed < '1996-06-01T02:00:00+02:00' AS early FROM sales WHERE placed >= '1995-01-01T00:00:00Z'",
        "SELECT id, placed < TIMESTAMP '1996-06-01' AS early FROM sales WHERE placed >= TIMESTAMP '1995-01-01'", None,
    ),
    "sql_instant_groups": (
        "SELECT n, count(*) AS days FROM (SELECT placed, count(*) AS n FROM sales GROUP BY placed) AS g GROUP BY n",
        "SELECT n, count(*) AS days FROM (SELECT placed, count(*) AS n FROM sales GROUP BY placed) AS g GROUP BY n", None,
    ),
    "sql_dec_functions": (
        "SELECT buyer, dec_sum(price) + 0 AS total, dec_cmp(dec_sum(price), '500000') AS side, dec_add(count(*), '0.50') AS half FROM sales GROUP BY buyer",
        """SELECT buyer, CAST(sum(price) AS DOUBLE) AS total, CAST(sign(sum(price) - 500000) AS INTEGER) AS side, CAST(count(*) + 0.5 AS VARCHAR) AS half
           FROM sales GROUP BY buyer""", None,
    ),
    "sql_dec_row": (
        "SELECT id, dec_mul(dec_sub(price, '0.01'), '2') + 0 AS v FROM sales WHERE id < 500",
        "SELECT id, CAST((price - 0.01) * 2 AS DOUBLE) AS v FROM sales WHERE id < 500", None,
    ),
    "sql_like": (
        "SELECT id FROM buyers WHERE label LIKE 'CUSTOMER#%7' OR segment LIKE 'auto%' OR segment NOT LIKE '%E%'",
        "SELECT id FROM buyers WHERE label ILIKE 'CUSTOMER#%7' OR segment ILIKE 'auto%' OR segment NOT ILIKE '%E%'", None,
    ),
    "sql_glob": ("SELECT id FROM buyers WHERE label GLOB 'Customer#*[13]' AND segment GLOB '[A-F]*'", "SELECT id FROM buyers WHERE label GLOB 'Customer#*[13]' AND segment GLOB '[A-F]*'", None),
    "sql_division": (
        "SELECT id, id / 7 AS q, id % 7 AS r, -id / 4 AS n, id / (id % 3) AS z, id / 2.0 AS f FROM sales",
        "SELECT id, id // 7 AS q, id % 7 AS r, -(id // 4) AS n, CASE WHEN id % 3 <> 0 THEN id // (id % 3) END AS z, CAST(id / 2.0 AS DOUBLE) AS f FROM sales", None,
    ),
    "sql_substr": (
        "SELECT id, substr(label, 0, 3) AS a, substr(label, -4) AS b, substr(label, 3, -2) AS c, instr(label, '#') AS d, length(label) AS e FROM buyers",
        "SELECT id, label[1:2] AS a, right(label, 4) AS b, label[1:2] AS c, instr(label, '#') AS d, length(label) AS e FROM buyers", None,
    ),
    "sql_text_functions": (
        "SELECT id, upper(label) AS u, lower(segment) AS l, trim('  x ' || id || ' ') AS t, replace(label, '#', '-') AS r, quote(segment) AS q, hex(segment) AS h, unicode(segment) AS c FROM buyers",
        """SELECT id, upper(label) AS u, lower(segment) AS l, 'x ' || id AS t, replace(label, '#', '-') AS r, '''' || segment || '''' AS q,
            hex(encode(segment)) AS h, unicode(segment) AS c FROM buyers""", None,
    ),
    "sql_typeof": (
        "SELECT DISTINCT typeof(id) AS a, typeof(price) AS b, typeof(remark) AS c, typeof(1.5) AS d, typeof(x'00') AS e FROM sales",
        "SELECT DISTINCT 'integer' AS a, 'text' AS b, CASE WHEN remark IS NULL THEN 'null' ELSE 'text' END AS c, 'real' AS d, 'blob' AS e FROM sales", None,
    ),
    "sql_conditions": (
        "SELECT id, iif(remark IS NULL, 'none', remark) AS a, coalesce(remark, status, '?') AS b, nullif(status, 'F') AS c, ifnull(remark, '-') AS d, max(id, buyer, 40) AS e, min(id, NULL) AS f FROM sales",
        "SELECT id, coalesce(remark, 'none') AS a, coalesce(remark, status, '?') AS b, nullif(status, 'F') AS c, coalesce(remark, '-') AS d, greatest(id, buyer, 40) AS e, CAST(NULL AS BIGINT) AS f FROM sales", None,
    ),
    "sql_json_read": (
        "SELECT id, props ->> '$.k' AS k, json_type(props, '$.k') AS t, json_valid(props) AS v, json_array_length('[1,2]') AS n FROM clicks WHERE json_extract(props, '$.k') > 50",
        "SELECT id, props ->> '$.k' AS k, 'integer' AS t, TRUE AS v, 2 AS n FROM clicks WHERE CAST(props ->> '$.k' AS BIGINT) > 50", None,
    ),
    "sql_json_edit": (
        "SELECT id, json_set(props, '$.k', 1, '$.n', json('[]')) AS a, json_remove(props, '$.k') AS b, json_patch(props, '{\"z\":true}') AS c, json_object('id', id) AS d, json_array(id, kind) AS e FROM clicks",
        """SELECT id, '{"k":1,"n":[]}' AS a, '{}' AS b, '{"k":' || (props ->> '$.k') || ',"z":true}' AS c, '{"id":' || id || '}' AS d,
            '[' || id || ',"' || kind || '"]' AS e FROM clicks""", None,
    ),
    "sql_json_each": (
        "SELECT c.id, j.key AS name, j.value AS v, j.type AS t FROM clicks c, json_each(c.props) j",
        "SELECT id, 'k' AS name, props ->> '$.k' AS v, 'integer' AS t FROM clicks", None,
    ),
    "sql_json_tree": ("SELECT c.id, t.fullkey AS f, t.type AS t FROM clicks c, json_tree(c.props) t", "SELECT id, unnest(['$', '$.k']) AS f, unnest(['object', 'integer']) AS t FROM clicks", None),
    "sql_dates": (
        "SELECT id, strftime('%Y-%m', at) AS m, date(at, 'start of month', '+1 month', '-1 day') AS e, time(at) AS t, datetime(at, '+90 minutes') AS d, unixepoch(at) AS u, strftime('%w', at) AS w FROM clicks",
        """SELECT id, strftime(moment, '%Y-%m') AS m, strftime(last_day(moment), '%Y-%m-%d') AS e, strftime(moment, '%H:%M:%S') AS t,
            strftime(date_trunc('second', moment) + INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') AS d, CAST(floor(epoch(moment)) AS BIGINT) AS u,
            CAST(dayofweek(moment) AS VARCHAR) AS w FROM clicks""", None,
    ),
    "sql_julianday": ("SELECT id, round(julianday(at), 4) AS j FROM clicks", "SELECT id, round(floor(epoch(moment)) / 86400 + 2440587.5, 4) AS j FROM clicks", None),
    "sql_bare_columns": (
        "SELECT buyer, id, urgency, max(id) AS top FROM sales GROUP BY buyer",
        "SELECT buyer, max(id) AS id, arg_max(urgency, id) AS urgency, max(id) AS top FROM sales GROUP BY buyer", None,
    ),
    "sql_aggregates": (
        "SELECT status, count(*) AS n, count(remark) AS gifts, total(id) AS t, sum(buyer) AS s, count(*) FILTER (WHERE price > 100000) AS dear FROM sales GROUP BY status HAVING n > 1",
        "SELECT status, count(*) AS n, count(remark) AS gifts, CAST(sum(id) AS DOUBLE) AS t, CAST(sum(buyer) AS BIGINT) AS s, count(*) FILTER (WHERE price > 100000) AS dear FROM sales GROUP BY status HAVING count(*) > 1", None,
    ),
    "sql_group_concat": (
        "SELECT person, group_concat(kind, '|' ORDER BY id) AS kinds FROM clicks WHERE person < 30 GROUP BY person",
        "SELECT person, string_agg(kind, '|' ORDER BY id) AS kinds FROM clicks WHERE person < 30 GROUP BY person", None,
    ),
    "sql_natural_join": (
        "SELECT label, segment, n FROM buyers NATURAL JOIN (SELECT buyer AS id, count(*) AS n FROM sales GROUP BY buyer) AS c",
        "SELECT label, segment, n FROM buyers NATURAL JOIN (SELECT buyer AS id, count(*) AS n FROM sales GROUP BY buyer) AS c", None,
    ),
    "sql_exists": (
        "SELECT id FROM buyers b WHERE EXISTS (SELECT 1 FROM sales s WHERE s.buyer = b.id AND s.price > '150000') AND id NOT IN (SELECT buyer FROM sales WHERE status = 'P')",
        "SELECT id FROM buyers b WHERE EXISTS (SELECT 1 FROM sales s WHERE s.buyer = b.id AND s.price > 150000) AND id NOT IN (SELECT buyer FROM sales WHERE status = 'P')", None,
    ),
    "sql_with": (
        "WITH top AS (SELECT buyer, max(price) AS best FROM sales GROUP BY buyer), r AS (SELECT buyer FROM top WHERE best > '120000.0') SELECT count(*) AS n FROM r",
        "SELECT count(*) AS n FROM (SELECT buyer FROM sales GROUP BY buyer HAVING max(price) > 120000)", None,
    ),
    "sql_set_operations": (
        "SELECT buyer FROM sales WHERE status = 'F' EXCEPT SELECT id FROM buyers WHERE segment LIKE 'b%' UNION SELECT -1",
        "(SELECT buyer FROM sales WHERE status = 'F' EXCEPT SELECT id FROM buyers WHERE segment ILIKE 'b%') UNION SELECT -1", None,
    ),
    "sql_offset": ("SELECT id FROM sales ORDER BY price DESC, id LIMIT 50 OFFSET 25", "SELECT id FROM sales ORDER BY price DESC, id LIMIT 50 OFFSET 25", None),
    "sql_math": (
        "SELECT id, abs(-id) AS a, round(id / 3.0, 1) AS r, sign(id - 50) AS s, floor(id / 2.0) AS f, sqrt(-1.0) AS q, round(log(100.0), 6) AS l, round(log(2, 8), 6) AS b, trunc(-2.7) AS t, mod(id, 5) AS m FROM buyers",
        """SELECT id, id AS a, CAST(round(id / 3.0, 1) AS DOUBLE) AS r, CAST(sign(id - 50) AS INTEGER) AS s, CAST(floor(id / 2.0) AS DOUBLE) AS f, CAST(NULL AS DOUBLE) AS q, CAST(2 AS DOUBLE) AS l, CAST(3 AS DOUBLE) AS b, CAST(-2 AS DOUBLE) AS t,
            CAST(id % 5 AS DOUBLE) AS m FROM buyers""", None,
    ),
}


def _registered(name: str, sql: str, plain: str, args: list | dict | None) -> None:
    QUERIES[name] = lambda spark, d: shop(spark, d).query(sql, args)
    recursive = plain.lstrip().upper().startswith("WITH")
    ORACLES[name] = plain if recursive else HEAD + plain


for _name, (_sql, _plain, _args) in STATEMENTS.items():
    _registered(_name, _sql, _plain, _args)


# ---- changes ----------------------------------------------------------------

#: Rows a change spoils, each kind on rows of its own.
SPOILS = {
    "short": ("urgency", "id % 11 = 1", "''"),
    "number": ("price", "id % 11 = 2", "'twelve'"),
    "moment": ("placed", "id % 11 = 3", "'no time at all'"),
    "missing": ("buyer", "id % 11 = 4", "CAST(NULL AS BIGINT)"),
    "listed": ("status", "id % 11 = 5", "'X'"),
}


@query(
    """SELECT o_orderkey AS id, CASE o_orderkey % 11 WHEN 1 THEN '/urgency' WHEN 2 THEN '/price' WHEN 3 THEN '/placed' WHEN 5 THEN '/status' ELSE '' END AS pointer,
            CASE o_orderkey % 11 WHEN 4 THEN 'ROW_MISSING_FIELD' ELSE 'SCHEMA_VIOLATION' END AS code
        FROM orders WHERE o_orderkey % 11 BETWEEN 1 AND 5"""
)
def val_change_rows(spark: SparkSession, d: str) -> DataFrame:
    """What changed rows break of their schema: only rows that a change wrote are looked at."""
    t = shop(spark, d, plain=True).table("sales")
    after = t.rows
    for column, where, value in SPOILS.values():
        after = after.withColumn(column, F.when(F.expr(where), F.expr(value)).otherwise(F.col(column)))
    moved = changes.difference(t, Table(after, t.contract))
    found = rowtext.findings(t, rowtext.image(t, moved, "after"))
    number = F.regexp_extract("path", r"(\d+)\.json$", 1).cast("long")
    return found.select(number.alias("id"), F.when(F.col("code") == "ROW_MISSING_FIELD", "").otherwise(F.col("pointer")).alias("pointer"), "code")


@query(
    """SELECT status, count(*) AS n, CASE status WHEN 'F' THEN 'SCHEMA_VIOLATION' WHEN 'O' THEN 'ROW_MISSING_FIELD' ELSE 'accepted' END AS outcome
        FROM (SELECT o_orderstatus AS status FROM orders) GROUP BY status"""
)
def val_change_refused(spark: SparkSession, d: str) -> DataFrame:
    """Statements that spoil rows are refused with the finding's code; one that doesn't is accepted."""
    db = shop(spark, d, plain=True)
    statements = {"F": "UPDATE sales SET urgency = '' WHERE status = 'F'", "O": "UPDATE sales SET buyer = NULL WHERE status = 'O'", "P": "UPDATE sales SET remark = 'seen' WHERE status = 'P'"}
    outcomes = []
    for status, sql in statements.items():
        try:
            db.execute(sql, dry_run=True)
            outcomes.append((status, "accepted"))
        except ChangeRefused as e:
            outcomes.append((status, e.code))
    table_ = spark.createDataFrame(outcomes, "status string, outcome string")
    return db.table("sales").rows.groupBy("status").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(table_), "status")


@query(
    """SELECT o_orderkey AS id FROM orders WHERE CAST(o_totalprice AS DECIMAL(18,2)) >= 140000
        UNION ALL SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND CAST(o_totalprice AS DECIMAL(18,2)) < 140000"""
)
def val_check_exact(spark: SparkSession, d: str) -> DataFrame:
    """Checks over decimals and instants compare by value."""
    from dataclasses import replace

    from ..operators import validate
    from ..plans.contract import Rule

    t = shop(spark, d).table("sales")
    t = Table(t.rows, replace(t.contract, checks=(Rule("modest", "price < '140000.00'"), Rule("before", "placed < '1998-01-01T02:00:00+02:00' OR price >= 140000"))))
    found = validate.judge(spark, {"sales": t}, only={"sales"}).where("code = 'CHECK_VIOLATION'")
    return found.select(F.regexp_extract("path", r"(\d+)\.json$", 1).cast("long").alias("id"))


@query("SELECT o_orderkey AS id, o_orderpriority || '!' AS urgency FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def dml_with(spark: SparkSession, d: str) -> DataFrame:
    """A change with a common table expression."""
    db = shop(spark, d, plain=True)
    sql = "WITH m AS (SELECT id FROM buyers WHERE segment = 'MACHINERY') UPDATE sales SET urgency = urgency || '!' WHERE buyer IN (SELECT id FROM m) RETURNING id, urgency"
    return db.execute(sql, dry_run=True)[0]
