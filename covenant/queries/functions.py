"""Scalar functions, exact values, dates and JSON over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dialect, exact, jsons
from ..operators.validate import Table
from ..plans import shape
from ..plans.contract import from_spark
from ..plans.database import Database
from . import query, table


@query(
    """SELECT p_partkey, lower(p_name) AS low, upper(p_brand) AS up, length(p_name) AS n, substr(p_name, 2, 4) AS mid,
            substr(p_name, length(p_name) - 2) AS tail, left(p_name, 1) AS from_zero, instr(p_name, 'a') AS at_a, replace(p_type, ' ', '_') AS t,
            trim(p_name) AS trimmed, '''' || replace(p_name, '''', '''''') || '''' AS quoted, hex(p_brand) AS hexed, unicode(p_name) AS code,
            p_brand || '-' || p_size AS joined
        FROM part"""
)
def fn_string(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        "p_partkey", dialect.lower("p_name").alias("low"), dialect.upper("p_brand").alias("up"), F.char_length("p_name").cast("long").alias("n"),
        dialect.substr("p_name", 2, 4).alias("mid"), dialect.substr("p_name", -3).alias("tail"), dialect.substr("p_name", 0, 2).alias("from_zero"),
        F.instr("p_name", "a").cast("long").alias("at_a"), F.replace("p_type", F.lit(" "), F.lit("_")).alias("t"), F.trim("p_name").alias("trimmed"),
        dialect.quote("p_name").alias("quoted"), F.hex("p_brand").alias("hexed"), dialect.unicode("p_name").alias("code"),
        dialect.concat("p_brand", F.lit("-"), "p_size").alias("joined"),
    )


@query(
    """SELECT c_custkey, abs(c_acctbal) AS a, CAST(sign(c_acctbal) AS INTEGER) AS s, round(c_acctbal, 1) AS r, ceil(c_acctbal) AS c, floor(c_acctbal) AS f,
            trunc(c_acctbal) AS t, round(sqrt(abs(c_acctbal)), 6) AS q, round(log10(c_custkey + 1), 6) AS lg, round(ln(c_custkey + 1), 6) AS n,
            round(pow(c_nationkey, 2), 3) AS p, (c_custkey - 700) % 7 AS m, round(degrees(radians(c_nationkey)), 6) AS d,
            round(sin(c_nationkey) + cos(c_nationkey) + atan2(c_nationkey, 2), 6) AS trig, c_custkey // 7 AS whole,
            CASE WHEN c_nationkey = 0 THEN NULL ELSE c_custkey // c_nationkey END AS guarded
        FROM customer"""
)
def fn_math(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("c_nationkey")
    return table(spark, d, "customer").select(
        "c_custkey", F.abs("c_acctbal").alias("a"), F.signum("c_acctbal").cast("int").alias("s"), F.round("c_acctbal", 1).alias("r"),
        F.ceil("c_acctbal").cast("double").alias("c"), F.floor("c_acctbal").cast("double").alias("f"), dialect.trunc("c_acctbal").alias("t"),
        F.round(dialect.sqrt(F.abs("c_acctbal")), 6).alias("q"), F.round(dialect.log(F.col("c_custkey") + 1), 6).alias("lg"),
        F.round(F.ln(F.col("c_custkey") + 1), 6).alias("n"), F.round(F.pow(n, F.lit(2)), 3).alias("p"), dialect.modulo(F.col("c_custkey") - 700, F.lit(7)).alias("m"),
        F.round(F.degrees(F.radians(n)), 6).alias("d"), F.round(F.sin(n) + F.cos(n) + F.atan2(n, F.lit(2)), 6).alias("trig"),
        dialect.divide("c_custkey", F.lit(7), integral=True).alias("whole"), dialect.divide("c_custkey", n, integral=True).alias("guarded"),
    )


@query(
    """SELECT o_orderkey, CASE WHEN o_totalprice IS NULL OR o_custkey IS NULL THEN NULL ELSE greatest(o_totalprice, o_custkey * 100.0) END AS big,
            least(o_totalprice, o_custkey * 100.0) AS small, nullif(o_orderstatus, 'F') AS open_status,
            coalesce(nullif(o_orderstatus, 'F'), 'done') AS shown, CASE WHEN o_totalprice > 200000 THEN 'big' ELSE 'small' END AS size
        FROM orders"""
)
def fn_conditional(spark: SparkSession, d: str) -> DataFrame:
    hundred = F.col("o_custkey") * 100.0
    return table(spark, d, "orders").select(
        "o_orderkey", dialect.scalar_max("o_totalprice", hundred).alias("big"), dialect.scalar_min("o_totalprice", hundred).alias("small"),
        F.nullif("o_orderstatus", F.lit("F")).alias("open_status"), F.ifnull(F.nullif("o_orderstatus", F.lit("F")), F.lit("done")).alias("shown"),
        F.when(F.col("o_totalprice") > 200000, "big").otherwise("small").alias("size"),
    )


@query(
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate, '%Y/%m') AS ym,
            strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month_start,
            strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH + to_days(CAST(day(o_orderdate) - 1 AS INTEGER)), '%Y-%m-%d') AS next_month,
            strftime(o_orderdate + INTERVAL 36 HOUR, '%Y-%m-%d %H:%M:%S') AS later, CAST(epoch(o_orderdate) AS BIGINT) AS unix,
            round(epoch(o_orderdate) / 86400.0 + 2440587.5, 6) AS jd, CAST(dayofweek(o_orderdate) AS VARCHAR) AS weekday
        FROM orders"""
)
def fn_date(spark: SparkSession, d: str) -> DataFrame:
    at = "o_orderdate"
    return table(spark, d, "orders").select(
        "o_orderkey", dialect.date(at).alias("d"), dialect.strftime("%Y/%m", at).alias("ym"), dialect.date(at, "start of month").alias("month_start"),
        dialect.date(at, "+1 month").alias("next_month"), dialect.datetime(at, "+36 hours").alias("later"), dialect.unixepoch(at).alias("unix"),
        F.round(dialect.julianday(at), 6).alias("jd"), dialect.strftime("%w", at).alias("weekday"),
    )


@query(
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_valid(props) AS ok,
            lower(json_type(props, '$.k')) IN ('ubigint', 'bigint') AS whole, json_extract_string(props, '$.none') AS missing
        FROM events"""
)
def fn_json_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        "event_id", jsons.extract("props", "$.k").cast("long").alias("k"), jsons.valid("props").alias("ok"),
        (jsons.type_of("props", "$.k") == "integer").alias("whole"), jsons.extract("props", "$.none").alias("missing"),
    )


@query(
    """SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || ',"t":"x"}' AS added,
            '{"k":0}' AS replaced, '{}' AS removed, '{"k":' || json_extract_string(props, '$.k') || ',"m":[1]}' AS patched
        FROM events"""
)
def fn_json_edit(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        "event_id", jsons.insert("props", "$.t", "x").alias("added"), jsons.replace("props", "$.k", 0).alias("replaced"),
        jsons.remove("props", "$.k").alias("removed"), jsons.patch("props", {"m": [1]}).alias("patched"),
    )


@query("SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value, 'integer' AS type, '$.k' AS fullkey FROM events")
def fn_json_each(spark: SparkSession, d: str) -> DataFrame:
    return jsons.each(table(spark, d, "events").select("event_id", "props"), "props").select("event_id", "key", "value", "type", "fullkey")


@query(
    """SELECT event_id, '$' AS fullkey, CAST(NULL AS BIGINT) AS parent, 'object' AS type FROM events
        UNION ALL SELECT event_id, '$.k', 0, 'integer' FROM events"""
)
def fn_json_tree(spark: SparkSession, d: str) -> DataFrame:
    return jsons.tree(table(spark, d, "events").select("event_id", "props"), "props").select("event_id", "fullkey", "parent", "type")


# ---- exact values -----------------------------------------------------------


@query(
    """SELECT o_orderkey, row_number() OVER (ORDER BY CAST(o_totalprice AS DECIMAL(18,2)), o_orderkey) AS place FROM orders
        QUALIFY place <= 200"""
)
def val_decimal_order(spark: SparkSession, d: str) -> DataFrame:
    """Prices as decimal text, ordered by value through their keys."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("total"))
    from pyspark.sql import Window

    top = o.orderBy(exact.number_key("total"), "o_orderkey").limit(200)
    place = F.row_number().over(Window.orderBy(exact.number_key("total"), "o_orderkey"))
    return top.select("o_orderkey", place.cast("long").alias("place"))


@query(
    """SELECT o_custkey, rtrim(rtrim(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS VARCHAR), '0'), '.') AS spent
        FROM orders GROUP BY o_custkey"""
)
def agg_dec_sum(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("total"))
    return exact.dec_sum(o, ["o_custkey"], "total", "spent")


@query(
    """WITH o AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(12,2)) AS t FROM orders)
        SELECT o_orderkey, rtrim(rtrim(CAST(t + 0.1 AS VARCHAR), '0'), '.') AS more,
            rtrim(rtrim(CAST(CAST(t AS DECIMAL(18,2)) * CAST(1.05 AS DECIMAL(3,2)) AS VARCHAR), '0'), '.') AS taxed,
            CASE WHEN t < 100000 THEN -1 WHEN t > 100000 THEN 1 ELSE 0 END AS cmp FROM o"""
)
def fn_dec_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(12,2)").cast("string").alias("t"))
    return o.select(
        "o_orderkey", exact.dec_add("t", F.lit("0.1")).alias("more"), exact.dec_mul("t", F.lit("1.05")).alias("taxed"),
        exact.dec_cmp("t", F.lit("1e5")).alias("cmp"),
    )


@query(
    """SELECT o_orderkey, o_orderkey % 24 AS zone FROM orders WHERE o_orderdate + to_hours(CAST(0 AS INTEGER)) >= TIMESTAMP '1998-01-01'
        AND o_orderdate < TIMESTAMP '1998-02-01'"""
)
def val_instant_compare(spark: SparkSession, d: str) -> DataFrame:
    """Each date is written in another offset; comparison is by the instant."""
    zone = (F.col("o_orderkey") % 24).cast("int")
    local = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(hours=zone - 12)
    offset = F.format_string("%s%02d:00", F.when(zone < 12, "-").otherwise("+"), F.abs(zone - 12))
    text = F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), offset)
    low, high = (F.lit(exact.instant_key_of(t)) for t in ("1998-01-01T00:00:00Z", "1998-02-01T02:00:00+02:00"))
    # a filter works out a text or key wherever it is named
    within = exact.once(text, lambda t: exact.once(exact.instant_key(t), lambda key: (key >= low) & (key < high)))
    return table(spark, d, "orders").where(within).select("o_orderkey", (F.col("o_orderkey") % 24).alias("zone"))


@query("SELECT o_orderkey, CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR) AS plain FROM orders")
def fn_normalize_number(spark: SparkSession, d: str) -> DataFrame:
    """``123e0`` and ``123.000`` normalise to 123."""
    whole = F.rint("o_totalprice").cast("long").cast("string")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(whole, F.lit("e0"))).otherwise(F.concat(whole, F.lit(".000")))
    return table(spark, d, "orders").select("o_orderkey", exact.normalized_number(text).alias("plain"))


@query("SELECT doc_id, length(nfc_normalize(text)) AS n FROM documents")
def fn_nfc(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.char_length(exact.nfc("text")).cast("long").alias("n"))


# ---- front end and inference ------------------------------------------------


@query(
    """SELECT o_orderstatus, coalesce(sum(o_totalprice) FILTER (WHERE o_totalprice > 1e9), 0.0) AS t, string_agg(DISTINCT o_orderstatus, ',') AS names,
            CASE WHEN count(*) > 10 THEN 'many' ELSE 'few' END AS size, max(greatest(o_custkey, 50)) AS top
        FROM orders GROUP BY o_orderstatus"""
)
def sql_front_end(spark: SparkSession, d: str) -> DataFrame:
    """A statement of the dialect, run over the state's tables."""
    orders = table(spark, d, "orders")
    db = Database(spark, {"orders": Table(orders, from_spark("orders", orders.schema, ["o_orderkey"]))})
    return db.query(
        """SELECT o_orderstatus, total(CASE WHEN o_totalprice > 1e9 THEN o_totalprice END) AS t, group_concat(DISTINCT o_orderstatus) AS names,
               iif(count(*) > 10, 'many', 'few') AS size, max(max(o_custkey, 50)) AS top
           FROM orders GROUP BY o_orderstatus"""
    )


@query(
    """SELECT count(*) AS n, CASE WHEN bool_and(json_type(props) = 'OBJECT') THEN 'object' ELSE 'json' END AS kind,
            CASE WHEN bool_and(json_type(props, '$.k') IN ('UBIGINT', 'BIGINT')) THEN 'int' ELSE 'number' END AS k_kind FROM events"""
)
def infer_shape(spark: SparkSession, d: str) -> DataFrame:
    """The shape of the events' properties, folded in the partitions."""
    s = shape.of_column(table(spark, d, "events"), "props")
    return spark.createDataFrame([(s.n, s.kind(), s.members["k"].kind())], "n long, kind string, k_kind string")
