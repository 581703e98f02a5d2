"""A folder of JSON files as tables: a directory a table, a file a row.

Files are listed and read by Spark, one partition for many files, so any store
that Spark reaches will do. What is read is the text of each row; typed columns
are projections of it by the contract.
"""

from __future__ import annotations

import json

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.validate import Table
from ..plans import jsonschema, shape
from ..plans.contract import Column, Contract, decode
from . import naming

SKIPPED = frozenset({"schema"})


def discover(spark: SparkSession, root: str) -> list[str]:
    """Names of the child directories that hold JSON files, sorted."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for status in fs.listStatus(path(root)):
        name = status.getPath().getName()
        if status.isDirectory() and not name.startswith(".") and name not in SKIPPED:
            if any(f.isFile() and f.getPath().getName().endswith(".json") for f in fs.listStatus(status.getPath())):
                found.append(name)
    return sorted(found)


def scan(spark: SparkSession, root: str, table: str) -> DataFrame:
    """``(_path, _name, _text, _modified, _size)`` of a table's files."""
    files = spark.read.option("pathGlobFilter", "[!.]*.json").text(f"{root.rstrip('/')}/{table}", wholetext=True)
    at = F.col("_metadata.file_name")
    name = F.url_decode(F.replace(at, F.lit("+"), F.lit("%2B")))
    return files.select(
        F.concat(F.lit(f"{table}/"), name).alias("_path"), F.regexp_replace(name, r"\.json$", "").alias("_name"),
        F.regexp_replace("value", "^\ufeff", "").alias("_text"), F.col("_metadata.file_modification_time").alias("_modified"),
        F.col("_metadata.file_size").alias("_size"),
    )


def changed(now: DataFrame, before: DataFrame) -> DataFrame:
    """Files whose time or size moved since an earlier listing, and new ones."""
    same = ["_path", "_modified", "_size"]
    return now.join(before.select(*same), same, "left_anti")


def contracts(spark: SparkSession, root: str) -> dict[str, Contract]:
    """The contracts in ``schema/``, by table."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    at = path(f"{root.rstrip('/')}/schema")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return {}
    rows = spark.read.option("pathGlobFilter", "*.json").text(at.toString(), wholetext=True).collect()  # a file a table
    found = [decode(json.loads(r["value"])) for r in rows]
    return {c.table: c for c in found}


def typed(scanned: DataFrame, contract: Contract) -> DataFrame:
    """The contract's columns, ``_path`` and ``_present``, from the texts.

    Exact types stay as the text they were written with. A member that is left out
    reads as its default; ``_present`` lists the members a row does have.
    """
    present = F.coalesce(F.json_object_keys("_text"), F.array().cast("array<string>"))
    columns: list[SparkColumn] = []
    for c in contract.columns:
        if contract.identity == "filename" and c.name == contract.key[0]:
            columns.append(F.col("_name").cast(c.spark_type()).alias(c.name))
            continue
        columns.append(_member(c).alias(c.name))
    return scanned.select("_path", "_text", present.alias("_present")).withColumn("_name", F.regexp_extract("_path", r"([^/]*)\.json$", 1)).select(*columns, "_path", "_present")


def _member(c: Column) -> SparkColumn:
    raw = F.get_json_object("_text", "$['" + c.name.replace("'", "\\'") + "']")
    kind = c.spark_type()
    if isinstance(kind, (T.ArrayType, T.StructType)):
        value = F.from_json(raw, kind)
    elif kind == T.StringType():
        value = raw
    elif kind == T.BooleanType():
        value = raw.try_cast("boolean")
    else:
        value = raw.try_cast(kind)
    if c.has_default and c.default is not None:
        there = F.array_contains("_present", c.name)
        default = F.lit(json.dumps(c.default) if isinstance(c.default, (list, dict)) else c.default)
        default = F.from_json(default, kind) if isinstance(kind, (T.ArrayType, T.StructType)) else default.cast(kind)
        value = F.when(there, value).otherwise(default)
    return value


def table(spark: SparkSession, root: str, contract: Contract) -> Table:
    return Table(typed(scan(spark, root, contract.table), contract), contract)


def judged(spark: SparkSession, root: str, contract: Contract) -> DataFrame:
    """Row findings: what a file's text or its name breaks.

    In a table whose contract is inferred, a row beyond it is a warning.
    """
    scanned = scan(spark, root, contract.table)
    found = jsonschema.judge_rows(scanned, contract.document or {})
    shape_codes = ["SCHEMA_VIOLATION", "TYPE_MISMATCH", "ROW_MISSING_FIELD", "ROW_UNKNOWN_FIELD", "NOT_NULL_VIOLATION"]
    beyond = F.lit(contract.inferred) & F.col("code").isin(shape_codes)
    rows = found.select(
        F.when(beyond, "warning").otherwise("error").alias("severity"), F.when(beyond, "CONTRACT_EXCEEDED").otherwise(F.col("code")).alias("code"),
        F.lit(contract.table).alias("table"), "path", "pointer", F.lit(contract.table).alias("constraint"), F.lit(None).cast("string").alias("observed"), "message",
    )
    if contract.identity == "filename":
        return rows
    rule, keys = contract.naming, list(contract.key)

    @F.udf(T.StringType())
    def spelled(*values: object) -> str | None:
        try:
            return naming.spell(list(values), rule) if all(v is not None for v in values) else None
        except naming.NameError_:
            return None

    named = typed(scanned, contract).withColumn("_want", spelled(*(F.col(f"`{k}`").cast("string") for k in keys)))
    have = F.regexp_extract("_path", r"([^/]*)\.json$", 1)
    wrong = named.where(F.col("_want").isNotNull() & (F.col("_want") != have))
    mismatch = wrong.select(
        F.lit("error").alias("severity"), F.lit("IDENTITY_MISMATCH").alias("code"), F.lit(contract.table).alias("table"), F.col("_path").alias("path"),
        F.lit("").alias("pointer"), F.lit(contract.table).alias("constraint"), F.col("_want").alias("observed"), F.lit("the name isn't the one the key spells").alias("message"),
    )
    return rows.unionAll(mismatch)


def infer(spark: SparkSession, root: str, name: str) -> dict:
    """An inferred contract's document for a bare table."""
    scanned = scan(spark, root, name)
    found = shape.of_column(scanned, "_text")
    # of the columns that could be the key, those that spell every file's name
    fits = [k for k, m in found.members.items() if m.n == found.objects and not m.nulls and m.kind() in ("string", "int", "integer", "uuid", "ulid", "date", "timestamp")]
    if fits:
        raw = lambda k: F.get_json_object("_text", "$['" + k + "']")
        held = scanned.agg(*(F.bool_and(raw(k) == F.col("_name")).alias(str(i)) for i, k in enumerate(fits))).first()
        fits = [k for i, k in enumerate(fits) if held[str(i)]]
    singular = name[:-3] + "y" if name.endswith("ies") else name[:-1] if name.endswith("s") else name
    key = next((k for k in ("id", f"{singular}_id") if k in fits), fits[0] if fits else None)
    return shape.contract_document(name, found, key)


def write_rows(t: Table, folder: str) -> None:
    """A table as JSON lines in a directory of its own; never over an existing one."""
    t.rows.select(*(f"`{c}`" for c in t.rows.columns if not c.startswith("_"))).write.mode("errorifexists").json(f"{folder.rstrip('/')}/{t.name}")
