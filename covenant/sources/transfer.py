"""Import and export: JSON, JSON lines, CSV and Parquet.

Cells of a text format are typed by the contract and must lose nothing: a cell
that doesn't fit its column makes the transfer fail, with its row, rather than
become null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exact
from ..operators.changes import ChangeRefused
from ..operators.validate import Table
from ..plans.contract import Contract

TEXT = frozenset({"string", "enum", "date", "timestamp", "uuid", "ulid", "decimal", "bytes"})


def _cell(x: Column, kind: str, nullable: bool, name: str) -> Column:
    """A text cell as its column's type; an empty one is null where null is admitted."""
    refuse = lambda: F.raise_error(F.concat(F.lit(f"TYPE_MISMATCH: {name} can't hold "), x))
    if kind in TEXT:
        value = x
    elif kind == "bool":
        value = F.when(x.isin("true", "false"), x.cast("boolean")).when(x.isNotNull(), refuse().cast("boolean"))
    elif kind == "int":
        value = F.when(x.rlike(exact.INTEGER) & x.try_cast("long").isNotNull(), x.try_cast("long")).when(x.isNotNull(), refuse().cast("long"))
    elif kind in ("float", "number"):
        value = F.when(exact.is_number(x), x.try_cast("double")).when(x.isNotNull(), refuse().cast("double"))
    elif kind == "integer":
        value = F.when(x.rlike(exact.INTEGER), x).when(x.isNotNull(), refuse().cast("string"))
    else:
        value = F.when(F.try_parse_json(x).isNotNull(), x).when(x.isNotNull(), refuse().cast("string"))
    if nullable:
        return F.when((x == "") & F.lit(kind not in ("string", "enum")) | x.isNull(), None).otherwise(value)
    return value


def read_csv(spark: SparkSession, path: str, contract: Contract) -> DataFrame:
    """Rows of a CSV file whose header names columns; all cells are read as text first."""
    raw = spark.read.option("header", True).option("inferSchema", False).option("escape", '"').option("multiLine", True).csv(path)
    unknown = [c for c in raw.columns if not contract.has(c)]
    if unknown:
        raise ChangeRefused("UNKNOWN_COLUMN", f"{contract.table} has no column {unknown[0]!r}")
    cells = [_cell(F.col(f"`{c}`"), contract.column(c).kind, contract.column(c).nullable, c).cast(contract.column(c).spark_type()).alias(c) for c in raw.columns]
    return raw.select(*cells)


def read_json(spark: SparkSession, path: str, contract: Contract, lines: bool = False) -> DataFrame:
    """Rows of a JSON array or object, or of JSON lines (blank lines skipped).

    Members are taken from the raw text of each object, so exact types keep their
    digits; something that is no object is refused.
    """
    if lines:
        texts = spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("_text"))
    else:
        whole = spark.read.text(path, wholetext=True)
        as_array = F.when(F.ltrim("value").startswith("["), F.col("value")).otherwise(F.concat(F.lit("["), F.col("value"), F.lit("]")))
        elements = F.from_json(as_array, "array<string>")
        bad = F.raise_error(F.lit("INVALID_JSON: the file is no JSON array or object")).cast("array<string>")
        texts = whole.select(F.explode(F.coalesce(elements, bad)).alias("_text"))
    refuse = F.raise_error(F.concat(F.lit("ROW_ROOT_NOT_OBJECT: "), F.col("_text"))).cast("array<string>")
    checked = texts.withColumn("_present", F.coalesce(F.json_object_keys("_text"), refuse))
    from .folder import _member

    unknown = F.array_except("_present", F.array(*(F.lit(c.name) for c in contract.columns)))
    guarded = checked.withColumn(
        "_text", F.when(F.size(unknown) > 0, F.raise_error(F.concat(F.lit("UNKNOWN_COLUMN: "), F.get(unknown, F.lit(0)))).cast("string")).otherwise(F.col("_text"))
    )
    return guarded.select(*(_member(c).alias(c.name) for c in contract.columns))


def _chosen(t: Table, where: Column | None, order: list | None) -> DataFrame:
    rows = t.rows.select(*(f"`{c}`" for c in t.rows.columns if not c.startswith("_")))
    if where is not None:
        rows = rows.where(where)
    return rows.orderBy(*order) if order else rows


def export(t: Table, path: str, kind: str = "jsonl", where: Column | None = None, order: list | None = None) -> None:
    """Writes a table; an existing target is never replaced."""
    rows = _chosen(t, where, order)
    if kind == "parquet":
        exactly(t, rows).write.mode("errorifexists").option("compression", "snappy").parquet(path)
    elif kind == "csv":
        flat = rows.select(*(F.to_json(f"`{f.name}`").alias(f.name) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f"`{f.name}`") for f in rows.schema))
        flat.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)
    elif kind in ("jsonl", "json"):
        rows.write.mode("errorifexists").option("ignoreNullFields", False).json(path)
    else:
        raise ValueError(f"can't write {kind!r}")


#: Integers beyond this lose digits as doubles.
SAFE = 1 << 53


def exactly(t: Table, rows: DataFrame) -> DataFrame:
    """Columns as Parquet holds them, refusing what a double would round.

    Integers are 64-bit, numbers are doubles, booleans are booleans, all else text.
    """
    out = []
    for f in rows.schema:
        kind = t.contract.column(f.name).kind if t.contract.has(f.name) else "string"
        x = F.col(f"`{f.name}`")
        if kind in ("float", "number") and f.dataType.typeName() == "string":
            as_double = x.try_cast("double")
            same = exact.number_key(as_double.cast("string")) == exact.number_key(x)
            refuse = F.raise_error(F.concat(F.lit(f"TYPE_MISMATCH: a double can't hold {f.name} "), x)).cast("double")
            out.append(F.when(x.isNull() | same, as_double).otherwise(refuse).alias(f.name))
        elif kind in ("array", "object", "json") and f.dataType.typeName() != "string":
            out.append(F.to_json(x).alias(f.name))
        else:
            out.append(x)
    return rows.select(*out)


def inexact(t: Table, column: str) -> DataFrame:
    """Rows whose integer a double can't hold exactly."""
    x = F.col(column)
    return t.rows.where((F.abs(x) > SAFE) & (x.cast("double").cast("decimal(38,0)") != x.cast("decimal(38,0)")))
