"""Rows of a state as the texts they would be written as, and what those break."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exact
from ..operators import changes
from ..operators.validate import Table
from . import contract as contracts
from . import jsonschema

NUMBERS = {"int", "integer", "float", "number"}
#: Codes of rows that go beyond their contract.
SHAPE_CODES = ("SCHEMA_VIOLATION", "TYPE_MISMATCH", "ROW_MISSING_FIELD", "ROW_UNKNOWN_FIELD", "NOT_NULL_VIOLATION")


def member(c: contracts.Column, x: Column, kind: T.DataType) -> Column:
    """A value's JSON text; null for null."""
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(x)
    quoted = F.when(x.isNotNull(), F.regexp_replace(F.to_json(F.array(x.cast("string"))), r"^\[|\]$", ""))
    if not isinstance(kind, T.StringType):
        return x.cast("string")
    if c.kind in NUMBERS:
        return F.when(exact.is_number(x), x).otherwise(quoted)
    if c.kind in ("json", "object", "array", "bool", "null"):
        return x
    return quoted


def rendered(rows: DataFrame, c: contracts.Contract, at: str = "") -> Column:
    """A row's JSON text. A null is written where its column admits one, else the member is left out."""
    parts = []
    for m in c.columns:
        if m.name not in rows.columns or c.identity == "filename" and m.name == c.key[0]:
            continue
        x = F.col(f"`{m.name}`")
        name = F.lit(f'"{m.name}":'.replace("\\", "\\\\"))
        none = F.concat(name, F.lit("null")) if m.nullable else F.lit(None).cast("string")
        if m.nullable and not m.required and "_present" in rows.columns:  # a member that was left out stays so
            none = F.when(F.array_contains("_present", m.name), none)
        parts.append(F.coalesce(F.concat(name, member(m, x, rows.schema[m.name].dataType)), none))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def document_of(c: contracts.Contract) -> dict:
    """The row schema of a contract; columns that a migration made or changed are free within it."""
    document = c.document or {}
    if not document:
        return document
    declared = {m.name: m for m in contracts.decode(document).columns}
    if declared == {m.name: m for m in c.columns}:
        return document
    properties = {m.name: document["properties"].get(m.name, {}) if declared.get(m.name) == m else {} for m in c.columns}
    return {**document, "properties": properties, "required": [m.name for m in c.columns if m.required]}


def findings(t: Table, rows: DataFrame) -> DataFrame:
    """What the table's ``rows`` break of its schema; beyond an inferred contract, a warning."""
    c = t.contract
    texts = rows.select(Table(rows, c).path().alias("_path"), rendered(rows, c).alias("_text"))
    found = jsonschema.judge_rows(texts, document_of(c))
    beyond = F.lit(c.inferred) & F.col("code").isin(*SHAPE_CODES)
    return found.select(
        F.when(beyond, "warning").otherwise("error").alias("severity"), F.when(beyond, "CONTRACT_EXCEEDED").otherwise(F.col("code")).alias("code"),
        F.lit(c.table).alias("table"), "path", "pointer", F.lit(c.table).alias("constraint"), F.lit(None).cast("string").alias("observed"), "message",
    )


def changed(before: Table | None, after: Table) -> DataFrame:
    """``(op, key, before, after)`` of the rows that a change wrote, moved or took away."""
    if before is None or before.rows.columns != after.rows.columns:
        image = F.struct(*(F.col(f"`{x}`") for x in after.rows.columns))
        none = F.lit(None).cast(after.rows.select(image.alias("i")).schema["i"].dataType)
        return after.rows.select(F.lit("insert").alias("op"), after.key().alias("key"), none.alias("before"), image.alias("after"))
    return changes.difference(before, after)


def image(t: Table, rows: DataFrame, side: str) -> DataFrame:
    """One side of changed rows, as rows of the table."""
    return rows.where(F.col(side).isNotNull()).select(*(F.col(f"{side}.`{x}`").alias(x) for x in t.rows.columns))
