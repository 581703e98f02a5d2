"""Repairs: from findings to a ranked plan, and from a plan to a state."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exact
from .referential import _apply
from .validate import State, Table, dangling, references


@dataclass(frozen=True)
class Fix:
    """What a finding can be mended by: layout and data fixes are applied, the rest is for people."""

    id: str
    kind: str
    code: str
    rank: int
    safe: bool


# Which fix answers which finding, best first.
FIXES = (
    Fix("FIX_PIN_SCHEMA", "schema", "LINT_SCHEMA_UNPINNED", 10, True),
    Fix("FIX_WIDEN_CONTRACT", "schema", "CONTRACT_EXCEEDED", 11, True),
    Fix("FIX_RENAME_FILE", "layout", "IDENTITY_MISMATCH", 20, True),
    Fix("FIX_RENAME_FILE", "layout", "PORTABILITY_COLLISION", 21, False),
    Fix("FIX_CANONICALIZE", "layout", "LINT_NON_CANONICAL_FORMATTING", 22, True),
    Fix("FIX_COERCE_VALUE", "data", "TYPE_MISMATCH", 30, True),
    Fix("FIX_REMOVE_REFERENCE", "data", "FOREIGN_KEY_VIOLATION", 31, False),
    Fix("FIX_SET_NULL", "data", "FOREIGN_KEY_VIOLATION", 32, False),
    Fix("FIX_DELETE_ROW", "data", "FOREIGN_KEY_VIOLATION", 33, False),
    Fix("FIX_DELETE_DUPLICATE", "data", "PRIMARY_KEY_VIOLATION", 34, False),
    Fix("FIX_DELETE_DUPLICATE", "data", "UNIQUE_VIOLATION", 35, False),
    Fix("FIX_DELETE_DUPLICATE", "data", "DOMAIN_KEY_VIOLATION", 36, False),
    Fix("FIX_REMOVE_FIELD", "data", "ROW_UNKNOWN_FIELD", 37, False),
    Fix("FIX_ADD_DEFAULT", "data", "ROW_MISSING_FIELD", 38, False),
    Fix("FIX_BY_HAND", "manual", "CHECK_VIOLATION", 90, False),
    Fix("FIX_BY_HAND", "manual", "ASSERTION_VIOLATION", 91, False),
    Fix("FIX_BY_HAND", "manual", "CYCLE_VIOLATION", 92, False),
    Fix("FIX_BY_HAND", "manual", "MERGE_CONFLICT", 93, False),
    Fix("FIX_BY_HAND", "manual", "INVALID_JSON", 94, False),
    Fix("FIX_BY_HAND", "manual", "SCHEMA_VIOLATION", 95, False),
)


def plan(spark: SparkSession, findings: DataFrame) -> DataFrame:
    """``(fix, kind, safe, rank, code, path, pointer)``, best first for each finding."""
    rows = [(f.id, f.kind, f.safe, f.rank, f.code) for f in FIXES]
    fixes = spark.createDataFrame(rows, "fix string, kind string, safe boolean, rank int, code string")
    return findings.select("code", "path", "pointer").join(F.broadcast(fixes), "code").select("fix", "kind", "safe", "rank", "code", "path", "pointer").orderBy("rank", "path", "pointer")


def without_duplicates(t: Table, columns: tuple[str, ...] | None = None) -> Table:
    """Of rows that share a key the first by path stays."""
    from .validate import duplicates

    spare = duplicates(t, columns or t.contract.key, "PRIMARY_KEY_VIOLATION").select(F.col("path").alias("_spare"))
    at = t.rows.withColumn("_at", t.path())
    left = at.join(spare, F.col("_at") == F.col("_spare"), "left_anti").drop("_at")
    # rows of one path and one key are the same row twice
    return Table(left.dropDuplicates(list(columns or t.contract.key)), t.contract)


def without_dangling(state: State, table: str, action: str = "remove") -> State:
    """References that name no row are removed, set to null, or take their rows along."""
    state = dict(state)
    for fk in state[table].contract.foreign_keys:
        t = state[table]
        loose = dangling(state, t, fk).select("path", "pointer", F.col("observed").alias("key"), F.lit(None).cast("string").alias("new_key"))
        if loose.isEmpty():
            continue
        hits = references(t, fk).join(loose.select("path", "pointer", "new_key"), ["path", "pointer"]).select("path", "pointer", "key", "new_key")
        state[table], _ = _apply(t, fk, {"delete": "cascade"}.get(action, action), hits)
    return state


def coerced(t: Table, column: str, source: str) -> Table:
    """Values of a wrong type in their losslessly converted form, the others as they are."""
    kind = t.contract.column(column).kind
    x = F.col(f"`{column}`").cast("string")
    return Table(t.rows.withColumn(column, F.coalesce(exact.lossless_convert(x, source, kind), x)), t.contract)
