"""Profiling: lint proposals, undeclared references, statistics.

One aggregate over a table answers all of its column questions; distinct counts
that must be exact are counted from grouped values, in the same pass for all
columns.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exact
from ..plans.contract import SCALARS, Contract, comparable
from .validate import State, Table

FINDING = "table string, column string, code string, detail string"
#: Defaults of the proposals: distinct values of an enum, rows behind unique and check.
ENUM_MOST, UNIQUE_LEAST = 20, 10


@dataclass(frozen=True)
class Options:
    enum_max_values: int = ENUM_MOST
    unique_min_rows: int = UNIQUE_LEAST


def column_profile(t: Table) -> DataFrame:
    """``(column, n_rows, n_values, n_distinct, smallest, shortest)`` of the scalar columns.

    Values are unpivoted and grouped by (column, value): partial aggregates, and the
    only exact way to count distinct values of many columns in one shuffle.
    """
    c = t.contract
    names = [f.name for f in t.rows.schema if c.has(f.name) and c.column(f.name).kind in SCALARS]
    long = t.rows.select(F.explode(F.array(*(F.struct(F.lit(n).alias("column"), F.col(f"`{n}`").cast("string").alias("value")) for n in names))).alias("x")).select("x.*")
    grouped = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("k"))
    return grouped.groupBy("column").agg(
        F.sum("k").alias("n_rows"),
        F.sum(F.when(F.col("value").isNotNull(), F.col("k")).otherwise(0)).alias("n_values"),
        F.count("value").alias("n_distinct"),
        F.min(F.col("value").try_cast("double")).alias("smallest"),
        F.min(F.char_length("value")).alias("shortest"),
    )


def _found(df: DataFrame, table: str, code: str, detail) -> DataFrame:
    return df.select(F.lit(table).alias("table"), F.col("column"), F.lit(code).alias("code"), detail.cast("string").alias("detail"))


def lint(spark: SparkSession, t: Table, options: Options = Options()) -> DataFrame:
    """What the data would let a contract say, and what a contract leaves unsaid."""
    c = t.contract
    profile = column_profile(t)
    kind = {x.name: x.kind for x in c.columns}
    of = lambda kinds: F.col("column").isin([n for n, k in kind.items() if k in kinds])
    nullable = [x.name for x in c.columns if x.nullable]
    optional = [x.name for x in c.columns if not x.required]
    covered = {u[0] for u in c.unique if len(u) == 1} | ({c.key[0]} if len(c.key) == 1 else set())
    parts = [
        _found(profile.where((F.col("n_values") == F.col("n_rows")) & F.col("column").isin(nullable)), t.name, "LINT_NULLABLE_NEVER_NULL", F.col("n_rows")),
        _found(profile.where((F.col("n_values") == 0) & F.col("column").isin(optional)), t.name, "LINT_COLUMN_NEVER_POPULATED", F.col("n_rows")),
        _found(
            profile.where((F.col("n_values") > 0) & (F.col("n_values") < F.col("n_rows")) & F.col("column").isin(optional) & ~F.col("column").isin(nullable)),
            t.name, "LINT_INCONSISTENT_PRESENCE", F.col("n_values"),
        ),
        _found(
            profile.where(of({"string"}) & (F.col("n_distinct") <= options.enum_max_values) & (F.col("n_distinct") > 0) & (F.col("n_values") >= 3 * F.col("n_distinct"))),
            t.name, "LINT_ENUM_CANDIDATE", F.col("n_distinct"),
        ),
        _found(
            profile.where((F.col("n_distinct") == F.col("n_values")) & (F.col("n_values") >= options.unique_min_rows) & ~F.col("column").isin(list(covered)) & of(SCALARS - {"bool", "float", "number", "bytes"})),
            t.name, "LINT_UNIQUE_CANDIDATE", F.col("n_distinct"),
        ),
        _found(
            profile.where(of({"int", "integer", "number", "float"}) & (F.col("smallest") >= 0) & (F.col("n_values") >= options.unique_min_rows)),
            t.name, "LINT_CHECK_CANDIDATE", F.when(F.col("smallest") > 0, "> 0").otherwise(">= 0"),
        ),
    ]
    arrays = [f.name for f in t.rows.schema if isinstance(f.dataType, T.ArrayType)]
    if arrays:
        sizes = t.rows.agg(*(F.min(F.size(f"`{a}`")).alias(a) for a in arrays))
        long = sizes.select(F.explode(F.array(*(F.struct(F.lit(a).alias("column"), F.col(f"`{a}`").alias("least")) for a in arrays))).alias("x")).select("x.*")
        parts.append(_found(long.where("least >= 1"), t.name, "LINT_MIN_ITEMS_CANDIDATE", F.col("least")))
    return reduce(DataFrame.unionAll, [*parts, declared(spark, c)])


def declared(spark: SparkSession, c: Contract) -> DataFrame:
    """Proposals that need no rows."""
    rows = []
    if c.inferred:
        rows.append((c.table, "", "LINT_SCHEMA_UNPINNED", ""))
    if not c.closed:
        rows.append((c.table, "", "LINT_ADDITIONAL_FIELDS_ALLOWED", ""))
    if not c.description:
        rows.append((c.table, "", "LINT_NO_DESCRIPTION", ""))
    for fk in c.foreign_keys:
        if fk.declared != {"onDelete", "onUpdate"}:
            rows.append((c.table, fk.sources[0], "LINT_FK_ACTION_DEFAULTED", fk.name))
    for k in c.key:
        column = c.column(k)
        if c.identity == "body" and column.kind in ("uuid", "ulid") and not column.generated:
            rows.append((c.table, k, "LINT_PK_NOT_GENERATED", column.kind))
    return spark.createDataFrame(rows, FINDING)


def wider_types(spark: SparkSession, t: Table) -> DataFrame:
    """Columns of a wide type whose every value has a narrower form."""
    c = t.contract
    text = [x.name for x in c.columns if x.kind == "string" and x.name in t.rows.columns]
    forms = {"date": exact.DATE, "timestamp": exact.TIMESTAMP, "uuid": exact.UUID, "ulid": exact.ULID, "decimal": exact.DECIMAL}
    if not text:
        return spark.createDataFrame([], FINDING)
    agg = [F.count(f"`{n}`").alias(f"{n}|n") for n in text] + [
        F.bool_and(F.col(f"`{n}`").rlike(p)).alias(f"{n}|{k}") for n in text for k, p in forms.items()
    ]
    row = t.rows.agg(*agg).first()
    found = [(t.name, n, "LINT_WIDER_TYPE", k) for n in text for k in forms if row[f"{n}|n"] and row[f"{n}|{k}"]]
    return spark.createDataFrame(found, FINDING)


def discover_references(spark: SparkSession, state: State) -> DataFrame:
    """``(table, column, code, detail)``: columns whose every value is a key elsewhere.

    All distinct leaf values meet all keys of comparable type in one equi-join on
    the key; a column is a candidate for a table that holds all of its values. With
    several such tables there is no proposal; with values spread over several tables
    of one key type, each in exactly one, a domain is proposed.
    """
    leaves, keys = [], []
    for n, t in state.items():
        c = t.contract
        if len(c.key) == 1:
            kind = c.column(c.key[0]).kind
            keys.append(t.keys().select("key", F.col("table").alias("target"), F.lit(_family(kind)).alias("family")))
        referring = {fk.sources[0] for fk in c.foreign_keys}
        for x in c.columns:
            values = t.rows.schema[x.name].dataType if x.name in t.rows.columns else None
            if values is None or x.name in referring or c.key == (x.name,):
                continue
            leaf, name = (x.items, f"{x.name}[]") if x.kind == "array" and x.items else (x, x.name)
            if leaf.kind not in SCALARS - {"bool", "float", "number", "bytes", "date", "timestamp"}:
                continue
            value = F.explode(f"`{x.name}`") if x.kind == "array" else F.col(f"`{x.name}`")
            found = t.rows.select(value.alias("v")).where("v is not null").distinct()
            leaves.append(found.select(F.lit(n).alias("table"), F.lit(name).alias("column"), exact.key_of([(F.col("v"), leaf.kind)]).alias("key"), F.lit(_family(leaf.kind)).alias("family")))
    if not leaves or not keys:
        return spark.createDataFrame([], FINDING)
    values, held = reduce(DataFrame.unionAll, leaves), reduce(DataFrame.unionAll, keys)
    total = values.groupBy("table", "column").agg(F.count(F.lit(1)).alias("n"))
    hits = values.join(held, ["key", "family"])
    by_target = hits.groupBy("table", "column", "target").agg(F.count(F.lit(1)).alias("k"))
    spread = hits.groupBy("table", "column").agg(F.countDistinct("key").alias("distinct"), F.count(F.lit(1)).alias("hits"), F.array_join(F.sort_array(F.collect_set("target")), ", ").alias("targets"), F.countDistinct("target").alias("m"))
    whole = by_target.join(total, ["table", "column"]).where("k = n").groupBy("table", "column").agg(F.min("target").alias("target"), F.count(F.lit(1)).alias("ways"))
    fk = whole.where("ways = 1").select("table", "column", F.lit("LINT_FK_CANDIDATE").alias("code"), F.col("target").alias("detail"))
    domain = (
        spread.join(total, ["table", "column"]).where("distinct = n and hits = n and m > 1")
        .select("table", "column", F.lit("LINT_DOMAIN_CANDIDATE").alias("code"), F.col("targets").alias("detail"))
    )
    return fk.unionAll(domain)


def _family(kind: str) -> str:
    for family in ("int", "string"):
        if comparable(kind, family):
            return family
    return kind


def statistics(t: Table) -> dict[str, int]:
    """Row count and bytes as the optimiser estimates them."""
    plan = t.rows._jdf.queryExecution().optimizedPlan().stats()
    return {"rows": t.rows.count(), "bytes": int(plan.sizeInBytes().toString())}


def stale(known: int, now: int, floor: int = 64) -> bool:
    """Statistics are taken anew when a table's size has doubled or halved."""
    return max(known, now) >= floor and (now >= 2 * known or 2 * now <= known)
