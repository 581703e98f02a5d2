"""Referential actions: what a change of keys does to the rows that name them.

The rows a statement removed or re-keyed vacate keys. References to them are found
by joining the narrow reference table with the vacated keys, each foreign key's
action is applied to the rows concerned, rows that a cascade deletes vacate keys
of their own, and so on until nothing is vacated. Only the frontier is carried
from round to round, and its lineage is cut.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exact
from ..plans import paths
from ..plans.contract import ForeignKey
from .durable import cut
from .validate import State, Table, references, target_keys

INDUCED = "path string, action string, constraint string, key string, because string"
ROUNDS = 10_000


@dataclass
class Expansion:
    """The state when all actions are done, what they did, and what refuses the change."""

    state: State
    induced: DataFrame
    refused: DataFrame
    _parts: list = field(default_factory=list)


def vacated_by_delete(t: Table, gone: DataFrame) -> DataFrame:
    """``(b, a)`` images of deleted rows: the after image is null."""
    image = F.struct(*(F.col(f"`{c}`") for c in t.rows.columns))
    out = gone.select(image.alias("b"), image.alias("a"))
    return out.withColumn("a", F.lit(None).cast(out.schema["a"].dataType))


def _keys(t: Table, fk: ForeignKey, moved: DataFrame) -> DataFrame:
    """``(key, new_key)`` under the columns a foreign key compares with."""
    columns = fk.columns or t.contract.key
    key = lambda side: exact.key_of([(F.col(f"{side}.`{c}`"), t.contract.column(c).kind) for c in columns])
    return moved.select(key("b").alias("key"), key("a").alias("new_key")).where("key is not null and not (key <=> new_key)")


def _targets(state: State, fk: ForeignKey) -> list[str]:
    if fk.domain is not None:
        return [n for n, t in state.items() if t.contract.domain == fk.domain]
    return [n for n in fk.tables if n in state]


def rewritten(path: paths.Path, member: Column, kind: T.DataType, leaf: Column, key_kind: str, action: str) -> Column:
    """A member with the action applied to the hits at a path below it.

    ``leaf`` is a map from the keys that went to the keys they became (null for
    none); set_null and set_default come as ``action`` with the value in the map.
    """
    here, rest = path[0], path[1:]

    def hit(x: Column) -> Column:
        return F.coalesce(F.map_contains_key(leaf, F.coalesce(exact.key_of([(x, key_kind)]), F.lit(""))), F.lit(False))

    def at_leaf(x: Column, t: T.DataType) -> Column:
        new = F.get(F.from_json(F.element_at(leaf, exact.key_of([(x, key_kind)])), "array<string>"), F.lit(0)).cast(t)
        return F.when(hit(x), new).otherwise(x)

    def inside(x: Column, t: T.StructType) -> Column:
        n = rest[0].name
        return F.when(x.isNull(), x).otherwise(x.withField(n, rewritten(rest, x[n], t[n].dataType, leaf, key_kind, action)))

    def wanted(x: Column) -> Column:
        return F.lit(True) if here.field is None else F.coalesce(x[here.field] == F.lit(here.value), F.lit(False))

    if not here.iterates:
        return inside(member, kind) if rest else at_leaf(member, kind)
    if action == "remove" and not paths.iterates(rest):
        value = lambda x: reduce(lambda y, s: y[s.name], rest, x)
        return F.filter(member, lambda x: ~(wanted(x) & hit(value(x))))
    change = (lambda x: inside(x, kind.elementType)) if rest else (lambda x: at_leaf(x, kind.elementType))
    return F.transform(member, lambda x: F.when(wanted(x), change(x)).otherwise(x))


def expand(spark: SparkSession, state: State, moved: dict[str, DataFrame]) -> Expansion:
    """All actions that vacated keys call for.

    ``state`` is after the statement; ``moved`` holds, by table, the ``(b, a)``
    images of rows whose keys it vacated.
    """
    state = dict(state)
    induced, refused = [], []
    deferred: list[tuple[str, ForeignKey, DataFrame]] = []
    frontier = {n: cut(m) for n, m in moved.items()}
    for _ in range(ROUNDS):
        following: dict[str, list[DataFrame]] = {}
        for target, rows in frontier.items():
            for holder, t in list(state.items()):
                for fk in t.contract.foreign_keys:
                    if target not in _targets(state, fk):
                        continue
                    gone = _keys(state[target], fk, rows).join(target_keys(state, fk), "key", "left_anti")
                    hits = cut(references(state[holder], fk).join(gone.distinct(), "key"))
                    for action, part in ((fk.on_delete, hits.where("new_key is null")), (fk.on_update, hits.where("new_key is not null"))):
                        if part.isEmpty():
                            continue
                        name = f"{holder}.{','.join(fk.sources)} -> {target}"
                        said = part.select("path", F.lit(action).alias("action"), F.lit(name).alias("constraint"), "key", F.lit(target).alias("because"))
                        if action == "restrict":
                            refused.append(said)
                            continue
                        if action == "no_action":
                            deferred.append((holder, fk, said))
                            continue
                        induced.append(said)
                        state[holder], new = _apply(state[holder], fk, action, part)
                        if new is not None:
                            following.setdefault(holder, []).append(new)
        if not following:
            break
        frontier = {n: cut(reduce(DataFrame.unionAll, parts)) for n, parts in following.items()}
    else:
        raise RuntimeError(f"the referential actions did not settle in {ROUNDS} rounds")
    for holder, fk, said in deferred:
        # refused only if the reference still names nothing when all is done
        loose = references(state[holder], fk).join(target_keys(state, fk), "key", "left_anti").select("path", "key")
        refused.append(said.join(loose.distinct(), ["path", "key"], "left_semi").select("path", "action", "constraint", "key", "because"))
    none = spark.createDataFrame([], INDUCED)
    return Expansion(state, reduce(DataFrame.unionAll, induced, none).distinct(), reduce(DataFrame.unionAll, refused, none).distinct())


def _apply(t: Table, fk: ForeignKey, action: str, hits: DataFrame) -> tuple[Table, DataFrame | None]:
    """The table with an action applied; the images of rows whose own keys went or moved."""
    deleting = action == "cascade" and hits.where("new_key is not null").isEmpty()
    touched = hits.select(F.col("path").alias("_hit")).distinct()
    if deleting:
        marked = t.rows.withColumn("_at", t.path())
        gone = marked.join(touched, F.col("_at") == F.col("_hit"), "left_semi").drop("_at")
        left = marked.join(touched, F.col("_at") == F.col("_hit"), "left_anti").drop("_at")
        return Table(cut(left), t.contract), vacated_by_delete(t, gone)
    value = F.col("new_key")
    if action in ("set_null", "remove"):
        value = F.lit(None).cast("string")
    elif action == "set_default":
        default = t.contract.leaf(fk.paths[0]).default
        value = F.to_json(F.array(F.lit(default).cast("string")))
    by_row = hits.groupBy(F.col("path").alias("_hit")).agg(F.map_from_entries(F.collect_set(F.struct("key", value.alias("v")))).alias("_map"))
    joined = t.rows.withColumn("_at", t.path()).join(by_row, F.col("_at") == F.col("_hit"), "left")
    out = joined
    if len(fk.paths) == 1:
        p, kind = fk.paths[0], t.contract.leaf(fk.paths[0]).kind
        top = p[0].name
        member = rewritten(p, F.col(f"`{top}`"), t.rows.schema[top].dataType, F.col("_map"), kind, action)
        out = joined.withColumn(top, F.when(F.col("_map").isNull(), F.col(f"`{top}`")).otherwise(member))
    else:
        parts = F.from_json(F.get(F.map_values("_map"), F.lit(0)), "array<string>")
        for i, p in enumerate(fk.paths):
            top = p[0].name
            out = out.withColumn(top, F.when(F.col("_map").isNull(), F.col(f"`{top}`")).otherwise(F.get(parts, F.lit(i)).cast(t.rows.schema[top].dataType)))
    image = lambda columns: F.struct(*(F.col(f"`{c}`") for c in columns))
    after = cut(out.select(*t.rows.columns))
    new = Table(after, t.contract)
    moves = any(p[0].name in t.contract.key for p in fk.paths)
    if not moves:
        return new, None
    # the key itself was rewritten: pair the images by what the map says of the old key
    a = out.where("_map is not null").select("_at", image(t.rows.columns).alias("a"))
    b = t.rows.withColumn("_at", t.path()).join(touched, F.col("_at") == F.col("_hit"), "left_semi").select("_at", image(t.rows.columns).alias("b"))
    return new, b.join(a, "_at").select("b", "a")


def delete_rows(spark: SparkSession, state: State, table: str, where: Column) -> Expansion:
    """A delete with all its consequences; nothing is written where ``refused`` has rows."""
    t = state[table]
    hit = F.coalesce(where, F.lit(False))
    after = state | {table: Table(t.rows.where(~hit), t.contract)}
    return expand(spark, after, {table: vacated_by_delete(t, t.rows.where(hit))})


def rekey_rows(spark: SparkSession, state: State, table: str, where: Column, assign: dict[str, Column]) -> Expansion:
    """An update of keys with all its consequences."""
    t = state[table]
    hit = F.coalesce(where, F.lit(False))
    columns = t.rows.columns
    new = [(F.when(hit, assign[c]).otherwise(F.col(f"`{c}`")).cast(t.rows.schema[c].dataType) if c in assign else F.col(f"`{c}`")).alias(c) for c in columns]
    b = F.struct(*(F.col(f"`{c}`") for c in columns))
    moved = t.rows.where(hit).select(b.alias("b"), F.struct(*new).alias("a"))
    return expand(spark, state | {table: Table(t.rows.select(*new), t.contract)}, {table: moved})
