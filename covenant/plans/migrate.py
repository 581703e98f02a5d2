"""Migrations: structural changes of a state, applied to contracts and rows together."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as F

from ..functions import exact
from ..operators.validate import State, Table, duplicates
from .contract import Acyclic, Column, Contract, ForeignKey, Rule, check_alone


class MigrationRefused(ValueError):
    def __init__(self, message: str, code: str = "MIGRATION_REFUSED"):
        super().__init__(f"{code}: {message}")
        self.code = code


def _table(state: State, name: str) -> Table:
    if name not in state:
        raise MigrationRefused(f"there is no table {name}", "UNKNOWN_TABLE")
    return state[name]


def _with(state: State, t: Table) -> State:
    check_alone(t.contract)
    return state | {t.name: t}


def add_table(state: State, t: Table) -> State:
    if t.name in state:
        raise MigrationRefused(f"{t.name} exists", "SCHEMA_TABLE_EXISTS")
    return _with(state, t)


def drop_table(state: State, name: str) -> State:
    _table(state, name)
    for t in state.values():
        if t.name != name and any(name in fk.tables for fk in t.contract.foreign_keys):
            raise MigrationRefused(f"{t.name} refers to {name}")
    return {n: t for n, t in state.items() if n != name}


def rename_table(state: State, old: str, new: str) -> State:
    """The table and every reference to it under the new name."""
    _table(state, old)
    if new in state:
        raise MigrationRefused(f"{new} exists", "SCHEMA_TABLE_EXISTS")
    out = {}
    for n, x in state.items():
        fks = tuple(replace(fk, tables=tuple(new if y == old else y for y in fk.tables)) for fk in x.contract.foreign_keys)
        c = replace(x.contract, foreign_keys=fks, table=new if n == old else n)
        rows = x.rows
        if n == old and "_path" in rows.columns:
            rows = rows.withColumn("_path", F.regexp_replace("_path", f"^{old}/", f"{new}/"))
        out[new if n == old else n] = Table(rows, c)
    return out


def add_column(state: State, name: str, column: Column, value: SparkColumn | None = None) -> State:
    """A new member; a required one needs a value for the rows there are."""
    t = _table(state, name)
    if t.contract.has(column.name):
        raise MigrationRefused(f"{name}.{column.name} exists", "SCHEMA_COLUMN_EXISTS")
    if value is None:
        if column.required and not column.has_default:
            raise MigrationRefused(f"{column.name} is required and has no value", "DECISION_REQUIRED")
        value = F.lit(column.default)
    rows = t.rows.withColumn(column.name, value.cast(column.spark_type()))
    return _with(state, Table(rows, replace(t.contract, columns=(*t.contract.columns, column))))


def drop_column(state: State, name: str, column: str) -> State:
    t = _table(state, name)
    c = t.contract
    c.column(column)
    used = column in c.key or any(column in u for u in c.unique) or any(fk.paths[0][0].name == column for fk in c.foreign_keys)
    used = used or any(column in (fk.columns or ()) for x in state.values() for fk in x.contract.foreign_keys if name in fk.tables)
    if used:
        raise MigrationRefused(f"{name}.{column} is part of a key or a reference")
    return _with(state, Table(t.rows.drop(column), replace(c, columns=tuple(x for x in c.columns if x.name != column))))


def rename_column(state: State, name: str, old: str, new: str) -> State:
    t = _table(state, name)
    c = t.contract
    c.column(old)
    if c.has(new):
        raise MigrationRefused(f"{name}.{new} exists", "SCHEMA_COLUMN_EXISTS")
    swap = lambda xs: tuple(new if x == old else x for x in xs)
    source = lambda s: new + s[len(old) :] if s == old or s.startswith((old + ".", old + "[")) else s
    contract = replace(
        c, columns=tuple(replace(x, name=new) if x.name == old else x for x in c.columns), key=swap(c.key), unique=tuple(map(swap, c.unique)),
        indexes=tuple(map(swap, c.indexes)), foreign_keys=tuple(replace(fk, sources=tuple(map(source, fk.sources))) for fk in c.foreign_keys),
    )
    out = _with(state, Table(t.rows.withColumnRenamed(old, new), contract))
    for n, x in out.items():
        fks = tuple(replace(fk, columns=swap(fk.columns)) if name in fk.tables else fk for fk in x.contract.foreign_keys)
        out = out | {n: Table(x.rows, replace(x.contract, foreign_keys=fks))}
    return out


def change_type(state: State, name: str, column: str, kind: str, using: SparkColumn | None = None) -> State:
    """A column under another type: by ``using``, else only where nothing is lost.

    The count of values that would be lost is one aggregate; any refuses the whole.
    """
    t = _table(state, name)
    old = t.contract.column(column)
    new = replace(old, kind=kind)
    x = F.col(f"`{column}`")
    value = using if using is not None else exact.lossless_convert(x, old.kind, kind)
    lost = t.rows.where(x.isNotNull() & value.isNull()).count()
    if lost:
        raise MigrationRefused(f"{lost} values of {name}.{column} have no {kind} of the same value")
    rows = t.rows.withColumn(column, value.cast(new.spark_type()))
    return _with(state, Table(rows, replace(t.contract, columns=tuple(new if c.name == column else c for c in t.contract.columns))))


def add_constraint(state: State, name: str, rule: ForeignKey | Acyclic | Rule | tuple[str, ...], assertion: bool = False) -> State:
    """A foreign key, graph, check, assertion or unique list."""
    t = _table(state, name)
    c = t.contract
    if isinstance(rule, tuple):
        if rule in c.unique:
            raise MigrationRefused(f"{rule} is unique already", "SCHEMA_CONSTRAINT_EXISTS")
        held = duplicates(t, rule, "UNIQUE_VIOLATION")
        if not held.isEmpty():
            raise MigrationRefused(f"rows share {rule}")
        return _with(state, Table(t.rows, replace(c, unique=(*c.unique, rule))))
    names = {x.name for x in (*c.foreign_keys, *c.acyclic, *c.checks, *c.assertions)}
    if rule.name in names:
        raise MigrationRefused(f"{rule.name} exists", "SCHEMA_CONSTRAINT_EXISTS")
    if isinstance(rule, ForeignKey):
        c = replace(c, foreign_keys=(*c.foreign_keys, rule))
    elif isinstance(rule, Acyclic):
        c = replace(c, acyclic=(*c.acyclic, rule))
    elif assertion:
        c = replace(c, assertions=(*c.assertions, rule))
    else:
        c = replace(c, checks=(*c.checks, rule))
    return _with(state, Table(t.rows, c))


def drop_constraint(state: State, name: str, rule: str | tuple[str, ...]) -> State:
    t = _table(state, name)
    c = t.contract
    if isinstance(rule, tuple):
        if rule not in c.unique:
            raise MigrationRefused(f"{rule} isn't unique", "UNKNOWN_CONSTRAINT")
        return _with(state, Table(t.rows, replace(c, unique=tuple(u for u in c.unique if u != rule))))
    keep = lambda xs: tuple(x for x in xs if x.name != rule)
    new = replace(c, foreign_keys=keep(c.foreign_keys), acyclic=keep(c.acyclic), checks=keep(c.checks), assertions=keep(c.assertions))
    if new == c:
        raise MigrationRefused(f"{name} has no rule {rule}", "UNKNOWN_CONSTRAINT")
    return _with(state, Table(t.rows, new))


def add_index(state: State, name: str, columns: tuple[str, ...]) -> State:
    """Recorded in the contract; files written by :func:`clustered` are laid out by it."""
    t = _table(state, name)
    for c in columns:
        t.contract.column(c)
    return _with(state, Table(t.rows, replace(t.contract, indexes=(*t.contract.indexes, columns))))


def drop_index(state: State, name: str, columns: tuple[str, ...]) -> State:
    t = _table(state, name)
    return _with(state, Table(t.rows, replace(t.contract, indexes=tuple(i for i in t.contract.indexes if i != columns))))


def change_identity(state: State, name: str, key: tuple[str, ...]) -> State:
    """Another key, which no two rows may share."""
    t = _table(state, name)
    if not duplicates(t, key, "PRIMARY_KEY_VIOLATION").isEmpty():
        raise MigrationRefused(f"rows share {key}")
    return _with(state, Table(t.rows, replace(t.contract, key=key)))


def set_identity_domain(state: State, name: str, domain: str | None) -> State:
    t = _table(state, name)
    return _with(state, Table(t.rows, replace(t.contract, domain=domain)))


def clustered(t: Table, path: str) -> None:
    """Parquet files sorted by the first index, so that a lookup reads few of them."""
    columns = t.contract.indexes[0] if t.contract.indexes else t.contract.key
    t.rows.repartitionByRange(*columns).sortWithinPartitions(*columns).write.mode("errorifexists").parquet(path)


def contract_of(state: State, name: str) -> Contract:
    return _table(state, name).contract
