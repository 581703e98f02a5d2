"""Changes: what statements do to a state, as before and after images.

A change is computed whole before anything is written: the after image of a table
is a DataFrame, and the difference of two images is a DataFrame of row changes.
A value that is equal under its type (the same instant, the same number) is no
change and keeps its spelling.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exact
from ..plans.contract import Contract
from .validate import State, Table


class ChangeRefused(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass(frozen=True)
class Change:
    """The table after a statement, and the rows that it changed."""

    after: Table
    rows: DataFrame  # op, key, before, after

    def returning(self, *columns: Column | str) -> DataFrame:
        """The after image of inserted and updated rows, the before image of deleted ones."""
        image = F.when(F.col("op") == "delete", F.col("before")).otherwise(F.col("after"))
        return self.rows.select(image.alias("r")).select("r.*").select(*columns)


def _image(t: Table) -> Column:
    return F.struct(*(F.col(f"`{c}`") for c in t.rows.columns))


def _same(c: Contract, a: str, b: str, columns: list[str]) -> Column:
    out = F.lit(True)
    for n in columns:
        if n.startswith("_"):  # about the file, not the row
            continue
        kind = c.column(n).kind if c.has(n) else "string"
        out = out & exact.typed_equal(F.col(f"{a}.`{n}`"), F.col(f"{b}.`{n}`"), kind)
    return out


def difference(before: Table, after: Table) -> DataFrame:
    """``(op, key, before, after)`` of the rows that differ: one full outer join on the key."""
    b = before.rows.select(before.key().alias("bk"), _image(before).alias("before"))
    a = after.rows.select(after.key().alias("ak"), _image(after).alias("after"))
    both = b.join(a, F.col("bk") == F.col("ak"), "full")
    op = (
        F.when(F.col("before").isNull(), "insert")
        .when(F.col("after").isNull(), "delete")
        .when(~_same(before.contract, "before", "after", before.rows.columns), "update")
    )
    return both.select(op.alias("op"), F.coalesce("bk", "ak").alias("key"), "before", "after").where("op is not null")


def update(t: Table, where: Column, assign: dict[str, Column]) -> Change:
    """``UPDATE``: assigned values are computed from the row as it was.

    Column by column, the old value stays where the new one equals it under its
    type. No join: both images are projections of one scan.
    """
    hit = F.coalesce(where, F.lit(False))
    new = {}
    for n, value in assign.items():
        kind = t.contract.column(n).kind
        value = value.cast(t.rows.schema[n].dataType)
        new[n] = F.when(exact.typed_equal(F.col(n), value, kind), F.col(n)).otherwise(value)
    changed = F.lit(False)
    for n, value in new.items():
        changed = changed | ~value.eqNullSafe(F.col(n))
    columns = t.rows.columns
    after_row = F.struct(*((new[c] if c in new else F.col(f"`{c}`")).alias(c) for c in columns))
    touched = t.rows.where(hit & changed).select(F.lit("update").alias("op"), t.key().alias("key"), _image(t).alias("before"), after_row.alias("after"))
    after = t.rows.select(*((F.when(hit, new[c]).otherwise(F.col(f"`{c}`")).alias(c)) if c in new else F.col(f"`{c}`") for c in columns))
    return Change(Table(after, t.contract), touched)


def delete(t: Table, where: Column) -> Change:
    hit = F.coalesce(where, F.lit(False))
    gone = t.rows.where(hit).select(F.lit("delete").alias("op"), t.key().alias("key"), _image(t).alias("before"), _image(t).alias("after"))
    gone = gone.withColumn("after", F.lit(None).cast(gone.schema["after"].dataType))
    return Change(Table(t.rows.where(~hit), t.contract), gone)


# ---- insert -----------------------------------------------------------------


def ulid() -> Column:
    """A new ULID: ten characters of milliseconds, sixteen of chance."""
    alphabet = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
    millis = F.unix_millis(F.current_timestamp())
    digit = lambda i: F.substring(F.lit(alphabet), F.pmod(F.shiftright(millis, 5 * i), F.lit(32)).cast("int") + 1, F.lit(1))
    chance = [F.substring(F.lit(alphabet), F.floor(F.rand() * 32).cast("int") + 1, F.lit(1)) for _ in range(16)]
    return F.concat(*(digit(i) for i in range(9, -1, -1)), *chance)


def generated(t: Table, new: DataFrame) -> DataFrame:
    """The new rows with columns filled that the contract generates and they lack.

    A sequence goes on from the table's greatest value; ranks come from partition
    counts, so no row leaves its partition.
    """
    for c in t.contract.columns:
        if not c.generated or c.name in new.columns:
            continue
        if c.generated == "uuid":
            new = new.withColumn(c.name, F.uuid())
        elif c.generated == "ulid":
            new = new.withColumn(c.name, ulid())
        elif c.generated == "now":
            new = new.withColumn(c.name, F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
        else:
            from .durable import cut

            top = t.rows.agg(F.coalesce(F.max(c.name), F.lit(0)).alias("m")).first()["m"]
            held = cut(new.withColumn("_id", F.monotonically_increasing_id()))
            part = F.shiftright("_id", 33)
            counts = held.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # a row a partition
            before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
            starts = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
            numbered = held.withColumn("_part", part).join(F.broadcast(starts), "_part")
            place = F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
            if top is not None and top + held.count() > (1 << 63) - 1:
                raise ChangeRefused("MUTATION_CONFLICT", f"the sequence of {c.name} is at its end")
            new = numbered.withColumn(c.name, F.lit(top) + place).drop("_id", "_part", "_before")
    return new


def _shaped(t: Table, new: DataFrame) -> DataFrame:
    """The new rows in the table's columns; those they don't name are null."""
    unknown = [c for c in new.columns if c not in t.rows.columns]
    if unknown:
        raise ChangeRefused("UNKNOWN_COLUMN", f"{t.name} has no column {unknown[0]!r}")
    kinds = {f.name: f.dataType for f in t.rows.schema}
    if "_present" in kinds and "_present" not in new.columns:
        new = new.withColumn("_present", F.array(*(F.lit(c) for c in new.columns)))
    return new.select(*((F.col(f"`{c}`") if c in new.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in t.rows.columns))


def insert(t: Table, new: DataFrame, on_conflict: str = "error", assign: dict[str, Column] | None = None) -> Change:
    """``INSERT``: ``on_conflict`` is error, nothing, replace or update.

    For update, ``assign`` is computed from ``old.*`` and ``excluded.*``. Of new rows
    with one key, the first in the order of all columns counts, and any is a
    conflict for error.
    """
    rows = Table(_shaped(t, generated(t, new)), t.contract)
    own = Window.partitionBy("k").orderBy(*(F.col(f"n.`{c}`") for c in t.rows.columns))
    fresh = rows.rows.select(rows.key().alias("k"), _image(rows).alias("n")).withColumn("nth", F.row_number().over(own))
    held = t.rows.select(t.key().alias("k2"), _image(t).alias("o"))
    if on_conflict == "error":
        clash = fresh.where("nth > 1").select("k").union(fresh.join(held, F.col("k") == F.col("k2"), "left_semi").select("k"))
        first = clash.orderBy("k").first()
        if first is not None:
            raise ChangeRefused("PRIMARY_KEY_VIOLATION", f"{t.name} already holds {first['k']}")
    both = fresh.where("nth = 1").join(held, F.col("k") == F.col("k2"), "full")
    clash = F.col("n").isNotNull() & F.col("o").isNotNull()
    if on_conflict == "update":
        wide = both.withColumnsRenamed({"o": "old", "n": "excluded"})
        merged = F.struct(*((assign[c].cast(t.rows.schema[c].dataType) if c in (assign or {}) else F.col(f"old.`{c}`")).alias(c) for c in t.rows.columns))
        chosen = F.when(F.col("old").isNull(), F.col("excluded")).when(F.col("excluded").isNull(), F.col("old")).otherwise(merged)
        both = wide.withColumn("r", chosen).withColumnsRenamed({"old": "o", "excluded": "n"})
    else:
        winner = F.when(clash, F.col("o") if on_conflict == "nothing" else F.col("n")).otherwise(F.coalesce("n", "o"))
        both = both.withColumn("r", winner)
    after = Table(both.select("r.*"), t.contract)
    op = F.when(F.col("o").isNull(), "insert").when(clash & ~_same(t.contract, "o", "r", t.rows.columns), "update")
    changes = both.select(op.alias("op"), F.coalesce("k", "k2").alias("key"), F.col("o").alias("before"), F.col("r").alias("after")).where("op is not null")
    return Change(after, changes)


# ---- import -----------------------------------------------------------------

MODES = ("insert", "upsert", "replace")


def import_rows(t: Table, new: DataFrame, mode: str = "insert") -> tuple[Change, DataFrame]:
    """Rows from outside, and counts ``(op, n)`` with the unchanged ones.

    insert refuses held keys; upsert changes them; replace also deletes rows that
    the input doesn't hold. A key twice in the input is refused.
    """
    if mode not in MODES:
        raise ValueError(f"no mode {mode!r}")
    rows = Table(_shaped(t, generated(t, new)), t.contract)
    twice = rows.keys().groupBy("key").count().where("count > 1").orderBy("key").first()
    if twice is not None:
        raise ChangeRefused("PRIMARY_KEY_VIOLATION", f"the input holds {twice['key']} twice")
    if mode == "insert":
        return (c := insert(t, new)), c.rows.groupBy("op").agg(F.count(F.lit(1)).alias("n"))
    b = t.rows.select(t.key().alias("bk"), _image(t).alias("before"))
    a = rows.rows.select(rows.key().alias("ak"), _image(rows).alias("after"))
    both = b.join(a, F.col("bk") == F.col("ak"), "full")
    op = (
        F.when(F.col("before").isNull(), "insert")
        .when(F.col("after").isNull(), F.lit("delete" if mode == "replace" else "unchanged"))
        .when(_same(t.contract, "before", "after", t.rows.columns), "unchanged")
        .otherwise("update")
    )
    marked = both.withColumn("op", op)
    kept = marked.where("op <> 'delete'")
    # rows that are equal under their types keep their spelling
    row = F.when(F.col("op") == "unchanged", F.col("before")).otherwise(F.col("after"))
    after = Table(kept.select(row.alias("r")).select("r.*"), t.contract)
    changed = marked.where("op <> 'unchanged'").select("op", F.coalesce("bk", "ak").alias("key"), "before", "after")
    counted = marked if mode == "replace" else marked.where("after is not null")
    return Change(after, changed), counted.groupBy("op").agg(F.count(F.lit(1)).alias("n"))


# ---- null and absent --------------------------------------------------------


def write_back(t: Table, columns: list[str], present: str = "_present") -> Table:
    """Nulls by contract: kept where admitted, else the member goes if it is optional.

    ``_present`` lists the members a row has; a null in a column that admits none
    and isn't required takes its name off the list.
    """
    gone = [
        F.when(F.col(c).isNull(), F.lit(c))
        for c in columns
        if not t.contract.column(c).nullable and not t.contract.column(c).required
    ]
    if not gone:
        return t
    return Table(t.rows.withColumn(present, F.array_except(F.col(present), F.array_compact(F.array(*gone)))), t.contract)


def absent(t: Table, where: Column, column: str, present: str = "_present") -> Table:
    """``absent()``: the member is removed, whatever the column admits."""
    hit = F.coalesce(where, F.lit(False))
    kind = t.rows.schema[column].dataType
    return Table(
        t.rows.withColumn(present, F.when(hit, F.array_remove(F.col(present), column)).otherwise(F.col(present))).withColumn(
            column, F.when(hit, F.lit(None).cast(kind)).otherwise(F.col(column))
        ),
        t.contract,
    )


def table_token(t: Table) -> str:
    """A hash of a table's rows that doesn't depend on their order."""
    hashed = F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(t.rows.columns)))), 256)
    # two 64-bit sums of each hash: order-free, and one partial aggregate
    low, high = (F.conv(F.substring(hashed, i, 15), 16, 10).cast("decimal(38,0)") for i in (1, 16))
    r = t.rows.select(low.alias("l"), high.alias("h")).agg(F.sum("l"), F.sum("h"), F.count(F.lit(1))).first()
    return f"{r[0]}:{r[1]}:{r[2]}"


def token_of(parts: dict[str, str]) -> str:
    """A state's token, of its tables'."""
    import hashlib

    return hashlib.sha256("|".join(f"{n}:{parts[n]}" for n in sorted(parts)).encode()).hexdigest()


def state_token(state: State) -> str:
    """A hash of all rows of all tables that doesn't depend on their order."""
    return token_of({n: table_token(t) for n, t in state.items()})
