"""Comparing states: differences, renames, three-way merges, revisions.

States are compared by row hash first: rows whose hash is the same on both sides
are never opened, and hashes are narrow.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .durable import cut
from .validate import State, Table


def canonical(column: Column, kind: T.DataType) -> Column:
    """A value as text that doesn't depend on the order of members."""
    if isinstance(kind, T.StructType):
        parts = [F.concat(F.lit(json.dumps(f.name) + ":"), canonical(column[f.name], f.dataType)) for f in sorted(kind, key=lambda f: f.name)]
        return F.when(column.isNull(), "null").otherwise(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))
    if isinstance(kind, T.ArrayType):
        inner = F.array_join(F.transform(column, lambda x: canonical(x, kind.elementType)), ",")
        return F.when(column.isNull(), "null").otherwise(F.concat(F.lit("["), inner, F.lit("]")))
    if isinstance(kind, T.MapType):
        return F.coalesce(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(column)))), F.lit("null"))
    if isinstance(kind, T.StringType):
        return F.coalesce(F.regexp_replace(F.to_json(F.array(column)), r"^\[|\]$", ""), F.lit("null"))
    return F.coalesce(column.cast("string"), F.lit("null"))


def row_hash(t: Table) -> Column:
    """The identity of a row's value: SHA-256 of its canonical text."""
    fields = sorted((f for f in t.rows.schema if not f.name.startswith("_")), key=lambda f: f.name)
    parts = [F.concat(F.lit(json.dumps(f.name) + ":"), canonical(F.col(f"`{f.name}`"), f.dataType)) for f in fields]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")), 256)


def hashes(t: Table) -> DataFrame:
    return t.rows.select(t.path().alias("path"), row_hash(t).alias("hash"))


def diff(before: Table, after: Table) -> DataFrame:
    """``(table, path, kind, from_path)``: added, removed, renamed or changed rows.

    A removed and an added row of one hash are a rename; with several, they pair up
    in the order of their paths.
    """
    b, a = hashes(before), hashes(after)
    both = b.select(F.col("path").alias("bp"), F.col("hash").alias("bh")).join(
        a.select(F.col("path").alias("ap"), F.col("hash").alias("ah")), F.col("bp") == F.col("ap"), "full"
    ).where("not (bh <=> ah)")
    both = cut(both)
    nth = lambda h, p: F.row_number().over(Window.partitionBy(h).orderBy(p))
    removed = both.where("ap is null").select("bp", "bh").withColumn("n", nth("bh", "bp"))
    added = both.where("bp is null").select("ap", "ah").withColumn("m", nth("ah", "ap"))
    pairs = removed.join(added, (F.col("bh") == F.col("ah")) & (F.col("n") == F.col("m")), "full")
    kind = F.when(F.col("bp").isNull(), "added").when(F.col("ap").isNull(), "removed").otherwise("renamed")
    name = F.lit(after.name).alias("table")
    moved = pairs.select(name, F.coalesce("ap", "bp").alias("path"), kind.alias("kind"), F.when(kind == "renamed", F.col("bp")).alias("from_path"))
    changed = both.where("ap is not null and bp is not null").select(name, F.col("ap").alias("path"), F.lit("changed").alias("kind"), F.lit(None).cast("string").alias("from_path"))
    return moved.unionAll(changed)


def _leaves(prefix: str, b: Column, a: Column, kind: T.DataType) -> list[tuple[str, Column, Column, T.DataType]]:
    if isinstance(kind, T.StructType):
        return [x for f in kind for x in _leaves(f"{prefix}/{f.name}", b[f.name], a[f.name], f.dataType)]
    return [(prefix, b, a, kind)]


def value_changes(before: Table, after: Table) -> DataFrame:
    """``(table, path, pointer, before, after)`` of rows on both sides; arrays compare whole."""
    image = lambda t, n: t.rows.select(t.path().alias(f"{n}_path"), F.struct(*(F.col(f"`{c}`") for c in t.rows.columns)).alias(n), row_hash(t).alias(f"{n}_hash"))
    both = image(before, "b").join(image(after, "a"), F.col("b_path") == F.col("a_path")).where("b_hash <> a_hash")
    cells = []
    for f in after.rows.schema:
        if f.name.startswith("_") or f.name not in before.rows.columns:
            continue
        for pointer, b, a, kind in _leaves(f"/{f.name}", F.col("b")[f.name], F.col("a")[f.name], f.dataType):
            b, a = canonical(b, kind), canonical(a, kind)
            cells.append(F.when(b != a, F.struct(F.lit(pointer).alias("pointer"), b.alias("before"), a.alias("after"))))
    found = both.select(F.lit(after.name).alias("table"), F.col("a_path").alias("path"), F.explode(F.array_compact(F.array(*cells))).alias("c"))
    return found.select("table", "path", "c.pointer", "c.before", "c.after")


def merge3(base: Table, ours: Table, theirs: Table) -> tuple[Table, DataFrame]:
    """The merged table and ``(path, pointer, base, ours, theirs)`` conflicts.

    Cell by cell: equal sides, or the side that changed; where both changed to
    different values, a conflict, and ours stays. Structs merge member by member.
    Rows are cells too: a row that one side removed and the other left alone goes.
    """
    names = ours.rows.columns
    image = lambda t, n: t.rows.select(t.key().alias(f"{n}_key"), t.path().alias(f"{n}_path"), F.struct(*(F.col(f"`{c}`") for c in names)).alias(n), row_hash(t).alias(f"{n}_hash"))
    all3 = image(base, "b").join(image(ours, "o"), F.col("b_key") == F.col("o_key"), "full")
    all3 = all3.withColumn("_k", F.coalesce("b_key", "o_key")).join(image(theirs, "t"), F.col("_k") == F.col("t_key"), "full")
    path = F.coalesce("o_path", "t_path", "b_path").alias("path")
    same_ot, same_bo, same_bt = (F.col(x).eqNullSafe(F.col(y)) for x, y in (("o_hash", "t_hash"), ("b_hash", "o_hash"), ("b_hash", "t_hash")))
    conflicts: list[Column] = []

    def cell(pointer: str, b: Column, o: Column, t: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            merged = F.struct(*(cell(f"{pointer}/{f.name}", b[f.name], o[f.name], t[f.name], f.dataType).alias(f.name) for f in kind))
            whole = _pick(pointer, b, o, t, kind, objects=True)
            return F.when(o.isNotNull() & t.isNotNull(), merged).otherwise(whole)
        return _pick(pointer, b, o, t, kind)

    def _pick(pointer: str, b: Column, o: Column, t: Column, kind: T.DataType, objects: bool = False) -> Column:
        cb, co, ct = (canonical(x, kind) for x in (b, o, t))
        clash = (co != ct) & (cb != co) & (cb != ct)
        if objects:
            clash = clash & (o.isNull() | t.isNull())
        conflicts.append(F.when(F.col("o").isNotNull() & F.col("t").isNotNull() & clash, F.struct(F.lit(pointer).alias("pointer"), cb.alias("base"), co.alias("ours"), ct.alias("theirs"))))
        return F.when(cb == co, t).otherwise(o)

    kinds = {f.name: f.dataType for f in ours.rows.schema}
    merged = F.struct(*(cell(f"/{c}", F.col("b")[c], F.col("o")[c], F.col("t")[c], kinds[c]).alias(c) for c in names))
    row = (
        F.when(same_ot | same_bt, F.col("o"))
        .when(same_bo, F.col("t"))
        .when(F.col("o").isNotNull() & F.col("t").isNotNull(), merged)
        .otherwise(F.col("o"))
    )
    opposed = ~same_ot & ~same_bt & ~same_bo
    one_gone = F.when(
        F.col("o").isNull() | F.col("t").isNull(),
        F.struct(F.lit("").alias("pointer"), F.col("b_hash").alias("base"), F.col("o_hash").alias("ours"), F.col("t_hash").alias("theirs")),
    )
    found = all3.where(opposed).select(path, F.explode(F.array_compact(F.array(one_gone, *conflicts))).alias("c")).select("path", "c.*")
    return Table(all3.select(row.alias("r")).where("r is not null").select("r.*"), ours.contract), found


# ---- revisions --------------------------------------------------------------


@dataclass(frozen=True)
class Revision:
    id: str
    number: int
    parents: tuple[str, ...]
    when: str
    message: str
    tables: tuple[str, ...]
    token: str
    key: str | None = None  # of an idempotent change
    #: of each table, a token of its rows and the revision whose directory holds them
    tokens: dict = field(default_factory=dict, hash=False)
    places: dict = field(default_factory=dict, hash=False)


class Store:
    """Revisions of a state in a folder that Spark reaches: directories of tables, and a log.

    A revision writes the tables that changed since the one before; of others its log
    entry names the directory that holds them.

    A revision's tables are written first and its log entry last, by one file that
    is created whole, so a reader sees a revision entirely or not at all.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _read(self, path) -> str:
        return self.spark.read.text(path.toString(), wholetext=True).first()[0]

    def log(self) -> list[Revision]:
        """Revisions, newest first."""
        at = self._path(f"{self.folder}/log")
        if not self._fs.exists(at):
            return []
        found = []
        for status in self._fs.listStatus(at):
            if status.getPath().getName().endswith(".json"):
                r = json.loads(self._read(status.getPath()))
                found.append(Revision(**{**r, "parents": tuple(r["parents"]), "tables": tuple(r["tables"])}))
        return sorted(found, key=lambda r: (r.number, r.id), reverse=True)

    def resolve(self, name: str) -> Revision:
        """A revision by ``#n`` or by four and more characters of its id."""
        log = self.log()
        hits = [r for r in log if name == f"#{r.number}" or len(name) >= 4 and r.id.startswith(name)]
        if len(hits) != 1:
            raise KeyError(f"UNKNOWN_REVISION: {name}")
        return hits[0]

    def commit(self, state: State, message: str = "", when: str = "", key: str | None = None, expect: str | None = None, tokens: dict[str, str] | None = None) -> Revision:
        """Records a state; a key seen before gives the earlier revision.

        ``tokens`` are those of tables for which they are known.
        """
        from .changes import table_token, token_of

        log = self.log()
        if key is not None and (seen := [r for r in log if r.key == key]):
            return seen[0]
        if expect is not None and (not log or log[0].token != expect):
            raise ValueError("PLAN_CHANGED: the state is not the expected one")
        tokens = {n: (tokens or {}).get(n) or table_token(t) for n, t in state.items()}
        token = token_of(tokens)
        parents = (log[0].id,) if log else ()
        number = log[0].number + 1 if log else 1
        rid = hashlib.sha256(f"{parents}{number}{token}{message}{uuid.uuid4().hex}".encode()).hexdigest()[:16]
        places = {}
        for n, t in state.items():
            if log and log[0].tokens.get(n) == tokens[n]:
                places[n] = log[0].places[n]
                continue
            t.rows.write.parquet(f"{self.folder}/states/{rid}/{n}")
            places[n] = rid
        revision = Revision(rid, number, parents, when, message, tuple(sorted(state)), token, key, tokens, places)
        out = self._fs.create(self._path(f"{self.folder}/log/{number:012d}-{rid}.json"), False)
        out.write(json.dumps(asdict(revision)).encode())
        out.close()
        return revision

    def show(self, name: str) -> dict[str, DataFrame]:
        r = self.resolve(name)
        return {n: self.spark.read.parquet(f"{self.folder}/states/{r.places.get(n, r.id)}/{n}") for n in r.tables}

    def tree_diff(self, before: str, after: str) -> dict[str, str]:
        """What became of each table between two revisions, from the log alone."""
        b, a = self.resolve(before).tokens, self.resolve(after).tokens
        return {n: "removed" if n not in a else "added" if n not in b else "same" if a[n] == b[n] else "changed" for n in sorted({*a, *b})}

    # ---- snapshots: names of revisions

    def _snapshot(self, name: str):
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", name):
            raise ValueError(f"{name!r} can't name a snapshot")
        return self._path(f"{self.folder}/snapshots/{name}.json")

    def snapshot(self, name: str, state: State, message: str = "") -> Revision:
        """Records a state under a name that isn't taken."""
        at = self._snapshot(name)
        if self._fs.exists(at):
            raise ValueError(f"SNAPSHOT_EXISTS: {name}")
        revision = self.commit(state, message or f"snapshot {name}")
        out = self._fs.create(at, False)
        out.write(json.dumps({"revision": revision.id}).encode())
        out.close()
        return revision

    def snapshots(self) -> dict[str, Revision]:
        at = self._path(f"{self.folder}/snapshots")
        if not self._fs.exists(at):
            return {}
        by = {r.id: r for r in self.log()}
        found = {s.getPath().getName().removesuffix(".json"): json.loads(self._read(s.getPath()))["revision"] for s in self._fs.listStatus(at) if s.getPath().getName().endswith(".json")}
        return {n: by[r] for n, r in sorted(found.items())}

    def drop_snapshot(self, name: str) -> None:
        """The name goes; the revision stays in the log."""
        if not self._fs.delete(self._snapshot(name), False):
            raise KeyError(f"UNKNOWN_SNAPSHOT: {name}")

    def restore(self, name: str, contracts: dict, message: str = "restore") -> Revision:
        """A new revision with an earlier one's rows."""
        state = {n: Table(df, contracts[n]) for n, df in self.show(name).items()}
        return self.commit(state, message)


def lineages(parents: DataFrame, starts: list[str], rounds: int = 100_000) -> DataFrame:
    """``(id, origin)``: each start's ancestors, itself too, a generation a round.

    Only the starts' own frontiers are walked, never the closure of the history.
    """
    spark = parents.sparkSession
    edges = cut(parents.select("id", "parent").distinct())
    reach = frontier = cut(spark.createDataFrame([(s, s) for s in starts], "id string, origin string"))
    for _ in range(rounds):
        up = frontier.join(edges, "id").select(F.col("parent").alias("id"), "origin").distinct()
        frontier = cut(up.join(reach, ["id", "origin"], "left_anti"))
        if frontier.isEmpty():
            return reach
        reach = cut(reach.unionAll(frontier))
    raise RuntimeError("the revision graph did not settle")


def merge_bases(parents: DataFrame, a: str, b: str) -> DataFrame:
    """Common ancestors that are ancestors of no other common one.

    All ancestors of a common one are common, so it is enough to leave out parents.
    """
    reach = lineages(parents, [a, b] if a != b else [a])
    n = 2 if a != b else 1
    common = cut(reach.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == n).select("id"))
    above = parents.join(common, "id", "left_semi").select(F.col("parent").alias("id")).distinct()
    return common.join(above, "id", "left_anti")
