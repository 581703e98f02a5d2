"""Validation of whole states: keys, domains, references, graphs, checks, assertions.

Every rule is a DataFrame of findings with one schema, so a verdict is their
union. Rules look at keys and references only (narrow projections of the tables),
group with partial aggregates, and compare by the contract's keys: a decimal 1.50
and 1.5, or one instant in two offsets, are the same key.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exact
from ..plans import paths
from ..plans.contract import Contract, ForeignKey, Rule

FINDING = "severity string, code string, table string, path string, pointer string, constraint string, observed string, message string"


@dataclass(frozen=True)
class Table:
    """Rows and the contract they are held to; ``_path`` names a row's file, if it has one."""

    rows: DataFrame
    contract: Contract

    @property
    def name(self) -> str:
        return self.contract.table

    def key(self, columns: tuple[str, ...] | None = None) -> Column:
        names = columns or self.contract.key
        return exact.key_of([(F.col(f"`{n}`"), self.contract.column(n).kind) for n in names])

    def path(self) -> Column:
        parts = [F.col(f"`{k}`").cast("string") for k in self.contract.key]
        spelled = F.concat(F.lit(self.name + "/"), F.concat_ws(",", *parts), F.lit(".json"))
        return F.coalesce("_path", spelled) if "_path" in self.rows.columns else spelled

    def keys(self, columns: tuple[str, ...] | None = None) -> DataFrame:
        """``(table, path, key)`` of the rows that take part in a key."""
        return self.rows.select(F.lit(self.name).alias("table"), self.path().alias("path"), self.key(columns).alias("key")).where("key is not null")


State = dict[str, Table]


def no_findings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], FINDING)


def finding(df: DataFrame, code: str, constraint: str, message: Column, observed: Column, pointer: Column | None = None, severity: str = "error") -> DataFrame:
    return df.select(
        F.lit(severity).alias("severity"), F.lit(code).alias("code"), "table", "path",
        (F.lit("") if pointer is None else pointer).alias("pointer"), F.lit(constraint).alias("constraint"),
        observed.alias("observed"), message.alias("message"),
    )


def union(spark: SparkSession, parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, parts, no_findings(spark))


def duplicates(table: Table, columns: tuple[str, ...], code: str) -> DataFrame:
    """All holders of a key but the first by path.

    The first holder is a partial aggregate; only keys held more than once go
    through the join, so unique tables move one narrow row a key.
    """
    held = table.keys(columns)
    shared = held.groupBy("key").agg(F.min("path").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = held.join(shared, "key").withColumn("nth", F.row_number().over(Window.partitionBy("key", "path").orderBy(F.lit(1))))
    again = again.where("path <> first or nth > 1")
    name = f"{table.name} ({', '.join(columns)})"
    return finding(again, code, name, F.concat(F.col("key"), F.lit(" is held by "), F.col("first"), F.lit(" too")), F.col("key"))


def domain_clashes(spark: SparkSession, domain: str, members: list[Table], code: str = "DOMAIN_KEY_VIOLATION") -> DataFrame:
    """Keys held in two member tables: every holder outside the first holder's table."""
    if len(members) < 2:
        return no_findings(spark)
    held = reduce(DataFrame.unionAll, [m.keys() for m in members])
    shared = held.groupBy("key").agg(
        F.min(F.struct("path", "table")).alias("first"), F.min("table").alias("low"), F.max("table").alias("high")
    ).where("low <> high")
    again = held.join(shared, "key").where("table <> first.table")
    return finding(again, code, domain, F.concat(F.col("key"), F.lit(" is held by "), F.col("first.path"), F.lit(" too")), F.col("key"))


def references(table: Table, fk: ForeignKey) -> DataFrame:
    """``(table, path, pointer, key)``: one row for each reference a row makes."""
    kinds = [table.contract.leaf(p).kind for p in fk.paths]
    head = [F.lit(table.name).alias("table"), table.path().alias("path")]
    if len(fk.paths) == 1:
        found = table.rows.select(*head, F.explode(paths.occurrences(fk.paths[0])).alias("o"))
        return found.select("table", "path", F.col("o.pointer").alias("pointer"), exact.key_of([(F.col("o.value"), kinds[0])]).alias("key"))
    each = [F.get(paths.occurrences(p), F.lit(0)) for p in fk.paths]
    key = exact.key_of([(e["value"], k) for e, k in zip(each, kinds)])
    pointer = F.concat_ws(",", *(e["pointer"] for e in each))
    return table.rows.select(*head, pointer.alias("pointer"), key.alias("key")).where("key is not null")


def target_keys(state: State, fk: ForeignKey) -> DataFrame:
    """``(key)`` of all rows a foreign key may name."""
    if fk.domain is not None:
        names = [n for n, t in state.items() if t.contract.domain == fk.domain]
    else:
        names = list(fk.tables)
    return reduce(DataFrame.unionAll, [state[n].keys(fk.columns or None).select("key") for n in names])


def dangling(state: State, table: Table, fk: ForeignKey) -> DataFrame:
    """References that name no row: one anti-join on the key."""
    loose = references(table, fk).join(target_keys(state, fk), "key", "left_anti")
    to = fk.domain or " or ".join(fk.tables)
    name = f"{table.name}.{','.join(fk.sources)} -> {to}"
    return finding(loose, "FOREIGN_KEY_VIOLATION", name, F.concat(F.lit(f"no row of {to} has the key "), F.col("key")), F.col("key"), F.col("pointer"))


def broken_checks(table: Table, rule: Rule) -> DataFrame:
    """Rows for which the condition is false; null passes."""
    from ..plans import statements

    keyed = statements.with_keys(table)
    rows = keyed.where(~statements.scalar(keyed.sparkSession, table, rule.text)).select(F.lit(table.name).alias("table"), table.path().alias("path"))
    return finding(rows, "CHECK_VIOLATION", f"{table.name}.{rule.name}", F.lit(f"the row breaks {rule.text}"), F.lit(None).cast("string"))


def broken_assertions(spark: SparkSession, state: State, table: Table, rule: Rule) -> DataFrame:
    """Rows whose key the rule's query returns."""
    from ..plans import statements

    named = statements.select(spark, state, rule.text)
    kinds = [(F.col(c), k) for c, (_, k) in zip(named.columns, table.contract.key_kinds())]
    keys = named.select(exact.key_of(kinds).alias("key")).distinct()
    hit = table.keys().join(keys, "key", "left_semi")
    return finding(hit, "ASSERTION_VIOLATION", f"{table.name}.{rule.name}", F.lit(rule.message or f"the row breaks {rule.name}"), F.col("key"), severity=rule.severity)


def graph_edges(table: Table, edges: tuple[str, ...]) -> DataFrame:
    """``(a, b)``: from a row's key to the keys it names that exist."""
    kind = table.contract.column(table.contract.key[0]).kind
    found = [
        table.rows.select(table.key().alias("a"), F.explode(paths.occurrences(paths.parse(e))).alias("o")).select(
            "a", exact.key_of([(F.col("o.value"), kind)]).alias("b")
        )
        for e in edges
    ]
    return reduce(DataFrame.unionAll, found).where("a is not null and b is not null").distinct().join(
        table.keys().select(F.col("key").alias("b")), "b", "left_semi"
    )


def on_cycles(edges: DataFrame, rounds: int = 10_000) -> DataFrame:
    """``(node, next, cycle)`` of real cycles; empty exactly if the graph has none.

    Nodes without a way in or out are stripped until none is left. Each node of the
    rest has a way on; following the least one leads onto a cycle, found by
    doubling the steps. ``cycle`` is its least node.
    """
    left = _kept(edges.select("a", "b"))
    n = left.count()
    for _ in range(rounds):
        ways_in, ways_out = left.select(F.col("b").alias("a")).distinct(), left.select(F.col("a").alias("b")).distinct()
        left = _kept(left.join(ways_in, "a", "left_semi").join(ways_out, "b", "left_semi").select("a", "b"))
        before, n = n, left.count()
        if n == before or not n:
            break
    else:
        raise RuntimeError(f"the graph was not stripped in {rounds} rounds")
    step = _kept(left.groupBy("a").agg(F.min("b").alias("b")))
    jump = step.select("a", "b", F.least("a", "b").alias("low"))
    reach, size = 1, step.count()
    while reach < size:
        far = jump.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("low").alias("low2"))
        jump = _kept(jump.join(far, "b").select("a", F.col("c").alias("b"), F.least("low", "low2").alias("low")))
        reach *= 2
    ends = jump.select(F.col("b").alias("a")).distinct()
    return step.join(ends, "a", "left_semi").join(jump.select("a", "low"), "a").select(F.col("a").alias("node"), F.col("b").alias("next"), F.col("low").alias("cycle"))


def _kept(df: DataFrame) -> DataFrame:
    from .durable import cut

    return cut(df)


def cycles(table: Table, name: str, edges: tuple[str, ...]) -> DataFrame:
    """One finding for each cycle, at its least node's row."""
    found = on_cycles(graph_edges(table, edges))
    members = found.groupBy("cycle").agg(F.array_join(F.sort_array(F.collect_list("node")), ", ").alias("members"), F.count(F.lit(1)).alias("n"))
    at = table.keys().join(members, F.col("key") == F.col("cycle"))
    return finding(at, "CYCLE_VIOLATION", f"{table.name}.{name}", F.concat(F.lit(f"{name} must be acyclic, but these form a cycle: "), F.col("members")), F.col("members"))


def folded_names(table: Table, strict: bool = False) -> DataFrame:
    """Paths equal but for case or Unicode form, against the least of their group."""
    held = table.rows.select(F.lit(table.name).alias("table"), table.path().alias("path"))
    folded = held.withColumn("fold", F.lower(exact.nfc("path")))
    shared = folded.groupBy("fold").agg(F.min("path").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = folded.join(shared, "fold").where("path <> first")
    return finding(again, "PORTABILITY_COLLISION", table.name, F.concat(F.lit("the name equals that of "), F.col("first"), F.lit(" but for case or form")), F.col("first"), severity="error" if strict else "warning")


def judge(
    spark: SparkSession, state: State, row_findings: dict[str, DataFrame] | None = None, only: set[str] | None = None, columns: dict[str, set[str]] | None = None
) -> DataFrame:
    """The verdict on a state: all findings of all rules.

    ``only`` names the tables that a change touched, and ``columns`` the columns it
    assigned in tables whose rows it neither added nor took away: rules that look at
    none of them are left out, as their findings can't have changed.
    """
    parts = list((row_findings or {}).values())

    def hit(name: str, *names: str) -> bool:
        """Whether a change can matter to what looks at these columns of a table."""
        return only is None or name in only and (columns is None or name not in columns or not columns[name].isdisjoint(names))

    def targeted(names: list[str], fk: ForeignKey) -> bool:
        return any(hit(n, *(fk.columns or state[n].contract.key)) for n in names if n in state)

    domains: dict[str, list[Table]] = {}
    for t in state.values():
        c = t.contract
        if c.domain:
            domains.setdefault(c.domain, []).append(t)
        if hit(t.name, *c.key):
            parts.append(duplicates(t, c.key, "PRIMARY_KEY_VIOLATION"))
        parts += [duplicates(t, u, "UNIQUE_VIOLATION") for u in c.unique if hit(t.name, *u)]
        parts += [cycles(t, a.name, a.edges) for a in c.acyclic if hit(t.name, *c.key, *(paths.parse(e)[0].name for e in a.edges))]
        parts += [broken_checks(t, r) for r in c.checks if hit(t.name, *re.findall(r"\w+", r.text))]
        for fk in c.foreign_keys:
            if not _targets_known(state, fk):
                continue
            if hit(t.name, *(p[0].name for p in fk.paths)) or targeted(targets_of(state, fk), fk):
                parts.append(dangling(state, t, fk))
            if len(fk.tables) > 1 and targeted(list(fk.tables), fk):
                parts.append(domain_clashes(spark, ", ".join(sorted(fk.tables)), [state[n] for n in sorted(fk.tables)], "SCHEMA_TARGET_KEYS_OVERLAP"))
        for r in c.assertions:
            words = set(re.findall(r"\w+", r.text))
            seen = [n for n in {t.name, *state} if n in words or n == t.name]
            if any(hit(n, *(state[n].rows.columns if "*" in r.text else words)) for n in seen):
                parts.append(broken_assertions(spark, state, t, r))
    parts += [domain_clashes(spark, d, members) for d, members in domains.items() if any(hit(m.name, *m.contract.key) for m in members)]
    return union(spark, parts)


def targets_of(state: State, fk: ForeignKey) -> list[str]:
    if fk.domain is not None:
        return [n for n, t in state.items() if t.contract.domain == fk.domain]
    return list(fk.tables)


def _targets_known(state: State, fk: ForeignKey) -> bool:
    if fk.domain is not None:
        return any(t.contract.domain == fk.domain for t in state.values())
    return all(n in state for n in fk.tables)


def in_order(findings: DataFrame) -> DataFrame:
    return findings.orderBy("path", "pointer", "code", "constraint", "message")


def scoped(state: State, table: str, touched: DataFrame) -> State:
    """The state with one table cut to the rows whose key is in ``touched``.

    For rules that look at a row and what it names; keys and targets still come
    from whole tables.
    """
    t = state[table]
    rows = t.rows.withColumn("_k", t.key()).join(touched.select(F.col("key").alias("_k")), "_k", "left_semi").drop("_k")
    return state | {table: Table(rows, t.contract)}
