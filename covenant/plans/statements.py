"""Statements that change a state: read from tokens, run as changes."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exact, sqlfunctions
from ..operators import changes, referential
from ..operators.changes import Change, ChangeRefused
from ..operators.validate import State, Table
from . import sqlfront, translate
from .sqlfront import QueryError, Token, tokens

def kinds_of(t: Table) -> dict[str, str | None]:
    """A table's columns and what they are: exact by contract, else by their type."""
    by_type = {"long": "int", "integer": "int", "short": "int", "byte": "int", "double": "real", "float": "real", "string": "text", "boolean": "bool", "binary": "blob", "array": "array"}
    out: dict[str, str | None] = {}
    for f in t.rows.schema:
        if f.name.startswith("_"):
            continue
        kind = t.contract.column(f.name).kind if t.contract.has(f.name) else ""
        out[f.name] = translate.KINDS[kind] if translate.KINDS.get(kind) in translate.EXACT else by_type.get(f.dataType.typeName())
    return out


def with_keys(t: Table) -> DataFrame:
    """The table's rows with a hidden key beside each exact column."""
    return t.rows.withColumns({translate.HIDDEN + n: exact.sort_key(F.col(f"`{n}`"), t.contract.column(n).kind) for n, k in kinds_of(t).items() if k in translate.EXACT})


def translated(spark: SparkSession, state: State, sql: str, args: list | dict | None = None) -> DataFrame:
    """A query of the dialect over a state's tables, with parameters as values."""
    if sqlfront.classify(sql) != "select":
        raise QueryError("QUERY_UNSUPPORTED", "only a SELECT is a query")
    tr = translate.Translator(sql, {n: kinds_of(t) for n, t in state.items()}, args)
    text, _ = tr.select(None, "top")
    if tr.peek().kind != "none":
        raise QueryError("QUERY_UNSUPPORTED", f"{tr.peek().text!r} where the query should end")
    sqlfunctions.register(spark, tr.functions)
    text = text.replace("{", "{{").replace("}", "}}")
    heads = ", ".join(f"`{n}` AS (SELECT * FROM {{{n}}})" for n in sorted(tr.used))
    if heads:
        m = re.match(r"WITH (RECURSIVE )?", text)
        text = f"WITH {m[1] or ''}{heads}, {text[m.end():]}" if m else f"WITH {heads} {text}"
    frames = {n: with_keys(state[n]) for n in tr.used}
    args = {k: v for k, v in tr.args.items() if re.search(rf":{re.escape(k)}\b", text)}
    return spark.sql(text if frames else text.replace("{{", "{").replace("}}", "}"), args=args or None, **frames)


def select(spark: SparkSession, state: State, sql: str, args: list | dict | None = None) -> DataFrame:
    """A SELECT over a state, exact columns compared by value."""
    return translated(spark, state, sql, args)


def explained(spark: SparkSession, state: State, sql: str, mode: str = "formatted") -> str:
    """The plan of a query, as Spark words it."""
    df = select(spark, state, re.sub(r"^\s*EXPLAIN(\s+QUERY\s+PLAN)?\s+", "", sql, flags=re.I))
    return spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def scalar(spark: SparkSession, t: Table, expr: str, extra: dict[str, dict[str, str | None]] | None = None) -> Column:
    """An expression over a table's row (with its hidden keys) as a Column."""
    tr = translate.Translator(expr, {})
    out = tr.expr(translate.Scope({t.name: kinds_of(t), **(extra or {})}, named={}))
    if tr.peek().kind != "none":
        raise QueryError("QUERY_UNSUPPORTED", f"{tr.peek().text!r} where the expression should end")
    sqlfunctions.register(spark, tr.functions)
    return F.expr(out.sql.replace(f"`{t.name}`.", ""))


# ---- changes ----------------------------------------------------------------


@dataclass(frozen=True)
class Parsed:
    op: str
    table: str
    columns: tuple[str, ...] = ()
    source: str = ""
    assign: tuple[tuple[str, str], ...] = ()
    where: str = ""
    conflict: str = "error"
    returning: str = ""
    head: str = ""


def _split_at(ts: list[Token], *words: str) -> dict[str, list[Token]]:
    """The tokens after each of the words that stand outside brackets, and those before."""
    out: dict[str, list[Token]] = {"": []}
    depth, now, i = 0, "", 0
    while i < len(ts):
        t = ts[i]
        depth += (t.text == "(") - (t.text == ")")
        hit = next((w for w in words if depth == 0 and [x.word for x in ts[i : i + len(w.split())]] == w.split() and w not in out), None)
        if hit:
            now = hit
            out[now] = []
            i += len(hit.split())
            continue
        out[now].append(t)
        i += 1
    return out


def _text(ts: list[Token]) -> str:
    """Tokens as text again; signs that were one are kept apart from names."""
    return " ".join(t.text for t in ts).replace(" . ", ".").replace(" (", "(").replace("( ", "(").replace(" )", ")")


def _commas(ts: list[Token]) -> list[list[Token]]:
    depth, out = 0, [[]]
    for t in ts:
        depth += (t.text == "(") - (t.text == ")")
        if t.text == "," and depth == 0:
            out.append([])
        else:
            out[-1].append(t)
    return out


def _name(t: Token) -> str:
    return t.text[1:-1] if t.kind == "quoted" else t.text


def parse(sql: str) -> Parsed:
    """An INSERT, REPLACE, UPDATE or DELETE."""
    ts = [t for t in tokens(sql) if t.kind != "space"]
    if ts and ts[0].word == "WITH":  # the expressions go in front of the change's queries
        depth = 0
        for i, t in enumerate(ts):
            depth += (t.text == "(") - (t.text == ")")
            if depth == 0 and t.word in sqlfront.WRITES:
                return replace(parse(_text(ts[i:])), head=_text(ts[:i]) + " ")
    op = ts[0].word
    if op == "DELETE":
        p = _split_at(ts[2:], "WHERE", "RETURNING")
        return Parsed("delete", _name(p[""][0]), where=_text(p.get("WHERE", [])), returning=_text(p.get("RETURNING", [])))
    if op == "UPDATE":
        p = _split_at(ts[1:], "SET", "WHERE", "RETURNING")
        return Parsed("update", _name(p[""][0]), assign=_assigned(p["SET"]), where=_text(p.get("WHERE", [])), returning=_text(p.get("RETURNING", [])))
    p = _split_at(ts, "INTO", "ON CONFLICT", "RETURNING")
    conflict = "replace" if op == "REPLACE" or any(t.word == "REPLACE" for t in p[""]) else "nothing" if any(t.word == "IGNORE" for t in p[""]) else "error"
    body = p["INTO"]
    table, rest = _name(body[0]), body[1:]
    columns: tuple[str, ...] = ()
    if rest and rest[0].text == "(":
        end = next(i for i, t in enumerate(rest) if t.text == ")")
        columns = tuple(_name(t) for t in rest[1:end] if t.text != ",")
        rest = rest[end + 1 :]
    assign: tuple = ()
    if "ON CONFLICT" in p:
        c = _split_at(p["ON CONFLICT"], "DO NOTHING", "DO UPDATE SET")
        conflict = "nothing" if "DO NOTHING" in c else "update"
        assign = _assigned(c.get("DO UPDATE SET", []))
    return Parsed("insert", table, columns, _text(rest), assign, conflict=conflict, returning=_text(p.get("RETURNING", [])))


def _assigned(ts: list[Token]) -> tuple[tuple[str, str], ...]:
    return tuple((_name(part[0]), _text(part[2:])) for part in _commas(ts) if part)


@dataclass(frozen=True)
class Outcome:
    state: State
    change: Change
    induced: DataFrame
    returning: DataFrame | None
    table: str = ""
    #: the columns that an UPDATE assigned; null for a change of whole rows
    assigned: frozenset[str] | None = None


def _condition(spark: SparkSession, state: State, t: Table, p: Parsed) -> tuple[Table, Column]:
    """The condition as a Column; one with a subquery is decided by key beforehand."""
    keyed = Table(with_keys(t), t.contract)
    if not p.where:
        return keyed, F.lit(True)
    if re.search(r"\bselect\b", p.where, re.I):
        hits = select(spark, state, f"{p.head}SELECT {', '.join(t.contract.key)} FROM {t.name} WHERE {p.where}")
        marked = hits.distinct().withColumn("_hit", F.lit(True))
        rows = keyed.rows.join(marked, list(t.contract.key), "left").select(*(f"`{c}`" for c in keyed.rows.columns), "_hit")
        return Table(rows, t.contract), F.coalesce("_hit", F.lit(False))
    return keyed, scalar(spark, t, p.where)


def run(spark: SparkSession, state: State, sql: str) -> Outcome:
    """One change, completed with the referential actions it calls for."""
    p = parse(sql)
    if p.table not in state:
        raise QueryError("UNKNOWN_TABLE", p.table)
    t = state[p.table]
    names = t.rows.columns
    if p.op == "insert":
        new = _new_rows(spark, state, t, p)
        sides = {"excluded": kinds_of(t), "old": kinds_of(t)}
        assign = {n: scalar(spark, Table(t.rows, t.contract), _old(e, t), sides) for n, e in p.assign}
        change = changes.insert(t, new, p.conflict, assign)
    else:
        marked, where = _condition(spark, state, t, p)
        for n, _ in p.assign:
            t.contract.column(n)
        if p.op == "delete":
            change = changes.delete(marked, where)
        else:
            change = changes.update(marked, where, {n: scalar(spark, t, e) for n, e in p.assign})
        change = Change(Table(change.after.rows.select(*(f"`{c}`" for c in names)), t.contract), change.rows)
    after = state | {p.table: change.after}
    none = spark.createDataFrame([], referential.INDUCED)
    e = referential.Expansion(after, none, none)
    if _vacates(state, t, p):
        image = lambda side: F.struct(*(F.col(f"{side}.`{c}`") for c in names))
        vacating = change.rows.where("op <> 'insert'")
        moved = vacating.select(F.when(F.col("before").isNotNull(), image("before")).alias("b"), F.when(F.col("after").isNotNull(), image("after")).alias("a"))
        e = referential.expand(spark, after, {p.table: moved})
        first = e.refused.orderBy("path", "constraint").first()
        if first is not None:
            raise ChangeRefused("FOREIGN_KEY_VIOLATION", f"{first['path']} still refers to {first['key']} ({first['constraint']}, {first['action']})")
    out = None
    if p.returning:
        shown = names if p.returning.strip() == "*" else [x.strip() for x in p.returning.split(",")]
        out = change.returning(*(scalar(spark, t, x) if x not in names else F.col(f"`{x}`") for x in shown))
    return Outcome(e.state, change, e.induced, out, p.table, frozenset(n for n, _ in p.assign) if p.op == "update" else None)


def _vacates(state: State, t: Table, p: Parsed) -> bool:
    """Whether a change can take away a key that a reference names."""
    if p.op == "insert":
        return False
    named = [fk for x in state.values() for fk in x.contract.foreign_keys if t.name in fk.tables or fk.domain and fk.domain == t.contract.domain]
    keys = {c for fk in named for c in (fk.columns or t.contract.key)}
    return bool(named) and (p.op == "delete" or not keys.isdisjoint(n for n, _ in p.assign))


def _old(expr: str, t: Table) -> str:
    """An upsert's expression: a bare column is the held row's."""
    ts = [x for x in tokens(expr)]
    out = []
    for i, x in enumerate(ts):
        bare = x.kind == "name" and x.text in t.rows.columns and (i == 0 or ts[i - 1].text != ".")
        out.append(f"old.{x.text}" if bare else x.text)
    return "".join(out).replace(f"{t.name}.old.", "old.").replace(f"{t.name}.", "old.")


def _new_rows(spark: SparkSession, state: State, t: Table, p: Parsed) -> DataFrame:
    if p.source.upper().startswith("DEFAULT"):
        raise QueryError("QUERY_UNSUPPORTED", "DEFAULT VALUES names no member")
    named = p.columns or tuple(c for c in t.rows.columns if not c.startswith("_"))
    unknown = [c for c in named if c not in t.rows.columns]
    if unknown:
        raise QueryError("UNKNOWN_COLUMN", f"{t.name} has no column {unknown[0]!r}")
    df = select(spark, state, p.head + p.source)
    if len(df.columns) != len(named):
        raise QueryError("QUERY_TYPE_ERROR", f"{len(df.columns)} values for {len(named)} columns")
    return df.toDF(*named)
