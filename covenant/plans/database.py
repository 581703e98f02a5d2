"""The database: a state held to its contracts, with everything one does to it."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes, profile, states, validate
from ..operators.changes import ChangeRefused
from ..operators.validate import State, Table
from . import migrate, rowtext, sqlfront, statements
from .contract import Contract, ContractError, cross_check


class Database:
    """Tables with contracts. Reads are DataFrames; a change is judged before it takes effect."""

    def __init__(self, spark: SparkSession, state: State, store: states.Store | None = None, row_findings: dict[str, DataFrame] | None = None):
        self.spark, self.state, self.store = spark, dict(state), store
        self._known: dict[str, tuple[Table, str]] = {}
        #: what the files broke when they were read, and the state that was
        self.row_findings, self.opened = row_findings or {}, dict(self.state)
        problems = cross_check({n: t.contract for n, t in self.state.items()})
        if problems:
            raise ContractError(problems[0].code, "", problems[0].message)

    # ---- opening ------------------------------------------------------------

    @classmethod
    def open(cls, spark: SparkSession, root: str, store: str | None = None) -> Database:
        """A folder of JSON files: pinned contracts from ``schema/``, others inferred."""
        from ..sources import folder
        from .contract import decode

        pinned = folder.contracts(spark, root)
        state, findings = {}, {}
        for name in folder.discover(spark, root):
            c = pinned.get(name) or decode(folder.infer(spark, root, name), inferred=True)
            state[name] = folder.table(spark, root, c)
            findings[name] = folder.judged(spark, root, c)
        return cls(spark, state, states.Store(spark, store) if store else None, findings)

    # ---- reading ------------------------------------------------------------

    def tables(self) -> list[str]:
        return sorted(self.state)

    def table(self, name: str) -> Table:
        if name not in self.state:
            raise sqlfront.QueryError("UNKNOWN_TABLE", name)
        return self.state[name]

    def describe(self, name: str) -> DataFrame:
        c = self.table(name).contract
        rows = [(x.name, x.kind, x.nullable, x.required, x.name in c.key, x.generated) for x in c.columns]
        return self.spark.createDataFrame(rows, "column string, type string, nullable boolean, required boolean, key boolean, generated string")

    def query(self, sql: str, args: list | dict | None = None) -> DataFrame:
        return statements.select(self.spark, self.state, sql, args)

    def one(self, sql: str, args: list | dict | None = None):
        rows = self.query(sql, args).take(2)
        if len(rows) != 1:
            raise sqlfront.QueryError("UNKNOWN_ROW", f"{'no' if not rows else 'more than one'} row")
        return rows[0]

    def scalar(self, sql: str, args: list | dict | None = None):
        return self.one(sql, args)[0]

    def get(self, name: str, *key: object):
        t = self.table(name)
        where = F.lit(True)
        for k, v in zip(t.contract.key, key, strict=True):
            where = where & (F.col(f"`{k}`") == F.lit(v))
        rows = t.rows.where(where).take(1)
        if not rows:
            raise sqlfront.QueryError("UNKNOWN_ROW", f"{name} holds no {list(key)}")
        return rows[0]

    def list(self, name: str, where: str | None = None, order: str | None = None, limit: int | None = None) -> DataFrame:
        """Rows by a condition, in the order of ``[-]column`` (default: the key)."""
        t = self.table(name)
        terms = order.split(",") if order else list(t.contract.key)
        by = ", ".join(f"{x.strip().removeprefix('-')}{' DESC' if x.strip().startswith('-') else ''}" for x in terms)
        cap = f" LIMIT {limit}" if limit is not None else ""
        return self.query(f"SELECT * FROM {name}{f' WHERE {where}' if where else ''} ORDER BY {by}{cap}")

    def explain(self, sql: str) -> str:
        return statements.explained(self.spark, self.state, sql)

    def page(self, sql: str, order: list, skip: int, take: int, cursor: str | None = None) -> tuple[DataFrame, bool, str]:
        """A window of a result and the state's token; a token of another state is refused."""
        token = self.token()
        if cursor is not None and cursor != token:
            raise sqlfront.QueryError("CURSOR_STALE", "the state has changed")
        window, more = sqlfront.page(self.query(sql), order, skip, take)
        return window, more, token

    def _tokens(self) -> dict[str, str]:
        """Tokens by table; a table that didn't change since is not read again."""
        self._known = {n: k for n, k in self._known.items() if self.state.get(n) is k[0]}
        for n, t in self.state.items():
            if n not in self._known:
                self._known[n] = (t, changes.table_token(t))
        return {n: k[1] for n, k in self._known.items()}

    def token(self) -> str:
        return changes.token_of(self._tokens())

    # ---- judging ------------------------------------------------------------

    def _rows_judged(self) -> dict[str, DataFrame]:
        """Row findings of the state as it is: those of the opening, but for rows written since."""
        out = {}
        for n, found in self.row_findings.items():
            now, then = self.state.get(n), self.opened.get(n)
            if now is None:
                continue
            if now is not then and then is not None and now.rows.columns == then.rows.columns:
                moved = rowtext.changed(then, now)
                written = rowtext.image(then, moved, "before")
                gone = written.select(Table(written, then.contract).path().alias("path")).distinct()
                found = found.join(gone, "path", "left_anti").select(*found.columns)
                found = found.unionAll(rowtext.findings(now, rowtext.image(now, moved, "after")))
            elif now is not then:
                found = rowtext.findings(now, now.rows)
            out[n] = found
        return out

    def check(self) -> DataFrame:
        return validate.in_order(validate.judge(self.spark, self.state, self._rows_judged()))

    def valid(self) -> bool:
        return validate.judge(self.spark, self.state, self._rows_judged()).where("severity = 'error'").isEmpty()

    def lint(self, options: profile.Options = profile.Options()) -> DataFrame:
        parts = [profile.lint(self.spark, t, options) for t in self.state.values()]
        parts += [profile.wider_types(self.spark, t) for t in self.state.values()]
        parts.append(profile.discover_references(self.spark, self.state))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionAll(p)
        return out

    def status(self) -> dict:
        found = self.check().groupBy("severity").count().collect()
        return {"tables": {n: t.rows.count() for n, t in self.state.items()}, "findings": {r[0]: r[1] for r in found}, "state": self.token()}

    def analyze(self, name: str) -> dict[str, int]:
        return profile.statistics(self.table(name))

    # ---- changing -----------------------------------------------------------

    def _admit(self, new: State, dry_run: bool = False, written: dict[str, DataFrame] | None = None, columns: dict[str, set[str]] | None = None) -> State:
        """Findings that a change introduces refuse it; those that were there before don't.

        ``written`` has the changed rows of tables where they are known; of others they
        are found by key. ``columns`` has the assigned columns of tables whose rows
        stayed, for rules that look at others needn't be asked again. The state before is judged only if the new one has errors.
        """
        touched = {n for n in {*new, *self.state} if new.get(n) is not self.state.get(n)}
        moved = {}
        for n in touched & set(new):
            if new[n].contract.document:
                moved[n] = (written or {}).get(n)
                if moved[n] is None:
                    moved[n] = rowtext.changed(self.state.get(n), new[n])
        rows = {n: rowtext.findings(new[n], rowtext.image(new[n], d, "after")) for n, d in moved.items()}
        same = ["code", "path", "pointer", "constraint", "observed"]
        keyed = lambda d: d.where("severity = 'error'").select(*(F.coalesce(c, F.lit("")).alias(c) for c in same), "message")
        after = keyed(validate.judge(self.spark, new, rows, only=touched, columns=columns))
        if not after.isEmpty():
            known = {n: d for n, d in moved.items() if n in self.state and self.state[n].rows.columns == new[n].rows.columns}
            held = {n: rowtext.findings(self.state[n], rowtext.image(self.state[n], d, "before")) for n, d in known.items()}
            before = keyed(validate.judge(self.spark, self.state, held, only=touched, columns=columns))
            worse = after.join(before.drop("message"), same, "left_anti").orderBy("path", "code").first()
            if worse is not None:
                raise ChangeRefused(worse["code"], f"{worse['path']}{worse['pointer']}: {worse['message']}")
        if not dry_run:
            self.state = new
        return new

    def execute(self, sql: str, dry_run: bool = False, expect: str | None = None) -> list[DataFrame | None]:
        """A script as one transaction: each statement sees the ones before, the end is judged once."""
        if expect is not None and expect != self.token():
            raise ChangeRefused("PLAN_CHANGED", "the state is not the expected one")
        parts, commit = sqlfront.script(sql)
        state, out = dict(self.state), []
        written: dict[str, DataFrame | None] = {}
        columns: dict[str, set[str] | None] = {}
        for s in parts:
            if sqlfront.classify(s) == "select":
                out.append(statements.select(self.spark, state, s))
                continue
            done = statements.run(self.spark, state, s)
            for n in done.state:
                if done.state[n] is not state.get(n):  # known rows only where one statement alone wrote
                    own = n == done.table and done.state[n] is done.change.after
                    written[n] = done.change.rows if own and n not in written else None
                    known = columns.get(n, set()) if own and done.assigned is not None else None
                    columns[n] = known | done.assigned if known is not None else None
            state = done.state
            out.append(done.returning)
        if commit:
            self._admit(state, dry_run, written, {n: c for n, c in columns.items() if c is not None})
        return out

    @contextlib.contextmanager
    def transaction(self) -> Iterator[Database]:
        """Changes inside are kept together if the state they make is valid."""
        inside = Database(self.spark, self.state, None, {})
        inside._admit = lambda new, dry_run=False, written=None, columns=None: inside.state.update(new) or [inside.state.pop(n) for n in set(inside.state) - set(new)] or new  # noqa: SLF001
        yield inside
        self._admit(inside.state)

    def insert(self, name: str, rows: DataFrame, on_conflict: str = "error") -> changes.Change:
        c = changes.insert(self.table(name), rows, on_conflict)
        self._admit(self.state | {name: c.after}, written={name: c.rows})
        return c

    def update(self, name: str, where: Column, assign: dict[str, Column]) -> DataFrame:
        from ..operators import referential

        t = self.table(name)
        if set(assign) & set(t.contract.key):
            e = referential.rekey_rows(self.spark, self.state, name, where, assign)
            self._refuse(e)
            self._admit(e.state)
            return e.induced
        c = changes.update(t, where, assign)
        self._admit(self.state | {name: c.after}, written={name: c.rows})
        return c.rows

    def delete(self, name: str, where: Column) -> DataFrame:
        from ..operators import referential

        e = referential.delete_rows(self.spark, self.state, name, where)
        self._refuse(e)
        self._admit(e.state)
        return e.induced

    @staticmethod
    def _refuse(e) -> None:
        first = e.refused.orderBy("path").first()
        if first is not None:
            raise ChangeRefused("FOREIGN_KEY_VIOLATION", f"{first['path']} still refers to {first['key']} ({first['constraint']})")

    def import_(self, name: str, rows: DataFrame, mode: str = "insert") -> dict[str, int]:
        c, counts = changes.import_rows(self.table(name), rows, mode)
        found = {r["op"]: r["n"] for r in counts.collect()}
        self._admit(self.state | {name: c.after}, written={name: c.rows})
        return found

    def export(self, name: str, path: str, kind: str = "jsonl", where: Column | None = None, order: list | None = None) -> None:
        from ..sources import transfer

        transfer.export(self.table(name), path, kind, where, order)

    def migrate(self, *steps: tuple) -> None:
        """Operations by name with their arguments; all are applied, or none."""
        state = dict(self.state)
        for op, *args in steps:
            state = getattr(migrate, op)(state, *args)
        problems = cross_check({n: t.contract for n, t in state.items()})
        if problems:
            raise migrate.MigrationRefused(problems[0].message, problems[0].code)
        self._admit(state)

    def pin(self, name: str) -> Contract:
        """An inferred contract becomes a declared one."""
        t = self.table(name)
        self.state[name] = Table(t.rows, replace(t.contract, inferred=False))
        return self.state[name].contract

    # ---- history ------------------------------------------------------------

    def commit(self, message: str = "", key: str | None = None, expect: str | None = None) -> states.Revision:
        if self.store is None:
            raise RuntimeError("the database was opened without a store")
        return self.store.commit(self.state, message, key=key, expect=expect, tokens=self._tokens())

    def snapshot(self, name: str, message: str = "") -> states.Revision:
        """Records the state under a name."""
        if self.store is None:
            raise RuntimeError("the database was opened without a store")
        return self.store.snapshot(name, self.state, message)

    def log(self) -> list[states.Revision]:
        return self.store.log() if self.store else []

    def at(self, revision: str) -> State:
        return {n: Table(df, self.state[n].contract) for n, df in self.store.show(revision).items()}

    def diff(self, before: str | State, after: str | State | None = None) -> DataFrame:
        """Differences of two revisions or states, table by table."""
        b = self.at(before) if isinstance(before, str) else before
        a = self.state if after is None else self.at(after) if isinstance(after, str) else after
        parts = [states.diff(b[n], a[n]) for n in sorted(set(a) & set(b))]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionAll(p)
        return out

    def restore(self, revision: str) -> None:
        self._admit(self.at(revision))

    def merge(self, base: State, theirs: State) -> DataFrame:
        """Takes their changes since ``base``; conflicts keep ours and are returned."""
        merged, conflicts = dict(self.state), None
        for n in sorted(set(self.state) & set(base) & set(theirs)):
            merged[n], found = states.merge3(base[n], self.state[n], theirs[n])
            conflicts = found if conflicts is None else conflicts.unionAll(found)
        self._admit(merged)
        return conflicts
