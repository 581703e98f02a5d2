"""A DB-API 2.0 face of a database: connect, cursor, execute, fetch."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from ..operators.changes import ChangeRefused
from . import sqlfront, statements
from .database import Database

apilevel, threadsafety, paramstyle = "2.0", 1, "qmark"
Error, ProgrammingError, IntegrityError = Exception, sqlfront.QueryError, ChangeRefused


def connect(database: Database) -> Connection:
    return Connection(database)


class Connection:
    """Changes are kept apart until ``commit``, which judges them once."""

    def __init__(self, database: Database):
        self.database, self._state = database, None

    @property
    def state(self):
        return self.database.state if self._state is None else self._state

    def cursor(self) -> Cursor:
        return Cursor(self)

    def commit(self) -> None:
        if self._state is not None:
            self.database._admit(self._state)  # noqa: SLF001
            self._state = None

    def rollback(self) -> None:
        self._state = None

    def close(self) -> None:
        self.rollback()

    def __enter__(self) -> Connection:
        return self

    def __exit__(self, kind, *_) -> None:
        self.rollback() if kind else self.commit()


class Cursor:
    arraysize = 1

    def __init__(self, connection: Connection):
        self.connection = connection
        self.description: list[tuple] | None = None
        self._rows: Iterator = iter(())
        self.rowcount = -1

    def execute(self, sql: str, parameters: Sequence | dict = ()) -> Cursor:
        c = self.connection
        spark = c.database.spark
        if sqlfront.classify(sql) == "select":
            self._take(statements.select(spark, c.state, sql, parameters or None))
            return self
        if parameters:
            sql = bound(sql, list(parameters))
        done = statements.run(spark, c.state, sql)
        c._state = done.state  # noqa: SLF001
        self.rowcount = done.change.rows.count()
        if done.returning is not None:
            self._take(done.returning)
        else:
            self.description, self._rows = None, iter(())
        return self

    def executemany(self, sql: str, many: Sequence[Sequence]) -> Cursor:
        total = 0
        for parameters in many:
            self.execute(sql, parameters)
            total += max(self.rowcount, 0)
        self.rowcount = total
        return self

    def _take(self, df) -> None:
        self.description = [(f.name, f.dataType.simpleString(), None, None, None, None, f.nullable) for f in df.schema]
        # a partition at a time, so a large result isn't on the driver at once
        self._rows, self.rowcount = df.toLocalIterator(), -1

    def fetchone(self) -> tuple | None:
        row = next(self._rows, None)
        return None if row is None else tuple(row)

    def fetchmany(self, size: int | None = None) -> list[tuple]:
        out = []
        while len(out) < (size or self.arraysize) and (row := self.fetchone()) is not None:
            out.append(row)
        return out

    def fetchall(self) -> list[tuple]:
        return [tuple(r) for r in self._rows]

    def __iter__(self) -> Iterator[tuple]:
        return map(tuple, self._rows)

    def close(self) -> None:
        self._rows = iter(())


def literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def bound(sql: str, parameters: list) -> str:
    """A change's ``?`` marks as literals; marks in strings and comments are none."""
    out, left = [], list(parameters)
    for t in sqlfront.tokens(sql):
        if t.kind == "mark" and t.text == "?":
            if not left:
                raise sqlfront.QueryError("QUERY_UNSUPPORTED", "too few parameters")
            out.append(literal(left.pop(0)))
        else:
            out.append(t.text)
    if left:
        raise sqlfront.QueryError("QUERY_UNSUPPORTED", "too many parameters")
    return "".join(out)
