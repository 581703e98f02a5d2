"""JSON functions over texts: reading by built-in functions, editing in batches of Python.

Paths are ``$``, ``$.member``, ``$."member"``, ``$[n]`` and ``$[#-n]`` steps. Texts
keep their numbers as written wherever they aren't replaced.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

ColumnLike = Column | str


def _c(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---- reading, by built-in functions -----------------------------------------


def extract(x: ColumnLike, path: str) -> Column:
    """``json_extract`` and ``->>``: a scalar's text, a container's JSON; null if absent or null."""
    return F.get_json_object(_c(x), path)


def valid(x: ColumnLike) -> Column:
    return F.when(_c(x).isNotNull(), F.try_parse_json(_c(x)).isNotNull())


def array_length(x: ColumnLike, path: str = "$") -> Column:
    """The number of elements; 0 for what is no array; null if absent."""
    inner = _c(x) if path == "$" else F.get_json_object(_c(x), path)
    return F.when(inner.isNull(), None).otherwise(F.coalesce(F.json_array_length(inner), F.lit(0)))


def array(*xs: ColumnLike) -> Column:
    return F.to_json(F.array(*map(_c, xs)))


def object_(**members: ColumnLike) -> Column:
    return F.to_json(F.struct(*(_c(v).alias(k) for k, v in members.items())), {"ignoreNullFields": "false"})


def minified(x: ColumnLike) -> Column:
    """``json``: the text without white space outside strings."""
    return _edit(lambda v: v)(_c(x))


# ---- values with numbers as written -----------------------------------------


class _Number(float):
    """A number that is written out as it was read."""

    def __new__(cls, text: str):
        self = super().__new__(cls, text)
        self.text = text
        return self

    def __repr__(self) -> str:
        return self.text


def loads(text: str) -> object:
    return json.loads(text, parse_float=_Number, parse_int=lambda t: _Number(t) if len(t) > 15 else int(t))


def dumps(v: object, indent: int | None = None) -> str:
    if isinstance(v, _Number):
        return v.text
    if isinstance(v, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{dumps(x)}" for k, x in v.items()) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(dumps, v)) + "]"
    return json.dumps(v, ensure_ascii=False)


def pretty(v: object, level: int = 0) -> str:
    pad, end = "    " * (level + 1), "    " * level
    if isinstance(v, dict) and v:
        inner = ",\n".join(f"{pad}{json.dumps(k, ensure_ascii=False)}: {pretty(x, level + 1)}" for k, x in v.items())
        return "{\n" + inner + "\n" + end + "}"
    if isinstance(v, list) and v:
        return "[\n" + ",\n".join(pad + pretty(x, level + 1) for x in v) + "\n" + end + "]"
    return dumps(v)


STEP = re.compile(r'\.(?:"((?:[^"\\]|\\.)*)"|([^.\[\]"]+))|\[(?:(\d+)|#(?:-(\d+))?)\]')


def steps(path: str) -> list[str | int | None]:
    """Members by name, elements by number (negative from the end), None for ``[#]``."""
    if not path.startswith("$"):
        raise ValueError(f"{path!r} doesn't start with $")
    at, out = 1, []
    while at < len(path):
        m = STEP.match(path, at)
        if not m:
            raise ValueError(f"can't read {path!r} at {at}")
        quoted, name, number, back = m.groups()
        out.append(name if name is not None else quoted if quoted is not None else int(number) if number is not None else -int(back) if back else None)
        at = m.end()
    return out


def _place(v: list, step: int | None) -> int:
    return len(v) if step is None else step + len(v) if step < 0 else step


def edited(v: object, path: list, new: object, make: bool, replace: bool) -> object:
    """The value with ``new`` at the path; ``make`` and ``replace`` tell when."""
    if not path:
        return new if replace else v
    step, rest = path[0], path[1:]
    if isinstance(step, str):
        if not isinstance(v, dict):
            return v
        if step in v:
            return {**v, step: edited(v[step], rest, new, make, replace)}
        return {**v, step: _made(rest, new)} if make else v
    if not isinstance(v, list):
        return v
    i = _place(v, step)
    if 0 <= i < len(v):
        return [*v[:i], edited(v[i], rest, new, make, replace), *v[i + 1 :]]
    return [*v, _made(rest, new)] if make and i == len(v) else v


def _made(path: list, new: object) -> object:
    for step in reversed(path):
        new = {step: new} if isinstance(step, str) else [new]
    return new


def removed(v: object, path: list) -> object:
    if not path:
        return None
    step, rest = path[0], path[1:]
    if isinstance(step, str) and isinstance(v, dict) and step in v:
        return {k: removed(x, rest) if k == step else x for k, x in v.items() if rest or k != step}
    if not isinstance(step, str) and isinstance(v, list) and 0 <= (i := _place(v, step)) < len(v):
        return [removed(x, rest) if j == i else x for j, x in enumerate(v) if rest or j != i]
    return v


def patched(target: object, patch: object) -> object:
    """A merge patch: members that are null go, objects merge, all else replaces."""
    if not isinstance(patch, dict):
        return patch
    out = dict(target) if isinstance(target, dict) else {}
    for k, x in patch.items():
        if x is None:
            out.pop(k, None)
        else:
            out[k] = patched(out.get(k), x)
    return out


def type_name(v: object) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, _Number):
        return "real" if any(c in v.text for c in ".eE") else "integer"
    return {int: "integer", float: "real", str: "text", list: "array", dict: "object"}[type(v)]


# ---- editing and asking, in batches -----------------------------------------


def _edit(change: Callable[[object], object], show: Callable[[object], str] = dumps):
    # a function of a series: Spark runs all those of a projection in one worker a task, iterators in one each
    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else _tried(t, change, show))

    return run


def _tried(text: str, change: Callable, show: Callable) -> str | None:
    try:
        return show(change(loads(text)))
    except ValueError:
        return None


def set_(x: ColumnLike, path: str, value: object) -> Column:
    p = steps(path)
    return _edit(lambda v: edited(v, p, value, True, True))(_c(x))


def insert(x: ColumnLike, path: str, value: object) -> Column:
    p = steps(path)
    return _edit(lambda v: edited(v, p, value, True, False))(_c(x))


def replace(x: ColumnLike, path: str, value: object) -> Column:
    p = steps(path)
    return _edit(lambda v: edited(v, p, value, False, True))(_c(x))


def remove(x: ColumnLike, *paths: str) -> Column:
    ps = [steps(p) for p in paths]

    def run(v: object) -> object:
        for p in ps:
            v = removed(v, p)
        return v

    return _edit(run)(_c(x))


def patch(x: ColumnLike, other: object) -> Column:
    return _edit(lambda v: patched(v, other))(_c(x))


def pretty_(x: ColumnLike) -> Column:
    return _edit(lambda v: v, pretty)(_c(x))


def quote(x: ColumnLike) -> Column:
    """A text as a JSON string."""
    return F.regexp_replace(F.to_json(F.array(_c(x).cast("string"))), r"^\[|\]$", "")


def _at(v: object, path: list) -> tuple[bool, object]:
    for step in path:
        if isinstance(step, str) and isinstance(v, dict) and step in v:
            v = v[step]
        elif not isinstance(step, str) and isinstance(v, list) and 0 <= (i := _place(v, step)) < len(v):
            v = v[i]
        else:
            return False, None
    return True, v


def type_of(x: ColumnLike, path: str = "$") -> Column:
    """``json_type``: the type's name at a path, null if nothing is there."""
    p = steps(path)

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if t is None:
                return None
            try:
                there, v = _at(loads(t), p)
            except ValueError:
                return None
            return type_name(v) if there else None

        return texts.map(one)

    return run(_c(x))


def error_position(x: ColumnLike) -> Column:
    """0 for valid JSON, else the character (from 1) at which reading stops."""

    @F.pandas_udf(LongType())
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> int | None:
            if t is None:
                return None
            try:
                json.loads(t)
            except json.JSONDecodeError as e:
                return e.pos + 1
            return 0

        return texts.map(one)

    return run(_c(x))


# ---- table-valued -----------------------------------------------------------

ROW = StructType(
    [
        StructField("key", StringType()), StructField("value", StringType()), StructField("type", StringType()),
        StructField("atom", StringType()), StructField("id", LongType()), StructField("parent", LongType()),
        StructField("fullkey", StringType()), StructField("path", StringType()),
    ]
)


def _named(path: str, key: str | int) -> str:
    if isinstance(key, int):
        return f"{path}[{key}]"
    return f"{path}.{key}" if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", key) else f"{path}.{json.dumps(key, ensure_ascii=False)}"


def _shown(v: object) -> str | None:
    if v is None:
        return None
    return v if isinstance(v, str) else ("1" if v else "0") if isinstance(v, bool) else dumps(v)


def rows_of(text: str | None, deep: bool) -> list[tuple]:
    """The rows of ``json_each`` (one level) or ``json_tree`` (all, the root too)."""
    if text is None:
        return []
    try:
        root = loads(text)
    except ValueError:
        return []
    out: list[tuple] = []

    def visit(v: object, key: str | int | None, parent: int | None, full: str, path: str, depth: int) -> None:
        number = len(out)
        if deep or depth == 1 or depth == 0 and not isinstance(v, (dict, list)):
            atom = None if isinstance(v, (dict, list)) else _shown(v)
            shown = dumps(v) if isinstance(v, (dict, list)) else _shown(v)
            out.append((None if key is None else str(key), shown, type_name(v), atom, number, parent if deep else None, full, path))
        if deep or depth == 0:
            inner = v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ()
            for k, x in inner:
                visit(x, k, number if deep else None, _named(full, k), full, depth + 1)

    visit(root, None, None, "$", "$", 0)
    return out


def _table(deep: bool):
    @F.pandas_udf(ArrayType(ROW))
    def run(texts: pd.Series) -> pd.Series:
        names = ROW.fieldNames()
        return texts.map(lambda t: [dict(zip(names, r)) for r in rows_of(t, deep)])

    return run


def each(df: DataFrame, column: str) -> DataFrame:
    """The rows of ``df`` joined with ``json_each`` of a column (``key``, ``value``, ``type``, ...)."""
    return df.withColumn("_j", F.explode(_table(False)(F.col(column)))).select("*", "_j.*").drop("_j")


def tree(df: DataFrame, column: str) -> DataFrame:
    """The rows of ``df`` joined with ``json_tree`` of a column."""
    return df.withColumn("_j", F.explode(_table(True)(F.col(column)))).select("*", "_j.*").drop("_j")
