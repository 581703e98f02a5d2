"""Paths into rows: ``a.b``, ``a[].b``, ``a[?f='v'].b``; parsed, and compiled to Columns."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"""(?P<name>[A-Za-z_][A-Za-z0-9_]*|"(?:[^"\\]|\\.)*")
        (?:(?P<all>\[\])|\[\?(?P<field>[A-Za-z_][A-Za-z0-9_]*|"(?:[^"\\]|\\.)*")=
        (?P<literal>'(?:[^']|'')*'|-?[0-9][0-9.eE+-]*|true|false|null)\])?(?P<dot>\.|$)""",
    re.X,
)


@dataclass(frozen=True)
class Segment:
    name: str
    iterates: bool = False
    field: str | None = None
    value: object = None


Path = tuple[Segment, ...]


class PathError(ValueError):
    pass


def _name(token: str) -> str:
    return json.loads(token) if token.startswith('"') else token


def _literal(token: str) -> object:
    return token[1:-1].replace("''", "'") if token.startswith("'") else json.loads(token)


def parse(text: str) -> Path:
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise PathError(f"can't read {text!r} at {at}")
        filtered = m["field"] is not None
        out.append(
            Segment(_name(m["name"]), bool(m["all"]) or filtered, _name(m["field"]) if filtered else None, _literal(m["literal"]) if filtered else None)
        )
        at = m.end()
        if m["dot"] == "." and at == len(text):
            raise PathError(f"{text!r} ends with a dot")
    if not out:
        raise PathError("an empty path")
    return tuple(out)


def text(path: Path) -> str:
    def one(s: Segment) -> str:
        name = s.name if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", s.name) else json.dumps(s.name)
        if s.field is not None:
            value = "'" + s.value.replace("'", "''") + "'" if isinstance(s.value, str) else json.dumps(s.value)
            return f"{name}[?{s.field}={value}]"
        return name + "[]" * s.iterates

    return ".".join(map(one, path))


def iterates(path: Path) -> bool:
    return any(s.iterates for s in path)


def _escaped(name: str) -> str:
    return name.replace("~", "~0").replace("/", "~1")


def occurrences(path: Path, root: Column | None = None, pointer: Column | None = None) -> Column:
    """All values at a path: an array of ``(pointer, value)``, nulls left out."""
    here, rest = path[0], path[1:]
    member = F.col(f"`{here.name}`") if root is None else root[here.name]
    at = F.concat(F.lit("") if pointer is None else pointer, F.lit("/" + _escaped(here.name)))
    if not here.iterates:
        if rest:
            return occurrences(rest, member, at)
        one = F.array(F.struct(at.alias("pointer"), member.cast("string").alias("value")))
        return F.filter(one, lambda e: e["value"].isNotNull())
    numbered = F.coalesce(F.transform(member, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), F.array())
    if here.field is not None:
        numbered = F.filter(numbered, lambda e: e["x"][here.field] == F.lit(here.value))
    place = lambda e: F.concat(at, F.lit("/"), e["i"].cast("string"))
    if rest:
        return F.flatten(F.transform(numbered, lambda e: occurrences(rest, e["x"], place(e))))
    found = F.transform(numbered, lambda e: F.struct(place(e).alias("pointer"), e["x"].cast("string").alias("value")))
    return F.filter(found, lambda e: e["value"].isNotNull())


def get(value: object, path: Path, pointer: str = "") -> list[tuple[str, object]]:
    """The same over a plain Python value."""
    here, rest = path[0], path[1:]
    if not isinstance(value, dict) or value.get(here.name) is None:
        return []
    member, at = value[here.name], f"{pointer}/{_escaped(here.name)}"
    if not here.iterates:
        return get(member, rest, at) if rest else [(at, member)]
    found = []
    for i, x in enumerate(member if isinstance(member, list) else []):
        if here.field is not None and not (isinstance(x, dict) and x.get(here.field) == here.value):
            continue
        found += get(x, rest, f"{at}/{i}") if rest else [(f"{at}/{i}", x)] if x is not None else []
    return found
