"""Shapes: the least description of JSON values, joined as a semilattice.

A shape counts what it has seen, so joining is adding: commutative, associative,
and any order of partitions gives the same result. A table's shape is folded in
each partition and the few partition shapes are joined in a tree; no row leaves
its executor.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exact

# The written forms that strings are tried for, in order of preference.
FORMS = (
    ("timestamp", re.compile(exact.TIMESTAMP)), ("date", re.compile(exact.DATE)), ("uuid", re.compile(exact.UUID)), ("ulid", re.compile(exact.ULID)),
)
#: An object is a map rather than a record beyond so many names, none of which half of its instances have.
MAP_NAMES = 32


class Lexeme(str):
    """A number as it is written."""


def parse(text: str) -> object:
    """JSON with numbers kept as written."""
    return json.loads(text, parse_float=Lexeme, parse_int=Lexeme, parse_constant=_refuse)


def _refuse(name: str) -> object:
    raise ValueError(f"{name} is no JSON")


def number_class(text: str) -> str:
    """``int``, ``integer`` (beyond 64 bits), or ``float`` by spelling."""
    if any(c in text for c in ".eE"):
        return "float"
    return "int" if -(1 << 63) <= int(text) < 1 << 63 else "integer"


@dataclass
class Shape:
    """What has been seen at a place; all counts are of instances."""

    n: int = 0
    nulls: int = 0
    bools: int = 0
    numbers: dict[str, int] = field(default_factory=dict)
    strings: int = 0
    forms: dict[str, int] = field(default_factory=dict)
    arrays: int = 0
    items: Shape | None = None
    shortest: int | None = None
    objects: int = 0
    members: dict[str, Shape] = field(default_factory=dict)

    # -- the semilattice ------------------------------------------------------

    def observe(self, value: object) -> Shape:
        self.n += 1
        if value is None:
            self.nulls += 1
        elif isinstance(value, bool):
            self.bools += 1
        elif isinstance(value, (Lexeme, int, float)):
            kind = number_class(str(value))
            self.numbers[kind] = self.numbers.get(kind, 0) + 1
        elif isinstance(value, str):
            self.strings += 1
            for name, pattern in FORMS:
                if pattern.match(value):
                    self.forms[name] = self.forms.get(name, 0) + 1
        elif isinstance(value, list):
            self.arrays += 1
            self.items = self.items or Shape()
            self.shortest = len(value) if self.shortest is None else min(self.shortest, len(value))
            for x in value:
                self.items.observe(x)
        else:
            self.objects += 1
            for k, x in value.items():
                self.members.setdefault(k, Shape()).observe(x)
        return self

    def join(self, other: Shape) -> Shape:
        """The least shape above both; neither is changed."""
        add = lambda a, b: {k: a.get(k, 0) + b.get(k, 0) for k in sorted({*a, *b})}
        both = [x for x in (self.items, other.items) if x is not None]
        least = [x for x in (self.shortest, other.shortest) if x is not None]
        names = sorted({*self.members, *other.members})
        return Shape(
            self.n + other.n, self.nulls + other.nulls, self.bools + other.bools, add(self.numbers, other.numbers),
            self.strings + other.strings, add(self.forms, other.forms), self.arrays + other.arrays,
            Shape().join(both[0]).join(both[1]) if len(both) == 2 else both[0] if both else None, min(least, default=None),
            self.objects + other.objects,
            {k: self.members.get(k, Shape()).join(other.members.get(k, Shape())) for k in names},
        )

    # -- what it says ---------------------------------------------------------

    def kinds(self) -> list[str]:
        """JSON types seen, null apart."""
        seen = (("boolean", self.bools), ("number", sum(self.numbers.values())), ("string", self.strings), ("array", self.arrays), ("object", self.objects))
        return [k for k, n in seen if n]

    def number(self) -> str:
        """int below integer; float apart from both; all else is number."""
        seen = {k for k, n in self.numbers.items() if n}
        if seen == {"int"}:
            return "int"
        if seen <= {"int", "integer"}:
            return "integer"
        return "float" if seen == {"float"} else "number"

    def form(self) -> str:
        return next((name for name, _ in FORMS if self.strings and self.forms.get(name, 0) == self.strings), "string")

    def is_map(self) -> bool:
        return len(self.members) > MAP_NAMES and all(2 * m.n <= self.objects for m in self.members.values())

    def kind(self) -> str:
        """The column type."""
        kinds = self.kinds()
        if len(kinds) != 1:
            return "json"
        return {"boolean": "bool", "number": self.number(), "string": self.form()}.get(kinds[0], kinds[0])

    def subschema(self) -> dict:
        """The JSON Schema that admits exactly what this shape says."""
        kinds = self.kinds()
        if len(kinds) != 1:
            return {} if kinds or not self.nulls else {"type": "null"}
        null = lambda k: [k, "null"] if self.nulls else k
        kind = self.kind()
        if kind == "bool":
            return {"type": null("boolean")}
        if kind in ("int", "float"):
            return {"type": null("integer" if kind == "int" else "number"), "x-type": kind}
        if kind in ("integer", "number"):
            return {"type": null(kind)}
        if kind in ("timestamp", "date", "uuid"):
            return {"type": null("string"), "format": "date-time" if kind == "timestamp" else kind}
        if kind == "ulid":
            return {"type": null("string"), "x-type": "ulid"}
        if kind == "string":
            return {"type": null("string")}
        if kind == "array":
            return {"type": null("array"), "items": self.items.subschema() if self.items and self.items.n else {}}
        if self.is_map():
            values = Shape()
            for m in self.members.values():
                values = values.join(m)
            return {"type": null("object"), "additionalProperties": values.subschema()}
        return {
            "type": null("object"),
            "properties": {k: self.members[k].subschema() for k in sorted(self.members)},
            "required": [k for k in sorted(self.members) if self.members[k].n == self.objects],
            "additionalProperties": False,
        }

    def admits(self, value: object) -> bool:
        """Whether a value changes nothing the shape says."""
        return Shape().join(self).observe(value).subschema() == self.subschema()

    def widening_for(self, value: object) -> Shape | None:
        """The least shape that admits the value too; None if this one does."""
        wide = Shape().join(self).observe(value)
        return None if wide.subschema() == self.subschema() else wide

    # -- carrying it ----------------------------------------------------------

    def to_dict(self) -> dict:
        out = {k: v for k, v in self.__dict__.items() if k not in ("items", "members")}
        return out | {"items": self.items.to_dict() if self.items else None, "members": {k: m.to_dict() for k, m in self.members.items()}}

    @staticmethod
    def from_dict(d: dict) -> Shape:
        inner = {"items": Shape.from_dict(d["items"]) if d["items"] else None, "members": {k: Shape.from_dict(m) for k, m in d["members"].items()}}
        return Shape(**{**d, **inner})


def of_values(values: Iterable[object]) -> Shape:
    shape = Shape()
    for v in values:
        shape.observe(v)
    return shape


#: Partition shapes that one task joins.
FAN_IN = 64


def of_column(df: DataFrame, column: str) -> Shape:
    """The shape of a column of JSON texts; texts that aren't JSON are left out.

    Texts are observed where they are. Shapes meet in groups of ``FAN_IN`` until few
    are left, so the driver gets a bounded number of them.
    """

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shape = Shape()
        for part in parts:
            for text in part.iloc[:, 0]:
                try:
                    shape.observe(parse(text))
                except (ValueError, TypeError, RecursionError):
                    continue
        yield pd.DataFrame({"shape": [json.dumps(shape.to_dict())]})

    def meet(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shape = Shape()
        for part in parts:
            for text in part.iloc[:, 0]:
                shape = shape.join(Shape.from_dict(json.loads(text)))
        yield pd.DataFrame({"shape": [json.dumps(shape.to_dict())]})

    shapes = df.select(F.col(column).alias("text")).mapInPandas(fold, "shape string")
    parts = df.rdd.getNumPartitions() if not df.isStreaming else 1
    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        shapes = shapes.repartition(parts).mapInPandas(meet, "shape string")
    whole = Shape()
    for row in shapes.collect():
        whole = whole.join(Shape.from_dict(json.loads(row["shape"])))
    return whole


def identity_of(table: str, shape: Shape, names: list[tuple[str, dict]] | None = None) -> str | None:
    """The key column by convention: ``id``, ``<singular>_id``, then the first that fits."""
    fit = [k for k, m in shape.members.items() if m.n == shape.objects and not m.nulls and m.kind() in ("string", "int", "integer", "uuid", "ulid", "date", "timestamp")]
    if names is not None:
        fit = [k for k in fit if all(str(row.get(k)) == name for name, row in names)]
    singular = table[:-3] + "y" if table.endswith("ies") else table[:-1] if table.endswith("s") else table
    for preferred in ("id", f"{singular}_id"):
        if preferred in fit:
            return preferred
    return fit[0] if fit else None


def contract_document(table: str, shape: Shape, key: str | None) -> dict:
    """An inferred contract's document."""
    body = shape.subschema()
    identity = {"source": "body", "columns": [key], "naming": {"rule": "percent"}} if key else {"source": "filename", "column": "id", "type": "string"}
    return {**body, "x-covenant": {"table": table, "identity": identity}}
