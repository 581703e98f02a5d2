"""Widening and tightening contracts.

Widening finds the least change of a schema that admits given rows: each round
looks at the first fault of each place and loosens the rule that it broke, until
nothing is broken. Tightening goes the other way, from what the data would bear.
"""

from __future__ import annotations

import copy

from pyspark.sql import DataFrame

from ..operators.validate import Table
from . import jsonschema, paths
from .contract import Contract, decode

ROUNDS = 16
BOUNDS = {"maxLength": len, "minLength": len, "maxItems": len, "minItems": len, "maxProperties": len, "minProperties": len}


class CannotWiden(ValueError):
    pass


def _walk(schema: dict, pointer: str) -> tuple[dict, str, dict | None]:
    """The subschema at a value's pointer, the member's name, and the schema around it."""
    at, around, name = schema, None, ""
    for part in pointer.split("/")[1:]:
        part = part.replace("~1", "/").replace("~0", "~")
        around, name = at, part
        if part in at.get("properties", {}):
            at = at["properties"][part]
        elif part.isdigit() and "prefixItems" in at and int(part) < len(at["prefixItems"]):
            at = at["prefixItems"][int(part)]
        elif part.isdigit() and isinstance(at.get("items"), dict):
            at = at["items"]
        elif isinstance(at.get("additionalProperties"), dict):
            at = at["additionalProperties"]
        else:
            return {}, part, at
    return at, name, around


def _value(row: object, pointer: str) -> object:
    for part in pointer.split("/")[1:]:
        part = part.replace("~1", "/").replace("~0", "~")
        row = row[int(part)] if isinstance(row, list) else row.get(part)
    return row


def loosened(schema: dict, row: object, fault: jsonschema.Fault, add_members: bool = False) -> str:
    """Changes ``schema`` so that one fault is none; says what was done."""
    pointer, keyword, message = fault
    if keyword == "required":
        name = message.split("'")[1]
        at, _, _ = _walk(schema, pointer)
        at["required"] = [x for x in at["required"] if x != name]
        return f"{pointer}/{name} is optional"
    if keyword == "additionalProperties":
        _, name, around = _walk(schema, pointer)
        if not add_members:
            raise CannotWiden(f"UNKNOWN_COLUMN: {name}")
        around.setdefault("properties", {})[name] = {}
        return f"{pointer} is declared"
    at, _, _ = _walk(schema, pointer)
    value = _value(row, pointer)
    if keyword in ("type", "x-type"):
        kinds = at.get("type", [])
        kinds = [kinds] if isinstance(kinds, str) else list(kinds)
        new = jsonschema.type_of(value)
        if keyword == "type" and new == "number" and jsonschema.number(value) == jsonschema.number(value).to_integral_value():
            new = "integer"
        if keyword == "type":
            kinds = [k for k in kinds if not (k == "integer" and new == "number")] + [new]
            at["type"] = kinds[0] if len(kinds) == 1 else kinds
        if keyword == "x-type" or "null" != new:
            for k in [k for k in at if k.startswith("x-")]:
                del at[k]
        return f"{pointer} admits {new}"
    if keyword in ("maximum", "exclusiveMaximum", "minimum", "exclusiveMinimum"):
        at.pop(keyword)
        number = jsonschema.number(value)
        at["maximum" if "aximum" in keyword else "minimum"] = int(number) if number == number.to_integral_value() else float(number)
        return f"{pointer} reaches {value}"
    if keyword in BOUNDS:
        at[keyword] = len(value)
        return f"{pointer} has {keyword} {len(value)}"
    if keyword == "enum":
        at["enum"] = [*at["enum"], value]
        return f"{pointer} lists {value!r}"
    owner = at if keyword in at else None
    if owner is None:
        raise CannotWiden(f"{pointer}: {keyword} can't be loosened")
    del owner[keyword]
    return f"{pointer} has no {keyword}"


def admit(document: dict, rows: list[object], add_members: bool = False) -> tuple[dict, list[str]]:
    """The least widening found that admits all rows, and its steps."""
    schema, steps = copy.deepcopy(document), []
    for row in rows:
        for _ in range(ROUNDS):
            faults = jsonschema.Validator(schema).faults(row)
            if not faults:
                break
            steps.append(loosened(schema, row, faults[0], add_members))
        else:
            raise CannotWiden(f"{ROUNDS} rounds weren't enough")
    return schema, steps


def widened(document: dict, member: str, null: bool = False, optional: bool = False, kind: str | None = None, anything: bool = False) -> dict:
    """One member, named by a path, widened by hand."""
    schema = copy.deepcopy(document)
    at, around, name = schema, None, ""
    for s in paths.parse(member):
        around, name = at, s.name
        if s.name not in at.get("properties", {}):
            raise CannotWiden(f"UNKNOWN_COLUMN: {member}")
        at = at["properties"][s.name]
        if s.iterates:
            around, name, at = at, "items", at.get("items", {})
    if anything:
        (around if name == "items" else around["properties"])[name] = {}
        return schema
    if optional:
        around["required"] = [x for x in around.get("required", []) if x != name]
    new = "null" if null else kind
    if new:
        if "type" not in at:
            raise CannotWiden(f"{member} states no type")
        kinds = [at["type"]] if isinstance(at["type"], str) else list(at["type"])
        at["type"] = kinds if new in kinds else [*kinds, new]
        if len(at["type"]) == 1:
            at["type"] = at["type"][0]
        if kind:
            for k in [k for k in at if k.startswith("x-")]:
                del at[k]
    return schema


def tightened(t: Table, proposals: DataFrame, wanted: tuple[str, ...] = ("enum", "unique", "checks", "min_items")) -> Contract:
    """The contract with what lint proposes: enums, unique columns, bounds, least sizes.

    Of a proposed enum the values are collected: at most as many as lint admits.
    """
    document = copy.deepcopy(t.contract.document)
    extension = next(k for k, v in document.items() if k.startswith("x-") and isinstance(v, dict) and "table" in v)
    facts = document[extension]
    for r in proposals.collect():  # a few rows a column
        if r["table"] != t.name:
            continue
        at = document["properties"].get(r["column"])
        if r["code"] == "LINT_ENUM_CANDIDATE" and "enum" in wanted and at is not None:
            held = t.rows.select(r["column"]).where(f"`{r['column']}` is not null").distinct().limit(int(r["detail"]) + 1).collect()
            at["enum"] = sorted(x[0] for x in held) + ([None] if "null" in at.get("type", []) else [])
        elif r["code"] == "LINT_UNIQUE_CANDIDATE" and "unique" in wanted:
            facts["unique"] = [*facts.get("unique", []), [r["column"]]]
        elif r["code"] == "LINT_CHECK_CANDIDATE" and "checks" in wanted:
            facts["checks"] = [*facts.get("checks", []), {"name": f"{r['column'].lower()}_bound", "expr": f"{r['column']} {r['detail']}"}]
        elif r["code"] == "LINT_MIN_ITEMS_CANDIDATE" and "min_items" in wanted and at is not None:
            at["minItems"] = int(r["detail"])
    return decode(document, t.contract.inferred)
