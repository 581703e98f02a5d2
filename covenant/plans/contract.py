"""Contracts: what a table's rows must look like and how tables relate.

A contract is decoded from a JSON Schema document whose extension member (the one
that starts with ``x-`` and names a ``table``) holds the relational facts, or is
made from a DataFrame's schema. Decoding refuses what is not understood; checks
that need other contracts are in :func:`cross_check`.
"""

from __future__ import annotations

import difflib
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

from . import paths

# The sixteen column types; those that can be keys; actions.
TYPES = (
    "bool", "int", "integer", "float", "number", "decimal", "string", "bytes", "date", "timestamp", "uuid", "ulid",
    "enum", "array", "object", "json",
)
SCALARS = frozenset(TYPES) - {"array", "object", "json"}
KEY_TYPES = SCALARS - {"float", "number", "bool", "bytes"}
ACTIONS = ("restrict", "no_action", "cascade", "remove", "set_null", "set_default")
GENERATORS = {"uuid": "uuid", "ulid": "ulid", "now": "timestamp", "sequence": "int"}
NAME = re.compile(r"^[a-z][a-z0-9_]*$")
FORMATS = {"date": "date", "date-time": "timestamp", "uuid": "uuid"}
TAGS = {"int": "integer", "float": "number", "decimal": "string", "ulid": "string"}


class ContractError(ValueError):
    def __init__(self, code: str, pointer: str, message: str):
        super().__init__(f"{code} at {pointer or '/'}: {message}")
        self.code, self.pointer, self.message = code, pointer, message


@dataclass(frozen=True)
class Column:
    name: str
    kind: str
    nullable: bool = False
    required: bool = False
    default: object = None
    has_default: bool = False
    generated: str | None = None
    items: Column | None = None
    properties: tuple[Column, ...] = ()
    positional: bool = False  # an array typed by position
    schema: dict = field(default_factory=dict, hash=False, compare=False)

    def spark_type(self) -> T.DataType:
        plain = {"bool": T.BooleanType(), "int": T.LongType(), "float": T.DoubleType(), "number": T.DoubleType()}
        if self.kind in plain:
            return plain[self.kind]
        if self.kind == "array" and self.items is not None and self.items.kind != "json":
            return T.ArrayType(self.items.spark_type())
        if self.kind == "object" and self.properties:
            return T.StructType([T.StructField(c.name, c.spark_type()) for c in self.properties])
        return T.StringType()


@dataclass(frozen=True)
class ForeignKey:
    name: str
    sources: tuple[str, ...]
    tables: tuple[str, ...] = ()
    domain: str | None = None
    columns: tuple[str, ...] = ()
    on_delete: str = "restrict"
    on_update: str = "restrict"
    declared: frozenset[str] = frozenset()  # the actions that were written out

    @property
    def paths(self) -> list[paths.Path]:
        return [paths.parse(s) for s in self.sources]


@dataclass(frozen=True)
class Rule:
    """A check (``text`` is a condition) or an assertion (``text`` is a query)."""

    name: str
    text: str
    severity: str = "error"
    message: str | None = None


@dataclass(frozen=True)
class Acyclic:
    name: str
    edges: tuple[str, ...]


@dataclass(frozen=True)
class Contract:
    table: str
    columns: tuple[Column, ...]
    key: tuple[str, ...]
    identity: str = "body"  # or filename
    unique: tuple[tuple[str, ...], ...] = ()
    indexes: tuple[tuple[str, ...], ...] = ()
    domain: str | None = None
    foreign_keys: tuple[ForeignKey, ...] = ()
    acyclic: tuple[Acyclic, ...] = ()
    checks: tuple[Rule, ...] = ()
    assertions: tuple[Rule, ...] = ()
    inferred: bool = False
    closed: bool = True  # no member beyond the declared ones
    naming: dict = field(default_factory=lambda: {"rule": "percent"}, hash=False)
    version: int = 1
    description: str | None = None
    document: dict | None = field(default=None, hash=False, compare=False)

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name == name:
                return c
        near = difflib.get_close_matches(name, [c.name for c in self.columns], 1)
        raise ContractError("SCHEMA_COLUMN_UNKNOWN", "", f"{self.table} has no column {name!r}" + (f"; did you mean {near[0]!r}?" if near else ""))

    def has(self, name: str) -> bool:
        return any(c.name == name for c in self.columns)

    def key_kinds(self) -> list[tuple[str, str]]:
        return [(k, self.column(k).kind) for k in self.key]

    def spark_schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.spark_type()) for c in self.columns])

    def leaf(self, path: paths.Path) -> Column:
        """The scalar that a path ends at."""
        at: Column | None = None
        members: tuple[Column, ...] = self.columns
        for k, s in enumerate(path):
            found = next((c for c in members if c.name == s.name), None)
            if found is None:
                raise ContractError("SCHEMA_REFERENCE_PATH_INVALID", "", f"{self.table}: {paths.text(path)} names no member {s.name!r}")
            at = found
            if s.iterates:
                if found.kind != "array" or found.items is None:
                    raise ContractError("SCHEMA_REFERENCE_PATH_INVALID", "", f"{self.table}: {s.name!r} is no declared array")
                at = found.items
            members = at.properties
        if at is None or at.kind not in SCALARS:
            raise ContractError("SCHEMA_REFERENCE_PATH_INVALID", "", f"{self.table}: {paths.text(path)} ends at no scalar")
        return at


def _members(value: object, allowed: set[str], pointer: str) -> dict:
    if not isinstance(value, dict):
        raise ContractError("SCHEMA_GRAMMAR", pointer, "an object is needed")
    for k in value:
        if k not in allowed:
            near = difflib.get_close_matches(k, sorted(allowed), 1)
            raise ContractError("SCHEMA_UNKNOWN_KEY", f"{pointer}/{k}", f"{k!r} is not known" + (f"; did you mean {near[0]!r}?" if near else ""))
    return value


def kind_of(schema: dict, pointer: str = "", tag: str = "type") -> tuple[str, bool]:
    """A subschema's column type, and whether it admits null."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else list(kinds or [])
    nullable = "null" in kinds or not kinds and "enum" not in schema and "const" not in schema
    plain = [k for k in kinds if k != "null"]
    tagged = next((v for k, v in schema.items() if k.startswith("x-") and k.endswith(f"-{tag}")), None)
    if tagged is not None:
        if tagged not in TAGS:
            raise ContractError("SCHEMA_TYPE_UNKNOWN", pointer, f"no type {tagged!r}")
        if plain != [TAGS[tagged]]:
            raise ContractError("SCHEMA_TYPE_TAG_CONFLICT", pointer, f"{tagged} refines {TAGS[tagged]}")
        return tagged, nullable
    values = schema.get("enum", [schema["const"]] if "const" in schema else None)
    if values is not None and all(isinstance(v, str) or v is None for v in values):
        return "enum", nullable or None in values
    if len(plain) != 1:
        return "json", True
    only = plain[0]
    if only == "string":
        if schema.get("contentEncoding") == "base64":
            return "bytes", nullable
        return FORMATS.get(schema.get("format", ""), "string"), nullable
    return {"boolean": "bool", "integer": "integer", "number": "number", "array": "array", "object": "object"}.get(only, "json"), nullable


def decode_column(name: str, schema: dict, required: bool, generated: str | None, pointer: str, defs: dict, seen: tuple = ()) -> Column:
    """A column of a subschema; a recursive reference is of type json."""
    ref = schema.get("$ref") if isinstance(schema, dict) else None
    if ref is not None:
        if not ref.startswith("#/$defs/"):
            raise ContractError("SCHEMA_REF_EXTERNAL", pointer, f"{ref!r} is not in this document")
        if ref in seen:
            return Column(name, "json", True, required, schema=schema)
        schema, seen = defs.get(ref.removeprefix("#/$defs/"), {}), (*seen, ref)
    if not isinstance(schema, dict):
        return Column(name, "json", True, required, schema={} if schema is True else {"not": {}})
    kind, nullable = kind_of(schema, pointer)
    items = None
    if kind == "array" and "items" in schema:
        items = decode_column("", schema["items"], False, None, f"{pointer}/items", defs, seen)
    properties = ()
    if kind == "object":
        need = set(schema.get("required", ()))
        properties = tuple(
            decode_column(k, v, k in need, None, f"{pointer}/properties/{k}", defs, seen)
            for k, v in schema.get("properties", {}).items()
        )
    return Column(
        name, kind, nullable, required, schema.get("default"), "default" in schema, generated, items, properties,
        "prefixItems" in schema, schema,
    )


FACTS = {
    "table", "identity", "style", "unique", "indexes", "generated", "identityDomain", "foreignKeys", "acyclic", "checks",
    "assertions", "schemaVersion",
}


def decode(document: dict, inferred: bool = False) -> Contract:
    """A contract from its document."""
    if not isinstance(document, dict):
        raise ContractError("SCHEMA_INVALID_JSON", "", "a schema is an object")
    extension = next((k for k, v in document.items() if k.startswith("x-") and isinstance(v, dict) and "table" in v), None)
    if extension is None:
        raise ContractError("SCHEMA_MISSING_REQUIRED", "", "no extension member names a table")
    at = f"/{extension}"
    facts = _members(document[extension], FACTS, at)
    table = facts["table"]
    if not isinstance(table, str) or not NAME.match(table):
        raise ContractError("SCHEMA_INVALID_TABLE_NAME", f"{at}/table", f"{table!r}")
    generated = facts.get("generated", {})
    need = set(document.get("required", ()))
    columns = tuple(
        decode_column(k, v, k in need, generated.get(k), f"/properties/{k}", document.get("$defs", {}))
        for k, v in document.get("properties", {}).items()
    )
    identity = _members(facts.get("identity"), {"source", "column", "type", "columns", "naming"}, f"{at}/identity")
    by_name = identity.get("source") == "filename"
    if by_name:
        key = (identity["column"],)
        if any(c.name == key[0] for c in columns):
            raise ContractError("SCHEMA_IDENTITY_INVALID", f"{at}/identity", f"{key[0]!r} is also a member of the body")
        columns = (Column(key[0], identity.get("type", "string"), False, True), *columns)
    else:
        key = tuple(identity.get("columns", ()))
        if not key:
            raise ContractError("SCHEMA_IDENTITY_INVALID", f"{at}/identity", "no key column")
    contract = Contract(
        table, columns, key, "filename" if by_name else "body",
        tuple(tuple(u) for u in facts.get("unique", ())), tuple(tuple(u) for u in facts.get("indexes", ())),
        facts.get("identityDomain"), tuple(_foreign_key(f, f"{at}/foreignKeys/{i}") for i, f in enumerate(facts.get("foreignKeys", ()))),
        tuple(Acyclic(a["name"], tuple(a["edges"])) for a in facts.get("acyclic", ())),
        tuple(Rule(c["name"], c["expr"]) for c in facts.get("checks", ())),
        tuple(Rule(a["name"], a["query"], a.get("severity", "error"), a.get("message")) for a in facts.get("assertions", ())),
        inferred, document.get("additionalProperties", True) is False, identity.get("naming", {"rule": "percent"}),
        facts.get("schemaVersion", 1), document.get("description"), document,
    )
    check_alone(contract, at)
    return contract


def _foreign_key(f: dict, pointer: str) -> ForeignKey:
    _members(f, {"name", "from", "to", "columns", "onDelete", "onUpdate"}, pointer)
    to = _members(f.get("to"), {"table", "tables", "domain"}, f"{pointer}/to")
    for k in ("onDelete", "onUpdate"):
        if f.get(k, "restrict") not in ACTIONS:
            raise ContractError("SCHEMA_FK_ACTION_INVALID", f"{pointer}/{k}", f"no action {f[k]!r}")
    sources = tuple(f["from"])
    name = f.get("name") or "fk_" + "_".join(re.sub(r"\W+", "_", s).strip("_") for s in sources)
    return ForeignKey(
        name, sources, tuple(to.get("tables", [to["table"]] if "table" in to else [])), to.get("domain"),
        tuple(f.get("columns", ())), f.get("onDelete", "restrict"), f.get("onUpdate", "restrict"),
        frozenset(k for k in ("onDelete", "onUpdate") if k in f),
    )


def check_alone(c: Contract, at: str = "") -> None:
    """What one contract must satisfy by itself."""
    for k in c.key:
        column = next((x for x in c.columns if x.name == k), None)
        if column is None or column.kind not in KEY_TYPES or column.nullable or not (column.required or column.generated):
            raise ContractError("SCHEMA_IDENTITY_INVALID", f"{at}/identity", f"{k!r} can't be a key")
    for u in c.unique:
        for name in u:
            if c.column(name).kind not in SCALARS:
                raise ContractError("SCHEMA_KEY_NOT_SCALAR", f"{at}/unique", f"{name!r} is no scalar")
    for column in c.columns:
        if column.generated and (GENERATORS.get(column.generated) != column.kind or column.has_default):
            raise ContractError("SCHEMA_DEFAULT_TYPE_MISMATCH", f"{at}/generated/{column.name}", f"{column.generated} doesn't fill a {column.kind}")
    names = [x.name for x in (*c.foreign_keys, *c.acyclic, *c.checks, *c.assertions)]
    for n in names:
        if not NAME.match(n):
            raise ContractError("SCHEMA_GRAMMAR", at, f"{n!r} is no constraint name")
        if names.count(n) > 1:
            raise ContractError("SCHEMA_CONSTRAINT_NAME_DUPLICATE", at, f"{n!r} names two rules")
    for fk in c.foreign_keys:
        crossing = [p for p in fk.paths if paths.iterates(p)]
        if len(fk.sources) > 1 and crossing:
            raise ContractError("SCHEMA_REFERENCE_PATH_INVALID", at, f"{fk.name}: a composite reference can't cross an array")
        for p in fk.paths:
            leaf = c.leaf(p)
            for action in (fk.on_delete, fk.on_update):
                optional = not leaf.required
                if action == "set_null" and not leaf.nullable or action == "set_default" and not leaf.has_default:
                    raise ContractError("SCHEMA_FK_ACTION_INVALID", at, f"{fk.name}: the reference doesn't admit {action}")
                if action == "remove" and not paths.iterates(p) and not optional:
                    raise ContractError("SCHEMA_FK_ACTION_INVALID", at, f"{fk.name}: a required member can't be removed")
                if action == "remove" and any(s.iterates and _array(c, p, i).positional for i, s in enumerate(p)):
                    raise ContractError("SCHEMA_FK_ACTION_INVALID", at, f"{fk.name}: the array is typed by position")
    for r in c.checks:
        _rule(r, "SCHEMA_CHECK_INVALID", at)
    for r in c.assertions:
        if not re.match(r"\s*(SELECT|WITH)\b", r.text, re.I):
            raise ContractError("SCHEMA_ASSERTION_INVALID", at, f"{r.name} is no query")
        _rule(r, "SCHEMA_ASSERTION_INVALID", at)
    for a in c.acyclic:
        for e in a.edges:
            if len(c.key) != 1 or not comparable(c.leaf(paths.parse(e)).kind, c.column(c.key[0]).kind):
                raise ContractError("SCHEMA_ACYCLIC_INVALID", at, f"{a.name}: {e} doesn't reach the table's key")


def _rule(r: Rule, code: str, at: str) -> None:
    from . import sqlfront

    try:
        sqlfront.check_rule(r.text, code)
    except sqlfront.QueryError as e:
        raise ContractError(code, at, f"{r.name}: {e}") from e


def _array(c: Contract, path: paths.Path, upto: int) -> Column:
    members, at = c.columns, None
    for s in path[: upto + 1]:
        at = next(x for x in members if x.name == s.name)
        members = (at.items.properties if at.items else ()) if s.iterates else at.properties
    return at


def comparable(a: str, b: str) -> bool:
    """Whether values of two types can be equal keys."""
    text = {"string", "enum"}
    exact = {"int", "integer"}
    return a == b or {a, b} <= text or {a, b} <= exact


@dataclass(frozen=True)
class SchemaFinding:
    code: str
    table: str
    constraint: str
    message: str


def cross_check(contracts: dict[str, Contract]) -> list[SchemaFinding]:
    """What contracts must satisfy together."""
    found = []
    domains: dict[str, list[Contract]] = {}
    for c in contracts.values():
        if c.domain:
            domains.setdefault(c.domain, []).append(c)
    for d, members in domains.items():
        for c in members:
            if len(c.key) != 1 or not comparable(c.column(c.key[0]).kind, members[0].column(members[0].key[0]).kind):
                found.append(SchemaFinding("SCHEMA_DOMAIN_KEY_INVALID", c.table, d, f"{c.table} can't share the keys of {d}"))
    for c in contracts.values():
        for fk in c.foreign_keys:
            if fk.domain is not None:
                targets = [t.table for t in domains.get(fk.domain, [])]
                if not targets:
                    found.append(SchemaFinding("SCHEMA_FK_TARGET_MISSING", c.table, fk.name, f"no table is in domain {fk.domain}"))
            else:
                targets = list(fk.tables)
            for t in targets:
                target = contracts.get(t)
                if target is None:
                    found.append(SchemaFinding("SCHEMA_FK_TARGET_MISSING", c.table, fk.name, f"there is no table {t}"))
                    continue
                columns = fk.columns or target.key
                if fk.columns and fk.columns != target.key and fk.columns not in target.unique:
                    found.append(SchemaFinding("SCHEMA_FK_TARGET_NOT_UNIQUE", c.table, fk.name, f"{columns} is no key of {t}"))
                    continue
                if len(columns) != len(fk.sources):
                    found.append(SchemaFinding("SCHEMA_FK_TARGET_INVALID", c.table, fk.name, f"{len(fk.sources)} paths for {len(columns)} columns"))
                    continue
                for p, k in zip(fk.paths, columns):
                    a, b = c.leaf(p).kind, target.column(k).kind
                    if not comparable(a, b):
                        found.append(SchemaFinding("SCHEMA_FK_TYPE_MISMATCH", c.table, fk.name, f"{a} never equals {b} ({t}.{k})"))
    return found


def from_spark(table: str, schema: T.StructType, key: list[str], **facts) -> Contract:
    """An inferred contract of a typed DataFrame."""

    def column(name: str, kind: T.DataType, nullable: bool) -> Column:
        if isinstance(kind, T.ArrayType):
            return Column(name, "array", nullable, not nullable, items=column("", kind.elementType, True))
        if isinstance(kind, T.StructType):
            return Column(name, "object", nullable, not nullable, properties=tuple(column(f.name, f.dataType, True) for f in kind))
        by = {"long": "int", "integer": "int", "short": "int", "byte": "int", "double": "number", "float": "number", "boolean": "bool"}
        return Column(name, by.get(kind.typeName(), "string"), nullable, not nullable)

    columns = tuple(replace(column(f.name, f.dataType, f.name not in key), required=True) for f in schema)
    return Contract(table, columns, tuple(key), inferred=True, **facts)
