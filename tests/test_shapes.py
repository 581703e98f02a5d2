"""The laws of shapes, the row validator, paths, names, rules and graphs."""

from __future__ import annotations

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from covenant.operators import validate
from covenant.operators.states import merge_bases
from covenant.plans import jsonschema, paths, shape, sqlfront
from covenant.sources import naming

SCALAR = st.one_of(st.none(), st.booleans(), st.integers(-(10**25), 10**25), st.floats(allow_nan=False, allow_infinity=False), st.text(max_size=8),
                   st.sampled_from(["2024-01-01", "2024-01-01T00:00:00Z", "a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11"]))
VALUE = st.recursive(SCALAR, lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from("abcd"), x, max_size=3), max_leaves=8)
VALUES = st.lists(VALUE.map(lambda v: shape.parse(json.dumps(v))), max_size=5)


@settings(max_examples=200, deadline=None)
@given(VALUES, VALUES, VALUES)
def test_shapes_are_a_semilattice(a, b, c):
    x, y, z = map(shape.of_values, (a, b, c))
    assert x.join(y).to_dict() == y.join(x).to_dict()
    assert x.join(y).join(z).to_dict() == x.join(y.join(z)).to_dict()
    assert x.join(x).subschema() == x.subschema()
    assert shape.of_values(a + b).subschema() == x.join(y).subschema()
    assert shape.Shape.from_dict(json.loads(json.dumps(x.to_dict()))).to_dict() == x.to_dict()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.dictionaries(st.sampled_from("abcd"), VALUE, max_size=4), min_size=1, max_size=5))
def test_a_contract_admits_its_rows(rows):
    rows = [shape.parse(json.dumps(r)) for r in rows]
    whole = shape.of_values(rows)
    assert all(whole.admits(r) for r in rows)
    validator = jsonschema.Validator(json.loads(json.dumps(whole.subschema())))
    assert all(validator.valid(r) for r in rows)


def test_number_classes_and_maps():
    assert shape.of_values(map(shape.parse, ["1", "2"])).kind() == "int"
    assert shape.of_values(map(shape.parse, ["1", "99999999999999999999"])).kind() == "integer"
    assert shape.of_values(map(shape.parse, ["1.0", "1e3"])).kind() == "float"
    assert shape.of_values(map(shape.parse, ["1", "1.0"])).kind() == "number"
    wide = shape.of_values([{f"k{i}": "x"} for i in range(40)])
    assert wide.is_map() and "additionalProperties" in wide.subschema()
    assert shape.of_values([{"a": "x"}]).widening_for({"a": None}).subschema()["properties"]["a"]["type"] == ["string", "null"]


CASES = [
    ({"type": "integer"}, [("1", True), ("1.0", True), ("1.5", False), ('"1"', False), ("true", False)]),
    ({"type": "integer", "x-t-type": "int"}, [("1", True), ("1.0", False), ("9223372036854775808", False)]),
    ({"type": "number", "x-t-type": "float"}, [("1.0", True), ("1", False), ("1e3", True)]),
    ({"type": "string", "x-t-type": "decimal"}, [('"1.5"', True), ('"1.50"', False), ('"-0"', False)]),
    ({"enum": [1, "a", None]}, [("1.0", True), ('"a"', True), ("null", True), ("2", False)]),
    ({"multipleOf": 0.01}, [("0.0075", False), ("4.02", True)]),
    ({"minLength": 2}, [('"é"', False), ('"ab"', True), ("1", True)]),
    ({"uniqueItems": True}, [("[1,1.0]", False), ("[1,true]", True), ('[{"a":1,"b":2},{"b":2,"a":1}]', False)]),
    ({"required": ["a"], "properties": {"a": {"type": "string"}}, "additionalProperties": False}, [('{"a":"x"}', True), ("{}", False), ('{"a":"x","b":1}', False)]),
    ({"prefixItems": [{"type": "string"}], "items": {"type": "integer"}}, [('["a",1]', True), ('["a","b"]', False), ("[1]", False)]),
    ({"contains": {"const": 5}, "minContains": 2, "maxContains": 3}, [("[5]", False), ("[5,5]", True), ("[5,5,5,5]", False)]),
    ({"if": {"properties": {"k": {"const": 1}}}, "then": {"required": ["x"]}, "else": {"required": ["y"]}}, [('{"k":1,"x":0}', True), ('{"k":2}', False)]),
    ({"oneOf": [{"minimum": 2}, {"maximum": 3}]}, [("1", True), ("2.5", False), ("9", True)]),
    ({"not": {"type": "null"}}, [("null", False), ("0", True)]),
    ({"dependentRequired": {"a": ["b"]}}, [('{"a":1}', False), ('{"a":1,"b":2}', True), ("{}", True)]),
    ({"propertyNames": {"pattern": "^[a-z]+$"}, "patternProperties": {"^n": {"type": "number"}}}, [('{"n":1}', True), ('{"N":1}', False), ('{"nn":"x"}', False)]),
    ({"allOf": [{"properties": {"a": True}}], "unevaluatedProperties": False}, [('{"a":1}', True), ('{"b":1}', False)]),
    ({"$defs": {"n": {"type": "object", "properties": {"next": {"$ref": "#/$defs/n"}}, "required": ["v"]}}, "$ref": "#/$defs/n"}, [('{"v":1,"next":{"v":2}}', True), ('{"v":1,"next":{}}', False)]),
    ({"format": "date-time"}, [('"2024-02-30T00:00:00Z"', False), ('"2024-02-29T00:00:00+01:00"', True), ("1", True)]),
    ({"format": "ipv4"}, [('"1.2.3.4"', True), ('"1.2.3.256"', False)]),
    ({"format": "uuid"}, [('"a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11"', True), ('"a0eebc99"', False)]),
    ({"type": "string", "contentEncoding": "base64"}, [('"aGk="', True), ('"a"', False)]),
]


@pytest.mark.parametrize("schema,cases", CASES)
def test_keywords(schema, cases):
    v = jsonschema.Validator(schema)
    assert [v.valid(shape.parse(t)) for t, _ in cases] == [ok for _, ok in cases]


def test_unknown_keywords_and_formats():
    assert jsonschema.unknown_keywords({"properties": {"a": {"minlength": 1}}}) == [("/properties/a/minlength", "minLength")]
    with pytest.raises(jsonschema.SchemaError):
        jsonschema.Validator({"format": "colour"})


def test_paths(spark):
    for text in ("a", "a[]", "a[].b.c", "relations[?relation='it''s'].target", 'a."b c"[?n=1.5].d', "a[?on=true].x"):
        assert paths.text(paths.parse(text)) == text
    with pytest.raises(paths.PathError):
        paths.parse("a..b")
    row = {"m": [{"l": [{"r": "x"}, {"r": None}]}, {"l": []}, {"l": [{"r": "y"}]}]}
    df = spark.createDataFrame([(row["m"],), (None,)], "m array<struct<l: array<struct<r: string>>>>")
    p = paths.parse("m[].l[].r")
    got = [[(e.pointer, e.value) for e in r[0]] for r in df.select(paths.occurrences(p)).collect()]
    assert got == [[("/m/0/l/0/r", "x"), ("/m/2/l/0/r", "y")], []] and paths.get(row, p) == got[0]


def test_names():
    rule = {"rule": "percent"}
    for key, name in (("a b/é", "a%20b%2F%C3%A9"), (".x.", "%2Ex%2E"), ("con", "%63on"), ("a~b", "a%7Eb")):
        assert naming.spell([key], rule) == name and naming.read(name, rule) == [key]
    template = {"rule": "template", "prefix": "user-", "suffix": "", "inner": {"rule": "verbatim", "alphabet": "0-9"}}
    assert naming.spell([17], template) == "user-17" and naming.read("user-17", template) == ["17"]
    for bad in (lambda: naming.spell(["x"], template), lambda: naming.spell(["a" * 300], rule), lambda: naming.read("x", template)):
        with pytest.raises(naming.NameError_):
            bad()


def test_front_end():
    assert sqlfront.split("SELECT ';' -- ;\n; SELECT 1;") == ["SELECT ';' -- ;", "SELECT 1"]
    assert sqlfront.classify("WITH x AS (SELECT 1) DELETE FROM t") == "delete"
    for bad in ("PRAGMA x", "ATTACH 'a'", "CREATE TABLE t(a)", ""):
        with pytest.raises(sqlfront.QueryError):
            sqlfront.classify(bad)
    for rule in ("start <= stop", "json_array_length(tags) > 0", "date('2024-01-01') < d", "strftime('%Y', d) > '2'"):
        sqlfront.check_rule(rule)
    for rule in ("random() > 0", "date('now') > d", "d < CURRENT_TIMESTAMP", "date() > d", "a; b", "load_extension('x')", "date('n' || 'ow') > d", "a = ?", "(a"):
        with pytest.raises(sqlfront.QueryError):
            sqlfront.check_rule(rule)


def test_cycles(spark):
    def cyclic(pairs):
        df = spark.createDataFrame(pairs, "a string, b string")
        return {(r.node, r.next) for r in validate.on_cycles(df).collect()}

    assert cyclic([("a", "b"), ("b", "c")]) == set()
    assert cyclic([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "a")]) == {("a", "b"), ("b", "c"), ("c", "a")}
    assert cyclic([("s", "s"), ("p", "q"), ("q", "p"), ("p", "s")]) == {("s", "s"), ("p", "q"), ("q", "p")}


def test_merge_bases(spark):
    g = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("e", "c"), ("f", "b")], "id string, parent string")
    found = lambda x, y: {r.id for r in merge_bases(g, x, y).collect()}
    assert found("d", "e") == {"c"} and found("d", "f") == {"b"} and found("b", "c") == {"a"} and found("d", "b") == {"b"}


def test_scoped_equals_whole(spark):
    """Findings on the touched rows are those of the whole."""
    from covenant.plans.contract import Column, Contract, ForeignKey

    fk = ForeignKey("fk_parent", ("parent",), ("items",))
    c = Contract("items", (Column("id", "int", False, True), Column("parent", "int", True, True)), ("id",), foreign_keys=(fk,))
    rows = spark.range(60).select("id", F.when(F.col("id") % 3 == 0, F.col("id") * 2).alias("parent"))
    state = {"items": validate.Table(rows, c)}
    touched = rows.where("id % 2 = 0").select(validate.Table(rows, c).key().alias("key"))
    whole = {r.path for r in validate.dangling(state, state["items"], fk).collect() if int(r.path[6:-5]) % 2 == 0}
    scope = validate.scoped(state, "items", touched)
    assert {r.path for r in validate.dangling(state, scope["items"], fk).collect()} == whole
