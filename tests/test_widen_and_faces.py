"""Widening and tightening, repairs, the DB-API face and result formats."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from covenant.operators import doctor, profile, validate
from covenant.operators.validate import Table
from covenant.plans import dbapi, jsonschema, widen
from covenant.plans.contract import Column, Contract, ContractError, ForeignKey, decode
from covenant.plans.database import Database
from covenant.plans.shape import parse
from covenant.sources import results

DOCUMENT = {
    "type": "object",
    "properties": {
        "id": {"type": "integer", "x-c-type": "int"}, "kind": {"type": "string"}, "size": {"type": "integer", "x-c-type": "int", "maximum": 9},
        "tags": {"type": "array", "items": {"type": "string"}},
    },
    "required": ["id", "kind", "size"], "additionalProperties": False,
    "x-c": {"table": "things", "identity": {"source": "body", "columns": ["id"]}},
}


@pytest.mark.parametrize(
    "row,step",
    [
        ('{"id":1,"kind":null,"size":1}', "/kind admits null"), ('{"id":1,"size":1}', "/kind is optional"), ('{"id":1,"kind":"a","size":10}', "/size reaches 10"),
        ('{"id":1,"kind":"a","size":1.5}', "/size admits number"), ('{"id":1,"kind":"a","size":1,"tags":["x",null]}', "/tags/1 admits null"),
        ('{"id":1,"kind":7,"size":1}', "/kind admits integer"),
    ],
)
def test_least_widening(row, step):
    value = parse(row)
    assert jsonschema.Validator(DOCUMENT).faults(value)
    wide, steps = widen.admit(DOCUMENT, [value])
    assert steps[0] == step and jsonschema.Validator(wide).valid(value) and widen.admit(wide, [value])[1] == []
    narrow = parse('{"id":1,"kind":"a","size":1,"tags":["x"]}')
    assert jsonschema.Validator(wide).valid(narrow)


def test_widening_by_hand():
    assert widen.widened(DOCUMENT, "kind", null=True)["properties"]["kind"]["type"] == ["string", "null"]
    assert widen.widened(DOCUMENT, "kind", optional=True)["required"] == ["id", "size"]
    assert widen.widened(DOCUMENT, "tags[]", kind="integer")["properties"]["tags"]["items"]["type"] == ["string", "integer"]
    assert widen.widened(DOCUMENT, "size", anything=True)["properties"]["size"] == {}
    with pytest.raises(widen.CannotWiden):
        widen.widened(DOCUMENT, "nope", null=True)
    with pytest.raises(widen.CannotWiden, match="UNKNOWN_COLUMN"):
        widen.admit(DOCUMENT, [{"id": 1, "kind": "a", "size": 1, "more": 2}])


@pytest.fixture
def things(spark):
    c = decode(DOCUMENT)
    rows = [(i, "ab"[i % 2], i, ["x"] * (1 + i % 2)) for i in range(24)]
    return Table(spark.createDataFrame(rows, c.spark_schema()), c)


def test_tightening(spark, things):
    c = widen.tightened(things, profile.lint(spark, things))
    assert c.column("kind").kind == "enum" and c.column("kind").schema["enum"] == ["a", "b"]
    assert c.unique == (("size",),) and {r.text for r in c.checks} == {"id >= 0", "size >= 0"} and c.column("tags").schema["minItems"] == 1


def test_rules_are_held_to_the_list():
    for bad, code in (({"checks": [{"name": "c", "expr": "random() > 0"}]}, "SCHEMA_CHECK_INVALID"), ({"assertions": [{"name": "a", "query": "DELETE FROM x"}]}, "SCHEMA_ASSERTION_INVALID")):
        with pytest.raises(ContractError) as e:
            decode({**DOCUMENT, "x-c": {**DOCUMENT["x-c"], **bad}})
        assert e.value.code == code


def test_cursor(spark, things):
    db = Database(spark, {"things": things})
    with dbapi.connect(db) as connection:
        cursor = connection.cursor()
        assert cursor.execute("SELECT id, kind FROM things WHERE size < ? ORDER BY id", [3]).fetchall() == [(0, "a"), (1, "b"), (2, "a")]
        assert [d[0] for d in cursor.description] == ["id", "kind"]
        cursor.execute("SELECT id FROM things ORDER BY id")
        assert cursor.fetchone() == (0,) and cursor.fetchmany(2) == [(1,), (2,)]
        cursor.executemany("UPDATE things SET kind = ? WHERE id = ?", [("it's ?", 0), ("c", 1)])
        assert cursor.rowcount == 2
        assert cursor.execute("SELECT kind FROM things WHERE id = 0").fetchone() == ("it's ?",)
    assert db.get("things", 1).kind == "c"
    connection = dbapi.connect(db)
    connection.cursor().execute("DELETE FROM things")
    connection.rollback()
    assert db.scalar("SELECT count(*) FROM things") == 24
    with pytest.raises(dbapi.ProgrammingError):
        dbapi.bound("DELETE FROM t WHERE a = ?", [])


def test_transaction_is_judged_at_its_end(spark, things):
    db = Database(spark, {"things": things})
    with db.transaction() as inside:
        inside.delete("things", F.col("id") == 0)
        inside.update("things", F.col("id") == 1, {"kind": F.lit("z")})
        assert db.get("things", 0).kind == "a"
    assert db.scalar("SELECT count(*) FROM things") == 23 and db.get("things", 1).kind == "z"


def test_results(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b,c", [1])], "id long, s string, xs array<long>").orderBy("id")
    assert json.loads(results.as_json(df))[1] == {"id": 2, "s": "b,c", "xs": [1]}
    assert results.as_lines(df).count("\n") == 2 and results.as_csv(df) == 'id,s,xs\n1,a,\n2,"b,c",[1]\n'
    assert results.as_table(df.select("id", "s")) == "id | s\n---+----\n1  | a\n2  | b,c\n(2 rows)\n"
    with pytest.raises(Exception, match="RESOURCE_LIMIT"):
        results.as_json(df, 1)
    found = spark.createDataFrame([("error", "CHECK_VIOLATION", "t", "t/1.json", "", "c", None, "bad")], validate.FINDING)
    run = json.loads(results.as_sarif(found))["runs"][0]
    assert run["results"][0]["ruleId"] == "CHECK_VIOLATION" and run["tool"]["driver"]["rules"] == [{"id": "CHECK_VIOLATION"}]


def test_doctor(spark):
    keys = Table(spark.createDataFrame([(1,), (2,)], "k long"), Contract("keys", (Column("k", "int", False, True),), ("k",)))
    fk = ForeignKey("fk_refs", ("refs[]",), ("keys",), on_delete="remove")
    c = Contract("rows", (Column("id", "int", False, True), Column("refs", "array", items=Column("", "int"))), ("id",), foreign_keys=(fk,))
    state = {"keys": keys, "rows": Table(spark.createDataFrame([(1, [1, 9, 2]), (2, [9]), (3, None)], "id long, refs array<long>"), c)}
    plan = doctor.plan(spark, validate.judge(spark, state)).collect()
    assert [p.fix for p in plan if p.path == "rows/2.json"] == ["FIX_REMOVE_REFERENCE", "FIX_SET_NULL", "FIX_DELETE_ROW"]
    mended = doctor.without_dangling(state, "rows")
    assert {r.id: r.refs for r in mended["rows"].rows.collect()} == {1: [1, 2], 2: [], 3: None}
    assert validate.judge(spark, mended).isEmpty()
    assert {r.id for r in doctor.without_dangling(state, "rows", "delete")["rows"].rows.collect()} == {3}
    text = Table(spark.createDataFrame([("7",), ("x",)], "n string"), Contract("t", (Column("n", "int"),), ("n",)))
    assert [r.n for r in doctor.coerced(text, "n", "string").rows.collect()] == ["7", "x"]
