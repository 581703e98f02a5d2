"""A small apiary's database: keepers, blooms, hives and harvests, from opening to history."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from covenant.operators import referential, states
from covenant.operators.changes import ChangeRefused
from covenant.operators.validate import Table
from covenant.plans import migrate, sqlfront
from covenant.plans.contract import Column, ContractError, Rule, decode
from covenant.plans.database import Database


def contract(table, properties, required, **facts):
    identity = {"source": "body", "columns": ["code"], "naming": {"rule": "percent"}}
    return {"type": "object", "properties": properties, "required": required, "x-rel": {"table": table, "identity": identity, **facts}}


TEXT = {"type": "string"}
KEEPERS = {**contract("keepers", {"code": TEXT, "called": TEXT}, ["code", "called"]), "additionalProperties": False}
BLOOMS = contract("blooms", {"code": TEXT}, ["code"])
HIVES = contract(
    "hives", {"code": TEXT, "keeper": TEXT, "label": {"type": "string", "minLength": 2}, "forage": {"type": "array", "items": TEXT}}, ["code", "keeper", "label"],
    foreignKeys=[
        {"from": ["keeper"], "to": {"table": "keepers"}, "onDelete": "restrict", "onUpdate": "cascade"},
        {"from": ["forage[]"], "to": {"table": "blooms"}, "onDelete": "remove"},
    ],
)
HARVESTS = contract(
    "harvests",
    {"code": {"type": "integer", "x-rel-type": "int"}, "keeper": TEXT, "kilos": {"type": "string", "x-rel-type": "decimal"}, "taken": {"type": "string", "format": "date-time"}, "remark": {"type": ["string", "null"]}},
    ["code", "keeper", "kilos", "taken"],
    generated={"code": "sequence"}, foreignKeys=[{"from": ["keeper"], "to": {"table": "keepers"}, "onDelete": "cascade"}],
)
ROWS = {
    "keepers": [{"code": "ines", "called": "Ines"}, {"code": "olu", "called": "Olu"}],
    "blooms": [{"code": "clover"}, {"code": "heather"}, {"code": "lime"}],
    "hives": [
        {"code": "h1", "keeper": "ines", "label": "Orchard", "forage": ["lime", "clover"]},
        {"code": "h2", "keeper": "olu", "label": "Moor", "forage": ["heather"]},
    ],
    "harvests": [
        {"code": 1, "keeper": "ines", "kilos": "31.25", "taken": "2021-07-04T06:30:00+03:00"},
        {"code": 2, "keeper": "olu", "kilos": "8.4", "taken": "2021-07-04T04:00:00Z", "remark": None},
        {"code": 3, "keeper": "ines", "kilos": "204", "taken": "2021-08-19T18:45:00-04:00", "remark": "late"},
    ],
}


def write(root, documents=(KEEPERS, BLOOMS, HIVES, HARVESTS), rows=ROWS):
    (root / "schema").mkdir(parents=True)
    for d in documents:
        (root / "schema" / f"{d['x-rel']['table']}.json").write_text(json.dumps(d))
    for name, held in rows.items():
        (root / name).mkdir()
        for r in held:
            (root / name / f"{r['code']}.json").write_text(json.dumps(r))
    return str(root)


@pytest.fixture
def db(spark, tmp_path):
    return Database.open(spark, write(tmp_path / "db"), str(tmp_path / "store"))


def values(df):
    return [tuple(r) for r in df.collect()]


def test_opens_and_is_valid(db):
    assert db.tables() == ["blooms", "harvests", "hives", "keepers"]
    assert db.check().collect() == [] and db.valid()
    assert db.status()["tables"] == {"harvests": 3, "hives": 2, "blooms": 3, "keepers": 2}
    assert db.get("keepers", "olu").called == "Olu"
    present = {r.code: "remark" in r["_present"] for r in db.table("harvests").rows.collect()}
    assert present == {1: False, 2: True, 3: True}


QUESTIONS = [
    ("SELECT h.label, k.called FROM hives h JOIN keepers k ON k.code = h.keeper ORDER BY h.label", [("Moor", "Olu"), ("Orchard", "Ines")]),
    ("SELECT code, kilos FROM harvests WHERE kilos > 9 ORDER BY kilos DESC", [(3, "204"), (1, "31.25")]),
    ("SELECT max(kilos), min(kilos) FROM harvests", [("204", "8.4")]),
    ("SELECT code FROM harvests WHERE kilos BETWEEN '9' AND '204.0' ORDER BY code", [(1,), (3,)]),
    ("SELECT code FROM harvests WHERE kilos IN ('8.40', 204) ORDER BY 1", [(2,), (3,)]),
    ("SELECT DISTINCT kilos FROM harvests ORDER BY kilos", [("8.4",), ("31.25",), ("204",)]),
    ("SELECT code FROM harvests WHERE kilos + 0 > 100", [(3,)]),
    ("SELECT code FROM harvests WHERE kilos > '5' AND code IN (SELECT code FROM harvests) ORDER BY taken DESC", [(3,), (2,), (1,)]),
    ("SELECT code FROM harvests WHERE taken = '2021-07-04T03:30:00Z'", [(1,)]),
    ("SELECT keeper, dec_sum(kilos) FROM harvests GROUP BY keeper ORDER BY keeper", [("ines", "235.25"), ("olu", "8.4")]),
    ("SELECT h.code, f.value FROM hives h, json_each(h.forage) f ORDER BY f.value", [("h1", "clover"), ("h2", "heather"), ("h1", "lime")]),
    ("SELECT code FROM keepers WHERE called LIKE 'OL_' OR called GLOB 'I*' ORDER BY code", [("ines",), ("olu",)]),
    ("SELECT 9/4, 9%0, 1/0, substr('comb',0,3), iif(1 IS NULL, 'a', 'b')", [(2, None, None, "co", "b")]),
    ("SELECT keeper, remark, max(kilos) FROM harvests GROUP BY keeper ORDER BY keeper", [("ines", "late", "204"), ("olu", None, "8.4")]),
    ("WITH big AS (SELECT code, kilos FROM harvests WHERE kilos > 9) SELECT code FROM big ORDER BY kilos LIMIT 1", [(1,)]),
    ("SELECT label FROM hives ORDER BY label COLLATE NOCASE DESC LIMIT 1 OFFSET 1", [("Moor",)]),
    ("SELECT '{\"a\":[1,{\"b\":null}]}' -> '$.a' AS j, json_type('{\"a\":[]}', '$.a') AS t, json_set('[1]', '$[1]', 'x') AS s", [('[1,{"b":null}]', "array", '[1,"x"]')]),
]


@pytest.mark.parametrize("sql,want", QUESTIONS)
def test_questions(db, sql, want):
    assert values(db.query(sql)) == want


def test_parameters_and_lists(db):
    assert values(db.query("SELECT code FROM harvests WHERE kilos <= ? AND keeper = ?", ["31.250", "ines"])) == [(1,)]
    assert values(db.query("SELECT code FROM harvests WHERE keeper = :k AND kilos <> :n ORDER BY code", {"k": "ines", "n": "204.00"})) == [(1,)]
    assert values(db.list("harvests", "keeper = 'ines'", "-kilos", 1))[0][0] == 3
    assert db.scalar("SELECT count(*) FROM blooms") == 3
    assert "Scan" in db.explain("SELECT code FROM keepers WHERE code = 'olu'")
    for refused in ("DROP TABLE keepers", "SELECT 1 FROM hives WHERE label GLOB code", "SELECT 1 2 3"):
        with pytest.raises(sqlfront.QueryError, match="QUERY_UNSUPPORTED"):
            db.query(refused)


def test_paging(db):
    window, more, token = db.page("SELECT code FROM harvests", ["code"], 0, 2)
    assert [r.code for r in window.collect()] == [1, 2] and more
    window, more, _ = db.page("SELECT code FROM harvests", ["code"], 2, 2, token)
    assert [r.code for r in window.collect()] == [3] and not more
    with pytest.raises(sqlfront.QueryError, match="CURSOR_STALE"):
        db.page("SELECT code FROM harvests", ["code"], 0, 2, "another")
    with pytest.raises(sqlfront.QueryError, match="RESOURCE_LIMIT"):
        sqlfront.bounded(db.query("SELECT code FROM harvests"), 2)


def test_changes(db):
    out = db.execute("UPDATE hives SET label = 'North ' || label WHERE code = 'h1' RETURNING code, label")
    assert values(out[0]) == [("h1", "North Orchard")]
    out = db.execute("INSERT INTO harvests (keeper, kilos, taken) VALUES ('olu', '12.5', '2021-09-01T12:00:00+01:00') RETURNING code, kilos")
    assert values(out[0]) == [(4, "12.5")]
    # the same instant and the same number are no change
    db.execute("UPDATE harvests SET taken = '2021-07-04T03:30:00Z', kilos = '31.250' WHERE code = 1")
    assert db.get("harvests", 1).taken == "2021-07-04T06:30:00+03:00" and db.get("harvests", 1).kilos == "31.25"
    db.execute("INSERT INTO keepers (code, called) VALUES ('ines', 'Inês') ON CONFLICT (code) DO UPDATE SET called = excluded.called")
    assert db.get("keepers", "ines").called == "Inês"
    db.execute("WITH heavy AS (SELECT max(kilos) AS m FROM harvests) DELETE FROM harvests WHERE kilos = (SELECT m FROM heavy)")
    assert db.scalar("SELECT group_concat(code, '' ORDER BY code) FROM harvests") == "124"


@pytest.mark.parametrize(
    "sql,code",
    [
        ("UPDATE hives SET label = '' WHERE code = 'h2'", "SCHEMA_VIOLATION"),
        ("UPDATE harvests SET kilos = 'plenty' WHERE code = 1", "SCHEMA_VIOLATION"),
        ("UPDATE keepers SET called = NULL WHERE code = 'olu'", "ROW_MISSING_FIELD"),
        ("INSERT INTO harvests (keeper, kilos, taken) VALUES ('olu', '1', 'this morning')", "SCHEMA_VIOLATION"),
        ("INSERT INTO hives (code, keeper) VALUES ('h3', 'olu')", "ROW_MISSING_FIELD"),
    ],
)
def test_changes_are_held_to_the_row_schema(db, sql, code):
    before = db.token()
    with pytest.raises(ChangeRefused, match=code):
        db.execute(sql)
    assert db.token() == before
    # a later statement can make it good: only the end is judged
    db.execute("UPDATE hives SET label = '' WHERE code = 'h2'; UPDATE hives SET label = 'Heath' WHERE code = 'h2'")
    assert db.get("hives", "h2").label == "Heath"


def test_findings_follow_the_rows(spark, tmp_path):
    rows = {**ROWS, "hives": [{"code": "h1", "keeper": "ines", "label": "X"}, {"code": "h2", "keeper": "olu", "label": "Y"}]}
    db = Database.open(spark, write(tmp_path / "db", rows=rows))
    bad = lambda: sorted(r.path for r in db.check().collect())
    assert bad() == ["hives/h1.json", "hives/h2.json"] and not db.valid()
    db.execute("UPDATE hives SET keeper = 'olu' WHERE code = 'h1'")  # what was broken before doesn't stand in the way
    assert bad() == ["hives/h1.json", "hives/h2.json"]
    db.execute("UPDATE hives SET label = 'Xanthe' WHERE code = 'h1'")
    assert bad() == ["hives/h2.json"]
    db.execute("DELETE FROM hives WHERE code = 'h2'")
    assert bad() == [] and db.valid()


def test_checks_compare_by_value(spark, db):
    t = db.table("harvests")
    rules = (("light", "kilos < '100'"), ("early", "taken < '2021-08-01T00:00:00Z'"), ("whole", "iif(kilos < 100, 1, 0) = 1"))
    from covenant.operators import validate

    for name, text in rules:
        assert [r.path for r in validate.broken_checks(t, Rule(name, text)).collect()] == ["harvests/3.json"]
    found = validate.broken_assertions(spark, db.state, t, Rule("top", "SELECT code FROM harvests WHERE kilos = (SELECT max(kilos) FROM harvests)"))
    assert [r.path for r in found.collect()] == ["harvests/3.json"]


def test_referential_actions(spark, db):
    e = referential.delete_rows(spark, db.state, "blooms", F.col("code") == "clover")
    assert values(e.induced) == [("hives/h1.json", "remove", "hives.forage[] -> blooms", '["clover"]', "blooms")]
    db.execute("DELETE FROM blooms WHERE code = 'clover'")
    assert db.get("hives", "h1").forage == ["lime"]
    with pytest.raises(ChangeRefused, match="FOREIGN_KEY_VIOLATION"):
        db.execute("DELETE FROM keepers WHERE code = 'ines'")
    assert db.scalar("SELECT count(*) FROM keepers") == 2
    db.execute("DELETE FROM hives WHERE keeper = 'olu'; DELETE FROM keepers WHERE code = 'olu'")
    assert values(db.query("SELECT code FROM harvests ORDER BY code")) == [(1,), (3,)]


def test_rekey_cascades(db):
    db.execute("DELETE FROM harvests WHERE keeper = 'ines'")
    induced = db.update("keepers", F.col("code") == "ines", {"code": F.lit("ines-2")})
    assert values(induced.select("path", "action")) == [("hives/h1.json", "cascade")]
    assert db.get("hives", "h1").keeper == "ines-2"


def test_scripts_are_judged_once(db):
    db.execute("INSERT INTO hives (code, keeper, label) VALUES ('h3', 'mei', 'Roof; top'); INSERT INTO keepers (code, called) VALUES ('mei', 'Mei')")
    assert db.get("hives", "h3").label == "Roof; top"
    with pytest.raises(ChangeRefused):
        db.execute("BEGIN; INSERT INTO hives (code, keeper, label) VALUES ('h4', 'nobody', 'Shed'); COMMIT")
    db.execute("BEGIN; DELETE FROM harvests; ROLLBACK")
    assert db.scalar("SELECT count(*) FROM harvests") == 3
    with pytest.raises(sqlfront.QueryError, match="TRANSACTION_STATEMENT"):
        db.execute("DELETE FROM harvests; COMMIT; SELECT 1")
    with pytest.raises(ChangeRefused, match="PLAN_CHANGED"):
        db.execute("DELETE FROM harvests", expect="another")


def test_import_modes(spark, db):
    new = spark.createDataFrame([("ines", "Ines"), ("mei", "Mei"), ("olu", "O.")], "code string, called string")
    assert db.import_("keepers", new, "upsert") == {"insert": 1, "unchanged": 1, "update": 1}
    with pytest.raises(ChangeRefused, match="PRIMARY_KEY_VIOLATION"):
        db.import_("keepers", new, "insert")
    with pytest.raises(ChangeRefused, match="twice"):
        db.import_("keepers", new.union(new), "upsert")
    more = spark.createDataFrame([("clover",), ("heather",), ("lime",), ("rape",)], "code string")
    assert db.import_("blooms", more, "replace")["insert"] == 1


def test_history(db):
    one = db.commit("first", key="k")
    assert db.commit("again", key="k").id == one.id
    db.execute("UPDATE keepers SET called = 'I.' WHERE code = 'ines'; DELETE FROM blooms WHERE code = 'heather'")
    two = db.commit("second")
    assert [r.message for r in db.log()] == ["second", "first"] and two.parents == (one.id,)
    assert sorted(values(db.diff("#1", "#2").select("path", "kind"))) == [("blooms/heather.json", "removed"), ("hives/h2.json", "changed"), ("keepers/ines.json", "changed")]
    assert db.store.tree_diff("#1", "#2") == {"blooms": "changed", "harvests": "same", "hives": "changed", "keepers": "changed"}
    assert two.places["harvests"] == one.id and two.places["hives"] == two.id  # what didn't change isn't written again
    three = db.snapshot("before-frost")
    assert set(three.places.values()) == {one.id, two.id} and list(db.store.snapshots()) == ["before-frost"]
    with pytest.raises(ValueError, match="SNAPSHOT_EXISTS"):
        db.snapshot("before-frost")
    db.store.drop_snapshot("before-frost")
    assert db.store.snapshots() == {} and db.log()[0].id == three.id
    db.restore(one.id[:6])
    assert db.get("keepers", "ines").called == "Ines" and db.token() == one.token


def test_merge(spark, db):
    base = dict(db.state)
    renamed = db.state["keepers"].rows.withColumn("called", F.when(F.col("code") == "olu", "Olu B.").otherwise(F.col("called")))
    theirs = db.state | {"keepers": Table(renamed, db.state["keepers"].contract)}
    db.execute("UPDATE keepers SET called = 'Ines R.' WHERE code = 'ines'")
    assert db.merge(base, theirs).collect() == []
    assert dict(values(db.query("SELECT code, called FROM keepers"))) == {"ines": "Ines R.", "olu": "Olu B."}
    changed = states.value_changes(base["keepers"], db.state["keepers"])
    assert sorted(values(changed.select("path", "pointer", "before", "after"))) == [("keepers/ines.json", "/called", '"Ines"', '"Ines R."'), ("keepers/olu.json", "/called", '"Olu"', '"Olu B."')]


def test_migrations(db):
    db.migrate(("add_column", "keepers", Column("since", "int", True), F.lit(1999)), ("rename_column", "keepers", "called", "full_name"))
    assert db.get("keepers", "ines").full_name == "Ines" and db.get("keepers", "ines").since == 1999
    db.migrate(("change_type", "keepers", "since", "string"), ("drop_column", "keepers", "since"), ("rename_table", "blooms", "plants"))
    assert db.table("hives").contract.foreign_keys[1].tables == ("plants",) and db.valid()
    with pytest.raises(migrate.MigrationRefused):
        db.migrate(("drop_table", "keepers"))
    with pytest.raises(migrate.MigrationRefused, match="values"):
        db.migrate(("change_type", "keepers", "full_name", "int"))
    with pytest.raises(ChangeRefused, match="CHECK_VIOLATION"):
        db.migrate(("add_constraint", "harvests", Rule("light", "kilos < 200.5")))
    db.migrate(("add_constraint", "keepers", ("full_name",)))
    db.migrate(("drop_constraint", "keepers", ("full_name",)), ("set_identity_domain", "keepers", "party"))


def test_findings_of_a_broken_folder(spark, tmp_path):
    rows = {k: list(v) for k, v in ROWS.items()}
    rows["hives"] = [{"code": "h1", "keeper": "nobody", "label": "", "forage": ["lime", 3]}, {"code": "h2", "label": "Moor", "keeper": None, "extra": 1}]
    root = tmp_path / "broken"
    write(root, rows=rows)
    (root / "keepers" / "other.json").write_text(json.dumps({"code": "ines", "called": "Again"}))
    (root / "blooms" / "bad.json").write_text("{not json")
    (root / "blooms" / "list.json").write_text("[1]")
    (root / "blooms" / "merge.json").write_text('<<<<<<< ours\n{"code":"merge"}\n')
    found = {(r.code, r.path, r.pointer) for r in Database.open(spark, str(root)).check().collect()}
    assert {
        ("FOREIGN_KEY_VIOLATION", "hives/h1.json", "/keeper"), ("SCHEMA_VIOLATION", "hives/h1.json", "/label"), ("TYPE_MISMATCH", "hives/h1.json", "/forage/1"),
        ("NOT_NULL_VIOLATION", "hives/h2.json", "/keeper"), ("PRIMARY_KEY_VIOLATION", "keepers/other.json", ""), ("IDENTITY_MISMATCH", "keepers/other.json", ""),
        ("INVALID_JSON", "blooms/bad.json", ""), ("ROW_ROOT_NOT_OBJECT", "blooms/list.json", ""), ("MERGE_CONFLICT", "blooms/merge.json", ""),
    } <= found


def test_infers_a_bare_folder(spark, tmp_path):
    root = tmp_path / "bare"
    (root / "makers").mkdir(parents=True)
    for name, since in (("stradivari", 1666), ("guarneri", 1715)):
        (root / "makers" / f"{name}.json").write_text(json.dumps({"town": "Cremona", "since": since, **({"mark": "IHS"} if name == "guarneri" else {})}))
    (root / "violins").mkdir()
    for i in (1, 2):
        (root / "violins" / f"{i}.json").write_text(json.dumps({"id": i, "maker_id": "guarneri", "nick": "n", "length": 35.5 if i == 1 else 36, "woods": ["spruce"]}))
    db = Database.open(spark, str(root))
    assert db.table("makers").contract.key == ("id",) and db.table("makers").contract.identity == "filename"
    violins = db.table("violins").contract
    assert violins.key == ("id",) and violins.inferred and {c.name: c.kind for c in violins.columns} == {"id": "int", "maker_id": "string", "nick": "string", "length": "number", "woods": "array"}
    assert db.valid() and not db.table("makers").contract.column("mark").required
    proposals = {(r.table, r.column, r.code, r.detail) for r in db.lint().collect()}
    assert ("violins", "maker_id", "LINT_FK_CANDIDATE", "makers") in proposals and ("violins", "", "LINT_SCHEMA_UNPINNED", "") in proposals


def test_contract_errors():
    def broken(**facts):
        return {**HIVES, "x-rel": {**HIVES["x-rel"], **facts}}

    for document, code in (
        (broken(colour=1), "SCHEMA_UNKNOWN_KEY"),
        (broken(foreignKeys=[{"from": ["nope"], "to": {"table": "keepers"}}]), "SCHEMA_REFERENCE_PATH_INVALID"),
        (broken(foreignKeys=[{"from": ["keeper"], "to": {"table": "keepers"}, "onDelete": "set_null"}]), "SCHEMA_FK_ACTION_INVALID"),
        (broken(identity={"source": "body", "columns": ["forage"]}), "SCHEMA_IDENTITY_INVALID"),
        (broken(table="Hives"), "SCHEMA_INVALID_TABLE_NAME"),
        (broken(unique=[["forage"]]), "SCHEMA_KEY_NOT_SCALAR"),
        (broken(generated={"label": "sequence"}), "SCHEMA_DEFAULT_TYPE_MISMATCH"),
        ({"type": "object"}, "SCHEMA_MISSING_REQUIRED"),
    ):
        with pytest.raises(ContractError) as e:
            decode(document)
        assert e.value.code == code
