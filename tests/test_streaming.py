from __future__ import annotations

import json

from covenant.operators.validate import Table
from covenant.plans.contract import decode
from covenant.streaming import arrivals

DOCUMENT = {
    "type": "object", "properties": {"id": {"type": "string"}, "owner": {"type": "string"}}, "required": ["id", "owner"], "additionalProperties": False,
    "x-rel": {"table": "items", "identity": {"source": "body", "columns": ["id"]}, "foreignKeys": [{"from": ["owner"], "to": {"table": "users"}}]},
}
USERS = {"type": "object", "properties": {"id": {"type": "string"}}, "required": ["id"], "x-rel": {"table": "users", "identity": {"source": "body", "columns": ["id"]}}}


def test_arrivals_are_judged_and_upserted(spark, tmp_path):
    (tmp_path / "items").mkdir()
    for i, row in enumerate([{"id": "a", "owner": "u"}, {"id": "b", "owner": "nobody"}, {"id": "c"}]):
        (tmp_path / "items" / f"{'abc'[i]}.json").write_text(json.dumps(row))
    contract, users = decode(DOCUMENT), decode(USERS)
    state = {
        "items": Table(spark.createDataFrame([("a", "old")], "id string, owner string"), contract),
        "users": Table(spark.createDataFrame([("u",)], "id string"), users),
    }
    seen = []

    def sink(changes, findings, number):
        seen.append(({(r.op, r.key) for r in changes.collect()}, {(r.code, r.path) for r in findings.collect()}))

    stream = arrivals.arriving(spark, str(tmp_path), "items")
    arrivals.follow(stream, contract, state, str(tmp_path / "cp"), sink, once=True).awaitTermination(120)
    assert seen == [({("update", '["a"]'), ("insert", '["b"]'), ("insert", '["c"]')}, {("FOREIGN_KEY_VIOLATION", "items/b.json")})]
    q = arrivals.row_findings(stream, contract).writeStream.format("memory").queryName("row_findings").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.path, r.code) for r in spark.table("row_findings").collect()] == [("items/c.json", "ROW_MISSING_FIELD")]
