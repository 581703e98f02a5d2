from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from covenant.operators.validate import Table
from covenant.plans.contract import Column, Contract
from covenant.sources import transfer

C = Contract(
    "t",
    (Column("id", "int", False, True), Column("name", "string", True), Column("price", "decimal", True), Column("on", "bool", True), Column("tags", "array", True, items=Column("", "string"))),
    ("id",),
)


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name,price,on\n1,"a ""b"", c",1.50,true\n2,,,\n')
    got = [tuple(r) for r in transfer.read_csv(spark, str(tmp_path / "a.csv"), C).orderBy("id").collect()]
    assert got == [(1, 'a "b", c', "1.50", True), (2, None, None, None)]
    (tmp_path / "b.csv").write_text("id,nope\n1,2\n")
    with pytest.raises(Exception, match="UNKNOWN_COLUMN"):
        transfer.read_csv(spark, str(tmp_path / "b.csv"), C)
    (tmp_path / "c.csv").write_text("id,on\n1,maybe\n")
    with pytest.raises(Exception, match="TYPE_MISMATCH"):
        transfer.read_csv(spark, str(tmp_path / "c.csv"), C).collect()


def test_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1, "tags": ["x"]}, {"id": 2, "price": "1.0"}]')
    got = [tuple(r) for r in transfer.read_json(spark, str(tmp_path / "a.json"), C).orderBy("id").collect()]
    assert got == [(1, None, None, None, ["x"]), (2, None, "1.0", None, None)]
    (tmp_path / "b.jsonl").write_text('{"id": 1}\n\n{"id": 2, "on": false}\n')
    assert [r.id for r in transfer.read_json(spark, str(tmp_path / "b.jsonl"), C, lines=True).orderBy("id").collect()] == [1, 2]
    (tmp_path / "c.jsonl").write_text("[1]\n")
    with pytest.raises(Exception, match="ROW_ROOT_NOT_OBJECT"):
        transfer.read_json(spark, str(tmp_path / "c.jsonl"), C, lines=True).collect()
    (tmp_path / "d.jsonl").write_text('{"id": 1, "zz": 2}\n')
    with pytest.raises(Exception, match="UNKNOWN_COLUMN"):
        transfer.read_json(spark, str(tmp_path / "d.jsonl"), C, lines=True).collect()


def test_export(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "1.5", True, ["x", "y"]), (2, None, None, None, None)], C.spark_schema())
    t = Table(rows, C)
    for kind in ("jsonl", "csv", "parquet"):
        transfer.export(t, str(tmp_path / kind), kind, F.col("id") > 0, ["id"])
        with pytest.raises(Exception, match="(?i)already exists"):
            transfer.export(t, str(tmp_path / kind), kind)
    assert spark.read.parquet(str(tmp_path / "parquet")).orderBy("id").first()["tags"] == '["x","y"]'
    assert spark.read.json(str(tmp_path / "jsonl")).count() == 2
    big = Table(spark.createDataFrame([(1 << 53,), ((1 << 53) + 1,)], "n long"), Contract("b", (Column("n", "int"),), ("n",)))
    assert [r.n for r in transfer.inexact(big, "n").collect()] == [(1 << 53) + 1]


def test_parquet_refuses_inexact_numbers(spark, tmp_path):
    c = Contract("n", (Column("x", "number", True),), ("x",))
    good = Table(spark.createDataFrame([("1.5",), ("100",)], "x string"), c)
    transfer.export(good, str(tmp_path / "good"), "parquet")
    bad = Table(spark.createDataFrame([("0.1000000000000000055511151231257827",)], "x string"), c)
    with pytest.raises(Exception, match="a double can't hold"):
        transfer.export(bad, str(tmp_path / "bad"), "parquet")
