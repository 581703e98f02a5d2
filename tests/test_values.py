from __future__ import annotations

import re
import tracemalloc
import unicodedata
from decimal import Decimal, localcontext

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from covenant.functions import dialect, exact, jsons

NUMBERS = ["1e2", "1.50", "-0", "0", "0.001", "-12.30", "-12.3", "123456789012345678901234567890.5", "-1e-5", "99", "100", "9e1", "2.5E+3",
           "-100", "-99", "1e40", "0.0", "-1e40", "1e-40", "10", "2", "0.5", "99999999999999999999", "100000000000000000000"]


def test_number_keys_order_by_value(spark):
    found = spark.createDataFrame([(x,) for x in NUMBERS], "x string").select("x", exact.number_key("x").alias("k"), exact.normalized_number("x").alias("n")).collect()
    for a in found:
        assert Decimal(a.n) == Decimal(a.x) and a.k == exact.number_key_of(a.x)
        for b in found:
            assert (a.k < b.k) == (Decimal(a.x) < Decimal(b.x))
            assert (a.k == b.k) == (Decimal(a.x) == Decimal(b.x))


@settings(max_examples=300, deadline=None)
@given(st.decimals(allow_nan=False, allow_infinity=False), st.decimals(allow_nan=False, allow_infinity=False))
def test_number_keys_of_any_two(a, b):
    with localcontext() as c:
        c.prec = 200
        ka, kb = exact.number_key_of(str(a)), exact.number_key_of(str(b))
        assert (ka < kb) == (a < b) and (ka == kb) == (a == b)


def test_texts_follow_numbers_and_null_stays_null(spark):
    df = spark.createDataFrame([("abc",), ("9e99",), (None,)], "x string").select(exact.number_key("x").alias("k"))
    text, number, none = (r.k for r in df.collect())
    assert text > number and none is None


def test_instants(spark):
    ordered = ["1969-12-31T23:59:59Z", "2024-03-01T10:00:00+02:00", "2024-03-01T08:00:00.123456788Z", "2024-03-01T08:00:00.123456789Z",
               "2024-03-01T08:00:00.5Z", "2024-03-01T08:30:00Z", "2024-03-02T09:15:00-05:00", "not a time"]
    found = spark.createDataFrame([(x,) for x in reversed(ordered)], "x string").select("x", exact.instant_key("x").alias("k"), exact.utc("x").alias("u"))
    assert [r.x for r in found.orderBy("k").collect()] == ordered
    assert all(r.k == exact.instant_key_of(r.x) for r in found.collect())
    by = {r.x: r for r in found.collect()}
    assert by["2024-03-01T10:00:00+02:00"].u == "2024-03-01T08:00:00Z"
    assert exact.instant_key_of("2024-01-01T10:00:00Z") == exact.instant_key_of("2024-01-01T12:00:00+02:00")


def test_keys(spark):
    df = spark.createDataFrame([("1.50", 'a"b', 7), (None, "x", 1)], "d string, s string, i long")
    keys = [r[0] for r in df.select(exact.key_of([("d", "decimal"), ("s", "string"), ("i", "int")])).collect()]
    assert keys == ['["1.5","a\\"b",7]', None]


def test_exact_arithmetic(spark):
    df = spark.createDataFrame([("0.1", "0.2"), ("1e30", "1"), ("-5", "5"), (None, "1")], "a string, b string")
    got = [tuple(r) for r in df.select(exact.dec_add("a", "b"), exact.dec_sub("a", "b"), exact.dec_mul("a", "b"), exact.dec_cmp("a", "b")).collect()]
    assert got[0] == ("0.3", "-0.1", "0.02", -1)
    assert got[1] == ("1" + "0" * 29 + "1", "9" * 30, "1" + "0" * 30, 1)
    assert got[2] == ("0", "-10", "-25", -1) and got[3] == (None, None, None, None)


def test_dec_sum(spark):
    df = spark.createDataFrame([("a", "19.99"), ("a", "5.5"), ("a", "120"), ("b", None), ("c", "-0.1"), ("c", "123456789012345678901234567890")], "g string, x string")
    assert {r.g: r.s for r in exact.dec_sum(df, ["g"], "x", "s").collect()} == {"a": "145.49", "b": None, "c": "123456789012345678901234567889.9"}
    with pytest.raises(Exception, match="dec_sum"):
        exact.dec_sum(df.withColumn("x", F.lit("1e99")), ["g"], "x", "s").collect()


CONVERSIONS = [("true", "string", "bool", "true"), ("yes", "string", "bool", None), ("7", "string", "int", "7"), ("07", "string", "int", None),
               ("1.0", "string", "float", "1.0"), ("1", "string", "float", None), ("1.50", "number", "decimal", "1.5"),
               ("99999999999999999999", "string", "int", None), ("2024-01-01", "date", "string", None),
               ("A0EEBC99-9C0B-4EF8-BB6D-6BB9BD380A11", "string", "uuid", "a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11")]


@pytest.mark.parametrize("value,source,target,want", CONVERSIONS)
def test_lossless(spark, value, source, target, want):
    got = spark.range(1).select(exact.lossless_convert(F.lit(value), source, target)).first()[0]
    assert got == want


ODD = ["2024-01-01T10:00:00Z", "2024-01-01t10:00:00z", "2024-01-01T10:00:00.000Z", "2024-01-01T10:00:00.5000+02:00", "2024-01-01T10:00:00.0050-00:00",
       "2024-02-30T10:00:00Z", "2024-01-01T24:00:00Z", "2024-01-01T10:00:00+18:00", "0001-01-01T00:00:00.10Z", "9999-12-31T23:59:59.999999999999-12:00",
       "2024-01-01T10:00:00", "not a time", "", "100", None]


def test_instant_keys_of_odd_texts(spark):
    found = spark.createDataFrame([(i, x) for i, x in enumerate(ODD)], "i int, x string").select("i", exact.instant_key("x").alias("k"), exact.utc("x").alias("u")).orderBy("i").collect()
    assert [r.k for r in found] == [None if x is None else exact.instant_key_of(x) for x in ODD]
    assert found[3].u == "2024-01-01T08:00:00.5Z" and [r.u for r in found[10:]] == ODD[10:] and found[5].u == ODD[5]


def test_nfc(spark):
    assert spark.range(1).select(exact.nfc(F.lit("café"))).first()[0] == "café"


def test_nfc_keeps_nulls_and_ascii_and_holds_a_slice_of_a_batch(spark):
    texts = [None, "", "plain", "e\u0301", "\u212b", "\u1100\u1161", "a\u0328\u0301"] * 100
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", exact.nfc("x").alias("y"))
    assert [r.y for r in df.orderBy("i").collect()] == [None if x is None else unicodedata.normalize("NFC", x) for x in texts]
    shown = df._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"_nfc\(CASE WHEN .*octet_length", shown)  # ASCII goes by as null
    batch = pa.array(["e\u0301" * 2000] * 4000 + [None])
    tracemalloc.start()
    try:
        done, peak = exact._nfc.func(batch), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert done.to_pylist() == ["\u00e9" * 2000] * 4000 + [None] and peak < 5e6


def test_dialect(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    h = F.lit("hello")
    assert one(dialect.substr(h, 0, 2)) == "h" and one(dialect.substr(h, -3, 2)) == "ll" and one(dialect.substr(h, 3, -2)) == "he"
    assert one(dialect.divide(F.lit(-7), F.lit(2), True)) == -3 and one(dialect.divide(F.lit(7), F.lit(0), True)) is None
    assert one(dialect.modulo(F.lit(-7), F.lit(3))) == -1
    assert one(dialect.scalar_max(F.lit(1), F.lit(None).cast("int"))) is None
    assert one(dialect.like(F.lit("ABC"), "a_C")) and not one(dialect.glob(F.lit("ABC"), "a*")) and one(dialect.glob(F.lit("a.c"), "a.[a-c]"))
    assert one(dialect.lower(F.lit("ÉA"))) == "Éa"
    assert one(dialect.quote(F.lit("it's"))) == "'it''s'" and one(dialect.trunc(F.lit(-2.7))) == -2
    assert one(dialect.concat(F.lit("a"), F.lit(None).cast("string"), F.lit(1))) == "a1"
    assert one(dialect.date(F.lit("2024-01-31"), "+1 month")) == "2024-03-02"
    assert one(dialect.date(F.lit("2024-01-31"), "start of year", "+2 days")) == "2024-01-03"
    assert one(dialect.date(F.lit("2024-01-31"), "weekday 1")) == "2024-02-05"
    assert one(dialect.strftime("%j %w %%", F.lit("2024-02-01"))) == "032 4 %"
    assert one(dialect.timediff(F.lit("2024-03-02 01:00:00"), F.lit("2024-01-31 00:00:00"))) == "+0000-01-00 01:00:00.000"
    assert one(dialect.log(F.lit(1000.0))) == pytest.approx(3) and one(dialect.log(F.lit(-1.0))) is None


def test_json_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    x = F.lit('{"a": [1, 2.50, "x"], "b": {"c": null}, "n": 12345678901234567890}')
    assert one(jsons.set_(x, "$.a[1]", 9)) == '{"a":[1,9,"x"],"b":{"c":null},"n":12345678901234567890}'
    assert one(jsons.insert(x, "$.a[#]", "y")).startswith('{"a":[1,2.50,"x","y"]')
    assert one(jsons.replace(x, "$.zz", 1)) == one(jsons.minified(x))
    assert one(jsons.remove(x, "$.a[#-1]", "$.n")) == '{"a":[1,2.50],"b":{"c":null}}'
    assert one(jsons.patch(x, {"b": None, "a": {"k": 1}})) == '{"a":{"k":1},"n":12345678901234567890}'
    assert [one(jsons.type_of(x, p)) for p in ("$", "$.a", "$.a[0]", "$.a[1]", "$.a[2]", "$.b.c", "$.q")] == ["object", "array", "integer", "real", "text", "null", None]
    assert one(jsons.array_length(x, "$.a")) == 3 and one(jsons.array_length(F.lit("7"))) == 0
    assert one(jsons.error_position(F.lit('{"a" 1}'))) == 6 and one(jsons.error_position(F.lit("[]"))) == 0
    assert one(jsons.valid(F.lit("{"))) is False and one(jsons.quote(F.lit('a"b'))) == '"a\\"b"'
    assert "\n    " in one(jsons.pretty_(x))
    df = spark.createDataFrame([("r", '{"a":[1,{"b":2}]}'), ("s", None)], "id string, j string")
    assert [(r.key, r.value, r.type) for r in jsons.each(df, "j").collect()] == [("a", '[1,{"b":2}]', "array")]
    tree = jsons.tree(df, "j").orderBy("id", "parent", "fullkey").collect()
    assert {r.fullkey for r in tree} == {"$", "$.a", "$.a[0]", "$.a[1]", "$.a[1].b"}
