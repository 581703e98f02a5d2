"""The plans are the ones meant: pushed filters, pruned columns, no needless shuffles or products."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from covenant import queries
from covenant.functions import jsons

QUERIES, _ = queries.load()


def plan(df) -> str:
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def shuffles(text: str) -> int:
    return len(re.findall(r"^\(\d+\) Exchange", text, re.M))


def columns_read(text: str) -> list[set[str]]:
    return [set(re.findall(r"(\w+):", m)) for m in re.findall(r"ReadSchema: struct<(.*?)>\s", text)]


def test_filters_and_columns_reach_the_scan(spark, small):
    text = plan(QUERIES["scan_filter_project"](spark, small))
    assert "GreaterThan(l_quantity,45.0)" in text and "LessThan(l_shipdate" in text and shuffles(text) == 0
    assert columns_read(text) == [{"l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_shipdate"}]
    orders = next(c for c in columns_read(plan(QUERIES["flagship_revenue"](spark, small))) if "o_orderkey" in c)
    assert orders == {"o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"}


@pytest.mark.parametrize("name", ["dml_update_returning", "dml_delete", "val_check", "row_column_rules", "fn_string", "fn_math", "export_exactness"])
def test_row_work_does_not_shuffle(spark, small, name):
    assert shuffles(plan(QUERIES[name](spark, small))) == 0


@pytest.mark.parametrize("name", ["val_decimal_order", "val_fk_dangling", "val_fk_nested_path", "val_primary_key", "diff_states", "merge3", "import_upsert", "sql_exact_compare", "fn_normalize_number", "val_instant_compare"])
def test_built_in_functions_only(spark, small, name):
    assert not re.search("Python|Pandas|Arrow", plan(QUERIES[name](spark, small)))


def test_references_are_one_anti_join_of_narrow_rows(spark, small):
    text = plan(QUERIES["val_fk_dangling"](spark, small))
    assert text.count("LeftAnti") >= 1
    assert {"o_custkey", "o_orderkey"} in columns_read(text) and {"c_custkey", "c_nationkey"} in columns_read(text)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_products(spark, small, name):
    if name in ("join_cross", "subq_scalar", "lint_proposals", "val_cycles"):
        return  # two dimension tables; a one-row side
    if name.startswith(("dml_", "doctor_", "dag_", "sql_", "base_", "infer_", "migrate_")):
        return  # they run jobs of their own; their joins are equi-joins of the operators tested above
    text = plan(QUERIES[name](spark, small))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin Inner" not in text


def test_functions_of_one_projection_share_a_python_worker(spark, small):
    assert len(re.findall(r"^\(\d+\) ArrowEvalPython", plan(QUERIES["fn_json_edit"](spark, small)), re.M)) == 1


def test_a_function_of_a_function_shares_its_worker(spark):
    text = plan(spark.range(1).select(jsons.insert(jsons.remove(F.col("id").cast("string"), "$.a"), "$.b", 1)))
    assert len(re.findall(r"^\(\d+\) ArrowEvalPython", text, re.M)) == 1


def test_recursion_joins_by_a_shuffle(spark, small):
    """Its rounds are planned as they run; a broadcast in each goes through the driver."""
    text = QUERIES["cte_recursive"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join Inner, .*rightHint=\(strategy=merge\)", text)


def test_a_filter_by_instants_makes_each_text_once(spark, small):
    text = QUERIES["val_instant_compare"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("date_format(") == 1 and text.count("format_string(") == 1 and text.count("gettimestamp(") == 1
