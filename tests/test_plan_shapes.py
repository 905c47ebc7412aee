"""What the physical plans must and must not contain."""

import re

import pytest

import __spark_entry__ as driver
from staylens import runtime
from staylens.operators.text import normalize_text
from staylens.plans import catalog

# The models' own fits are Spark ML; what they return is a small local table.
NAMES = [n for n in catalog.QUERIES if n.split("_")[0] not in ("rf", "dt", "gbt")]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_no_python_no_cartesian_no_global_window(name, spark, sf_dir):
    plan = plan_of(driver.queries()[name](spark, sf_dir))
    for bad in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan, bad
    for window in re.findall(r"Window \[.*?\], \[(.*?)\]", plan):
        assert window.strip(), "window without partition columns"


@pytest.mark.parametrize(
    "name,column,filters",
    [
        ("mean_by_group", "l_suppkey:bigint,l_extendedprice:double", None),
        ("filter_equal", "l_orderkey:bigint,l_linenumber:int,l_discount:double,l_tax:double", "EqualTo(l_discount,0.0)"),
        ("filter_non_negative", "c_custkey:bigint", "GreaterThanOrEqual(c_acctbal,0.0)"),
        ("token_counts", "text:string>", None),
    ],
)
def test_scans_are_narrow(name, column, filters, spark, sf_dir):
    plan = plan_of(driver.queries()[name](spark, sf_dir))
    assert f"ReadSchema: struct<{column}" in plan
    if filters:
        assert filters in plan


def test_grouped_mean_combines_before_its_shuffle(spark, sf_dir):
    plan = plan_of(driver.queries()["mean_by_group"](spark, sf_dir))
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_avg" in plan


def test_row_operators_do_not_shuffle(spark, sf_dir):
    for name in ("hash_split", "rating_bands", "coerce_numeric", "percent_to_ratio"):
        assert "Exchange" not in plan_of(driver.queries()[name](spark, sf_dir)), name
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert "Exchange" not in plan_of(normalize_text(docs, "text"))


def test_lemmas_shuffle_texts_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    table = spark.createDataFrame([("les", "le")], "token string, lemma string")
    plan = plan_of(normalize_text(docs, "text", lemmas=table, key="doc_id"))
    assert plan.count("Exchange hashpartitioning(_key") == 1


def test_checkpoints_go_where_the_session_says(spark, tmp_path):
    runtime.materialize(spark.range(3))
    assert spark.sparkContext.getCheckpointDir() is not None


def test_measured_size(spark):
    df = spark.createDataFrame([("abc",), (None,)], "v string")
    sized = runtime.measure(df)
    assert sized.rows == 2 and sized.fits
    assert not runtime.measure(df, limit=10).fits
    with pytest.raises(ValueError):
        runtime.join_sized(df, sized, ["v"], "full", ["v"])
