"""What the physical plans must and must not hold."""

import contextlib
import io

import pytest

import __spark_entry__ as entry

PATH = "/root/testdata/sf0.001"
EAGER = {"s1_csv_scan", "s4_prepared_round_trip", "s5_metrics_sink", "m1_fold_tfidf", "j3_fold_vocabulary"}
LAZY = sorted(set(entry.oracle_sql()) - EAGER)


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_and_no_python(spark, name):
    plan = plan_of(entry.queries()[name](spark, PATH))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas"):
        assert node not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(entry.queries()["f1_rows_of_label"](spark, PATH))
    assert "EqualTo(lang,fr)" in plan
    plan = plan_of(entry.queries()["a6_posts_per_author"](spark, PATH))
    assert "ReadSchema: struct<user_id:bigint>" in plan
    plan = plan_of(entry.queries()["w3_stratified_folds"](spark, PATH))
    assert "text" not in plan.split("ReadSchema: ")[1].splitlines()[0]


def test_ranks_are_cut_before_the_shuffle(spark):
    for name in ("w6_term_ranks", "w1_cap_per_author"):
        assert "WindowGroupLimit" in plan_of(entry.queries()[name](spark, PATH))


@pytest.mark.parametrize("name", LAZY)
def test_no_filter_computes_a_text_function_again(spark, name):
    """Catalyst may move a filter below the projection that made its column, and repeat the work."""
    plan = plan_of(entry.queries()[name](spark, PATH))
    filters = [block for block in plan.split("\n\n") if ") Filter" in block.split("\n")[0]]
    dear = ("regexp_", "md5(", "java_method", "reflect(")
    assert not [block for block in filters if any(f in block for f in dear)]
