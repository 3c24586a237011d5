import pytest

from quiver.plans import catalog
from tests.oracle import check

NAMES = sorted(catalog.queries())


@pytest.mark.parametrize("name", [n for n in NAMES if n in catalog.oracle_sql()])
def test_against_sql(spark, sf_dir, name):
    check(catalog.queries()[name](spark, sf_dir), catalog.oracle_sql()[name], sf_dir)


def test_whole_texts(spark, tmp_path):
    long = "the hen " * 200
    spark.createDataFrame([(1, long)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {n: catalog.queries()[n](spark, str(tmp_path)).first().r for n in ("words_of_line", "count_letter", "str_find_all")}
    assert got == {"words_of_line": 401, "count_letter": 400, "str_find_all": 200}


def test_no_plan_has_one_task_for_all_rows(spark, sf_dir):
    for name in ("where_index", "grade_up", "grade_down", "grade_keys", "global_scan", "global_scan_nulls", "bin_all", "multi_key_sort", "sort_by_table"):
        plan = catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan, name


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
