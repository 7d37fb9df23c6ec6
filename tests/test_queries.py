import __spark_entry__ as entry
import pytest

from broadsheet.plans import catalogue

from .oracle import ROOT, same_rows


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_like_its_sql(spark, name):
    same_rows(spark, catalogue.QUERIES[name], catalogue.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, ROOT).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "feature", "value"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_push_down_and_prune(spark):
    plan = lambda name: catalogue.QUERIES[name](spark, ROOT)._jdf.queryExecution().executedPlan().toString()
    p = plan("exact_split")
    assert "text" not in p.split("ReadSchema")[1]
    p = plan("page_filter_project")
    assert "StringContains(url,/en/)" in p
    for name in ("tokens", "feature_counts", "pooled_moments", "vocab_index"):
        assert "Python" not in plan(name) and "Cartesian" not in plan(name)
