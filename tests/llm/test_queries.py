import pytest

from broadsheet.llm.queries import ORACLES, QUERIES

from ..oracle import same_rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_like_its_sql(spark, name):
    same_rows(spark, QUERIES[name], ORACLES[name])


def test_one_query_for_each_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
