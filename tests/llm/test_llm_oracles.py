import pytest

from oracle import compare
from tallymill.llm import load

LLM = load()


@pytest.mark.parametrize("name", sorted(LLM.sql))
def test_same_as_sql(spark, small, name):
    compare(spark, small, LLM.queries[name], LLM.sql[name])
