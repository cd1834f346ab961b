"""Every query with SQL, against DuckDB on the smallest tables."""

import pytest

from oracle import compare
from tallymill.plans import load

CORE = load()


@pytest.mark.parametrize("name", sorted(CORE.sql))
def test_same_as_sql(spark, small, name):
    compare(spark, small, CORE.queries[name], CORE.sql[name])


def plausible(value, column):
    """Scores that are finite, decisions and labels that are 0 or 1, AUROC and accuracy within their ranges."""
    if value is None:
        return column in ("y", "likeness", "auroc")
    if column in ("y", "pred"):
        return value in (0, 1)
    if "auroc" in column:
        return 0 <= value <= 1
    if "mcc" in column:
        return -1 <= value <= 1
    return not isinstance(value, float) or value == value and abs(value) < 1e6


@pytest.mark.parametrize("name", sorted(set(CORE.queries) - set(CORE.sql)))
def test_without_sql_rows_are_whole_and_the_same_again(spark, small, name):
    """Fits can't be said in SQL: every item is scored once by each method, values are plausible, and a second run gives the same."""
    df = CORE.queries[name](spark, small)
    rows = [r.asDict() for r in df.collect()]
    assert rows and all(plausible(v, k) for r in rows for k, v in r.items())
    if "item_id" in df.columns and "score" in df.columns:
        keys = [(r["item_id"], r.get("method")) for r in rows]
        items, methods = {k for k, _ in keys}, {m for _, m in keys}
        assert len(keys) == len(set(keys)) == len(items) * len(methods)
    again = [r.asDict() for r in CORE.queries[name](spark, small).collect()]
    order = lambda r: str(sorted(r.items(), key=lambda x: x[0]))
    assert sorted(map(order, again)) == sorted(map(order, rows))
